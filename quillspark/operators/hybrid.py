"""Hybrid search over two stored indexes, read to the depth that the fused ranks ask for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .retrieval import RRF, fuse, rank_top
from .text_index import TextIndex, search_text_index
from .vector_index import VectorIndex, search_vector_index


def settled(legs: list[DataFrame], queries: DataFrame, top: int, depth: int, query: str, doc: str) -> DataFrame:
    """Queries whose first `top` fused hits can't change by what stands below `depth` in any leg.

    A document that a leg hasn't shown can still get less than that leg's next rank, or nothing if the leg has ended. Settled are queries whose `top` best known sums are complete and above all
    that others can still reach.
    """
    one = lambda leg, i: leg.select(query, doc, "rank", F.lit(i).alias("leg"))
    hits = one(legs[0], 0)
    for i, leg in enumerate(legs[1:], 1):
        hits = hits.unionByName(one(leg, i))
    more = F.lit(1.0) / (RRF + depth + 1)
    shown = hits.groupBy(query).agg(*[F.when(F.count_if(F.col("leg") == i) >= depth, more).otherwise(0.0).alias(f"more_{i}") for i in range(len(legs))])
    sums = hits.groupBy(query, doc).agg(F.sum(F.lit(1.0) / (F.lit(RRF) + F.col("rank"))).alias("score"), F.collect_set("leg").alias("legs")).join(shown, query)
    open_legs = sum((F.when(F.array_contains("legs", i), 0.0).otherwise(F.col(f"more_{i}")) for i in range(len(legs))), F.lit(0.0))
    sums = sums.withColumn("most", F.col("score") + open_legs)
    best = rank_top(sums, top, query, "score", doc)
    kth = best.groupBy(query).agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n"), F.bool_and(F.col("most") == F.col("score")).alias("whole"))
    rest = sums.join(best.select(query, doc), [query, doc], "left_anti").groupBy(query).agg(F.max("most").alias("rest"))
    unseen = shown.select(query, sum((F.col(f"more_{i}") for i in range(len(legs))), F.lit(0.0)).alias("unseen"))
    ok = kth.join(unseen, query).join(rest, query, "left")
    # Scores are rounded to 8 places, so a tie needs more than that much room.
    room = F.col("kth") - 2e-8
    ended = F.col("unseen") == 0
    ok = ok.where(F.col("whole") & (ended | ((F.col("n") == top) & (F.col("unseen") < room))) & (F.col("rest").isNull() | (F.col("rest") < room) | ended))
    without = queries.select(query).join(shown.select(query), query, "left_anti")
    return ok.select(query).unionByName(without)


def search_hybrid_index(
    queries: DataFrame, text: TextIndex, vectors: VectorIndex, top: int = 10, leg_top: int = 50, first: int = 20, mode: str = "any", query: str = "query_id", q_text: str = "q_text", q_vec: str = "q_vec", doc: str = "doc_id"
) -> DataFrame:
    """(query, doc, score, rank): reciprocal rank fusion of the first `leg_top` hits of both indexes, as `search_hybrid` gives it.

    Both legs are read `first` hits deep, then twice as deep for the queries that aren't settled, and so on to `leg_top`. No text is cut into terms and no vector outside the probed lists is read.
    """
    return _union([out for _, out in rounds(queries, text, vectors, top, leg_top, first, mode, query, q_text, q_vec, doc)])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rounds(queries: DataFrame, text: TextIndex, vectors: VectorIndex, top: int, leg_top: int, first: int, mode: str, query: str, q_text: str, q_vec: str, doc: str) -> list[tuple[int, DataFrame]]:
    """(depth, fused hits) of each round, for the queries that it settles."""
    out, depth, left = [], min(first, leg_top), queries
    while True:
        legs = [
            materialise(search_text_index(left, text, depth, mode, query, q_text, doc), "text-leg"),
            materialise(search_vector_index(left.where(F.col(q_vec).isNotNull()), vectors, depth, exact=True, query=query, q_vec=q_vec, doc=doc), "vector-leg"),
        ]
        fused = fuse(legs, top, query, doc)
        if depth == leg_top:
            return [*out, (depth, fused)]
        done = materialise(settled(legs, left, top, depth, query, doc), "settled")
        out.append((depth, fused.join(done, query, "left_semi")))
        left = materialise(left.join(done, query, "left_anti"), "unsettled")
        if left.isEmpty():
            return out
        depth = min(2 * depth, leg_top)
