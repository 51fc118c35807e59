"""A coarse-quantised vector index: trained centroids, inverted lists, probes chosen by measured recall, and an exact search that prunes lists by bounds.

Directions only count (cosine). Centroids are trained on a bounded sample; every row of the corpus is put into the list of its nearest centroid. A search ranks the lists for each query and reads the
nearest ones. How many (`probes`) is measured when the index is written: sampled rows are searched exactly and the number of lists that hold the wanted share of their neighbours is stored with the index.
With `exact`, the lists' angles bound what they can hold: after the nearest lists, all others whose bound reaches the query's k-th score are read too, so hits equal those of a full search.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from .nearest import Vectors, nearest
from .retrieval import norm, rank_top, search_vector


@dataclass
class VectorIndex:
    """Where an index lies, and what was measured: `probes` lists hold `recall` of the sampled rows' neighbours and `share` of the corpus."""

    path: str
    probes: int
    recall: float
    share: float


def unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def train_centroids(sample: np.ndarray, lists: int, rounds: int = 15, seed: int = 5) -> np.ndarray:
    """Spherical k-means. Starts are drawn far from each other; an empty centroid moves to the row that fits its own least."""
    x = unit(sample[np.linalg.norm(sample, axis=1) > 0])
    if not len(x):
        return np.zeros((1, sample.shape[1] if sample.ndim == 2 else 1))
    rng = np.random.default_rng(seed)
    lists = min(lists, len(x))
    chosen = [int(rng.integers(len(x)))]
    far = 1 - x @ x[chosen[0]]
    for _ in range(1, lists):
        weight = np.maximum(far, 0) ** 2
        chosen.append(int(rng.choice(len(x), p=weight / weight.sum())) if weight.sum() > 0 else int(rng.integers(len(x))))
        far = np.minimum(far, 1 - x @ x[chosen[-1]])
    c = x[chosen]
    for _ in range(rounds):
        sims = x @ c.T
        best = sims.argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, best, x)
        empty = np.flatnonzero(np.bincount(best, minlength=lists) == 0)
        if len(empty):
            sums[empty] = x[np.argsort(sims.max(axis=1))[: len(empty)]]
        c = unit(sums)
    return c


def _with_lists(df: DataFrame, vec: str, centroids: np.ndarray, keep: list[str]) -> DataFrame:
    """Add `list` and `fit`, the cosine to its centroid. Rows without a vector, or with a zero one, are in list 0."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            v = Vectors(b.column(b.schema.get_field_index(vec))).widened(centroids.shape[1])
            rows = np.where((v.size == centroids.shape[1])[:, None], v.rows[:, : centroids.shape[1]], 0.0)
            sims = unit(rows) @ centroids.T
            best = sims.argmax(axis=1)
            best[~rows.any(axis=1)] = 0
            fit = np.clip(np.nan_to_num(sims[np.arange(len(rows)), best], nan=-1.0), -1, 1) if len(rows) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), pa.array(best.astype(np.int32)), pa.array(fit)], names=[*keep, "list", "fit"])

    return df.select(*keep).mapInArrow(run, f"{kinds}, list int, fit double")


def _bounded_rows(df: DataFrame, key: str, columns: list[str], n: int) -> DataFrame:
    """At most n rows, those with the least hash of their key."""
    return df.select(*columns).orderBy(F.xxhash64(key), key).limit(n)


def write_vector_index(
    corpus: DataFrame, path: str, lists: int | None = None, sample_rows: int = 20_000, target: float = 0.95, top: int = 10, sample_queries: int = 100, parts: int = 8, doc: str = "doc_id", vec: str = "vec"
) -> VectorIndex:
    """Write an index of all rows of `corpus`.

    Centroids come from at most `sample_rows` rows in the driver's memory; `lists` is the square root of the corpus by default, at most 4096 and a tenth of the sample. `sample_queries`
    rows are searched exactly (each row of the corpus is scored against each of them once) to choose the probes that hold `target` of their `top` neighbours, themselves left out.
    Rows of a list are dealt to `parts` files by their document, so a list may hold any share of the rows.
    """
    spark = corpus.sparkSession
    corpus = corpus.select(doc, vec)
    n = corpus.count()
    sample = [r[vec] for r in _bounded_rows(corpus.where(F.col(vec).isNotNull()), doc, [doc, vec], sample_rows).collect()]
    lists = lists or max(1, min(4096, len(sample) // 10, round(math.sqrt(n))))
    centroids = train_centroids(np.array(sample, float).reshape(len(sample), -1), lists)
    rows = _with_lists(corpus, vec, centroids, [doc, vec]).withColumn("nv", norm(F.col(vec)))
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(doc), F.lit(parts)))
    dealt.repartition("list", "_part").drop("_part").sortWithinPartitions("list").write.mode("overwrite").parquet(f"{path}/lists")
    stored = spark.read.parquet(f"{path}/lists")
    about = stored.groupBy(F.col("list").cast("int").alias("list")).agg(F.count(F.lit(1)).alias("n"), F.min("fit").alias("fit"))
    about = {r["list"]: (r["n"], r["fit"]) for r in about.collect()}  # one row per list: 4096 at most
    probes, recall, share = _measure(stored, centroids, about, target, top, sample_queries, doc, vec)
    meta = [(i, c.tolist(), *about.get(i, (0, 1.0)), probes, recall, share) for i, c in enumerate(centroids)]
    spark.createDataFrame(meta, "list int, centroid array<double>, n long, fit double, probes int, recall double, share double").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    return VectorIndex(path, probes, recall, share)


def _measure(stored: DataFrame, centroids: np.ndarray, about: dict, target: float, top: int, sample_queries: int, doc: str, vec: str) -> tuple[int, float, float]:
    asked = _bounded_rows(stored.where("nv > 0"), doc, [doc, vec], sample_queries)
    near = search_vector(asked.withColumnsRenamed({doc: "_asked", vec: "_vec"}), stored, top + 1, "_asked", "_vec", doc, vec).where(F.col("_asked") != F.col(doc))
    hits = near.join(stored.select(doc, "list"), doc).select("_asked", "list").collect()  # sample_queries x top rows at most
    own = {r[doc]: np.array(r[vec]) for r in asked.collect()}
    sizes = np.array([about.get(i, (0, 1.0))[0] for i in range(len(centroids))], float)
    if not hits:
        return len(centroids), 1.0, 1.0
    order = {k: np.argsort(-(centroids @ v), kind="stable") for k, v in own.items()}
    place = {k: np.argsort(o) for k, o in order.items()}
    ranks = np.array([place[r["_asked"]][r["list"]] for r in hits])
    recall = np.cumsum(np.bincount(ranks, minlength=len(centroids))) / len(ranks)
    probes = int(np.argmax(recall >= target)) + 1
    share = float(np.mean([sizes[o[:probes]].sum() for o in order.values()]) / max(sizes.sum(), 1))
    return probes, float(recall[probes - 1]), share


def open_vector_index(spark: SparkSession, path: str) -> VectorIndex:
    r = spark.read.parquet(f"{path}/centroids").select("probes", "recall", "share").first()
    return VectorIndex(path, r["probes"], r["recall"], r["share"])


def _asked(about: list, probes: int, further: str | None) -> Callable:
    """Which lists a block of queries asks, as a matrix (queries x lists): the `probes` nearest, or else, with the name of the column that has the k-th score so far, all others that may hold a hit.

    A list's `fit` bounds the cosine that its rows can have with a query; rows without a direction, in list 0, score 0.
    """
    centroids = np.array([r["centroid"] for r in about], float)
    angle = np.arccos(np.clip([r["fit"] for r in about], -1, 1))
    filled = np.array([r["n"] > 0 for r in about])

    def run(t: pa.Table, v: Vectors) -> np.ndarray:
        rows = v.widened(centroids.shape[1]).rows[:, : centroids.shape[1]]
        u = unit(rows)
        sims = u @ centroids.T
        order = np.argsort(np.where(filled, -sims, np.inf), axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(len(about))[None, :], axis=1)
        # A query without a direction is as near to every list.
        whole = rows.any(axis=1)
        place[~whole] = 0
        if further is None:
            return filled & (place < probes)
        bound = np.where(whole[:, None] & np.isfinite(sims), np.cos(np.maximum(np.arccos(np.clip(sims, -1, 1)) - angle, 0)), 1.0)
        bound[:, 0] = np.maximum(bound[:, 0], 0.0)
        least = t[further].fill_null(-2.0).to_numpy()
        # Scores are rounded to 6 places, so bounds get that much room.
        return filled & (place >= probes) & (bound >= least[:, None] - 2e-6)

    return run


def search_vector_index(
    queries: DataFrame, index: VectorIndex, top: int, probes: int | None = None, exact: bool = False, query: str = "query_id", q_vec: str = "q_vec", doc: str = "doc_id", vec: str = "vec"
) -> DataFrame:
    """(query, doc, score, rank) from an index of `write_vector_index`. Queries without a vector have no hits."""
    spark = queries.sparkSession
    probes = probes or index.probes
    about = spark.read.parquet(f"{index.path}/centroids").orderBy("list").collect()
    stored = spark.read.parquet(f"{index.path}/lists")
    q = queries.where(F.col(q_vec).isNotNull()).select(query, q_vec)
    first = rank_top(nearest(q, stored, top, query, q_vec, doc, vec, _asked(about, probes, None)), top, query, "score", doc)
    if not exact:
        return first
    first = materialise(first, "first-hits")
    # The k-th score so far; with fewer hits every list may add one.
    least = first.where(F.col("rank") == top).select(query, F.col("score").alias("_least"))
    second = nearest(q.join(least, query, "left"), stored, top, query, q_vec, doc, vec, _asked(about, probes, "_least"), ("_least",))
    return rank_top(first.drop("rank").unionByName(second), top, query, "score", doc)
