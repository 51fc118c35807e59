"""Operator 7: exact token-length histogram, and what it answers for every context limit.

Each document's encoded length is counted once; equal lengths are summed in Spark (with a partial sum in each task), so
the histogram has one row per distinct length and the documents themselves never move. Prefix and suffix sums over it
give, for each limit L that occurs as a length: how many documents fit, how many are cut, tokens in all, tokens kept
when every document is truncated to L, tokens lost, and the share of documents no longer than L (the quantile rank).

The sums run in two levels, inside blocks of lengths and over the blocks' totals, so that no window holds the whole
histogram. Defined cases: null and empty texts have length 0 and are counted; repeated rows count each time; an empty
table gives no rows; very long texts and runs of white space are encoded whole. Only the text column is read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces
from .tokens import encoder

BLOCK = 4096


def token_lengths(df: DataFrame, json_path: str, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """n_tokens of each row, without any end id; a task sums equal lengths before it hands them on (n_docs)."""

    def run(batches: Iterator) -> Iterator:
        from collections import Counter

        import pyarrow as pa

        enc, seen = encoder(json_path, ranks_path, pattern), Counter()
        for b in pieces(batches):
            seen.update(len(enc.encode(t)) if t else 0 for t in b.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["n_tokens", "n_docs"])

    return df.select(text_col).mapInArrow(run, "n_tokens long, n_docs long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def context_table(hist: DataFrame) -> DataFrame:
    """From (n_tokens, n_docs): a row for each context limit with the answers named above. `hist` is read twice: write it first, or its texts are encoded twice."""
    h = hist.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    inside = Window.partitionBy("block").orderBy("n_tokens")
    h = h.withColumns({"d": F.sum("n_docs").over(inside), "t": F.sum("tokens").over(inside)})
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    # One row per BLOCK of lengths: a few rows even for texts of millions of tokens.
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("bd").over(before), F.lit(0)).alias("d0"),
        F.coalesce(F.sum("bt").over(before), F.lit(0)).alias("t0"),
        F.sum("bd").over(everything).alias("all_docs"),
        F.sum("bt").over(everything).alias("all_tokens"),
    )
    j = h.join(blocks, "block").withColumns({"d": F.col("d") + F.col("d0"), "t": F.col("t") + F.col("t0")})
    truncated = F.col("t") + F.col("n_tokens") * (F.col("all_docs") - F.col("d"))
    return j.select(
        F.col("n_tokens").alias("context_limit"),
        "n_docs",
        F.col("d").alias("docs_fitting"),
        (F.col("all_docs") - F.col("d")).alias("docs_cut"),
        F.col("t").alias("tokens_of_fitting"),
        (F.col("all_tokens") - F.col("t") + F.col("tokens")).alias("tokens_of_this_or_longer"),
        truncated.alias("tokens_truncated"),
        (F.col("all_tokens") - truncated).alias("tokens_lost"),
        F.col("all_docs").alias("total_docs"),
        F.col("all_tokens").alias("total_tokens"),
        (F.col("d") / F.col("all_docs")).alias("quantile_rank"),
    )


def answers_at(hist: DataFrame, limits: DataFrame) -> DataFrame:
    """The context table's rows for all of limits(context_limit), whether a document has that length or not (then n_docs is 0).

    Limits join the histogram as lengths of no document, so each is answered from what lies below it. Null limits are left out; an empty
    histogram gives no rows.
    """
    some = F.broadcast(hist.limit(1).select(F.lit(0).cast("long").alias("n_docs")))
    wanted = limits.where("context_limit is not null").select(F.col("context_limit").cast("long").alias("n_tokens")).distinct()
    both = hist.select("n_tokens", "n_docs").unionByName(wanted.crossJoin(some)).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))
    return context_table(both).join(wanted.withColumnRenamed("n_tokens", "context_limit"), "context_limit", "left_semi")


def quantile(table: DataFrame, q: float) -> DataFrame:
    """The least length whose rank reaches q, from a context table (a length, not an interpolation)."""
    return table.where(F.col("quantile_rank") >= q).agg(F.min("context_limit").alias("n_tokens"))
