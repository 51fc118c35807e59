"""Token windows over texts, their ids, and user-supplied encoders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import joined, words


def chunk_tokens(df: DataFrame, text: str, size: int = 512, overlap: int = 128, tokens: str | None = None) -> DataFrame:
    """A row per window of `size` tokens, each starting size - overlap after the last: adds chunk_no, n_tokens, content.

    Tokens are runs between white space, or the array column `tokens` where a caller has real ones. A text of n > 0 tokens has
    1 + max(0, ceil((n - size) / (size - overlap))) windows; an empty or null one has none.
    """
    step = size - overlap
    t = df.withColumn("_t", F.col(tokens) if tokens else words(F.col(text)))
    n = F.size("_t")
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")
    starts = F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: i * step + 1))
    out = t.select("*", F.posexplode(starts).alias("chunk_no", "_s"))
    window = F.slice("_t", F.col("_s"), F.lit(size))
    return out.withColumns({"n_tokens": F.size(window), "content": F.array_join(window, " ")}).drop("_t", "_s")


def chunk_ids(df: DataFrame, doc: str, mode: str = "position") -> DataFrame:
    """Add chunk_id = doc_chunk. With mode "first_index", equal chunks of a document share the first one's number."""
    if mode == "position":
        return df.withColumn("chunk_id", joined(doc, "chunk_no", sep="_"))
    first = F.min("chunk_no").over(Window.partitionBy(doc, "content"))
    return df.withColumn("chunk_id", joined(F.col(doc), first, sep="_"))


def encode_batches(df: DataFrame, key: str, text: str, fn: Callable[[list[str]], list[list[float]]], batch: int = 100) -> DataFrame:
    """(key, embedding) by a user's function over batches of at most `batch` texts."""

    def run(parts: Iterator) -> Iterator:
        import pandas as pd

        for pdf in parts:
            for i in range(0, len(pdf), batch):
                piece = pdf.iloc[i : i + batch]
                yield pd.DataFrame({key: piece[key].to_numpy(), "embedding": fn(piece[text].tolist())})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<float>")
