"""A training-corpus pipeline of five operators; each stage reads what the one before it kept. An empty table gives no rows in any stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import exact_dedup, near_dedup, packing, quality_cnn, suffix_dedup
from quillspark.llm.common import materialise, table
from quillspark.llm.queries import _byte_bpe, held_out

#: Bytes of a batch of rows on its way to Python. Spark's own limit is 64 MB, and each task holds such a batch several times outside the heap.
BATCH_BYTES, BATCH_KEY = "4m", "spark.sql.execution.arrow.maxBytesPerBatch"


def short_batches(spark: SparkSession) -> None:
    """Sets the session's batches to BATCH_BYTES, unless the session has a limit of its own. All rows still go, in more batches."""
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the byte-level network scores 0.7 or more. It learns from the labelled rows of the documents table that aren't held out. Null and empty texts are scored as empty ones."""
    short_batches(spark)
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    return quality_cnn.keep_good(docs, quality_cnn.fit(table(spark, sf_dir, "documents"), labels))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts: the longest, then the one with the smallest doc_id. Null counts as empty."""
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by similarities of 0.8 or more on five-word shingles, the one with the smallest doc_id. Texts without words, null ones included, are linked with nothing and stay."""
    short_batches(spark)
    return near_dedup.drop_near_copies(docs, k=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out every byte covered by a 200-byte string that occurs elsewhere too; n_chars follows the text. Null stays null, and a text that is wholly repeated becomes empty; its row stays."""
    short_batches(spark)
    out = suffix_dedup.drop_repeated_passages(docs, length=200)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 2048 tokens. Null and empty texts are their end id alone."""
    short_batches(spark)
    return packing.pack_documents(docs, **_byte_bpe())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_copies),
    ("minhash_near_dedup", near_copies),
    ("suffix_array_dedup", repeated_passages),
    ("packing", packed),
]

#: Not expressible in SQL: a trained network, sketches and a tokenizer. Tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
