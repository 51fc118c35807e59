"""JSON sources and the chunk, keyed and batched sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REF = "STRUCT<type:STRING, cap:STRING, section:STRING, subsection:STRING>"
#: The array of page references; files that call it otherwise are read with `pages_schema`.
PAGE_REF = "page_ref"
PAGES = (
    "nid INT, type STRING, is_complete BOOLEAN, title STRING, path STRING, url STRING, topic_value STRING, content STRING, is_noisy BOOLEAN, "
    "topic_key STRING, is_question BOOLEAN, context STRING, parsed_content STRING, cases_ref ARRAY<STRUCT<court:STRING, year:STRING, no:STRING>>, "
    "legislation_ref ARRAY<STRUCT<type:STRING, no:STRING, section:STRING>>, page_ref ARRAY<STRUCT<nid:INT, path:STRING>>, n_tokens INT"
)
CAPS = (
    "cap_no STRING, cap_type STRING, identifier STRING, language STRING, total_token_count INT, title STRING, long_title STRING, url STRING, eleg_url STRING, "
    "interpretations ARRAY<STRUCT<term:STRING, text:STRING, ref_tags:ARRAY<STRING>>>, "
    "sections ARRAY<STRUCT<no:STRING, name:STRING, heading:STRING, text:STRING, "
    f"subsections:ARRAY<STRUCT<name:STRING, text:STRING, token_count:INT, ref_tags:ARRAY<STRING>, references:ARRAY<{REF}>>>, "
    f"token_count:INT, url:STRING, eleg_url:STRING, interp_terms:ARRAY<STRING>, ref_tags:ARRAY<STRING>, references:ARRAY<{REF}>>>, "
    "schedules ARRAY<STRUCT<name:STRING, heading:STRING, text:STRING, url:STRING, eleg_url:STRING, token_count:INT, "
    "sections:ARRAY<STRUCT<name:STRING, heading:STRING, text:STRING, subsections:ARRAY<STRING>, token_count:INT, url:STRING, eleg_url:STRING, "
    f"interp_terms:ARRAY<STRING>, ref_tags:ARRAY<STRING>, references:ARRAY<{REF}>>>>>"
)
SUMMARIES = "citation STRING, summary STRING"


def pages_schema(page_ref: str = PAGE_REF) -> str:
    """The page schema with the name that a file gives its page references."""
    return PAGES.replace(f"{PAGE_REF} ARRAY", f"{page_ref} ARRAY")


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One file holding a JSON array of rows."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_json_dir(spark: SparkSession, directory: str, schema: str) -> DataFrame:
    """Every *.json of a folder, one object each; an unreadable file gives one row with only `_corrupt_record`."""
    return (
        spark.read.schema(f"{schema}, _corrupt_record STRING")
        .option("multiLine", True)
        .option("pathGlobFilter", "*.json")
        .option("mode", "PERMISSIVE")
        .json(directory)
    )


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record per line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_json_rows_of_arrays(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of string arrays: (row_no, items)."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<array<string>>").alias("rows"))
    return whole.select(F.posexplode("rows").alias("row_no", "items"))


def scan(df: DataFrame, where=None, select: list[str] | None = None) -> DataFrame:
    """Filtered and column-pruned scan; both reach a Parquet or JDBC source."""
    out = df if where is None else df.where(where)
    return out if select is None else out.select(*select)


def write_chunks(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("overwrite").format(fmt).save(path)


def read_chunks(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def clear(spark: SparkSession, path: str, schema: T.StructType, link_paths: dict[str, T.StructType] | None = None) -> None:
    """Empty a table; its link tables first."""
    for p, s in [*(link_paths or {}).items(), (path, schema)]:
        spark.createDataFrame([], s).write.mode("overwrite").parquet(p)


def jdbc_scan(spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, partitions: int, **options: str) -> DataFrame:
    """A table of a relational store, read in parallel ranges of a numeric column."""
    return spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=partitions, **options
    ).load()


def jdbc_append(df: DataFrame, url: str, table: str, batch: int = 1000, **options: str) -> None:
    df.write.format("jdbc").mode("append").options(url=url, dbtable=table, batchsize=batch, **options).save()
