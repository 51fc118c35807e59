"""A stored text index in segments: impact-ordered postings in blocks with their maxima, deletion sets, and totals kept by differences.

An index is a log (`manifest`) of segments. The first holds a whole corpus; each upsert or deletion adds one with the batch's own postings, the documents it replaces in earlier segments (`deletes`), and
signed differences of document frequencies and totals, so idf and average length are those of a new index without reading old postings. `compact` merges what is live into one new first segment.
A segment that isn't in the log isn't seen: a load that dies leaves the index as it was.

A term's postings are sorted by falling impact over ranges (a stop word spans many) and cut in blocks; a block's row also tells its greatest tf and least length, which bound what a document in it can
score whatever the average length is by then. `search_text_index` reads these few columns first and the postings of the blocks it needs later; no text is read or cut into terms, except the queries.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import terms
from ..session import materialise
from .retrieval import K1, B, asked_terms, rank_top

#: Postings in a block: 2^7.
BLOCK_BITS = 7
#: Scores are rounded to 4 places; bounds get that much room.
SLACK = 2e-4
MANIFEST = "seq long, kind string, folder string, n_docs long, n_terms long"


@dataclass
class TextIndex:
    path: str
    doc_type: str
    buckets: int = 16


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def _impact(tf: Column, length: Column, avg: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(avg)))


def _log(spark: SparkSession, index: TextIndex) -> list:
    """Rows of the log since the last whole segment; one for each load."""
    rows = sorted(spark.read.schema(MANIFEST).parquet(f"{index.path}/manifest").collect(), key=lambda r: r["seq"])
    first = max(i for i, r in enumerate(rows) if r["kind"] == "whole")
    return rows[first:]


def _read(spark: SparkSession, log: list, part: str, schema: str) -> DataFrame:
    out = None
    for r in log:
        d = spark.read.schema(schema).parquet(f"{r['folder']}/{part}").withColumn("seq", F.lit(r["seq"]).cast("long"))
        out = d if out is None else out.unionByName(d)
    return out


def _tokens(spark: SparkSession, index: TextIndex, log: list) -> DataFrame:
    return _read(spark, log, "tokens", f"doc {index.doc_type}, len long, terms array<string>")


def _deletes(spark: SparkSession, index: TextIndex, log: list) -> DataFrame:
    """(doc, old): versions of documents that later segments replaced or deleted."""
    return _read(spark, log, "deletes", f"doc {index.doc_type}, old long").drop("seq")


def _live(rows: DataFrame, spark: SparkSession, index: TextIndex, log: list) -> DataFrame:
    """Rows (doc, seq) of versions that no later segment has deleted."""
    if len(log) == 1:
        return rows
    return rows.join(_deletes(spark, index, log).withColumnRenamed("old", "seq"), ["doc", "seq"], "left_anti")


def _counted(tokens: DataFrame, doc_type: str) -> DataFrame:
    """(term, doc, tf, len): a document's terms are counted where its row is, as a document is one row."""

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            lists = b.column(b.schema.get_field_index("terms"))
            at = pc.list_parent_indices(lists)
            t = pa.table({"at": at, "term": pc.list_flatten(lists)}).group_by(["at", "term"]).aggregate([([], "count_all")])
            own = t["at"].combine_chunks()
            columns = [t["term"].combine_chunks(), b.column(b.schema.get_field_index("doc")).take(own), t["count_all"].combine_chunks(), b.column(b.schema.get_field_index("len")).take(own)]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "doc", "tf", "len"])

    return tokens.select("doc", "len", "terms").mapInArrow(run, f"term string, doc {doc_type}, tf long, len long")


def _cut(placed: DataFrame, doc_type: str) -> DataFrame:
    """Rows of one term and block, which follow each other, as one row."""

    def blocks(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        first = np.concatenate([[0], _changes(t), [len(t)]])
        heads = pa.array(first[:-1])
        tf, size = t["tf"].to_numpy(), t["len"].to_numpy()
        rows = pa.StructArray.from_arrays([t[c].combine_chunks() for c in ("doc", "tf", "len")], names=["doc", "tf", "len"])
        columns = [t["bucket"].combine_chunks().take(heads), t["term"].combine_chunks().take(heads), t["block"].combine_chunks().take(heads), pa.array(np.diff(first))]
        columns += [pa.array(np.maximum.reduceat(tf, first[:-1])), pa.array(np.minimum.reduceat(size, first[:-1])), pa.ListArray.from_arrays(pa.array(first, pa.int32()), rows)]
        return pa.RecordBatch.from_arrays(columns, names=["bucket", "term", "block", "n", "max_tf", "min_len", "postings"])

    def run(batches: Iterator) -> Iterator:
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = (t if rest is None else pa.concat_tables([rest, t])).combine_chunks()
            ends = _changes(t)
            rest = t
            if len(ends):
                yield blocks(t.slice(0, ends[-1]))
                rest = t.slice(ends[-1])
        if rest is not None and rest.num_rows:
            yield blocks(rest)

    return placed.select("bucket", "term", "block", "doc", "tf", "len").mapInArrow(
        run, f"bucket int, term string, block long, n long, max_tf long, min_len long, postings array<struct<doc:{doc_type},tf:long,len:long>>"
    )


def _changes(t: pa.Table) -> np.ndarray:
    """Where another term or block begins."""
    block, term = t["block"].to_numpy(), t["term"].combine_chunks()
    return np.flatnonzero((block[1:] != block[:-1]) | pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)) + 1


def _write_blocks(tokens: DataFrame, folder: str, buckets: int, avg: float) -> None:
    """Postings are shuffled once, into ranges by bucket, term and impact; counting before and cutting in blocks after need no other shuffle. A stop word's postings go to as many ranges as they fill, so it isn't one task."""
    doc_type = tokens.schema["doc"].dataType.simpleString()
    flat = _counted(tokens, doc_type).withColumn("bucket", _bucket(buckets))
    order = ["bucket", "term", _impact(F.col("tf"), F.col("len"), avg).desc(), "doc"]
    placed = flat.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS))
    _cut(placed, doc_type).write.partitionBy("bucket").parquet(f"{folder}/blocks")


def _add_segment(spark: SparkSession, index: TextIndex, seq: int, kind: str, docs: DataFrame | None, tokens: DataFrame | None, removed: DataFrame | None, log: list) -> None:
    """Write a segment of docs(doc, text) or of tokens, whose documents (and those of `removed`) replace earlier ones; the log's row comes last."""
    folder = f"{index.path}/segment-{seq}-{uuid.uuid4().hex}"
    if tokens is None:
        tokens = docs.select("doc", F.coalesce(terms(F.col("text")), F.array().cast("array<string>")).alias("terms"))
        tokens = tokens.select("doc", F.size("terms").cast("long").alias("len"), "terms")
    tokens.select("doc", "len", "terms").write.parquet(f"{folder}/tokens")
    tokens = spark.read.schema(f"doc {index.doc_type}, len long, terms array<string>").parquet(f"{folder}/tokens")
    own = tokens.select("doc")
    gone = own if removed is None else own.unionByName(removed.select("doc")).distinct()
    none = spark.createDataFrame([], f"doc {index.doc_type}, seq long, len long, terms array<string>")
    old = none if kind == "whole" else _live(_tokens(spark, index, log), spark, index, log).join(gone, "doc", "left_semi")
    old.select("doc", F.col("seq").alias("old")).write.parquet(f"{folder}/deletes")
    # What is taken away is read as the deletions that were just written, so both are the same rows.
    if kind != "whole":
        taken = spark.read.schema(f"doc {index.doc_type}, old long").parquet(f"{folder}/deletes").withColumnRenamed("old", "seq")
        old = _tokens(spark, index, log).join(taken, ["doc", "seq"], "left_semi")
    signed = tokens.select("len", "terms", F.lit(1).alias("sign")).unionByName(old.select("len", "terms", F.lit(-1).alias("sign")))
    df = signed.select("sign", F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.sum("sign").alias("df")).where("df != 0")
    df.withColumn("bucket", _bucket(index.buckets)).repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{folder}/df")
    t = signed.where("len > 0").agg(F.coalesce(F.sum("sign"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("sign") * F.col("len")), F.lit(0)).alias("t")).first()
    n_docs, n_terms = t["n"] + sum(r["n_docs"] for r in log), t["t"] + sum(r["n_terms"] for r in log)
    _write_blocks(tokens, folder, index.buckets, n_terms / n_docs if n_docs else 1.0)
    row = spark.createDataFrame([(seq, kind, folder, int(t["n"]), int(t["t"]))], MANIFEST)
    row.coalesce(1).write.mode("append").parquet(f"{index.path}/manifest")


def _named(docs: DataFrame, doc: str, text: str) -> DataFrame:
    return docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))


def create_text_index(docs: DataFrame, path: str, buckets: int = 16, doc: str = "doc_id", text: str = "text") -> TextIndex:
    """A new index of docs(doc, text), whose ids are unique. A null text has no terms."""
    index = TextIndex(path, docs.schema[doc].dataType.simpleString(), buckets)
    _add_segment(docs.sparkSession, index, 0, "whole", _named(docs, doc, text), None, None, [])
    return index


def upsert_documents(index: TextIndex, docs: DataFrame, doc: str = "doc_id", text: str = "text") -> None:
    """Add documents, or replace those with the same id. An id that the batch gives more than once must be made single before."""
    log = _log(docs.sparkSession, index)
    _add_segment(docs.sparkSession, index, log[-1]["seq"] + 1, "delta", _named(docs, doc, text), None, None, log)


def delete_documents(index: TextIndex, ids: DataFrame, doc: str = "doc_id") -> None:
    """Delete documents by id; unknown ids change nothing."""
    spark = ids.sparkSession
    log = _log(spark, index)
    none = spark.createDataFrame([], f"doc {index.doc_type}, text string")
    _add_segment(spark, index, log[-1]["seq"] + 1, "delta", none, None, ids.select(F.col(doc).alias("doc")), log)


def compact(spark: SparkSession, index: TextIndex) -> None:
    """Merge all live documents into one whole segment. Older segments stay on disk for searches that are under way; `drop_old_segments` deletes them."""
    log = _log(spark, index)
    _add_segment(spark, index, log[-1]["seq"] + 1, "whole", None, _live(_tokens(spark, index, log), spark, index, log), None, [])


def drop_old_segments(spark: SparkSession, index: TextIndex) -> int:
    """Delete segments from before the last whole one; returns how many."""
    rows = spark.read.schema(MANIFEST).parquet(f"{index.path}/manifest").collect()
    kept = {r["folder"] for r in _log(spark, index)}
    old = [r["folder"] for r in rows if r["folder"] not in kept]
    for folder in old:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(old)


# --- search ----------------------------------------------------------------------------------------------------------


@dataclass
class _Search:
    spark: SparkSession
    index: TextIndex
    log: list
    avg: float

    def blocks(self, wanted: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
        """Columns of the blocks whose keys are in `wanted`, which has the terms' buckets too: other folders aren't opened."""
        schema = f"term string, block long, n long, max_tf long, min_len long, postings array<struct<doc:{self.index.doc_type},tf:long,len:long>>, bucket int"
        rows = _read(self.spark, self.log, "blocks", schema)
        return rows.join(wanted.select("bucket", *keys).distinct(), ["bucket", *keys], "left_semi").select("seq", *columns)

    def postings(self, wanted: DataFrame, keys: list[str]) -> DataFrame:
        """(seq, term, block, doc, part): live postings, `part` without idf."""
        rows = self.blocks(wanted, ["term", "block", "postings"], keys).select("seq", "term", "block", F.explode("postings").alias("p"))
        rows = rows.select("seq", "term", "block", "p.doc", _impact(F.col("p.tf"), F.col("p.len"), self.avg).alias("part"))
        return _live(rows, self.spark, self.index, self.log)


def _weights(s: _Search, asked: DataFrame, n_docs: int) -> DataFrame:
    """(term, bucket, df, idf) of the asked terms that some live document holds."""
    df = _read(s.spark, s.log, "df", "term string, df long, bucket int")
    df = df.join(asked.select("term", "bucket").distinct(), ["bucket", "term"], "left_semi").groupBy("bucket", "term").agg(F.sum("df").alias("df")).where("df > 0")
    return df.withColumn("idf", F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def _plan(s: _Search, queries: DataFrame, top: int | None, mode: str, query: str, q_text: str) -> tuple[DataFrame, DataFrame]:
    """(query, term, ..., drives): asked terms with idf and bounds, and (query, term, seq, block, bucket): the blocks of driving terms that are read.

    With mode "all" a query's rarest term drives, as each hit holds it. Else the heads of all lists are read first: the k-th best of the sums over them is a score that k documents reach
    (`least`). Terms whose greatest parts together stay below it can't make a hit on their own; the others drive. A block is left out if its bound and the other terms' greatest parts don't reach it either.
    """
    asked = asked_terms(queries, query, q_text).withColumn("bucket", _bucket(s.index.buckets))
    asked = materialise(asked, "asked-terms")
    n_docs = sum(r["n_docs"] for r in s.log)
    weights = _weights(s, asked, n_docs)
    heads = s.blocks(asked, ["bucket", "term", "block", "n", "max_tf", "min_len"], ["term"]).join(weights.drop("df"), ["bucket", "term"])
    heads = materialise(heads.withColumn("bound", F.col("idf") * _impact(F.col("max_tf"), F.col("min_len"), s.avg)).drop("idf"), "block-bounds")
    greatest = heads.groupBy("bucket", "term").agg(F.max("bound").alias("greatest"))
    use = asked.join(weights, ["bucket", "term"]).join(greatest, ["bucket", "term"])
    need = asked.groupBy(query).agg(F.count(F.lit(1)).alias("need"))
    use = use.join(need, query)
    if mode == "all":
        first = F.row_number().over(Window.partitionBy(query).orderBy("df", "term"))
        use = use.withColumns({"drives": first == 1, "least": F.lit(None).cast("double"), "others": F.lit(0.0)})
    elif top is None:
        use = use.withColumns({"drives": F.lit(True), "least": F.lit(None).cast("double"), "others": F.lit(0.0)})
    else:
        ahead = heads.withColumn("head", F.row_number().over(Window.partitionBy("seq", "term").orderBy("block"))).where(F.col("head") <= math.ceil(top / (1 << BLOCK_BITS)) + 1)
        parts = s.postings(ahead, ["term", "block"]).join(use.select(query, "term", "idf"), "term")
        sums = parts.groupBy(query, "doc").agg(F.sum(F.col("idf") * F.col("part")).alias("score"))
        least = rank_top(sums, top, query, "score", "doc").where(F.col("rank") == top).select(query, F.col("score").alias("least"))
        use = use.join(least, query, "left")
        # Terms of one query, from the least greatest part on.
        below = Window.partitionBy(query).orderBy("greatest", "term").rowsBetween(Window.unboundedPreceding, 0)
        use = use.withColumn("sum_to_here", F.sum("greatest").over(below))
        drives = F.col("least").isNull() | (F.col("sum_to_here") >= F.col("least") - SLACK)
        use = use.withColumn("drives", drives).withColumn("others", F.sum("greatest").over(Window.partitionBy(query)) - F.col("greatest")).drop("sum_to_here")
    use = materialise(use, "query-terms")
    wanted = heads.join(use.where("drives").select(query, "term", "least", "others", "idf"), "term")
    wanted = wanted.where(F.col("least").isNull() | (F.col("bound") + F.col("others") >= F.col("least") - SLACK))
    return use, materialise(wanted.select(query, "bucket", "term", "seq", "block", "n", "idf"), "query-blocks")


def search_text_index(queries: DataFrame, index: TextIndex, top: int | None, mode: str = "any", query: str = "query_id", q_text: str = "q_text", doc: str = "doc_id") -> DataFrame:
    """(query, doc, score, rank) by BM25, equal to `search_text` over the live documents; with mode "all" every distinct query term must match."""
    return _searched(queries, index, top, mode, query, q_text, doc)[0]


def _searched(queries: DataFrame, index: TextIndex, top: int | None, mode: str, query: str, q_text: str, doc: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    spark = queries.sparkSession
    log = _log(spark, index)
    n_docs, n_terms = sum(r["n_docs"] for r in log), sum(r["n_terms"] for r in log)
    s = _Search(spark, index, log, n_terms / n_docs if n_docs else 1.0)
    use, wanted = _plan(s, queries, top, mode, query, q_text)
    # Range numbers of blocks differ between segments, so a block is named by segment, term and number.
    read = s.postings(wanted, ["term", "block"]).join(wanted.select(query, "term", "seq", "block", "idf"), ["seq", "term", "block"])
    driven = read.groupBy(query, "doc").agg(F.sum(F.col("idf") * F.col("part")).alias("score"), F.count(F.lit(1)).alias("matched"))
    rest = use.where("not drives").select(query, "bucket", "term", "idf", "greatest", "least")
    room = rest.groupBy(query).agg(F.sum("greatest").alias("room"), F.max("least").alias("least"))
    found = driven.join(room, query, "left").where(F.col("least").isNull() | (F.col("score") + F.col("room") >= F.col("least") - SLACK))
    found = materialise(found.select(query, "doc", "score", "matched"), "candidates")
    # The other terms' postings are met by (term, document) of the candidates only.
    more = found.select(query, "doc").join(rest.select(query, "term", "idf"), query)
    more = s.postings(rest, ["term"]).join(more, ["term", "doc"]).select(query, "doc", (F.col("idf") * F.col("part")).alias("score"), F.lit(1).cast("long").alias("matched"))
    scored = found.unionByName(more).groupBy(query, "doc").agg(F.round(F.sum("score"), 4).alias("score"), F.sum("matched").alias("matched"))
    if mode == "all":
        scored = scored.join(use.select(query, "need").distinct(), query).where("matched = need")
    scored = scored.select(query, F.col("doc").alias(doc), "score")
    return scored if top is None else rank_top(scored, top, query, "score", doc), wanted, use


def search_cost(queries: DataFrame, index: TextIndex, top: int, mode: str = "any", query: str = "query_id", q_text: str = "q_text") -> DataFrame:
    """Per query: postings of its terms, those in the blocks that are scored for all their documents, and candidates are left to `search_text_index`."""
    spark = queries.sparkSession
    log = _log(spark, index)
    n_docs, n_terms = sum(r["n_docs"] for r in log), sum(r["n_terms"] for r in log)
    use, wanted = _plan(_Search(spark, index, log, n_terms / n_docs if n_docs else 1.0), queries, top, mode, query, q_text)
    scored = wanted.groupBy(query).agg(F.sum("n").alias("scored"))
    return use.groupBy(query).agg(F.sum("df").alias("postings")).join(scored, query, "left").select(query, "postings", F.coalesce("scored", F.lit(0)).alias("scored"))
