"""Queries of the loading operators: scans, projections, key checks, keyed writes, audits."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.keys import iso_text, joined, tail_of
from ..operators import audit, chunks, ingest
from ..session import shared_folder, table
from ..sources import json_files
from .registry import query


@query("SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en'")
def scan_filter_project(spark, sf_dir):
    return json_files.scan(table(spark, sf_dir, "documents"), "lang = 'en'", ["doc_id", "source", "n_chars"])


CHUNKS = """
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(0, 1 + greatest(0, CAST(ceil((len(w) - 64) / 48.0) AS BIGINT)))) AS chunk_no FROM t WHERE len(w) > 0)
SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, CAST(len(w[chunk_no * 48 + 1 : chunk_no * 48 + 64]) AS BIGINT) AS n_tokens,
       array_to_string(w[chunk_no * 48 + 1 : chunk_no * 48 + 64], ' ') AS content FROM s
"""


def document_chunks(spark, sf_dir):
    c = chunks.chunk_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 64, 16)
    return c.select("doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.col("n_tokens").cast("bigint").alias("n_tokens"), "content")


@query(CHUNKS)
def chunk_windows(spark, sf_dir):
    return document_chunks(spark, sf_dir)


@query(f"""
WITH c AS ({CHUNKS})
SELECT doc_id, chunk_no, doc_id || '_' || min(chunk_no) OVER (PARTITION BY doc_id, content) AS chunk_id FROM c
""")
def chunk_ids_first_index(spark, sf_dir):
    return chunks.chunk_ids(document_chunks(spark, sf_dir), "doc_id", "first_index").select("doc_id", "chunk_no", "chunk_id")


@query(CHUNKS)
def chunk_roundtrip(spark, sf_dir):
    c = document_chunks(spark, sf_dir)
    path = f"{shared_folder(spark)}/chunks-{uuid.uuid4().hex}"
    json_files.write_chunks(c, path)
    return json_files.read_chunks(spark, path, c.schema)


@query("SELECT page_id AS nid, url, html AS content, 'en' AS \"languageCode\" FROM pages")
def map_columns(spark, sf_dir):
    return ingest.map_page(table(spark, sf_dir, "pages"), "en", {"page_id": "nid", "url": "url", "html": "content"})


@query("SELECT d.doc_id, d.lang FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.quality, 1) = 1")
def quality_filter(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return ingest.drop_flagged(d, F.col("quality") == 0).select("doc_id", "lang")


def nested_caps(spark, sf_dir):
    """Orders as caps, their lines as sections with one subsection, one reference each; flags as schedules."""
    line = table(spark, sf_dir, "lineitem")
    ref = lambda kind, cap, sec, sub: F.array(F.struct(F.lit(kind).alias("type"), cap.cast("string").alias("cap"), sec.alias("section"), sub.alias("subsection")))
    none = F.lit(None).cast("string")
    name = F.concat(F.lit("s"), F.col("l_linenumber"))
    sub = F.struct(F.lit("a").alias("name"), F.col("l_returnflag").alias("text"), ref("subsection", F.col("l_partkey"), F.concat(F.lit("s"), F.col("l_suppkey")), F.lit("b")).alias("references"))
    section = F.struct(
        none.alias("no"),
        name.alias("name"),
        F.col("l_linestatus").alias("heading"),
        F.col("l_returnflag").alias("text"),
        F.concat(F.lit("u/"), "l_orderkey").alias("url"),
        F.array(sub).alias("subsections"),
        ref("section", F.col("l_partkey"), name, none).alias("references"),
    )
    part = F.struct(
        F.concat(F.lit("P"), F.col("l_linenumber"), F.lit("_s"), F.col("l_suppkey"), F.lit("_x")).alias("name"),
        none.alias("heading"),
        F.col("l_linestatus").alias("text"),
        F.concat(F.lit("v/"), "l_orderkey").alias("url"),
        ref("legislation", F.col("l_suppkey"), none, none).alias("references"),
    )
    caps = line.groupBy("l_orderkey").agg(F.collect_list(section).alias("sections"), F.collect_list(part).alias("parts"))
    sch = F.array(F.struct(F.lit("sch1").alias("name"), none.alias("heading"), F.lit("text").alias("text"), none.alias("url"), F.col("parts").alias("sections")))
    return caps.select(F.col("l_orderkey").cast("string").alias("cap_no"), F.lit("en").alias("language"), "sections", sch.alias("schedules"))


@query("""
SELECT CAST(l_orderkey AS VARCHAR) AS cap_no, l_orderkey || '/s' || l_linenumber AS path, CAST(l_linenumber AS VARCHAR) AS section_number, CAST(NULL AS VARCHAR) AS subsection_number, l_returnflag AS content FROM lineitem
UNION ALL
SELECT CAST(l_orderkey AS VARCHAR), l_orderkey || '/s' || l_linenumber || '/a', CAST(l_linenumber AS VARCHAR), 'a', l_returnflag FROM lineitem
""")
def section_paths(spark, sf_dir):
    return ingest.explode_sections(nested_caps(spark, sf_dir)).select("cap_no", "path", "section_number", "subsection_number", "content")


@query("""
SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS cap_no, l_orderkey || '/sch1' AS path, CAST(NULL AS VARCHAR) AS subsection_number FROM lineitem
UNION ALL
SELECT CAST(l_orderkey AS VARCHAR), l_orderkey || '/sch1/s' || l_suppkey || '_x', 's' || l_suppkey || '_x' FROM lineitem
""")
def schedule_paths(spark, sf_dir):
    return ingest.explode_schedules(nested_caps(spark, sf_dir)).select("cap_no", "path", "subsection_number")


@query("SELECT p_partkey, array_to_string(string_split(replace(p_name, ' ', '_'), '_')[2:], '_') AS tail FROM part")
def tail_key(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tail_of(F.translate("p_name", " ", "_")).alias("tail"))


@query(r"""
WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, line FROM x WHERE regexp_replace(line, '^\s+|\s+$', '', 'g') <> ''
""")
def drop_blank(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return ingest.drop_blank(lines, "line")


@query("""
WITH x AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'app' || p_size || '_' || p_brand ELSE 'sec' || p_size || '_' || p_brand END AS section_number, 'u/' || p_size || '_' || p_brand AS url FROM part)
SELECT p_partkey, CASE WHEN section_number LIKE 'app%' THEN string_split(section_number, '_')[1] ELSE section_number END AS section_number,
       CASE WHEN section_number LIKE 'app%' THEN string_split(url, '_')[1] ELSE url END AS url FROM x
""")
def appendix_normalise(spark, sf_dir):
    head = F.when(F.col("p_size") % 2 == 0, F.lit("app")).otherwise(F.lit("sec"))
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(head, F.col("p_size"), F.lit("_"), "p_brand").alias("section_number"), F.concat(F.lit("u/"), F.col("p_size"), F.lit("_"), "p_brand").alias("url"))
    return ingest.normalise_appendix(p)


@query("SELECT d.doc_id, d.lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def skip_existing_keys(spark, sf_dir):
    return ingest.skip_existing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"]).select("doc_id", "lang")


@query("""
SELECT doc_id, quality, toxic FROM labels
UNION ALL
SELECT doc_id, NULL, NULL FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
""")
def append_new(spark, sf_dir):
    base = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return ingest.append_new(base, table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])


@query("""
WITH patch AS (
  SELECT doc_id, 'low' AS source, CAST(NULL AS BIGINT) AS n_chars, quality = 0 AS wipe FROM labels
  UNION ALL SELECT doc_id + 10000000, 'new', CAST(toxic AS BIGINT), false FROM labels)
SELECT coalesce(d.doc_id, p.doc_id) AS doc_id, d.lang, coalesce(p.source, d.source) AS source,
       CASE WHEN coalesce(p.wipe, false) THEN NULL ELSE coalesce(p.n_chars, d.n_chars) END AS n_chars
FROM documents d FULL OUTER JOIN patch p ON d.doc_id = p.doc_id
""")
def upsert_merge(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    wiped = F.when(F.col("quality") == 0, F.array(F.lit("n_chars"))).otherwise(F.array().cast("array<string>"))
    old = lab.select("doc_id", F.lit("low").alias("source"), F.lit(None).cast("bigint").alias("n_chars"), wiped.alias("nulls"))
    new = lab.select((F.col("doc_id") + 10_000_000).alias("doc_id"), F.lit("new").alias("source"), F.col("toxic").cast("bigint").alias("n_chars"), F.array().cast("array<string>").alias("nulls"))
    base = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return ingest.upsert_by_key(base, old.unionByName(new), ["doc_id"], "nulls")


@query("""
WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS row_no FROM events)
SELECT event_id, CAST(row_no AS BIGINT) AS row_no, CAST((row_no - 1) // 100 AS BIGINT) AS batch_no FROM r
""")
def batch_ids(spark, sf_dir):
    return ingest.batch_plan(table(spark, sf_dir, "events").select("event_id"), "event_id", 100).select("event_id", "row_no", "batch_no")


@query("""
WITH r AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS row_no FROM orders)
SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, CAST(row_no AS BIGINT) AS row_no, CAST((row_no - 1) // 1000 AS BIGINT) AS batch_no FROM r
""")
def batch_rows(spark, sf_dir):
    """Whole rows in batches of 1000, as they're inserted."""
    return ingest.batch_plan(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"), "o_orderkey", 1000)


@query("""
WITH bad AS (SELECT DISTINCT l_orderkey FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM bad)
""")
def reject_ambiguous_groups(spark, sf_dir):
    return ingest.reject_ambiguous(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey"], ["l_linenumber"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return ingest.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM w)
SELECT doc_id, term, CAST(min(pos) AS BIGINT) AS first_pos FROM t GROUP BY doc_id, term
""")
def dedupe_first_term(spark, sf_dir):
    from ..functions.keys import words

    t = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(words(F.col("text"))).alias("pos", "term"))
    first = ingest.dedupe_first(t, ["doc_id", "term"], ["pos"])
    return first.select("doc_id", "term", F.col("pos").cast("bigint").alias("first_pos"))


@query("""
SELECT o_orderkey AS cap, CAST(NULL AS BIGINT) AS line, o_orderstatus AS status FROM orders
UNION ALL SELECT l_orderkey, CAST(l_linenumber AS BIGINT), CAST(NULL AS VARCHAR) FROM lineitem
""")
def union_levels(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cap"), F.lit(None).cast("bigint").alias("line"), F.col("o_orderstatus").alias("status"))
    return ingest.union_levels(o, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cap"), F.col("l_linenumber").cast("bigint").alias("line")))


@query("""
SELECT count(*) AS total, count(*) FILTER (WHERE NOT (n_chars > 200)) AS failed,
       count(*) FILTER (WHERE n_chars > 200 AND doc_id IN (SELECT doc_id FROM labels)) AS skipped,
       count(*) FILTER (WHERE n_chars > 200 AND doc_id NOT IN (SELECT doc_id FROM labels)) AS added FROM documents
""")
def run_counts(spark, sf_dir):
    return audit.run_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"], F.col("n_chars") > 200)


COUNTS = """
SELECT count(*) AS total, count(*) FILTER (WHERE NOT (n_chars > 200)) AS failed,
       count(*) FILTER (WHERE n_chars > 200 AND doc_id IN (SELECT doc_id FROM labels)) AS skipped,
       count(*) FILTER (WHERE n_chars > 200 AND doc_id NOT IN (SELECT doc_id FROM labels)) AS added FROM documents
"""


@query(COUNTS)
def observed_load(spark, sf_dir):
    """Totals of a load, observed while its rows are written."""
    docs, path = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/load-{uuid.uuid4().hex}"
    counts = audit.observed_load(docs.select("doc_id", "n_chars", "text"), table(spark, sf_dir, "labels"), ["doc_id"], F.col("n_chars") > 200, lambda rows: rows.write.parquet(path))
    written = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("added"))
    return written.select(*[F.lit(counts[k]).cast("bigint").alias(k) for k in ("total", "failed", "skipped")], "added")


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def audit_unique(spark, sf_dir):
    return audit.audit_unique(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"])


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def audit_fk(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey")
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return audit.audit_fk(c, urgent, {"c_custkey": "o_custkey"})


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso, user_id || '/' || event_type AS event_key FROM events")
def key_and_date_text(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", iso_text(F.col("ts")).alias("iso"), joined("user_id", "event_type", sep="/").alias("event_key"))
