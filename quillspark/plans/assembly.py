"""Queries that put results together: sources, contexts, costs, conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import links_in
from ..operators import context
from ..session import table
from .registry import query

URL_RULES = [("cheap-pills", "spam"), ("spam-farm", "spam"), (".example.org", "org"), ("/en/", "english")]


@query("SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src3', 'src5')")
def topic_in(spark, sf_dir):
    return context.topic_filter(table(spark, sf_dir, "documents"), "source", "src1|src3|src5").select("doc_id", "source")


@query(r"""
WITH q AS (SELECT conv_id, turn, CASE turn % 5 WHEN 3 THEN '' WHEN 4 THEN '  ' ELSE text END AS q, CASE WHEN role = 'user' THEN 'en' ELSE role END AS language, CASE WHEN turn % 5 = 2 THEN 'sc' END AS code FROM conversations)
SELECT conv_id, turn, CAST(CASE WHEN q IS NULL OR q = '' THEN 400 WHEN regexp_replace(q, '\s+', '', 'g') = '' THEN 401
  WHEN language NOT IN ('en', 'sc', 'tc') THEN 401 WHEN code IN ('sc', 'tc') THEN 501 ELSE 200 END AS BIGINT) AS status FROM q
""")
def request_status(spark, sf_dir):
    k = F.col("turn") % 5
    q = F.when(k == 3, F.lit("")).when(k == 4, F.lit("  ")).otherwise(F.col("text"))
    language = F.when(F.col("role") == "user", F.lit("en")).otherwise(F.col("role"))
    status = context.request_status(q, language, F.when(k == 2, F.lit("sc")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", status.cast("bigint").alias("status"))


@query("""
SELECT doc_id % 7 AS request, 'page-' || doc_id || '-0' AS source_id, lang AS title, source AS url FROM documents
UNION ALL SELECT c_custkey % 7, 'judgment-' || c_custkey, c_name, 'https://j/' || c_mktsegment FROM customer
UNION ALL SELECT l_orderkey % 7, 'cap-' || l_partkey || '-' || l_linenumber || '-' || CASE WHEN l_returnflag = 'N' THEN 'none' ELSE l_returnflag END,
                 'Cap ' || l_partkey || ', s' || l_linenumber || ': ' || l_linestatus, 'u' FROM lineitem
""")
def source_ids(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 7).alias("request"), F.col("doc_id").alias("nid"), F.lit(0).alias("chunk_no"), F.col("lang").alias("title"), F.col("source").alias("url"))
    j = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 7).alias("request"), F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("url"))
    sub = F.when(F.col("l_returnflag") == "N", F.lit("")).otherwise(F.col("l_returnflag"))
    s = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 7).alias("request"), F.col("l_partkey").alias("cap"), F.col("l_linenumber").alias("section"), sub.alias("sub"), F.col("l_linestatus").alias("title"), F.lit("u").alias("url")
    )
    return context.source_rows(d, j, s, "https://j/")


@query("""
SELECT split_part(id, '-', 1) AS kind, count(*) AS n_sources, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM (
  SELECT 'page-' || source AS id FROM documents UNION ALL SELECT 'judgment-' || n_name FROM nation UNION ALL SELECT 'cap-' || l_returnflag FROM lineitem) GROUP BY 1
""")
def source_groups(spark, sf_dir):
    rows = None
    for kind, name, column in (("page-", "documents", "source"), ("judgment-", "nation", "n_name"), ("cap-", "lineitem", "l_returnflag")):
        part = table(spark, sf_dir, name).select(F.concat(F.lit(kind), column).alias("source_id"))
        rows = part if rows is None else rows.unionByName(part)
    return context.group_sources(rows).withColumn("ids", F.array_join("ids", ","))


@query("""
SELECT page_id, CASE WHEN contains(url, 'cheap-pills') OR contains(url, 'spam-farm') THEN 'spam' WHEN contains(url, '.example.org') THEN 'org' WHEN contains(url, '/en/') THEN 'english' ELSE 'other' END AS url_class FROM pages
""")
def url_class(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", context.url_class(F.col("url"), URL_RULES).alias("url_class"))


@query("SELECT conv_id, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS conversation FROM conversations GROUP BY conv_id")
def conversation_flatten(spark, sf_dir):
    return context.flatten_conversation(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query("""
SELECT l_orderkey AS request, 'Context:' || chr(10) || string_agg('<section id="' || l_linenumber || '" title="' || l_returnflag || '">' || l_linestatus || '</section>', chr(10) ORDER BY n) || chr(10) || 'End $& $1' AS context
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS n FROM lineitem) GROUP BY l_orderkey
""")
def context_xml(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    block = context.xml_block("section", {"id": F.col("l_linenumber"), "title": F.col("l_returnflag")}, F.col("l_linestatus"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request"), F.row_number().over(w).alias("n"), block.alias("block"))
    return context.context_rows(rows, "request", "n", "block", "Context:\n{context}\nEnd $& $1")


@query("""
WITH u AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN length(text) END AS i, CASE WHEN role <> 'user' THEN length(text) END AS o, CASE WHEN turn > 0 THEN 100 END AS c FROM conversations),
k AS (SELECT conv_id, CAST(coalesce(i, 0) AS DECIMAL(18,0)) * 0.00000025 AS ic, CAST(coalesce(o, 0) AS DECIMAL(18,0)) * 0.000002 AS oc, CAST(coalesce(c, 0) AS DECIMAL(18,0)) * 0.000000025 AS cc FROM u)
SELECT conv_id, CAST(sum(ic) AS DOUBLE) AS input_cost, CAST(sum(oc) AS DOUBLE) AS output_cost, CAST(sum(cc) AS DOUBLE) AS cached_cost, CAST(sum(ic) + sum(oc) + sum(cc) AS DOUBLE) AS total_cost FROM k GROUP BY conv_id
""")
def usage_cost(spark, sf_dir):
    n, user = F.length("text"), F.col("role") == "user"
    u = table(spark, sf_dir, "conversations").select("conv_id", F.when(user, n).alias("i"), F.when(~user, n).alias("o"), F.when(F.col("turn") > 0, F.lit(100)).alias("c"))
    costs = context.usage_cost(u, "i", "o", "c")
    return costs.groupBy("conv_id").agg(*(F.sum(c).cast("double").alias(c) for c in ("input_cost", "output_cost", "cached_cost", "total_cost")))


@query(r"""
SELECT page_id, unnest(regexp_extract_all(url || ' ' || html, '(https?://[^\s)\]>"'']+)', 1)) AS link FROM pages
""")
def extract_links(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.concat_ws(" ", "url", "html").alias("t"))
    return p.select("page_id", F.explode(links_in(F.col("t"))).alias("link"))
