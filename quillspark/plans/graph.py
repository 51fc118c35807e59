"""Queries of the reference graph: links, reports, hops, nested relations, cascades."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import expand, links
from ..session import table
from .loading import nested_caps
from .registry import query


@query("""
SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS source_path, CAST(l_partkey AS VARCHAR) AS target_path
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
""")
def resolve_refs(spark, sf_dir):
    text = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string")
    path = links.target_path(F.lit("section"), text("l_partkey"), none, none)
    refs = table(spark, sf_dir, "lineitem").select(text("l_orderkey").alias("source_path"), path.alias("target_path"))
    sources = table(spark, sf_dir, "orders").select(text("o_orderkey").alias("source_path"))
    targets = table(spark, sf_dir, "part").select(text("p_partkey").alias("target_path"))
    return links.resolve_refs(refs, sources, targets, "source_path", "target_path")


@query("""
SELECT CAST(l_orderkey AS VARCHAR) AS cap_no, l_orderkey || '/s' || l_linenumber AS source_path, 'section' AS type, CAST(l_partkey AS VARCHAR) AS t_cap, l_partkey || '/s' || l_linenumber AS target_path FROM lineitem
UNION ALL SELECT CAST(l_orderkey AS VARCHAR), l_orderkey || '/s' || l_linenumber || '/a', 'subsection', CAST(l_partkey AS VARCHAR), l_partkey || '/s' || l_suppkey || '/b' FROM lineitem
UNION ALL SELECT CAST(l_orderkey AS VARCHAR), l_orderkey || '/sch1/s' || l_suppkey || '_x', 'legislation', CAST(l_suppkey AS VARCHAR), CAST(l_suppkey AS VARCHAR) FROM lineitem
UNION ALL SELECT CAST(l_orderkey AS VARCHAR), l_orderkey || '/sch1', 'legislation', CAST(l_suppkey AS VARCHAR), CAST(l_suppkey AS VARCHAR) FROM lineitem
""")
def ref_union_rollup(spark, sf_dir):
    r = links.explode_refs(nested_caps(spark, sf_dir))
    path = links.target_path(*(F.col(c) for c in ("type", "t_cap", "t_sec", "t_sub")))
    return r.select("cap_no", "source_path", "type", "t_cap", path.alias("target_path"))


def linked_pages(spark, sf_dir):
    """Documents as pages that refer to the next, the second next and the double id."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(d.alias("nid"), F.col("lang").alias("languageCode"), F.array(d + 1, d + 2, d * 2).alias("refs"))


REFS = """
refs AS (SELECT doc_id AS src, lang, unnest([doc_id + 1, doc_id + 2, doc_id * 2]) AS dst FROM documents),
known AS (SELECT DISTINCT src, r.lang, dst, d.doc_id IS NOT NULL AS known FROM refs r LEFT JOIN documents d ON d.doc_id = r.dst AND d.lang = r.lang)
"""


@query(f"WITH {REFS} SELECT src, dst, lang FROM known WHERE known")
def page_links(spark, sf_dir):
    return links.link_pages(linked_pages(spark, sf_dir), "refs").withColumnRenamed("languageCode", "lang")


@query(f"WITH {REFS} SELECT src, lang, count(*) AS n_refs, count(*) FILTER (WHERE known) AS n_found, count(*) FILTER (WHERE NOT known) AS n_missing FROM known GROUP BY src, lang")
def missing_refs_report(spark, sf_dir):
    return links.missing_refs(linked_pages(spark, sf_dir), "refs").withColumnRenamed("languageCode", "lang")


def page_refs(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    refs = li.select(F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("cap"), F.col("l_linenumber").cast("bigint").alias("number"))
    return refs, li.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("cap"), F.col("l_linenumber").cast("bigint").alias("number"))


SECTIONS = "s AS (SELECT DISTINCT l_partkey AS cap, CAST(l_linenumber AS BIGINT) AS number FROM lineitem WHERE l_returnflag = 'R'), r AS (SELECT l_orderkey AS page, l_partkey AS cap, CAST(l_linenumber AS BIGINT) AS number FROM lineitem)"


@query(f"WITH {SECTIONS} SELECT DISTINCT a.page, a.cap, b.number FROM r a JOIN r b ON a.page = b.page JOIN s ON s.cap = a.cap AND s.number = b.number")
def links_in_lists(spark, sf_dir):
    return links.link_sections_in_lists(*page_refs(spark, sf_dir))


@query(f"WITH {SECTIONS} SELECT DISTINCT page, r.cap, r.number FROM r JOIN s ON s.cap = r.cap AND s.number = r.number")
def links_pairwise(spark, sf_dir):
    return links.link_sections_pairwise(*page_refs(spark, sf_dir))


@query(f"""WITH {SECTIONS}
SELECT DISTINCT a.page, a.cap, b.number FROM r a JOIN r b ON a.page = b.page JOIN s ON s.cap = a.cap AND s.number = b.number
EXCEPT SELECT page, cap, number FROM r""")
def link_difference(spark, sf_dir):
    refs, sections = page_refs(spark, sf_dir)
    return links.link_sections_in_lists(refs, sections, refs)


@query(f"""WITH {SECTIONS} SELECT page, cap FROM r UNION SELECT l_suppkey, l_partkey FROM lineitem""")
def link_union(spark, sf_dir):
    refs, _ = page_refs(spark, sf_dir)
    other = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), F.col("l_partkey").alias("cap"))
    return links.union_links(refs.select("page", "cap"), other)


@query("SELECT l_orderkey, l_partkey, coalesce(o_orderpriority, '') AS o_orderpriority FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def attach_parent(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    return expand.attach_parent(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), o, ["l_orderkey"], "o_orderpriority")


def hops(spark, sf_dir, depth, kind=None, expanded=expand.expand_hops):
    """All orders as pages, parts as sections; a part refers to the part on the next line of an order, where that line is of the `kind`."""
    li = table(spark, sf_dir, "lineitem")
    seeds = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seed"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_returnflag")
    edges = li.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"), "l_returnflag", "l_linenumber").where("dst is not null")
    edges = (edges.where(kind) if kind else edges).select("src", "dst")
    first = li.select(F.col("l_orderkey").alias("seed"), F.col("l_partkey").alias("node"))
    return expanded(seeds, first, edges, depth).select("seed", "node", F.col("hop").cast("bigint").alias("hop"))


#: One kind of reference, of which a part has few: from returned first lines.
RETURNED = "l_returnflag = 'R' AND l_linenumber = 1"
HOPS = """
WITH l AS (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) AS dst, l_returnflag, l_linenumber FROM lineitem),
e AS (SELECT DISTINCT src, dst FROM l WHERE dst IS NOT NULL AND {0}),
h1 AS (SELECT DISTINCT o_orderkey AS seed, l_partkey AS node, 1 AS hop FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
h2 AS (SELECT DISTINCT seed, dst AS node, 2 AS hop FROM h1 JOIN e ON node = src),
h3 AS (SELECT DISTINCT seed, dst AS node, 3 AS hop FROM h2 JOIN e ON node = src)
SELECT seed, node, CAST(min(hop) AS BIGINT) AS hop FROM ({1}) GROUP BY seed, node
"""
TWO, THREE = "SELECT * FROM h1 UNION ALL SELECT * FROM h2", "SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3"


@query("SELECT DISTINCT o_orderkey AS seed, l_partkey AS node, CAST(1 AS BIGINT) AS hop FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def hop_expand_d2(spark, sf_dir):
    return hops(spark, sf_dir, 2)


@query(HOPS.format(RETURNED, TWO))
def hop_expand_d3(spark, sf_dir):
    return hops(spark, sf_dir, 3, RETURNED)


@query(HOPS.format(RETURNED, THREE))
def hop_expand_d4(spark, sf_dir):
    return hops(spark, sf_dir, 4, RETURNED)


@query(HOPS.format("true", TWO))
def hop_expand_all_d3(spark, sf_dir):
    """Depth 3 along all references; hop_expand_d3 follows one kind."""
    return hops(spark, sf_dir, 3, expanded=expand.expand_hops_by_node)


@query()
def hop_expand_all_d4(spark, sf_dir):
    """Depth 4 along all references. It has no SQL, as its rows are over a thousand for each order; tested against brute force."""
    return hops(spark, sf_dir, 4, expanded=expand.expand_hops_by_node)


@query("""
WITH l AS (SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS lines FROM lineitem GROUP BY l_orderkey),
s AS (SELECT l_orderkey, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_suppkey) AS suppliers FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) GROUP BY l_orderkey)
SELECT o_orderkey, coalesce(lines, '') AS lines, coalesce(suppliers, '') AS suppliers FROM orders LEFT JOIN l ON l.l_orderkey = o_orderkey LEFT JOIN s ON s.l_orderkey = o_orderkey
""")
def nested_include(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    out = expand.include_relations(
        table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", lines=(li, ["l_linenumber", "l_partkey"]), suppliers=(li.select("o_orderkey", "l_suppkey").distinct(), ["l_suppkey"])
    )
    lines = F.transform("lines", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string")))
    return out.select("o_orderkey", F.array_join(lines, ",").alias("lines"), F.array_join(F.transform("suppliers", lambda x: x["l_suppkey"].cast("string")), ",").alias("suppliers"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def childless_parents(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").withColumnRenamed("o_custkey", "c_custkey")
    return links.childless(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), o, ["c_custkey"])


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def has_child(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return links.with_child(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), o, ["c_custkey"])


@query("""
SELECT DISTINCT l_orderkey AS case_key, l_suppkey AS id FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
""")
def bridge_pairs(spark, sf_dir):
    cases = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("case_key")).agg(F.collect_list("l_suppkey").alias("ids"))
    linked = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("case_key"))
    return links.bridge_pairs(cases, "case_key", "ids", linked)


CASCADE = """
WITH hit AS (
  SELECT l_orderkey AS row_id, l_linenumber AS ln, l_suppkey AS sk, l_partkey AS pk,
         EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size = l_linenumber) AS by_act,
         EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_acctbal > 5000) AS by_neutral
  FROM lineitem),
ids AS (
  SELECT DISTINCT CASE WHEN by_act THEN 1000000 + pk WHEN by_neutral THEN sk ELSE 2000000 + row_id % 100 END AS id FROM hit)
"""


@query(CASCADE + "SELECT id FROM ids")
def cascade_match(spark, sf_dir):
    li, part, sup = (table(spark, sf_dir, n) for n in ("lineitem", "part", "supplier"))
    text = lambda head, c: F.concat(F.lit(head), F.col(c).cast("string"))
    items = F.array(F.concat_ws("/", F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string")), text("S", "l_suppkey"), F.concat(F.lit("O"), (F.col("l_orderkey") % 100).cast("string")))
    rows = li.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_id"), items.alias("items"))
    cases = part.select(F.concat_ws("/", F.col("p_partkey").cast("string"), F.col("p_size").cast("string")).alias("act"), F.array(F.col("p_partkey").cast("bigint") + 1_000_000).alias("judgment_ids"))
    judgments = sup.where("s_acctbal > 5000").select(F.col("s_suppkey").cast("bigint").alias("id"), text("S", "s_suppkey").alias("citation"))
    parallels = li.select((F.col("l_orderkey") % 100).cast("bigint").alias("k")).distinct().select(F.concat(F.lit("O"), F.col("k").cast("string")).alias("citation"), (F.col("k") + 2_000_000).alias("judgment_id"))
    return links.cascade_match(rows, cases, judgments, parallels)


@query("""
WITH p AS (SELECT conv_id, max_by(text, turn) AS summary FROM conversations GROUP BY conv_id)
SELECT d.doc_id, d.lang, coalesce(p.summary, d.source) AS source, p.conv_id IS NOT NULL AS was_updated FROM documents d LEFT JOIN p ON p.conv_id = d.doc_id
""")
def update_last_wins(spark, sf_dir):
    patch = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.col("text").alias("source"))
    return links.update_by_key(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), patch, "doc_id", "turn", ["source"])


@query("""
SELECT count(*) FILTER (WHERE conv_id IN (SELECT doc_id FROM documents)) AS updated, count(*) FILTER (WHERE conv_id NOT IN (SELECT doc_id FROM documents)) AS not_found FROM conversations
""")
def update_counts(spark, sf_dir):
    patch = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"))
    return links.update_report(table(spark, sf_dir, "documents"), patch, "doc_id")


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND doc_id IN (SELECT doc_id FROM labels)")
def semi_lookup(spark, sf_dir):
    return links.lookup_pages(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"), "doc_id", "en").select("doc_id", "lang", "source")


@query("SELECT doc_id, lang, CAST(len(embedding) AS BIGINT) AS dims FROM documents JOIN embeddings ON vec_id = doc_id")
def attach_vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return links.attach_vectors(table(spark, sf_dir, "documents"), v, "doc_id").select("doc_id", "lang", F.size("embedding").cast("bigint").alias("dims"))


@query("""
WITH d AS (SELECT l_orderkey AS request, 'u/' || l_suppkey AS url, l_linenumber AS hop, l_partkey AS path FROM lineitem)
SELECT request, url, CAST(min(struct_pack(hop := hop, path := path)).path AS BIGINT) AS path FROM d GROUP BY request, url
""")
def dedupe_by_url(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request"), F.concat(F.lit("u/"), F.col("l_suppkey").cast("string")).alias("url"), F.col("l_linenumber").alias("hop"), F.lit(0).alias("rank"), F.col("l_partkey").cast("bigint").alias("path"))
    return expand.dedupe_by_url(s).select("request", "url", "path")


@query("""
SELECT DISTINCT l_orderkey AS nid, s_suppkey AS judgment_id FROM lineitem JOIN supplier ON s_nationkey = l_linenumber AND s_suppkey % 50 = l_suppkey % 50
""")
def link_cases(spark, sf_dir):
    """Orders as pages with one case reference a line: court by line number, year and number by supplier."""
    text = lambda c: c.cast("string")
    case = F.struct(F.concat(F.lit("C"), text(F.col("l_linenumber"))).alias("court"), text(F.lit(2000)).alias("year"), text(F.col("l_suppkey") % 50).alias("no"))
    pages = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("nid")).agg(F.collect_list(case).alias("cases_ref"))
    judgments = table(spark, sf_dir, "supplier").select(F.concat(F.lit("C"), text(F.col("s_nationkey"))).alias("courtName"), F.lit(2000).alias("year"), (F.col("s_suppkey") % 50).alias("number"), F.col("s_suppkey").alias("id"))
    return links.link_cases(pages, judgments)


TERM_LINKS = """
t AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS cap_no, l_returnflag AS term, l_orderkey || '/s' || l_linenumber AS path FROM lineitem
      WHERE l_returnflag IN (SELECT a.l_linestatus FROM lineitem a WHERE a.l_orderkey = lineitem.l_orderkey) OR l_returnflag = 'R')
"""


def term_caps(spark, sf_dir):
    """Orders as caps: each line a section that uses its flag as a term; the cap defines the lines' states and 'R'."""
    li = table(spark, sf_dir, "lineitem")
    section = F.struct(F.concat(F.lit("s"), F.col("l_linenumber")).alias("name"), F.array("l_returnflag").alias("interp_terms"))
    defined = F.transform(F.array_union(F.collect_set("l_linestatus"), F.array(F.lit("R"))), lambda x: F.struct(x.alias("term")))
    return li.groupBy("l_orderkey").agg(F.collect_list(section).alias("sections"), defined.alias("interpretations")).select(F.col("l_orderkey").cast("string").alias("cap_no"), "sections", "interpretations")


@query(f"WITH {TERM_LINKS} SELECT cap_no, term, path FROM t")
def link_terms(spark, sf_dir):
    return links.link_terms(term_caps(spark, sf_dir))


@query("SELECT DISTINCT o_custkey AS customer, l_partkey AS part FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def lift_links(spark, sf_dir):
    """Order -> part edges raised to customer -> part."""
    edges = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("part"))
    parents = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("customer"))
    return links.lift_links(edges, parents, "l_orderkey", "customer").select("customer", "part")


@query("SELECT DISTINCT l_orderkey AS page, l_partkey AS cap FROM lineitem WHERE l_returnflag = 'N' AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def link_caps(spark, sf_dir):
    """Lines flagged 'N' as references without a section, to parts as caps."""
    number = F.when(F.col("l_returnflag") == "N", F.lit("")).otherwise(F.col("l_linenumber").cast("string"))
    refs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("cap"), number.alias("number"))
    return links.link_caps(refs, table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("cap")))
