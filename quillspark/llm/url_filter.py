"""Operator 6: judge URLs by fixed rules, else by a tree of path templates with smoothed labelled purity.

1. Distinct paths of a host are counted: pages, labelled pages, those labelled bad. Each path is a way down a tree of segments, ended by `$`.
2. Level by level, from the host down, a segment stays a branch of its own if it has at least `FEW` pages and `RARE` of its parent's, and its bad share differs from that of its
   siblings by more than `Z` standard errors of their common share, or if it's the only segment there. All other segments, such as ids and branches that the
   labels don't tell apart, are merged into the wildcard `*`, and their subtrees with them. Where a path ends is always kept apart.
3. Purity is smoothed down the tree: all pages -> host -> branch -> ... -> template, each level adding `PRIOR` rows at its parent's share. A
   template whose smoothed bad share reaches `LIMIT` is rejected.

A level is one round over the distinct paths. Segments beyond the `DEPTH`th count as one. On the given tables no template reaches the limit: pages of all hosts and languages show documents
with about the same share of bad labels.

Everything is DataFrame functions; pages meet only aggregated tables.

Defined cases: a null URL or one without `://` has empty host and path, and the rules never fit it; unlabelled templates take their
parents' shares; a page labelled more than once counts once, as bad if any label is; repeated rows each count; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_groups, materialise

#: Verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
PRIOR, LIMIT, Z = 20.0, 0.5, 2.0
#: Least pages of a segment with a branch of its own, and least share of its parent's pages.
FEW, RARE = 8, 0.02
DEPTH = 12

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL column; both '' for null or without `://`."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest fitting rule, else nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(what)).otherwise(verdict)
    return text, verdict


def segments(path: Column) -> Column:
    """The path's segments, those beyond the DEPTHth as one, and the end."""
    segs = F.split(F.substring(path, 2, 1 << 30), "/")
    tail = F.when(F.size(segs) > DEPTH, F.array(F.array_join(F.slice(segs, F.lit(DEPTH), F.size(segs)), "/"))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.when(F.size(segs) > DEPTH, F.slice(segs, 1, DEPTH - 1)).otherwise(segs), tail, F.array(F.lit("$")))


def smooth(k, n, parent) -> Column:
    return (k + PRIOR * parent) / (n + PRIOR)


def template_tree(shapes: DataFrame) -> DataFrame:
    """(host, path, template, bad_share) for each row of shapes(host, path, pages, n, k): n labelled pages, k bad ones."""
    counts = lambda: [F.sum(c).alias(c) for c in ("pages", "n", "k")]
    rate, deepest = shapes.agg(F.coalesce(F.sum("k") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)), F.coalesce(F.max(F.size(segments(F.col("path")))), F.lit(0))).first()
    hosts = shapes.groupBy("host").agg(*counts()).select("host", smooth(F.col("k"), F.col("n"), F.lit(float(rate))).alias("share"))
    live = shapes.withColumns({"segs": segments(F.col("path")), "done": F.lit("")}).join(hosts, "host")
    live, out = materialise(live, "tree"), None
    for d in range(deepest):
        kids = materialise(live.groupBy("host", "done", F.col("segs")[d].alias("seg")).agg(*counts(), F.first("share").alias("share")), "branches")
        level = kids.groupBy("host", "done").agg(F.sum("pages").alias("pages_"), F.sum("n").alias("n_"), F.sum("k").alias("k_"), F.count(F.lit(1)).alias("kinds"))
        others = F.col("n_") - F.col("n")
        common = F.col("k_") / F.greatest("n_", F.lit(1))
        error = F.sqrt(common * (1 - common) * (1 / F.greatest("n", F.lit(1)) + 1 / F.greatest(others, F.lit(1))))
        apart = F.abs(F.col("k") / F.greatest("n", F.lit(1)) - (F.col("k_") - F.col("k")) / F.greatest(others, F.lit(1)))
        own = (F.col("pages") >= FEW) & (F.col("pages") >= F.col("pages_") * RARE) & (F.col("n") > 0) & (others > 0) & (apart > Z * error)
        named = kids.join(level, ["host", "done"]).withColumn("name", F.when(own | (F.col("kinds") == 1) | (F.col("seg") == "$"), F.col("seg")).otherwise(F.lit("*")))
        named = materialise(named.select("host", "done", "seg", "name", "n", "k", "share"), "named-branches")
        nodes = named.groupBy("host", "done", "name").agg(smooth(F.sum("k"), F.sum("n"), F.first("share")).alias("share"))
        ways = named.select("host", "done", "seg", "name").join(nodes, ["host", "done", "name"])
        step = join_groups(live.withColumn("seg", F.col("segs")[d]).drop("share"), ways, ["host", "done", "seg"], "path", 1)
        step = materialise(step.withColumn("done", F.concat_ws("/", "done", "name")).select(*live.columns), "tree")
        ended = step.where(F.size("segs") == d + 1).select("host", "path", F.col("done").alias("template"), F.col("share").alias("bad_share"))
        out = ended if out is None else out.unionByName(ended)
        live = step.where(F.size("segs") > d + 1)
    return out if out is not None else shapes.select("host", "path", F.lit("").alias("template"), F.lit(0.0).alias("bad_share"))


def named_document(path: Column) -> Column:
    """The document that a page shows, where its path ends in that document's number, else null."""
    return F.regexp_extract(path, r"([0-9]+)[^0-9/]*/?$", 1).try_cast("bigint")


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    label_id: str = "doc_id",
    label_col: str = "quality",
    rules=RULES,
    document=named_document,
) -> DataFrame:
    """One row per row of `pages`: `id_col`, host, path, rule, verdict, template, bad_share. Label 0 is bad.

    `document` gives the labelled id of a page from its path column.
    """
    p = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("_url"))
    host, path = host_and_path(F.col("_url"))
    p = p.select("id", host.alias("host"), path.alias("path")).withColumn("doc", document(F.col("path")))
    marks = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(label_id).alias("doc")).agg(F.max((F.col(label_col) == 0).cast("int")).alias("bad"))
    p = materialise(p.join(marks, "doc", "left").select("id", "host", "path", "bad"), "urls")
    shapes = p.groupBy("host", "path").agg(F.count(F.lit(1)).alias("pages"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    judged = join_groups(p, materialise(template_tree(materialise(shapes, "paths")), "templates"), ["host", "path"], "id", 1)
    text, verdict = rule_for(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_share") >= LIMIT, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(F.col("id").alias(id_col), "host", "path", text.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "template", "bad_share")
