"""References to edges: resolving, reports, list rules, bridges, cascades and keyed updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import mask, members, numbered
from ..functions.keys import joined, tail_of
from ..session import materialise

REF_FIELDS = ("cap_no", "source_path", "type", "t_cap", "t_sec", "t_sub")


def target_path(kind: Column, cap: Column, sec: Column, sub: Column) -> Column:
    """Target key of a reference: cap, cap/sN, cap/sN/sub or cap/schN, with one spelling of the leading letters."""
    bare = F.regexp_replace(sec, "^s(?=[0-9])", "")
    return (
        F.when(kind == "legislation", cap)
        .when(kind == "section", F.when(F.coalesce(sec, F.lit("")) == "", cap).otherwise(F.concat(cap, F.lit("/s"), bare)))
        .when(kind == "subsection", F.concat(cap, F.lit("/s"), bare, F.lit("/"), sub))
        .when(kind == "schedule", F.concat(cap, F.lit("/sch"), F.regexp_replace(sec, "^sch", "")))
    )


def explode_refs(caps: DataFrame) -> DataFrame:
    """References of sections, subsections and schedule sections, the last also rolled up to their schedule."""
    ref = [F.col("r.type").alias("type"), F.col("r.cap").alias("t_cap"), F.col("r.section").alias("t_sec"), F.col("r.subsection").alias("t_sub")]
    out = lambda df, path: df.select("cap_no", path.alias("source_path"), *ref)
    sec = caps.select("cap_no", F.explode("sections").alias("s"))
    sub = sec.select("cap_no", "s.name", F.explode("s.subsections").alias("u"))
    sch = caps.select("cap_no", F.explode("schedules").alias("s")).select("cap_no", "s.name", F.explode("s.sections").alias("u"))
    of_sections = sec.select("cap_no", "s", F.explode("s.references").alias("r"))
    of_subs = sub.select("cap_no", "name", "u", F.explode("u.references").alias("r"))
    of_parts = sch.select("cap_no", "name", "u", F.explode("u.references").alias("r"))
    return (
        out(of_sections, joined("cap_no", "s.name", sep="/"))
        .unionByName(out(of_subs, joined("cap_no", "name", "u.name", sep="/")))
        .unionByName(out(of_parts, F.concat_ws("/", "cap_no", "name", tail_of(F.col("u.name")))))
        .unionByName(out(of_parts, joined("cap_no", "name", sep="/")))
    )


def resolve_refs(refs: DataFrame, sources: DataFrame, targets: DataFrame, source: str, target: str, keys: list[str] | None = None) -> DataFrame:
    """Distinct edges (source, target) of references whose both ends exist; `keys` (such as a language) must agree too."""
    keys = keys or []
    out = refs.join(sources.select(source, *keys).distinct(), [source, *keys], "left_semi")
    return out.join(targets.select(target, *keys).distinct(), [target, *keys], "left_semi").select(source, target, *keys).distinct()


def link_pages(pages: DataFrame, refs: str, nid: str = "nid", lang: str = "languageCode") -> DataFrame:
    """Distinct page -> page edges inside a language, from an array column of target nids (nulls dropped)."""
    r = pages.select(F.col(nid).alias("src"), lang, F.explode(refs).alias("dst")).where("dst is not null")
    known = pages.select(F.col(nid).alias("dst"), lang).distinct()
    return r.join(known, ["dst", lang]).select("src", "dst", lang).distinct()


def missing_refs(pages: DataFrame, refs: str, nid: str = "nid", lang: str = "languageCode") -> DataFrame:
    """Per source page: references, those found, those missing."""
    r = pages.select(F.col(nid).alias("src"), lang, F.explode(refs).alias("dst")).where("dst is not null").distinct()
    known = pages.select(F.col(nid).alias("dst"), lang, F.lit(1).alias("known")).distinct()
    j = r.join(known, ["dst", lang], "left")
    return j.groupBy("src", lang).agg(F.count(F.lit(1)).alias("n_refs"), F.count("known").alias("n_found"), F.count_if(F.col("known").isNull()).alias("n_missing"))


def link_sections_in_lists(refs: DataFrame, sections: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Per page: sections whose cap is among the page's caps and whose number is among its numbers, not pairwise.

    Numbers are bit sets: a page has some words of 64 of them, a cap has others, and a page meets each of its caps word by word in an AND. So there is a row for each cap and word of a page at most, not
    for each cap and number, and a cap with many sections doesn't fan out.
    """
    whole = refs.where("cap is not null and number is not null")
    known = materialise(numbered(sections, "number"), "section-numbers")
    of_page = whole.select("page", "number").distinct().join(known, "number").groupBy("page", "word").agg(F.bit_or(mask(F.col("bit"))).alias("asked"))
    own = sections.select("cap", "number").distinct().join(known, "number")
    of_cap = own.groupBy("cap", "word").agg(F.bit_or(mask(F.col("bit"))).alias("has"), F.collect_list(F.struct("bit", "number")).alias("named"))  # 64 names at most
    met = whole.select("page", "cap").distinct().join(of_page, "page").join(of_cap, ["cap", "word"]).where(F.col("asked").bitwiseAND(F.col("has")) != 0)
    out = met.select("page", "cap", F.explode(members(F.col("asked"), F.col("named"))).alias("n")).select("page", "cap", "n.number")
    return difference(out, existing, ["page", "cap", "number"]) if existing is not None else out


def link_sections_pairwise(refs: DataFrame, sections: DataFrame) -> DataFrame:
    """The intended reading: cap and number of one reference."""
    return refs.join(sections.select("cap", "number").distinct(), ["cap", "number"]).select("page", "cap", "number").distinct()


def link_caps(refs: DataFrame, caps: DataFrame) -> DataFrame:
    """Page -> cap edges of references without a section."""
    bare = refs.where("coalesce(number, '') = ''").select("page", "cap").distinct()
    return bare.join(caps.select("cap").distinct(), "cap", "left_semi").select("page", "cap")


def union_links(*links: DataFrame) -> DataFrame:
    """Set union of edges: repeated links count once."""
    out = links[0]
    for d in links[1:]:
        out = out.unionByName(d)
    return out.distinct()


def difference(links: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    return links.join(existing.select(*keys).distinct(), keys, "left_anti")


def childless(parent: DataFrame, child: DataFrame, keys: list[str]) -> DataFrame:
    return parent.join(child.select(*keys).distinct(), keys, "left_anti")


def with_child(parent: DataFrame, child: DataFrame, keys: list[str]) -> DataFrame:
    return parent.join(child.select(*keys).distinct(), keys, "left_semi")


def bridge_pairs(cases: DataFrame, key: str, ids: str, linked: DataFrame) -> DataFrame:
    """Distinct (key, id) pairs of an array column, for cases that have no link yet."""
    return cases.join(linked.select(key).distinct(), key, "left_anti").select(key, F.explode(ids).alias("id")).distinct()


def cascade_match(rows: DataFrame, cases: DataFrame, judgments: DataFrame, parallels: DataFrame) -> DataFrame:
    """Distinct judgment ids found by rows(row_id, items).

    Items are tried in order; one with '/' is a case act, and its judgments are taken if it has any; another is a neutral citation, else a
    parallel citation. A row stops at its first hit and takes all judgments of that hit.
    cases(act, judgment_ids array), judgments(id, citation), parallels(citation, judgment_id).
    """
    items = rows.select("row_id", F.posexplode("items").alias("pos", "item"))
    act = items.where(F.contains("item", F.lit("/"))).join(cases.select(F.col("act").alias("item"), F.explode("judgment_ids").alias("id")), "item")
    other = items.where(~F.contains("item", F.lit("/")))
    neutral = other.join(judgments.select(F.col("citation").alias("item"), "id"), "item")
    parallel = other.join(parallels.select(F.col("citation").alias("item"), F.col("judgment_id").alias("id")), "item")
    tier = lambda df, k: df.select("row_id", F.struct("pos", F.lit(k).alias("prio")).alias("tier"), "id")
    hits = tier(act, 0).unionByName(tier(neutral, 1)).unionByName(tier(parallel, 2))
    first = hits.groupBy("row_id").agg(F.min("tier").alias("tier"))
    return hits.join(first, ["row_id", "tier"]).select("id").distinct()


def update_by_key(base: DataFrame, patch: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Set columns on all rows with the key; of repeated keys the last by `order` counts. A null in the patch keeps the old value. Adds `was_updated`."""
    last = patch.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_p"))
    j = base.join(last, key, "left")
    new = {c: F.coalesce(F.col(f"_p.{c}"), F.col(c)) for c in columns}
    return j.select(*(new[c].alias(c) if c in new else F.col(c) for c in base.columns), F.col("_p").isNotNull().alias("was_updated"))


def update_report(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """How many of the patch's rows have a key in `base`, and how many have not."""
    known = base.select(key, F.lit(1).alias("known")).distinct()
    return patch.join(known, key, "left").agg(F.count("known").alias("updated"), F.count_if(F.col("known").isNull()).alias("not_found"))


def lookup_pages(hits: DataFrame, pages: DataFrame, key: str, lang: str | None = None, lang_col: str = "lang") -> DataFrame:
    """Pages of the set of hit ids, in one language if it is given."""
    out = pages.join(hits.select(key).distinct(), key, "left_semi")
    return out if lang is None else out.where(F.col(lang_col) == lang)


def attach_vectors(chunks: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Vectors joined by chunk id; positions don't survive a shuffle."""
    return chunks.join(vectors, key)


def link_cases(pages: DataFrame, judgments: DataFrame, key: str = "nid") -> DataFrame:
    """Distinct page -> judgment edges from cases_ref(court, year, no), matched by court, year and number; what is no number matches nothing.

    Repeated references go before the join, so a judgment with one citation meets a page once, and only edges to those with several citations are shuffled to find repeats.
    """
    case = ["court", "year", "number"]
    r = pages.select(key, F.explode("cases_ref").alias("r"))
    r = r.select(key, F.col("r.court").alias("court"), F.col("r.year").try_cast("int").alias("year"), F.col("r.no").try_cast("int").alias("number")).dropna(subset=case).distinct()
    j = judgments.select(F.col("courtName").alias("court"), F.col("year").cast("int").alias("year"), F.col("number").cast("int").alias("number"), F.col("id").alias("judgment_id"))
    j = j.dropna(subset=case).distinct().withColumn("_cited", F.count(F.lit(1)).over(Window.partitionBy("judgment_id")))
    edges = lambda some: r.join(some, case).select(key, "judgment_id")
    return edges(j.where("_cited = 1")).unionByName(edges(j.where("_cited > 1")).distinct())


def link_terms(caps: DataFrame) -> DataFrame:
    """Distinct (cap_no, term, path) edges from sections' interp_terms to terms that their own cap defines."""
    s = caps.select("cap_no", F.explode("sections").alias("s")).select("cap_no", joined("cap_no", "s.name", sep="/").alias("path"), F.explode("s.interp_terms").alias("term"))
    t = caps.select("cap_no", F.explode("interpretations").alias("i")).select("cap_no", F.col("i.term").alias("term")).distinct()
    return s.join(t, ["cap_no", "term"], "left_semi").select("cap_no", "term", "path").distinct()


def lift_links(edges: DataFrame, parents: DataFrame, node: str, parent: str) -> DataFrame:
    """Edges raised from a node to its parent, such as judgment -> section to judgment -> cap."""
    return edges.join(parents.select(node, parent).distinct(), node).drop(node).distinct()
