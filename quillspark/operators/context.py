"""From hits to rows of sources, context texts, costs and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import blank_to, joined

#: US dollars per token: input, output, cached input. Decimals, so that sums don't depend on their order.
PRICES = ("0.00000025", "0.000002", "0.000000025")
LANGUAGES = ("en", "sc", "tc")


def topic_filter(df: DataFrame, column: str, topics: str | None) -> DataFrame:
    """Rows whose value is in a '|'-separated list; no list, no filter."""
    return df if topics is None else df.where(F.col(column).isin(*topics.split("|")))


def request_status(query: Column, language: Column, language_code: Column) -> Column:
    """400 without a query, 401 for white space only or an unknown language, 501 for a language not served yet, else 200."""
    return (
        F.when(query.isNull() | (query == ""), F.lit(400))
        .when(F.length(F.regexp_replace(query, r"\s+", "")) == 0, F.lit(401))
        .when(language.isNotNull() & ~language.isin(*LANGUAGES), F.lit(401))
        .when(language_code.isin("sc", "tc"), F.lit(501))
        .otherwise(F.lit(200))
    )


def section_id(cap: Column, section: Column, sub: Column) -> Column:
    return F.concat(F.lit("cap-"), cap.cast("string"), F.lit("-"), section.cast("string"), F.lit("-"), blank_to(sub.cast("string"), "none"))


def section_title(cap: Column, section: Column, title: Column) -> Column:
    return F.concat(F.lit("Cap "), cap.cast("string"), F.lit(", s"), section.cast("string"), F.lit(": "), F.coalesce(title, F.lit("")))


def source_rows(pages: DataFrame, judgments: DataFrame, sections: DataFrame, judgment_base: str = "", page_kind: str = "page") -> DataFrame:
    """Uniform (request, source_id, title, url) of the three kinds of hits; `page_kind` is the first part of page ids."""
    p = pages.select("request", joined(F.lit(page_kind), F.col("nid"), F.col("chunk_no"), sep="-").alias("source_id"), "title", "url")
    j = judgments.select("request", joined(F.lit("judgment"), F.col("id"), sep="-").alias("source_id"), "title", F.concat(F.lit(judgment_base), F.col("url")).alias("url"))
    s = sections.select(
        "request",
        section_id(F.col("cap"), F.col("section"), F.col("sub")).alias("source_id"),
        section_title(F.col("cap"), F.col("section"), F.col("title")).alias("title"),
        "url",
    )
    return p.unionByName(j).unionByName(s)


def url_class(url: Column, rules: list[tuple[str, str]], other: str = "other") -> Column:
    """The class of the first rule whose text the URL contains."""
    out = F.lit(other)
    for text, name in reversed(rules):
        out = F.when(F.contains(url, F.lit(text)), F.lit(name)).otherwise(out)
    return out


def flatten_conversation(df: DataFrame, key: str, order: str, role: str = "role", text: str = "text") -> DataFrame:
    """One text per conversation: `role: text` lines in order."""
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.concat(role, F.lit(": "), F.coalesce(text, F.lit(""))).alias("line"))))
    return df.groupBy(key).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("conversation"))


def escape_xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def xml_block(tag: str, attributes: dict[str, Column], body: Column, escape: bool = False) -> Column:
    clean = escape_xml if escape else (lambda c: c)
    some = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    parts = [F.lit(f"<{tag}")]
    for name, value in attributes.items():
        parts += [F.lit(f' {name}="'), clean(some(value)), F.lit('"')]
    return F.concat(*parts, F.lit(">"), clean(some(body)), F.lit(f"</{tag}>"))


def context_rows(blocks: DataFrame, request: str, order: str, block: str, template: str) -> DataFrame:
    """One context per request: its blocks in order, put in the template's `{context}` by concatenation."""
    before, _, after = template.partition("{context}")
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(block).alias("b"))))
    text = F.array_join(F.transform(lines, lambda x: x["b"]), "\n")
    return blocks.groupBy(request).agg(F.concat(F.lit(before), text, F.lit(after)).alias("context"))


def usage_cost(df: DataFrame, input_tokens: str, output_tokens: str, cached_tokens: str) -> DataFrame:
    """Add input_cost, output_cost, cached_cost and total_cost in dollars, as exact decimals of 9 places; null counts as 0."""
    price = lambda c, p: F.coalesce(F.col(c), F.lit(0)).cast("decimal(18,0)") * F.lit(p).cast("decimal(10,9)")
    cost = [price(c, p) for c, p in zip((input_tokens, output_tokens, cached_tokens), PRICES, strict=True)]
    names = ("input_cost", "output_cost", "cached_cost")
    out = {n: c.cast("decimal(28,9)") for n, c in zip(names, cost, strict=True)}
    return df.withColumns(out | {"total_cost": (cost[0] + cost[1] + cost[2]).cast("decimal(28,9)")})


def group_sources(rows: DataFrame, source_id: str = "source_id") -> DataFrame:
    """Sources by kind, the id's part before the first '-': count and sorted ids."""
    kind = F.split(F.col(source_id), "-")[0]
    return rows.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n_sources"), F.array_sort(F.collect_set(source_id)).alias("ids"))
