"""From nested JSON rows to tables: projections, flattening, key checks and keyed writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import joined, stripped, tail_of, without_first
from ..session import materialise


def map_page(df: DataFrame, lang: str, names: dict[str, str]) -> DataFrame:
    """Rename and project to page columns, with a constant language."""
    return df.select(*(F.col(old).alias(new) for old, new in names.items()), F.lit(lang).alias("languageCode"))


def drop_flagged(df: DataFrame, flag: Column) -> DataFrame:
    """Rows whose flag isn't true; a missing flag keeps the row."""
    return df.where(~F.coalesce(flag, F.lit(False)))


def section_number(no: Column, name: Column) -> Column:
    """`no`, or the name without its first "s" where `no` is null or ''."""
    return F.coalesce(F.nullif(no, F.lit("")), without_first(name, "s"))


def explode_sections(caps: DataFrame) -> DataFrame:
    """Sections and subsections of caps: path cap/name or cap/name/sub."""
    s = caps.select("cap_no", "language", F.explode("sections").alias("s"))
    number = section_number(F.col("s.no"), F.col("s.name"))
    common = [F.col("cap_no"), F.col("language"), number.alias("section_number")]
    sections = s.select(
        *common,
        F.lit(None).cast("string").alias("subsection_number"),
        joined("cap_no", "s.name", sep="/").alias("path"),
        F.col("s.heading").alias("heading"),
        F.col("s.text").alias("content"),
        F.col("s.url").alias("url"),
    )
    subs = s.select("*", F.explode("s.subsections").alias("u")).select(
        *common,
        F.col("u.name").alias("subsection_number"),
        joined("cap_no", "s.name", "u.name", sep="/").alias("path"),
        F.col("s.heading").alias("heading"),
        F.col("u.text").alias("content"),
        F.col("s.url").alias("url"),
    )
    return sections.unionByName(subs)


def explode_schedules(caps: DataFrame) -> DataFrame:
    """Schedules and their sections; a section's key is its name without the part up to the first `_`."""
    s = caps.select("cap_no", "language", F.explode("schedules").alias("s"))
    common = [F.col("cap_no"), F.col("language"), F.col("s.name").alias("section_number")]
    schedules = s.select(
        *common,
        F.lit(None).cast("string").alias("subsection_number"),
        joined("cap_no", "s.name", sep="/").alias("path"),
        F.col("s.heading").alias("heading"),
        F.col("s.text").alias("content"),
        F.col("s.url").alias("url"),
    )
    key = tail_of(F.col("u.name"))
    parts = s.select("*", F.explode("s.sections").alias("u")).select(
        *common,
        key.alias("subsection_number"),
        F.concat_ws("/", "cap_no", "s.name", key).alias("path"),
        F.col("u.heading").alias("heading"),
        F.col("u.text").alias("content"),
        F.col("u.url").alias("url"),
    )
    return schedules.unionByName(parts)


def drop_blank(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text isn't null or white space only."""
    return df.where(F.length(stripped(F.col(column))) > 0)


def normalise_appendix(df: DataFrame, number: str = "section_number", url: str = "url") -> DataFrame:
    """Where the number holds 'app' and a literal '_', cut number and URL at their first '_'."""
    hit = F.contains(F.col(number), F.lit("app")) & F.contains(F.col(number), F.lit("_"))
    cut = lambda c: F.when(hit, F.substring_index(F.col(c), "_", 1)).otherwise(F.col(c))
    return df.withColumns({number: cut(number), url: cut(url)})


def reject_ambiguous(df: DataFrame, group: list[str], key: list[str]) -> DataFrame:
    """All rows of groups in which no key repeats; groups with a repeated key lose all rows."""
    bad = df.groupBy(*group, *key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*group).distinct()
    return df.join(bad, group, "left_anti")


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def dedupe_first(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in a stated order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def first_terms(caps: DataFrame) -> DataFrame:
    """Each cap's terms in array order, the first of equal ones."""
    t = caps.select("cap_no", "language", F.posexplode("interpretations").alias("pos", "i"))
    t = t.select("cap_no", "language", "pos", F.col("i.term").alias("term"), F.col("i.text").alias("definition"))
    return dedupe_first(t, ["cap_no", "language", "term"], ["pos"])


def skip_existing(new: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` whose key isn't in `base`. Null keys match nothing and stay."""
    return new.join(base.select(*keys).distinct(), keys, "left_anti")


def append_new(base: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """`base` and the batch's rows with absent keys."""
    return base.unionByName(skip_existing(batch, base, keys), allowMissingColumns=True)


def upsert_by_key(base: DataFrame, batch: DataFrame, keys: list[str], null_flag: str | None = None) -> DataFrame:
    """Merge or insert: the batch's non-null columns override by key, new keys are added.

    `null_flag` names a batch column with an array of the columns to be set to null on purpose. A key that the batch gives more
    than once must be made single before.
    """
    values = [c for c in base.columns if c not in keys]
    new = batch.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in values if c in batch.columns), F.lit(True).alias("_in"), *([F.col(null_flag).alias("_nulls")] if null_flag else []))
    j = base.join(new, keys, "full_outer")

    def merged(c: str) -> Column:
        if f"_new_{c}" not in new.columns:
            return F.col(c)
        out = F.coalesce(F.col(f"_new_{c}"), F.col(c))
        return F.when(F.coalesce(F.array_contains("_nulls", c), F.lit(False)), F.lit(None)).otherwise(out) if null_flag else out

    return j.select(*keys, *(merged(c).alias(c) for c in values))


def batch_plan(df: DataFrame, order: str, n: int, parts: int | None = None) -> DataFrame:
    """Add row_no (from 1, by the order column) and batch_no = floor((row_no - 1) / n).

    Rows are dealt by sampled ranges of the column, sorted inside them and written once with all their columns, each with its range and its place there
    (both from monotonically_increasing_id). Counts and rows are read from what was written, so they can't belong to different ranges, whichever columns are kept. Each range starts
    after the count of those before it: one row per range meets in a single task, however the keys are spread. A salt lets equal keys be dealt to several
    ranges, so a hot key is no single task either. Equal keys are numbered in an arbitrary order; nulls come first.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part, low, start, salt = (f"_{c}_of_batch_plan" for c in ("part", "low", "start", "salt"))
    salted = df.withColumn(salt, F.xxhash64(F.monotonically_increasing_id()))
    placed = salted.repartitionByRange(parts, order, salt).sortWithinPartitions(order).drop(salt)
    at = F.monotonically_increasing_id()
    placed = materialise(placed.withColumns({part: F.shiftright(at, 33), low: at.bitwiseAND(F.lit((1 << 33) - 1))}), "batches")
    counts = placed.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(start))
    # One row per range: never more than `parts`.
    out = placed.join(F.broadcast(starts), part).withColumn("row_no", F.col(start) + F.col(low) + 1)
    return out.withColumn("batch_no", F.floor((F.col("row_no") - 1) / n)).drop(part, low, start)


def union_levels(*levels: DataFrame) -> DataFrame:
    """Rows of all levels; columns that one lacks are null."""
    out = levels[0]
    for d in levels[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out
