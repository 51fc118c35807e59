"""Declared keys, and totals of a run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def audit_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that break a declared uniqueness, with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def audit_fk(child: DataFrame, parent: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Children whose non-null foreign key has no parent; keys: child column -> parent column."""
    some = child.dropna(subset=list(keys))
    p = parent.select(*(F.col(b).alias(a) for a, b in keys.items())).distinct()
    return some.join(p, list(keys), "left_anti")


def audit_length(df: DataFrame, column: str, length: int) -> DataFrame:
    """Rows whose array column isn't of the declared length."""
    return df.where(F.coalesce(F.size(column), F.lit(-1)) != length)


def run_counts(new: DataFrame, base: DataFrame, keys: list[str], valid) -> DataFrame:
    """Totals of a load: all rows, failed a check, skipped as present, added."""
    known = base.select(*keys, F.lit(True).alias("_known")).distinct()
    j = new.join(known, keys, "left").withColumns({"_ok": F.coalesce(valid, F.lit(False)), "_has": F.coalesce("_known", F.lit(False))})
    return j.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~F.col("_ok")).alias("failed"),
        F.count_if(F.col("_ok") & F.col("_has")).alias("skipped"),
        F.count_if(F.col("_ok") & ~F.col("_has")).alias("added"),
    )


def observed_load(new: DataFrame, base: DataFrame, keys: list[str], valid, write: Callable[[DataFrame], None]) -> dict[str, int]:
    """Write the rows of a load that pass the check and have absent keys, and return the totals of `run_counts`, counted while they are written: the load is read once.

    `write` runs exactly one action on the rows it gets. The counts are of that action, so they tell of what was written, not of a second look at the sources.
    """
    known = base.select(*keys, F.lit(True).alias("_known")).distinct()
    j = new.join(known, keys, "left").withColumns({"_ok": F.coalesce(valid, F.lit(False)), "_has": F.coalesce("_known", F.lit(False))})
    seen = Observation()
    j = j.observe(
        seen,
        F.count(F.lit(1)).alias("total"),
        F.count_if(~F.col("_ok")).alias("failed"),
        F.count_if(F.col("_ok") & F.col("_has")).alias("skipped"),
        F.count_if(F.col("_ok") & ~F.col("_has")).alias("added"),
    )
    write(j.where(F.col("_ok") & ~F.col("_has")).select(*new.columns))
    return seen.get
