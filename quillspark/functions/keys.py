"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def joined(*parts: Column | str, sep: str = "") -> Column:
    """Key from parts; null if any part is null."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    out = cols[0].cast("string")
    for c in cols[1:]:
        out = F.concat(out, F.lit(sep), c.cast("string"))
    return out


def blank_to(c: Column, default: str) -> Column:
    """`default` for null and ''."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def without_first(c: Column, letter: str) -> Column:
    """The text without the first occurrence of a letter."""
    return F.regexp_replace(c, f"^([^{letter}]*){letter}", "$1")


def tail_of(c: Column, sep: str = "_") -> Column:
    """What follows the first separator, '' if there is none."""
    parts = F.split(c, sep)
    return F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), sep)


def stripped(c: Column) -> Column:
    """White space of any kind cut off at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, ISO_MILLIS)


def words(text: Column) -> Column:
    """Non-empty tokens between white space."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits, without an analyser."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def links_in(text: Column) -> Column:
    """http(s) links written in a text."""
    return F.regexp_extract_all(text, F.lit(r"(https?://[^\s)\]>\"']+)"), F.lit(1))
