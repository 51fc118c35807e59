"""Operator 2: exact de-duplication by two passes over a Bloom filter; DataFrame functions only.

Texts are read once, for the id, length and digest of each text's normal form (all white space deleted). First pass over these rows: each 64-bit hash meets two cells of a counting Bloom
filter. The cells' counts are summed in Spark (with partial sums), and the cells met more than once are packed into bit words. Second
pass: a row whose two cells are both in that filter is possibly repeated; only such rows' ids, lengths and digests shuffle to
their group. All others pass straight through as groups of one.

A filter serves at most `RANGE_ROWS` rows and is broadcast with at most 2^21 words (common.MAX_BLOOM_WORDS). More rows are cut into ranges of the hash, each with a filter of its own and
read from a folder of its own, so that the share of rows that count as possibly repeated doesn't grow with the input. Results are exact in any case, as groups are made by SHA-256 of the normal form.
A group's keeper comes from a partial aggregate, and its members find it in a join salted by id, so a group may hold
any share of the rows.

Defined cases: null counts as empty, and all-space texts are equal to empty ones; of equal texts the one with the most code points, then the
smallest id stays, null ids last; rows repeated with one id are all in the group and all marked kept if their id is the keeper's (null is equal to null here), while
`drop_exact_copies` keeps one row of a group in any case, also where one id stands on several texts. An empty table gives no rows. Other columns aren't read by `groups_of_equal_text` and are returned untouched by `drop_exact_copies`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MAX_BLOOM_WORDS, anti_by_bloom, bloom_words, join_groups, keyed_rows, materialise

SALTS = 16
#: Rows of one range of the hash: 16 bits of the largest filter for each.
RANGE_ROWS = MAX_BLOOM_WORDS * 64 // 16
#: Deleted in turn: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def normal_form(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def _cells(h: Column, words: int) -> Column:
    """Two cells of words * 64, from the two halves of a 64-bit hash."""
    return F.array(h.bitwiseAND(F.lit(words * 64 - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(words * 64 - 1)))


def repeated_cells(hashes: DataFrame, words: int) -> DataFrame:
    """(word, bits): the cells that at least two rows of `hashes.h` meet, as bits; at most `words` rows."""
    met = (
        hashes.select(F.explode(_cells(F.col("h"), words)).alias("cell"))
        .groupBy("cell")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("cell").bitwiseAND(F.lit(63)).cast("int"))
    return met.groupBy(F.shiftright("cell", 6).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))


def maybe_repeated(digests: DataFrame, filt: DataFrame, words: int) -> DataFrame:
    """`digests` without h, and maybe: whether both cells of the row's hash are in the filter, which has at most `words` rows."""
    a, b = (_cells(F.col("h"), words)[i] for i in (0, 1))
    probe = digests.withColumns({"c0": a, "c1": b})
    for c in ("c0", "c1"):
        f = filt.select(F.col("word").alias(f"w_{c}"), F.col("bits").alias(f"b_{c}"))
        probe = probe.join(F.broadcast(f), F.shiftright(c, 6).cast("int") == F.col(f"w_{c}"), "left")
        probe = probe.withColumn(f"in_{c}", F.coalesce(F.getbit(f"b_{c}", F.col(c).bitwiseAND(F.lit(63)).cast("int")) == 1, F.lit(False)))
    return probe.withColumn("maybe", F.col("in_c0") & F.col("in_c1")).select(*(c for c in digests.columns if c != "h"), "maybe")


def groups_of_equal_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_rows: int | None = None, tie_col: str | None = None) -> DataFrame:
    """One row per row of `df`: `id_col`, keep_id, group_size, kept, text_sha256. Of equally long texts the one with the least `tie_col` stays, then the one with the least id."""
    ties = [tie_col] if tie_col is not None and tie_col != id_col else []
    n_rows = df.count() if n_rows is None else n_rows
    ranges = max(1, -(-n_rows // RANGE_ROWS))
    words = bloom_words(-(-n_rows // ranges), 16)
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), normal_form(F.col(text_col)).alias("norm"), F.coalesce(F.length(text_col), F.lit(0)).alias("len"), *(F.col(c).alias("tie") for c in ties))
    own = ["id", "len", *("tie" for _ in ties)]
    digests = rows.select(*own, F.xxhash64("norm").alias("h"), F.sha2("norm", 256).alias("sha"))
    if ranges > 1:
        digests = digests.withColumn("range", F.pmod(F.xxhash64("h"), F.lit(ranges)).cast("int"))
    digests = materialise(digests, "digests", "range" if ranges > 1 else None)
    probe = None
    for r in range(ranges):
        part = digests.where(F.col("range") == r).drop("range") if ranges > 1 else digests
        flagged = maybe_repeated(part, materialise(repeated_cells(part.select("h"), words), "repeated-cells"), words)
        probe = flagged if probe is None else probe.unionByName(flagged)

    alone = probe.where("not maybe").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), "sha")
    maybe = probe.where("maybe").select(*own, "sha")
    order = F.struct(-F.col("len"), *(f(c) for c in (*own[2:], "id") for f in (F.isnull, F.col)))
    best = maybe.groupBy("sha").agg(F.min_by("id", order).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    grouped = join_groups(maybe.select("id", "sha"), best, ["sha"], "id", SALTS).select("id", "keep_id", "group_size", "sha")
    return alone.unionByName(grouped).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`df` without the rows whose text equals a kept row's. Columns stay as they are; only rows that may go are shuffled."""
    rows, key = keyed_rows(df, id_col, df.columns)
    lost = materialise(groups_of_equal_text(rows, key, text_col, tie_col=id_col).where("not kept").select(key), "exact-copies")
    return anti_by_bloom(rows, key, lost, lost.count()).select(*df.columns)


ORACLE = r"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), h AS (
  SELECT doc_id, length(t) AS len, sha256(norm) AS text_sha256 FROM n
), k AS (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY len DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM h
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM k
"""
