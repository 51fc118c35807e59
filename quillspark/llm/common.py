"""Shared pieces of the corpus operators: table access, shared-folder tables, bounded Bloom filters."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters counted as white space by every operator here, as a Java/Python character class.
SPACE = r"\x20\x09-\x0D"

#: Upper bound of a broadcast Bloom filter: 2^21 words of 64 bits (16 MB of bits), whatever the input size.
MAX_BLOOM_WORDS = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a local session has its own; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "/tmp/checkpoints/quillspark"
    return path.rstrip("/")


def fresh(columns: list[str], *names: str) -> list[str]:
    """Column names like `names` that none of `columns` has (in any case), so that helper columns never meet the caller's."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def materialise(df: DataFrame, label: str, folders: str | None = None) -> DataFrame:
    """Write `df` as Parquet in the shared folder, by a column's `folders` if one is named, and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=folders)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables written by `materialise`, once all that was derived from them is written too."""
    for t in tables:
        path = getattr(t, "_shared_path", None)
        if path:
            spark = t.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def keyed_rows(df: DataFrame, id_col: str, columns: list[str]) -> tuple[DataFrame, str]:
    """`columns` of `df`, and the name of a whole-number column among them that tells all rows apart and is never null.

    That is `id_col` where no id is null or repeated, which an aggregate of the ids alone finds out. Else the rows are numbered and written
    with their numbers, so that a row keeps its number whenever it's read.
    """
    ids = df.groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    if ids.where("n > 1 or id is null").isEmpty():
        return df.select(*columns), id_col
    (key,) = fresh(columns, "row_key")
    return materialise(df.select(*columns).withColumn(key, F.monotonically_increasing_id()), "numbered-rows"), key


def bloom_words(n_rows: int, bits_per_row: int = 16) -> int:
    """Number of 64-bit words for `n_rows` keys: a power of two, never more than MAX_BLOOM_WORDS."""
    words = 64
    while words * 64 < n_rows * bits_per_row and words < MAX_BLOOM_WORDS:
        words *= 2
    return words


def bloom_word(key_hash: Column, words: int) -> Column:
    return F.shiftright(key_hash, 40).bitwiseAND(F.lit(words - 1)).cast("int")


def bloom_mask(key_hash: Column) -> Column:
    """Four bits of one 64-bit word, from the low 24 bits of the key's hash."""
    one = F.lit(1).cast("bigint")
    bits = [F.shiftright(key_hash, 6 * k).bitwiseAND(F.lit(63)).cast("int") for k in range(4)]
    parts = [F.call_function("shiftleft", one, b) for b in bits]
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out


def bloom_filter(keys: DataFrame, key_hash: Column, words: int) -> DataFrame:
    """A blocked Bloom filter as a table (word, bits) of at most `words` rows."""
    rows = keys.select(bloom_word(key_hash, words).alias("word"), bloom_mask(key_hash).alias("m"))
    return rows.groupBy("word").agg(F.bit_or("m").alias("bits"))


def maybe_in(df: DataFrame, key_hash: Column, filt: DataFrame, words: int, flag: str) -> DataFrame:
    """Add boolean `flag`: false means the key is surely not in `filt`. The filter has at most MAX_BLOOM_WORDS rows."""
    word, mask, bits = fresh([*df.columns, flag], "bf_word", "bf_mask", "bf_bits")
    probe = df.withColumns({word: bloom_word(key_hash, words), mask: bloom_mask(key_hash)})
    hit = F.coalesce(F.col(bits).bitwiseAND(F.col(mask)) == F.col(mask), F.lit(False))
    small = filt.select(F.col("word").alias(word), F.col("bits").alias(bits))
    return probe.join(F.broadcast(small), word, "left").withColumn(flag, hit).drop(word, mask, bits)


def semi_by_bloom(df: DataFrame, key: str, wanted: DataFrame, n_wanted: int) -> DataFrame:
    """Rows of `df` whose `key` may be in `wanted[key]` (no false negatives): shrinks what a later join shuffles."""
    words = bloom_words(n_wanted)
    h = F.xxhash64(F.col(key).cast("bigint"))
    (flag,) = fresh(df.columns, "bf_hit")
    return maybe_in(df, h, bloom_filter(wanted, h, words), words, flag).where(F.col(flag)).drop(flag)


def anti_by_bloom(df: DataFrame, key: str, lost: DataFrame, n_lost: int) -> DataFrame:
    """Rows of `df` whose `key` isn't in `lost[key]`: only rows that may be in it are shuffled, the rest pass straight through."""
    words = bloom_words(n_lost)
    h = F.xxhash64(F.col(key).cast("bigint"))
    (flag,) = fresh(df.columns, "bf_hit")
    flagged = maybe_in(df, h, bloom_filter(lost, h, words), words, flag)
    tested = flagged.where(F.col(flag)).join(lost.select(key).distinct(), key, "left_anti")
    return flagged.where(~F.col(flag)).unionByName(tested).select(*df.columns)


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], by: str, salts: int = 16) -> DataFrame:
    """Inner join of `rows` to one row per group, salted by `by`: a group may hold any share of the rows."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    copies = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies.hint("merge"), [*keys, "_salt"]).drop("_salt")


#: A group with over this share of all rows of its join is hot. As sizes add up to the rows, fewer than 1 / HOT_SHARE groups are.
HOT_SHARE = 1e-3


def join_by_size(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, how: str = "inner") -> DataFrame:
    """Join (inner, left or left_semi) of `rows` to one row per group, whose column `size` counts the group's rows. A group may hold any share of the rows.

    Hot groups, fewer than 1 / HOT_SHARE at any input size, are broadcast, so their rows aren't shuffled; no other group has over HOT_SHARE of the
    rows, and these meet in a shuffle. `rows` is read twice, so it should be a written table.
    """
    groups = materialise(groups, "groups")
    least = (groups.agg(F.sum(size)).first()[0] or 0) * HOT_SHARE
    hot = groups.where(F.col(size) > F.lit(least))
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys, "inner" if how == "left" else how).unionByName(rest.join(groups.where(F.col(size) <= F.lit(least)).hint("merge"), keys, how))


# --- numpy helpers used inside tasks ---------------------------------------------------------------------------------

#: Odd 64-bit multipliers of the two multiplicative hash steps.
MULT_A = np.uint64(0x9E3779B97F4A7C15)
MULT_B = np.uint64(0xD6E8FEB86659FD93)
_S32 = np.uint64(32)


def mix64(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that their order and low bits look random."""
    h = (h ^ (h >> _S32)) * MULT_B
    h = (h ^ (h >> _S32)) * MULT_A
    return h ^ (h >> _S32)


def give_back() -> None:
    """Return freed memory to the system: Python workers live through many tasks, and what one task's arrays held would stay with them."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only in glibc
    if trim is not None:
        trim(0)


def pieces(batches, rows: int = 512):
    """Arrow batches in slices of at most `rows`, so that a task's Python copies of texts stay small; freed memory is given back at both ends of a task."""
    give_back()
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
    give_back()


def in_pieces(f, kind, *columns, rows: int = 512):
    """An Arrow array of type `kind`: what `f` makes of the columns' values, given to it as lists of at most `rows`; freed memory is given back at the end."""
    import pyarrow as pa

    out = [pa.array(f(*(c.slice(i, rows).to_pylist() for c in columns)), kind) for i in range(0, len(columns[0]), rows)]
    give_back()
    return pa.concat_arrays(out) if out else pa.array([], kind)


def texts_of(batch) -> list[str]:
    """The second column of an Arrow batch as strings, null as empty."""
    return [t if t is not None else "" for t in batch.column(1).to_pylist()]


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash, remembered up to `limit` words."""

    limit = 100_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_WORDS = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of k neighbours."""
    acc = h[: len(h) - k + 1]
    for j in range(1, k):
        acc = acc * MULT_A + h[j : len(h) - k + 1 + j]
    return mix64(acc)
