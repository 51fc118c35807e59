"""Operator 13: phrase collocations by dynamic itemset counting: cyclic scans of shards in which all phrase lengths are counted side by side.

The texts are cut into words once, in slices of numbers with their own word lists, and dealt to `shards` written shards, which are scanned in turn, round after round. Words are counted from the start. A longer phrase becomes active once both
its subphrases (without the last word, without the first) have reached the threshold, and is then counted for one full cycle, so on each shard exactly once; when nothing
is active any more, all counts are whole. After each scan the counts so far are summed in a written table, and phrases that have reached the threshold are added to a filter.

The filter is what tasks know of activity: a bitmap of fixed size (at most `max_words` words of 64 bits, 16 MB), to which bits are only added. At scan t a phrase is counted if both subphrases are in the
filter, unless both were already in it at scan t - shards. So even a subphrase that the filter only seems to hold starts a phrase at one scan and ends it a cycle
later: counts are exact for whatever is counted, and false hits only cost counting. The filters of the scans between tell when a phrase's cycle began, which depends on nothing but the phrase:
its counts carry the scan that ends its cycle, and a phrase that is rare then is dropped before the sums are written. With more phrases at the threshold than the filter can tell apart it prunes less and less; results stay the same.

Scores and comparisons are in whole numbers (decimals of 38 digits where products may pass 64 bits). Phrases of a language are ranked by limited windows, so each task hands on `top` rows at most.

Defined cases: null and empty texts and texts without words add nothing; a null language is `und`; repeated rows count each time; equal scores and counts are ranked by
the phrase's UTF-8 bytes; an empty table gives no rows. Words are kept as they are, whatever characters they hold beside the separators. Only the columns named are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MAX_BLOOM_WORDS, MULT_A, bloom_words, give_back, materialise, mix64, release

LONGEST = 4
TOKEN = re.compile(rb"[.,;:!?\n-\r]|[^ \t.,;:!?\n-\r]+")
BREAKS = b".,;:!?\n\x0b\x0c\r"
#: Words and ends of pieces in a slice, which a task counts at once.
SLICE = 800_000
_LOW = np.uint64(63)


class Numbers(dict):
    """Word -> number from 1 in order of first sight; 0 is what ends a piece."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.names: list[bytes] = []
        for b in BREAKS:
            self[bytes([b])] = 0

    def __missing__(self, word: bytes) -> int:
        self.names.append(word)
        n = self[word] = len(self.names)
        return n


def hashes_of(lang: str, names: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, 0 first for what ends a piece."""
    import xxhash

    seed = lang.encode() + b"\0"
    return np.fromiter((xxhash.xxh64_intdigest(seed + w) if w else 0 for w in (b"", *names)), np.uint64, len(names) + 1)


def grown(h: np.ndarray, next_word: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one more word."""
    return mix64(h * MULT_A + next_word)


def places(h: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Word of the filter and its four bits for each hash."""
    mask = np.zeros(len(h), np.uint64)
    for k in range(4):
        mask |= np.uint64(1) << ((h >> np.uint64(6 * k)) & _LOW)
    return ((h >> np.uint64(40)) & np.uint64(n_words - 1)).astype(np.int64), mask


def holds(bits: np.ndarray | None, h: np.ndarray) -> np.ndarray:
    if bits is None or not len(h):
        return np.zeros(len(h), bool)
    at, mask = places(h, len(bits))
    return (bits[at] & mask) == mask


def equal_phrases(h: np.ndarray, ids: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct phrase of n words, its count) among the places `at`; hashes group them and words confirm it."""
    at = at[order := np.argsort(h)]
    h = h[order]
    begins = np.ones(len(h), bool)
    begins[1:] = h[1:] != h[:-1]
    if all((begins[1:] | (ids[at[1:] + j] == ids[at[:-1] + j])).all() for j in range(n)):
        first = np.flatnonzero(begins)
        return at[first], np.diff(np.append(first, len(h)))
    rows = np.stack([ids[at + j] for j in range(n)], axis=1)
    _, first, count = np.unique(rows, axis=0, return_index=True, return_counts=True)
    return at[first], count


def active_phrases(ids: np.ndarray, hashes: np.ndarray, filters: list[np.ndarray], shards: int, with_words: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(length, scans of its cycle before this one, a place of each active phrase, its count) in a run of word numbers.

    `filters`: those of this scan and of up to `shards` scans before, the newest first.
    """
    if with_words:
        count = np.bincount(ids, minlength=len(hashes))
        place = np.zeros(len(hashes), np.int64)
        place[ids[::-1]] = np.arange(len(ids))[::-1]
        seen = np.flatnonzero(count[1:]) + 1
        yield 1, 0, place[seen], count[seen]
    real = np.arange(len(hashes)) > 0
    held = [(holds(f, hashes) & real)[ids] for f in filters]
    h = hashes[ids]
    for n in range(2, LONGEST + 1):
        at = np.flatnonzero(held[0][:-1] & held[0][1:])
        longer = grown(h[at], hashes[ids[at + n - 1]])
        active = [x[at] & x[at + 1] for x in held]
        scans = np.zeros(len(at), np.int64)
        for x in active[1:]:
            scans += x
        for k in range(shards):
            live = scans == k
            if live.any():
                yield n, k, *equal_phrases(longer[live], ids, at[live], n)
        if n == LONGEST or not len(at):
            return
        size = len(held[0]) - 1
        # What a filter only seems to hold counts as held where its own subphrases are: at every scan alike.
        held = [np.zeros(size, bool) for _ in filters]
        for x, f, own in zip(held, filters, active, strict=True):
            x[at] = holds(f, longer) & own
        h = np.zeros(size, np.uint64)
        h[at] = longer


CODED = "shard int, lang string, names array<binary>, ids binary"


def _coded(rows: DataFrame, shards: int, size: int) -> DataFrame:
    """Texts of a language in slices: their distinct words, and all words as numbers into them (32 bits, 0 ends a piece). A slice has `size` of them, or one whole text more. Slices go to the shards in turn."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        turn = TaskContext.get().partitionId()
        known: dict[str, tuple[Numbers, list[np.ndarray]]] = {}
        held: dict[str, int] = {}

        def slice_of(lang: str):
            nonlocal turn
            numbers, parts = known[lang]
            ids = np.concatenate(parts)
            turn += 1
            kinds = (pa.int32(), pa.string(), pa.list_(pa.binary()), pa.binary())
            row = pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((turn % shards, lang, numbers.names, ids.tobytes()), kinds, strict=True)], names=["shard", "lang", "names", "ids"])
            numbers.clear(), parts.clear()
            held[lang] = 0
            return row

        give_back()
        for b in batches:
            column = b.column(1)
            for i, lang in enumerate(b.column(0).to_pylist()):
                numbers, parts = known.setdefault(lang, (Numbers(), []))
                tokens = TOKEN.findall(column[i].as_py().encode().lower())
                ids = np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens))
                parts += [ids, np.zeros(1, np.int32)]
                held[lang] = held.get(lang, 0) + len(ids) + 1
                if held[lang] >= size:
                    yield slice_of(lang)
        for lang in known:
            if held[lang]:
                yield slice_of(lang)
        give_back()

    return rows.select("lang", "text").mapInArrow(run, CODED)


def _scan(shard: DataFrame, filters: list, step: int, shards: int) -> DataFrame:
    """(lang, phrase, n, c, until): partial counts of the active phrases of a shard of coded slices, and the scan that ends a phrase's cycle. `filters` are broadcast, the newest first."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bits = [f.value for f in filters]
        give_back()
        for b in batches:
            for i in range(b.num_rows):
                lang, names = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                ids = np.frombuffer(b.column(2)[i].as_buffer(), np.int32)
                for n, scans, at, count in active_phrases(ids, hashes_of(lang, names), bits, shards, step < shards):
                    until = shards - 1 if n == 1 else step + shards - 1 - scans
                    words = [[names[k] for k in (ids[at + j] - 1).tolist()] for j in range(n)]
                    phrases = words[0] if n == 1 else list(map(b" ".join, zip(*words, strict=True)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(np.full(len(phrases), n, np.int32)), pa.array(count.astype(np.int64)), pa.array(np.full(len(phrases), until, np.int32))],
                        names=["lang", "phrase", "n", "c", "until"],
                    )
        give_back()

    return shard.select("lang", "names", "ids").mapInArrow(run, "lang string, phrase string, n int, c long, until int")


def _filter_words(reached: DataFrame, n_words: int) -> DataFrame:
    """(word, bits) of the filter for phrases (lang, phrase)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            langs, phrases = b.column(0).to_pylist(), [p.encode().split(b" ") for p in b.column(1).to_pylist()]
            hashes = np.zeros(b.num_rows, np.uint64)
            for lang in set(langs):
                own = [i for i, x in enumerate(langs) if x == lang]
                for n in {len(phrases[i]) for i in own}:
                    same = [i for i in own if len(phrases[i]) == n]
                    word = [hashes_of(lang, [phrases[i][j] for i in same])[1:] for j in range(n)]
                    h = word[0]
                    for w in word[1:]:
                        h = grown(h, w)
                    hashes[same] = h
            at, mask = places(hashes, n_words)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(mask.view(np.int64))], names=["word", "m"])

    return reached.select("lang", "phrase").mapInArrow(run, "word long, m long").groupBy("word").agg(F.bit_or("m").alias("bits"))


def phrase_counts(docs: DataFrame, least: int = 30, shards: int = 2, max_words: int = MAX_BLOOM_WORDS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, n, count): exact counts of all phrases of 1 to 4 words that occur `least` times; rare words are summed in rows with n = 0. Rarer words of the last scans may be in it too."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = materialise(_coded(rows, shards, SLICE), "collocation-shards", folders="shard")
    # Of each length, phrases that occur `least` times are at most one for each `least` words.
    n_tokens = (dealt.agg(F.sum(F.length("ids"))).first()[0] or 0) // 4
    n_words = min(bloom_words(3 * n_tokens // least + 1), max_words)
    filters, sent = [np.zeros(n_words, np.uint64)], []
    state: DataFrame | None = None
    step = 0
    while step < shards or not np.array_equal(filters[-1], filters[-1 - shards]):
        sent = [spark.sparkContext.broadcast(filters[-1]), *sent]
        found = _scan(dealt.where(F.col("shard") == step % shards), sent, step, shards)
        found = found.select("lang", "phrase", "n", "c", F.lit(0).cast("long").alias("before"), "until")
        if state is not None:
            # Rare words whose cycle is over go into one row for each language.
            rare = (F.col("n") < 2) & (F.col("count") < least) & (F.col("until") < step)
            kept = state.withColumns({"phrase": F.when(rare, F.lit("")).otherwise(F.col("phrase")), "n": F.when(rare, 0).otherwise(F.col("n"))})
            found = found.unionByName(kept.select("lang", "phrase", "n", F.col("count").alias("c"), F.when(F.col("n") > 0, F.col("count")).otherwise(least).alias("before"), "until"))
        new = found.groupBy("lang", "phrase", "n").agg(F.sum("c").alias("count"), F.sum("before").alias("before"), F.max("until").alias("until"))
        new = materialise(new.where((F.col("n") < 2) | (F.col("count") >= least) | (F.col("until") > step)), "collocation-counts")
        # At most n_words rows of two numbers.
        bits = _filter_words(new.where((F.col("count") >= least) & (F.col("before") < least) & F.col("n").between(1, LONGEST - 1)), n_words).toPandas()
        grown_filter = filters[-1].copy()
        grown_filter[bits["word"].to_numpy(np.int64)] |= bits["bits"].to_numpy(np.int64).view(np.uint64)
        filters = [*filters, grown_filter][-1 - shards :]
        for x in sent[shards:]:
            x.destroy()
        sent = sent[:shards]
        if state is not None:
            release(state)
        state, step = new, step + 1
    for x in sent:
        x.destroy()
    release(dealt)
    return state.select("lang", "phrase", "n", "count")


def subphrases(phrase, n) -> list:
    """All shorter stretches of two words and more."""
    word = lambda i, k: F.substring_index(F.substring_index(phrase, " ", i + k), " ", -k)
    return [F.when(n > k, word(i, k)) for k in range(2, LONGEST) for i in range(LONGEST - k + 1)]


def score_phrases(counts: DataFrame, least: int = 30, covered: int = 80) -> DataFrame:
    """Candidates that no longer one covers, with a, l, r and score of their lowest cut, and n of their language."""
    frequent = counts.where((F.col("count") >= least) & (F.col("n") > 0))
    long = frequent.where("n > 1").select("lang", "phrase", "n", F.col("count").alias("a"))
    of = lambda name, out: frequent.select("lang", F.col("phrase").alias(name), F.col("count").alias(out)).hint("merge")
    k = F.explode(F.sequence(F.lit(1), F.col("n") - 1))
    cuts = long.select("*", k.alias("k")).withColumns(
        {"head": F.expr("substring_index(phrase, ' ', k)"), "rest": F.expr("substring_index(phrase, ' ', k - n)")}
    )
    cuts = cuts.join(of("head", "l"), ["lang", "head"]).join(of("rest", "r"), ["lang", "rest"])
    score = F.expr("(cast(a as decimal(20,0)) * cast(2000000 as decimal(7,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = cuts.groupBy("lang", "phrase", "n", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b"))
    inner = long.where("n > 2").select("lang", F.explode(F.array(*subphrases(F.col("phrase"), F.col("n")))).alias("phrase"), F.col("a").alias("longer"), "n", F.col("phrase").alias("whole"))
    inner = inner.where("phrase is not null").groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(inner.hint("merge"), ["lang", "phrase"], "left")
    kept = kept.where(F.expr(f"longer is null or cast(longer as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * {int(covered)}"))
    totals = counts.where("n < 2").groupBy("lang").agg(F.sum("count").alias("words"))
    out = kept.join(totals, "lang")
    return out.select("lang", "phrase", "a", "b.l", "b.r", F.col("words").alias("n"), "b.score")


def mine_collocations(docs: DataFrame, least: int = 30, top: int = 2000, covered: int = 80, shards: int = 2, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_BLOOM_WORDS) -> DataFrame:
    """Each language's first `top` phrases: lang, rank, phrase, a, l, r, n, score."""
    scored = score_phrases(phrase_counts(docs, least, shards, max_words, text_col, lang_col), least, covered)
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
c AS MATERIALIZED (
  SELECT lang, phrase, n, count(*) AS c FROM (
    SELECT lang, len, unnest(list_transform(range(1, length(w) - len + 2), lambda i: array_to_string(w[i:i + len - 1], ' '))) AS phrase, len AS n
    FROM w, (SELECT unnest([1, 2, 3, 4]) AS len) WHERE length(w) >= len) GROUP BY ALL),
f AS MATERIALIZED (SELECT * FROM c WHERE c >= 30),
k AS (SELECT lang, phrase, n, c AS a, string_split(phrase, ' ') AS w, unnest(range(1, n)) AS k FROM f WHERE n > 1),
s AS (
  SELECT k.lang, k.phrase, k.n, a, k, h.c AS l, t.c AS r, CAST((CAST(2000000 AS HUGEINT) * a) // (CAST(h.c AS HUGEINT) + t.c) AS BIGINT) AS score
  FROM k JOIN f h ON h.lang = k.lang AND h.phrase = array_to_string(w[:k], ' ') JOIN f t ON t.lang = k.lang AND t.phrase = array_to_string(w[k + 1:], ' ')),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM s),
e AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM (
        SELECT DISTINCT lang, w, a, n, m, unnest(range(1, n - m + 2)) AS i FROM (SELECT DISTINCT lang, w, a, n, unnest(range(2, n)) AS m FROM k WHERE n > 2)) GROUP BY ALL),
words AS (SELECT lang, CAST(sum(c) AS BIGINT) AS n FROM c WHERE n = 1 GROUP BY lang),
o AS (SELECT b.lang, b.phrase, b.a, b.l, b.r, words.n AS n, b.score, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
      FROM b JOIN words ON words.lang = b.lang LEFT JOIN e ON e.lang = b.lang AND e.phrase = b.phrase WHERE cut = 1 AND NOT coalesce(100 * longer >= 80 * b.a, false))
SELECT lang, rank, phrase, a, l, r, n, score FROM o WHERE rank <= 2000
"""
