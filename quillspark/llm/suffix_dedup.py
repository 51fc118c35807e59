"""Operator 10: remove every byte that a repeated passage of `length` bytes covers.

1. Anchors. The anchor of a window of `length` bytes is its 24-byte string with the least hash, so equal windows have equal anchors in
   equal places. Neighbouring windows with one anchor make a run (about 90 windows). Runs of an anchor that occurs
   once repeat nothing. Runs that are equal as a whole repeat in all their windows. These are exact rules; what is left are
   runs that share an anchor and differ, mostly next to edits and to the ends of copied passages. Runs that one text has several times (lines said
   over and over) are known there at once: they stay as united ranges, and each kind meets the other texts as one row with its count.
2. Suffix order. One copy of each distinct run of such an anchor is dealt by anchor to buckets of about half a megabyte, and each bucket is sorted
   by the difference-cover algorithm (difference_cover.py): sort sampled triples, recurse on their names, merge the remaining suffixes. Windows that are
   neighbours in that order are compared over their `length` bytes.
3. Hot anchors, whose distinct runs have over HOT_BYTES, don't go to one bucket. Their runs are cut into blocks of windows with like offsets
   to the anchor. A block whose core (the bytes that all its windows share) is unique repeats nothing, one that is equal to another as a whole repeats
   in all its windows, and only the others are cut finer, down to single windows. Counts are grouped sums, so an anchor may have any share of the rows.
4. The windows found are gathered per document, and only documents that have some are shuffled to meet them.

Positions and counts are judged on the input. Matches never cross documents. Hashes of anchor and run are 64 bits each and must both agree.

Defined cases: null and empty texts have no bytes and lose none; texts shorter than `length` lose none; a passage that repeats inside one text counts;
repeated rows remove each other wholly (from `length` bytes on); rows with one id, or none, and several texts are judged each for itself. Very long texts are read in overlapping blocks. An empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bloom_filter, bloom_words, fresh, give_back, in_pieces, join_by_size, keyed_rows, materialise, maybe_in, mix64, pieces, release, semi_by_bloom
from .difference_cover import repeated_windows

GRAM = 24
BLOCK = 1 << 18
BUCKET_BYTES = 1 << 19
HOT_BYTES = 1 << 16
#: Windows in a block of a hot anchor's runs, from coarse to fine.
WIDTHS = (24, 4, 1)

_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))
_BASE = np.uint64(0xA0761D6478BD642F)
_BASE2 = np.uint64(0xE7037ED1A0B428DB)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(n, base, np.uint64))])


_POW = _powers(_BASE, 2 * BLOCK)


def _grams(h: np.ndarray) -> np.ndarray:
    """Hashes of all GRAM-byte strings, from the bytes' hashes."""
    x = h[:-1] * _POW[1] + h[1:]
    x = x[:-2] * _POW[2] + x[2:]
    e = x[:-4] * _POW[4] + x[4:]
    return mix64(e[:-16] * _POW[16] + e[8:-8] * _POW[8] + e[16:])


def _runs_of_block(b: np.ndarray, length: int):
    """(start, windows, anchor, run) arrays of one block of at least `length` bytes."""
    h = _BYTE[b]
    g = _grams(h)
    wide = length - GRAM + 1
    where = np.uint64(2 * BLOCK - 1)
    least = (g & ~where) | np.arange(len(g), dtype=np.uint64)  # ties: the leftmost
    w = 1
    while 2 * w <= wide:
        least = np.minimum(least[:-w], least[w:])
        w *= 2
    if w < wide:
        least = np.minimum(least[: len(least) - (wide - w)], least[wide - w :])
    pos = (least & where).astype(np.int64)
    start = np.concatenate([[0], np.flatnonzero(pos[1:] != pos[:-1]) + 1])
    count = np.diff(np.append(start, len(pos)))
    end = start + count - 1 + length
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _POW[: len(h)], dtype=np.uint64)])
    run = mix64((sums[end] - sums[start]) * _POW[len(_POW) - 1 - start] + (end - start).astype(np.uint64) * _BASE2)
    return start, count, g[pos[start]], run


def runs(data: bytes, length: int):
    """(start, windows, anchor, run) of a text's windows, in text order."""
    b = np.frombuffer(data, np.uint8)
    out = [
        (s + at, c, a, r)
        for at in range(0, max(0, len(b) - length + 1), BLOCK)
        for s, c, a, r in [_runs_of_block(b[at : at + BLOCK + length - 1], length)]
    ]
    if not out:
        e = np.empty(0, np.int64)
        return e, e, e.astype(np.uint64), e.astype(np.uint64)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def blocks_of_runs(data: list[bytes], n: np.ndarray, anchors: np.ndarray, length: int, widths: tuple[int, ...] = WIDTHS):
    """The windows of many runs as nested blocks: of widths[0] windows, each cut into blocks of widths[1], and so on.

    For each width (run, block, at, m, full, core, window): the block's run, its number, first window, windows, two hashes, and its first window among those of all runs.
    Blocks are aligned by the offset to the run's anchor, so equal windows of two runs lie in equal blocks. `full` is the hash of a
    block's bytes, `core` that of the bytes which any window of such a block has; for single windows both are the window.
    """
    h = _BYTE[np.frombuffer(b"".join(data), np.uint8)]
    size = n + length - 1
    base = np.cumsum(size) - size
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _POW[np.arange(len(h)) - np.repeat(base, size)], dtype=np.uint64)])
    hashed = lambda r, x, y: mix64((sums[base[r] + y] - sums[base[r] + x]) * _POW[2048 - x] + (y - x).astype(np.uint64) * _BASE2).view(np.int64)
    # The leftmost place of the anchor in its run.
    there = np.flatnonzero(_grams(h) == np.repeat(anchors, size)[: len(h) - GRAM + 1])
    anchor = there[np.searchsorted(there, base)] - base
    run = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    for w in widths:
        block = (anchor[run] - inside) // w
        begins = np.ones(len(run), bool)
        begins[1:] = (run[1:] != run[:-1]) | (block[1:] != block[:-1])
        first = np.flatnonzero(begins)
        m = np.diff(np.append(first, len(run)))
        r, at, number = run[first], inside[first], block[first]
        core = anchor[r] - number * w
        yield r, number, at, m, hashed(r, at, at + m - 1 + length), hashed(r, core, core - w + 1 + length), first


def _bytes(batch) -> list[bytes]:
    return [t.encode() if t is not None else b"" for t in batch.column(1).to_pylist()]


def _kinds(which: np.ndarray, s: np.ndarray, n: np.ndarray, anchor: np.ndarray, run: np.ndarray):
    """Of runs in text order, `which` telling texts apart: (first, k, a, b).

    `first` are the runs that stand first of their kind in their text, `k` how often the text has the kind. The runs of kinds with several places
    in one text are those from a to b (included); each such range goes as far as their windows touch.
    """
    order = np.lexsort((run, anchor, which))  # stable: of each kind, the first place leads
    x, y = order[1:], order[:-1]
    begins = np.ones(len(order), bool)
    begins[1:] = (run[x] != run[y]) | (anchor[x] != anchor[y]) | (which[x] != which[y])
    lead = np.flatnonzero(begins)
    k = np.diff(np.append(lead, len(order)))
    again = np.empty(len(order), bool)
    again[order] = np.repeat(k > 1, k)
    hit = np.flatnonzero(again)
    apart = (which[hit[1:]] != which[hit[:-1]]) | (s[hit[1:]] != s[hit[:-1]] + n[hit[:-1]])
    ends = np.concatenate([[True], apart, [True]]) if len(hit) else np.zeros(1, bool)
    return order[lead], k, hit[ends[:-1]], hit[ends[1:]]


def occurrences(df: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, s, n, anchor, run, k): each kind of run that a text has, once, at its first place, with the number k of its places there.

    Rows with k = 0 and no anchor are ranges of windows that are known to repeat, as the text itself has their runs several times.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in pieces(batches):
            ids, parts = b.column(0).to_pylist(), [runs(t, length) for t in _bytes(b)]
            if not parts:
                continue
            s, n, a, r = (np.concatenate([p[k] for p in parts]) for k in range(4))
            which = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
            first, k, begin, end = _kinds(which, s, n, a, r)
            doc = np.array(ids, np.int64)[which]
            at = np.concatenate([first, begin])
            windows = np.concatenate([n[first], s[end] + n[end] - s[begin]])
            k = np.concatenate([k, np.zeros(len(begin), k.dtype)])
            for i in range(0, len(at), 100_000):
                j = at[i : i + 100_000]
                m, known = k[i : i + 100_000], k[i : i + 100_000] == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc[j]),
                        pa.array(s[j].astype(np.int32)),
                        pa.array(windows[i : i + 100_000].astype(np.int32)),
                        pa.array(a[j].view(np.int64), mask=known),
                        pa.array(r[j].view(np.int64), mask=known),
                        pa.array(m.astype(np.int32)),
                    ],
                    names=["doc", "s", "n", "anchor", "run", "k"],
                )

    return df.select(id_col, text_col).mapInArrow(run, "doc long, s int, n int, anchor long, run long, k int")


def _strings(texts: DataFrame, length: int) -> DataFrame:
    """Rows (doc, text, items array<struct<s,n,anchor,...>>) -> the items with their bytes."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["doc", "s", "n", "anchor", "c", "hot", "bucket", "data"]
        for b in pieces(batches):
            rows = [
                (doc, i["s"], i["n"], i["anchor"], i["c"], i["hot"], i["bucket"], t[i["s"] : i["s"] + i["n"] + length - 1])
                for doc, t, items in zip(b.column(0).to_pylist(), _bytes(b), b.column(2).to_pylist(), strict=True)
                for i in items
            ]
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return texts.mapInArrow(run, "doc long, s int, n int, anchor long, c long, hot boolean, bucket int, data binary")


def _by_suffix_order(strings: DataFrame, length: int) -> DataFrame:
    def run(pdf):
        import pandas as pd

        text = np.frombuffer(b"".join(pdf["data"]), np.uint8)
        n = pdf["n"].to_numpy().astype(np.int64)
        base = np.concatenate([[0], np.cumsum(n + length - 1)[:-1]])
        which = np.repeat(np.arange(len(n)), n)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        again = repeated_windows(text, base[which] + inside, length) & (pdf["c"].to_numpy() == 1)[which]
        # Neighbouring windows of a run become one range.
        hit = np.flatnonzero(again)
        begins = np.ones(len(hit), bool)
        begins[1:] = (hit[1:] != hit[:-1] + 1) | (which[hit[1:]] != which[hit[:-1]])
        first = hit[begins]
        last = hit[np.append(np.flatnonzero(begins)[1:] - 1, len(hit) - 1)] if len(hit) else hit
        row, s = which[first], pdf["s"].to_numpy().astype(np.int64)
        out = pd.DataFrame({"doc": pdf["doc"].to_numpy()[row], "a": s[row] + inside[first], "b": s[row] + inside[last] + 1})
        del text, base, which, inside, again, hit, row, first, last
        give_back()
        return out

    return strings.groupBy("bucket").applyInPandas(run, "doc long, a long, b long")


def _block_type(levels: int) -> str:
    """Spark type of a block with `levels` finer levels."""
    ddl = ""
    for k in range(levels + 1):
        ddl = "struct<block:int,at:int,m:int,full:bigint,core:bigint" + (f",finer:array<{ddl}>>" if k else ">")
    return ddl


def _blocks(strings: DataFrame, length: int) -> DataFrame:
    """(doc, s, anchor, c, b): the widest blocks of each run, with the finer ones inside."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in pieces(batches):
            if not b.num_rows:
                continue
            n, anchors = b.column(2).to_numpy().astype(np.int64), b.column(3).to_numpy().view(np.uint64)
            levels = list(blocks_of_runs(b.column(5).to_pylist(), n, anchors, length))
            inner, starts = None, None
            for r, number, at, m, full, core, first in reversed(levels):
                fields = {"block": pa.array(number.astype(np.int32)), "at": pa.array(at.astype(np.int32)), "m": pa.array(m.astype(np.int32)), "full": pa.array(full), "core": pa.array(core)}
                if inner is not None:
                    # Finer blocks never cross the border of a wider one.
                    fields["finer"] = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(starts, first), len(starts)).astype(np.int32)), inner)
                inner, starts = pa.StructArray.from_arrays(list(fields.values()), names=list(fields)), first
            at = pa.array(levels[0][0])
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in (0, 1, 3, 4)), inner], names=["doc", "s", "anchor", "c", "b"])

    return strings.select("doc", "s", "n", "anchor", "c", "data").mapInArrow(run, f"doc long, s int, anchor long, c long, b {_block_type(len(WIDTHS) - 1)}")


def _by_blocks(strings: DataFrame, length: int) -> DataFrame:
    """(doc, a, b): repeated windows of the runs of hot anchors that occur once."""
    rows, found = materialise(_blocks(strings, length), "blocks"), None
    for level in range(len(WIDTHS)):
        flat = rows.select("doc", "s", "anchor", "c", "b.*")
        core = ["anchor", "block", "core"]
        cores = flat.groupBy(*core).agg(F.count(F.lit(1)).alias("alike")).where("alike > 1")
        shared = materialise(join_by_size(flat, cores, core, "alike"), "blocks")
        wholes = shared.groupBy("anchor", "block", "full").agg(F.count(F.lit(1)).alias("k"))
        judged = materialise(join_by_size(shared, wholes, ["anchor", "block", "full"], "k"), "blocks")
        release(rows, shared)
        start = (F.col("s") + F.col("at")).cast("bigint")
        done = judged.where("k > 1 and c = 1").select("doc", start.alias("a"), (start + F.col("m")).alias("b"))
        found = done if found is None else found.unionByName(done)
        if level + 1 < len(WIDTHS):
            single = judged.where("k = 1")
            # One of each set of equal blocks goes on as a partner of the differing blocks that share its core.
            still = single.groupBy(*core).agg(F.first("alike").alias("size"))
            several = judged.where("k > 1").dropDuplicates(["anchor", "block", "full"]).withColumn("c", F.lit(2).cast("bigint"))
            partner = join_by_size(materialise(several, "blocks"), still, core, "size").drop("size")
            rows = materialise(single.unionByName(partner).select("doc", "s", "anchor", "c", F.explode("finer").alias("b")), "blocks")
    return found


def repeated_ranges(df: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, a, b): the windows starting at bytes a..b-1 of the document occur elsewhere too. Ranges may touch. Ids tell rows apart."""
    occ = materialise(occurrences(df, length, id_col, text_col), "runs")
    kinds, known = occ.where("k > 0"), occ.where("k = 0").withColumn("equal", F.lit(True))
    multi = kinds.groupBy("anchor").agg(F.sum("k").alias("times"), F.count(F.lit(1)).alias("size"), F.min("run").alias("r0"), F.max("run").alias("r1")).where("times > 1")
    multi = multi.select("anchor", "size", (F.col("r0") == F.col("r1")).alias("equal"))
    met = materialise(join_by_size(kinds, multi, ["anchor"], "size").drop("size").unionByName(known), "shared-anchors")
    release(occ)

    mixed = met.where("not equal")
    distinct = mixed.groupBy("anchor", "run").agg(F.sum("k").alias("c"), F.count_if(F.col("k") == 1).alias("size"), F.min(F.struct("doc", "s", "n")).alias("one"))
    distinct = materialise(distinct.select("anchor", "run", "c", "size", "one.*"), "distinct-runs")
    # Runs of an anchor that has no other run repeat without a look at their groups, and so do those that a text has several times; of the others, those
    # stay here whose run is repeated as a whole.
    several = distinct.where("c > 1 and size > 0").select("anchor", "run", "size")
    start = F.col("s").cast("bigint")
    ranges = lambda rows: rows.select("doc", start.alias("a"), (start + F.col("n")).alias("b"))
    easy = ranges(met.where("equal and k < 2")).unionByName(ranges(join_by_size(mixed.where("k = 1"), several, ["anchor", "run"], "size", "left_semi")))

    size = F.sum(F.col("n") + F.lit(length - 1))
    sized = materialise(distinct.groupBy("anchor").agg(size.alias("bytes"), F.count(F.lit(1)).alias("kinds")), "anchors")
    total = sized.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    buckets = max(1, -(-total // BUCKET_BYTES))
    tagged = join_by_size(distinct, sized.select("anchor", "kinds", (F.col("bytes") > HOT_BYTES).alias("hot")), ["anchor"], "kinds")
    item = F.struct("s", "n", "anchor", "c", "hot", F.pmod(F.xxhash64("anchor"), F.lit(buckets)).cast("int").alias("bucket"))
    items = materialise(tagged.groupBy(F.col("doc").alias(id_col)).agg(F.collect_list(item).alias("items")), "to-sort")
    texts = semi_by_bloom(df.select(id_col, text_col), id_col, items.select(id_col), items.count())
    fetched = texts.join(items.hint("merge"), id_col).select(F.col(id_col).alias("doc"), F.col(text_col), "items")
    strings = materialise(_strings(fetched, length), "strings")

    sorted_ = _by_suffix_order(strings.where("not hot").select("bucket", "doc", "s", "n", "c", "data"), length)
    hot = _by_blocks(strings.where("hot"), length)
    return easy.unionByName(sorted_).unionByName(hot)


def kept_bytes(data: bytes, ranges, length: int) -> tuple[bytes, int, int]:
    """What is left of a text without the bytes its ranges cover; how many go, in how many maximal runs."""
    cut = np.zeros(len(data) + 1, np.int32)
    for r in () if ranges is None else ranges:
        cut[r["a"]] += 1
        cut[r["b"] - 1 + length] -= 1
    gone = np.cumsum(cut[:-1]) > 0
    if not gone.any():
        return data, 0, 0
    starts = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), int(gone.sum()), starts


def with_ranges(df: DataFrame, ranges: DataFrame, id_col: str, columns: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """`columns` of df with the document's ranges as `name`, null where there are none: the documents that may have some, and those that surely have none, which aren't shuffled."""
    per_doc = materialise(ranges.groupBy(F.col("doc").alias(id_col)).agg(F.collect_list(F.struct("a", "b")).alias(name)), "document-ranges")
    words = bloom_words(per_doc.count())
    h = F.xxhash64(F.col(id_col).cast("bigint"))
    (flag,) = fresh([*df.columns, name], "bf_hit")
    marked = maybe_in(df.select(*columns), h, bloom_filter(per_doc.select(id_col), h, words), words, flag)
    none = F.lit(None).cast("array<struct<a:bigint,b:bigint>>")
    rest = marked.where(F.col(flag)).join(per_doc.hint("merge"), id_col, "left").select(*columns, name)
    return rest, marked.where(~F.col(flag)).select(*columns, none.alias(name))


def passage_digests(df: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `df`: `id_col`, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in pieces(batches):
            rows = []
            for t, r in zip(_bytes(b), b.column(2).to_pylist(), strict=True):
                left, gone, spans = kept_bytes(t, r, length)
                rows.append((len(t), gone, spans, hashlib.sha256(left).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())],
                names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    rows, key = keyed_rows(df, id_col, [id_col, text_col])
    (name,) = fresh(rows.columns, "ranges")
    some, none = with_ranges(rows, repeated_ranges(rows, length, key, text_col), key, rows.columns, name)
    return none.unionByName(some).select(id_col, text_col, name).mapInArrow(run, f"{id_col} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def drop_repeated_passages(df: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`df` with the repeated bytes cut out of the text column (a character cut in half goes wholly); other columns as they are. Texts without repeats don't go to Python."""

    @F.arrow_udf("string")
    def cut(text, ranges):
        left = lambda t, r: t if t is None or r is None else kept_bytes(t.encode(), r, length)[0].decode("utf-8", "ignore")
        return in_pieces(lambda ts, rs: [left(t, r) for t, r in zip(ts, rs, strict=True)], text.type, text, ranges)

    rows, key = keyed_rows(df, id_col, df.columns)
    (name,) = fresh(rows.columns, "ranges")
    some, none = with_ranges(rows, repeated_ranges(rows, length, key, text_col), key, rows.columns, name)
    return none.unionByName(some.withColumn(text_col, cut(F.col(text_col), F.col(name)))).select(*df.columns)
