"""Operator 3: pack documents into sequences of at most `window` tokens by best-fit decreasing.

A task packs its own partition in pools of about `POOL_WINDOWS` windows, so no shuffle is needed and memory is bounded:
1. a document's ids and one end id are cut into full windows; each full window is a sequence of its own;
2. the remainders, longest first, each go to the open window with the least room that still holds them. A segment tree
   indexed by remaining capacity counts the open windows with each capacity and finds the tightest in O(log window);
3. the least filled windows are then taken apart to fill the others' gaps (pieces may be cut freely), and what is left
   in the end goes into sequences whose lengths are powers of two, which need no padding.

Defined cases: a null or empty text is its end id alone. Very long texts, of white space too, are encoded whole. Repeated rows are packed once each. An empty table gives no
rows. Only the id and text columns are read. Results depend on how the rows are dealt to partitions, and a task that is
run again on the same rows gives the same result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import pieces, texts_of
from .tokens import encoder

POOL_WINDOWS = 4096
SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """Segment tree over capacities 0..window: how many open windows have each, and the least capacity >= x in use."""

    def __init__(self, window: int):
        self.size = 1 << (window + 1).bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, by: int) -> None:
        i = capacity + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def tightest(self, need: int) -> int:
        """The least capacity >= need that an open window has, or -1."""
        i = need + self.size
        if self.count[i]:
            return need
        while i > 1:  # climb until a right sibling holds something, then go down its left edge
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def best_fit(lengths: list[int], window: int) -> list[list[int]]:
    """Best-fit decreasing: windows as lists of indexes into `lengths` (each 1..window)."""
    tree, open_at, windows = CapacityTree(window), [[] for _ in range(window + 1)], []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        room = tree.tightest(lengths[k])
        if room < 0:
            room, w = window, len(windows)
            windows.append([])
        else:
            w = open_at[room].pop()
            tree.add(room, -1)
        windows[w].append(k)
        if room > lengths[k]:
            open_at[room - lengths[k]].append(w)
            tree.add(room - lengths[k], 1)
    return windows


def fill_gaps(windows: list[list[tuple[int, int, int]]], window: int) -> list[list[tuple[int, int, int]]]:
    """Empty the least filled windows into the others' gaps; pieces are (document, start, length) and may be cut."""
    filled = lambda w: sum(p[2] for p in w)
    order = sorted(windows, key=filled, reverse=True)
    total = sum(map(filled, order))
    keep, spare = order[: total // window], [p for w in order[total // window :] for p in w]
    for w in keep:
        room = window - filled(w)
        while room:
            doc, start, n = spare.pop()
            take = min(room, n)
            w.append((doc, start, take))
            room -= take
            if take < n:
                spare.append((doc, start + take, n - take))
    size = window
    left = sum(p[2] for p in spare)
    while left:  # the rest: sequences of 2^k tokens
        while size > left or size & (size - 1):
            size = size & (size - 1) if size & (size - 1) else size // 2
        w, room = [], size
        while room:
            doc, start, n = spare.pop()
            take = min(room, n)
            w.append((doc, start, take))
            room -= take
            if take < n:
                spare.append((doc, start + take, n - take))
        keep.append(w)
        left -= size
    return keep


def pack_documents(
    df: DataFrame,
    json_path: str,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 2048,
    end_id: int = 1,
) -> DataFrame:
    """One row per piece: `id_col`, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        enc = encoder(json_path, ranks_path, pattern)
        names = [id_col, *(c.split()[0] for c in SCHEMA.split(", "))]
        part, made, pool, held = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal made
            rest = [(k, len(ids) - len(ids) % window) for k, (_, ids) in enumerate(pool)]
            rest = [(k, s, len(pool[k][1]) - s) for k, s in rest if s < len(pool[k][1])]
            seqs = [[(k, s, window)] for k, (_, ids) in enumerate(pool) for s in range(0, len(ids) - window + 1, window)]
            seqs += fill_gaps([[rest[i] for i in w] for w in best_fit([r[2] for r in rest], window)], window)
            rows = []
            for w in seqs:
                at = 0
                for k, s, n in w:
                    doc, ids = pool[k]
                    rows.append((doc, s, n, zlib.crc32(ids[s : s + n].astype("<u4").tobytes()), len(ids), part << 33 | made, at))
                    at += n
                made += 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

        for b in pieces(batches):
            for doc, text in zip(b.column(0).to_pylist(), texts_of(b), strict=True):
                ids = np.append(enc.encode(text), np.uint32(end_id))
                pool.append((doc, ids))
                held += len(ids)
                if held >= POOL_WINDOWS * window:
                    yield flush()
                    pool, held = [], 0
        if pool:
            yield flush()

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} long, {SCHEMA}")
