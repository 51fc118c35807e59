"""The most similar vectors, on arrays: blocks of rows meet blocks of queries, and each block gives only what can be among a query's best."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import meet, packed, unpack, written

#: Rows and queries in a block, and rows that are scored at once.
ROWS, QUERIES, CHUNK = 1 << 13, 1 << 10, 1 << 11
#: Scores are rounded to 6 places; what is found by a matrix product gets a little more room than that.
HALF, ROOM = 0.5e-6, 1e-9


class Vectors:
    """A column of vectors as rows of doubles, with their lengths and norms. A missing vector, or one that lacks a number, is zero."""

    def __init__(self, column: pa.ChunkedArray | pa.Array):
        c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        self.size = pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = c.flatten()
        n, dims = len(c), int(self.size.max(initial=0))
        bad = np.zeros(n, bool)
        if flat.null_count or not (self.size == dims).all():
            row = np.repeat(np.arange(n), self.size)
            self.rows = np.zeros((n, dims))
            self.rows[row, np.arange(len(flat)) - np.repeat(np.cumsum(self.size) - self.size, self.size)] = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)
            bad[row[flat.is_null().to_numpy(zero_copy_only=False)]] = True
            self.rows[bad] = 0
        else:
            self.rows = flat.to_numpy(zero_copy_only=False).astype(float).reshape(n, dims)
        self.norm = np.sqrt(self._sum(lambda d: self.rows[:, d] * self.rows[:, d], n))
        self.codes: np.ndarray | None = None

    def _sum(self, part: Callable, n: int) -> np.ndarray:
        total = np.zeros(n)
        for d in range(self.rows.shape[1]):
            total += part(d)
        return total

    def widened(self, dims: int) -> Vectors:
        if self.rows.shape[1] < dims:
            self.rows = np.pad(self.rows, ((0, 0), (0, dims - self.rows.shape[1])))
        return self

    def taken(self, order: np.ndarray) -> Vectors:
        self.rows, self.size, self.norm = self.rows[order], self.size[order], self.norm[order]
        return self

    @property
    def unit(self) -> np.ndarray:
        with np.errstate(all="ignore"):
            return np.where(self.norm[:, None] > 0, self.rows / self.norm[:, None], np.where(np.isnan(self.norm)[:, None], np.nan, 0.0))


def exact(a: Vectors, b: Vectors, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of the pairs (i, j), summed in the order of the dimensions, as `retrieval.cosine` gives them; -inf where lengths differ."""
    at, bt, total = a.rows.T, b.rows.T, np.zeros(len(i))
    for d in range(a.rows.shape[1]):
        total += at[d][i] * bt[d][j]
    norms = a.norm[i] * b.norm[j]
    zero = norms == 0
    with np.errstate(all="ignore"):
        score = rounded(np.where(zero, 0.0, total / np.where(zero, 1.0, norms)))
    return np.where(~zero & (a.size[i] != b.size[j]), -np.inf, score)


def rounded(x: np.ndarray) -> np.ndarray:
    """To 6 places, halves of the written number away from zero, as Spark rounds."""
    out = np.array(x, float)
    at = np.flatnonzero(np.isfinite(out))
    y = np.abs(out[at]) * 1e6
    low = np.floor(y)
    near = at[np.abs(y - low - 0.5) < 1e-7]
    out[at] = np.sign(out[at]) * (low + (y - low >= 0.5)) / 1e6 + 0.0
    for i in near:
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out


def _leading(group: np.ndarray, keys: tuple, top: int) -> np.ndarray:
    """Places of the first `top` of each group by `keys`, most important first."""
    order = np.lexsort((*keys[::-1], group))
    g = group[order]
    new = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    place = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
    return order[place < top]


class _Best:
    """The `top` best scores of each query of a block so far."""

    def __init__(self, queries: int, top: int):
        self.scores, self.top = np.full((queries, top), -np.inf), top
        self.count = np.zeros(queries, np.int64)

    def least(self) -> np.ndarray:
        """What a score must reach, -inf with fewer than `top`."""
        return np.where(self.count >= self.top, self.scores[:, -1], -np.inf)

    def add(self, i: np.ndarray, score: np.ndarray) -> None:
        asked = np.unique(i)
        if not len(asked):
            return
        n = np.bincount(i, minlength=len(self.count))
        group = np.concatenate([np.repeat(asked, self.top), i])
        value = np.concatenate([self.scores[asked].ravel(), np.where(np.isnan(score), np.inf, score)])
        kept = _leading(group, (-value,), self.top)
        self.scores[asked] = value[kept].reshape(-1, self.top)
        self.count += n


def nearest(
    queries: DataFrame, corpus: DataFrame, top: int, query: str, q_vec: str, doc: str, vec: str, wanted: Callable | None = None, extra: tuple[str, ...] = (), allowed: Callable | None = None
) -> DataFrame:
    """(query, doc, score): of every pair of blocks the hits that can be among the `top` best, by score and least document.

    The queries are written in blocks; the corpus is read in blocks and isn't written. With `wanted`, the corpus has a column `list`, and wanted(block of queries, Vectors) tells by a matrix (queries x lists) which lists each asks;
    `extra` are columns of the queries that it needs. allowed(Vectors of queries, Vectors of rows) gives a test of pairs (i, j) that may be hits.
    """
    kinds = [f"`{query}` {queries.schema[query].dataType.simpleString()}", f"`{doc}` {corpus.schema[doc].dataType.simpleString()}", "score double"]
    asked = written(queries.select(query, q_vec, *extra), QUERIES, "queries").select(F.monotonically_increasing_id().alias("id"), F.col("data").alias("asked"))
    rows = packed(corpus.select(doc, vec, *(["list"] if wanted else [])), ROWS).withColumn("at", F.monotonically_increasing_id())

    def opened(data: bytes) -> tuple:
        t = unpack(data).combine_chunks()
        # Rows in the order of their documents, and of their lists before that.
        keys = [("list", "ascending")] * bool(wanted) + [(doc, "ascending")]
        t = t.take(pc.sort_indices(t, sort_keys=keys, null_placement="at_start")).combine_chunks()
        rank = np.empty(len(t), np.int64)
        rank[pc.sort_indices(t, sort_keys=[(doc, "ascending")], null_placement="at_start").to_numpy()] = np.arange(len(t))
        return t, Vectors(t[vec]), rank

    def block(q: pa.Table, u: Vectors, asks: np.ndarray | None, best: _Best, t: pa.Table, v: Vectors, rank: np.ndarray) -> pa.RecordBatch:
        dims = max(u.rows.shape[1], v.rows.shape[1])
        u, v = u.widened(dims), v.widened(dims)
        uneven = (u.size != dims).any() or (v.size != dims).any()
        left, right = u.unit, v.unit
        lists = t["list"].to_numpy() if wanted else np.zeros(len(t), np.int64)
        may = allowed(u, v) if allowed else None
        cuts = sorted({*range(0, len(t), CHUNK), *(np.flatnonzero(lists[1:] != lists[:-1]) + 1).tolist(), len(t)})
        found, own = [], _Best(len(q), top)
        for a, b in zip(cuts[:-1], cuts[1:]):
            who = np.arange(len(q)) if asks is None else np.flatnonzero(asks[:, lists[a]])
            if not len(who):
                continue
            near = (left if asks is None else left[who]) @ right[a:b].T
            if uneven:
                near[(u.size[who][:, None] != v.size[a:b]) & (u.norm[who][:, None] * v.norm[a:b] != 0)] = -np.inf
            least = best.least()[who] - HALF - ROOM
            # Inside a list documents rise, so later rows must be better than the best of the block.
            if asks is None:
                least = np.maximum(least, own.least() + HALF - ROOM)
            open_ = np.flatnonzero(best.count[who] < top)
            if len(open_):
                some = near[open_]
                if may:
                    i, j = np.nonzero(np.ones_like(some, bool))
                    some[i[~(ok := may(who[open_][i], j + a))], j[~ok]] = -np.inf
                k = min(top, b - a)
                kth = np.partition(some, b - a - k, axis=1)[:, b - a - k]
                least[open_] = np.maximum(least[open_], kth - 2 * HALF - 2 * ROOM if k == top else -np.inf)
            i, j = np.nonzero(~(near < least[:, None]))
            i, j = who[i], j + a
            if may and len(i):
                ok = may(i, j)
                i, j = i[ok], j[ok]
            score = exact(u, v, i, j)
            best.add(i, score)
            if asks is None:
                own.add(i, score)
            found.append((i, j, score))
        i, j, score = (np.concatenate(x) if found else np.zeros(0, kind) for x, kind in zip(zip(*found) if found else ((),) * 3, (np.int64, np.int64, float)))
        value = np.where(np.isnan(score), np.inf, score)
        kept = np.flatnonzero(value >= best.least()[i])
        kept = kept[_leading(i[kept], (-value[kept], rank[j[kept]]), top)]
        i, j, score = i[kept], j[kept], score[kept]
        return pa.RecordBatch.from_arrays([q[query].combine_chunks().take(pa.array(i)), t[doc].combine_chunks().take(pa.array(j)), pa.array(score, mask=score == -np.inf)], names=[query, doc, "score"])

    def run(batches: Iterator) -> Iterator:
        known: dict[int, tuple] = {}
        last, rows = None, ()
        for b in batches:
            for data, at, i, ask in zip(b.column("data"), b.column("at").to_pylist(), b.column("id").to_pylist(), b.column("asked")):
                if at != last:
                    last, rows = at, opened(data)
                if i not in known:
                    q = unpack(ask).combine_chunks()
                    u = Vectors(q[q_vec])
                    known[i] = (q, u, wanted(q, u) if wanted else None, _Best(len(q), top))
                yield block(*known[i], *rows)

    return meet(rows, asked).mapInArrow(run, ", ".join(kinds))
