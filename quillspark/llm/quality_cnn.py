"""Operator 9: a byte-level convolutional network, trained and run in numpy, scores whole documents for quality.

A document's UTF-8 bytes are cut into overlapping chunks that cover all of it. In each chunk, learned filters slide over embedded
bytes with a small stride; each filter's greatest activation is kept, and a small dense layer turns these maxima and the chunk's
length into a chunk score. The document's probability is the logistic of its chunks' mean score, weighted by length.

Training uses at most `max_rows` labelled documents, those with the least hash of their id, in one bounded collect; it is
seeded, so it gives the same weights each time. Scoring runs on the executors over all bytes of all documents.

Defined cases: null and empty texts are one chunk of padding and get a score like any text; repeated rows get equal scores; an empty
table gives no rows; with no labelled rows every score is 0.5, and with one class only the model learns that class. Ids, labels, languages and sources are not
inputs of a score. Only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_pieces, pieces

CHUNK, OVERLAP, WIDTH, STRIDE = 1024, 32, 12, 4
EMBED, FILTERS, HIDDEN = 8, 32, 24
PAD = 256


@dataclass
class Network:
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def params(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.hidden, self.hidden_bias, self.out, self.out_bias]


def new_network(rng: np.random.Generator) -> Network:
    n = lambda *s: rng.normal(size=s).astype(np.float32)
    return Network(
        n(257, EMBED) * 0.5,
        n(WIDTH * EMBED, FILTERS) / np.float32(np.sqrt(WIDTH * EMBED)),
        np.zeros(FILTERS, np.float32),
        n(FILTERS + 1, HIDDEN) / np.float32(np.sqrt(FILTERS)),
        np.zeros(HIDDEN, np.float32),
        n(HIDDEN) / np.float32(np.sqrt(HIDDEN)),
        np.zeros(1, np.float32),
    )


def chunks_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(chunks, lengths): rows of CHUNK byte values, each starting CHUNK - OVERLAP after the last; the end is padded."""
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(data) - OVERLAP) // step))
    b = np.full((n - 1) * step + CHUNK, PAD, np.int16)
    b[: len(data)] = np.frombuffer(data, np.uint8)
    rows = np.lib.stride_tricks.sliding_window_view(b, CHUNK)[::step]
    return rows, np.minimum(CHUNK, len(data) - np.arange(n) * step).astype(np.float32)


def windows_of(net: Network, chunks: np.ndarray) -> np.ndarray:
    """(chunks, windows, WIDTH * EMBED) embedded bytes under each place of a filter."""
    e = net.embed[chunks].reshape(len(chunks), CHUNK * EMBED)
    return np.lib.stride_tricks.sliding_window_view(e, WIDTH * EMBED, axis=1)[:, :: STRIDE * EMBED]


def chunk_scores(net: Network, chunks: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    x = np.ascontiguousarray(windows_of(net, chunks)).reshape(-1, WIDTH * EMBED)
    act = (x @ net.filters).reshape(len(chunks), -1, FILTERS).max(axis=1) + net.bias
    return dense(net, act, lengths)[0]


def dense(net: Network, act: np.ndarray, lengths: np.ndarray):
    z = np.concatenate([np.maximum(act, 0), np.log1p(np.maximum(lengths, 0))[:, None] / 7], axis=1)
    h = z @ net.hidden + net.hidden_bias
    return np.maximum(h, 0) @ net.out + net.out_bias[0], z, h


def score(net: Network, texts: list[str]) -> np.ndarray:
    """Probability of label 1 for each whole text."""
    out = np.zeros(len(texts))
    parts, owner = [], []
    total, weight = np.zeros(len(texts)), np.zeros(len(texts))

    def run() -> None:
        c, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        o, w = np.concatenate(owner), np.maximum(np.concatenate([p[1] for p in parts]), 1)
        for i in range(0, len(c), 32):
            j = slice(i, i + 32)
            np.add.at(total, o[j], chunk_scores(net, c[j], n[j]) * w[j])
            np.add.at(weight, o[j], w[j])

    held = 0
    for k, t in enumerate(texts):
        p = chunks_of(t.encode())
        parts.append(p)
        owner.append(np.full(len(p[1]), k))
        held += len(p[1])
        if held >= 4096:
            run()
            parts, owner, held = [], [], 0
    if parts:
        run()
    np.divide(total, np.maximum(weight, 1), out=out)
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def train(texts: list[str], labels: list[int], steps: int = 900, batch: int = 48, per_doc: int = 3, seed: int = 7) -> Network:
    """Adam on the logistic loss; each step takes `batch` documents, half of each label, and up to `per_doc` of their chunks."""
    rng = np.random.default_rng(seed)
    net = new_network(rng)
    y = np.asarray(labels, np.float32)
    if not len(y):
        net.out[:] = 0
        return net
    docs = [chunks_of(t.encode()) for t in texts]
    pools = [np.flatnonzero(y == v) for v in (0, 1)]
    pools = [p for p in pools if len(p)]
    share = float(y.mean())
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.params()]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(p, batch // len(pools)) for p in pools])
        c, n, o = [], [], []
        for row, k in enumerate(pick):
            chunks, lengths = docs[k]
            own = rng.choice(len(lengths), min(per_doc, len(lengths)), replace=False)
            c.append(chunks[own]), n.append(lengths[own]), o.append(np.full(len(own), row))
        c, n, o = np.concatenate(c), np.concatenate(n), np.concatenate(o)
        x = windows_of(net, c)
        act = np.ascontiguousarray(x).reshape(-1, WIDTH * EMBED) @ net.filters
        act = act.reshape(len(c), -1, FILTERS)
        top = act.argmax(axis=1)
        pooled = np.take_along_axis(act, top[:, None, :], 1)[:, 0] + net.bias
        s, z, h = dense(net, pooled, n)
        w = np.maximum(n, 1)
        w = w / np.bincount(o, w)[o]
        # Halves of each label in a batch: the classes' true shares come back as an offset of the logit.
        logit = np.bincount(o, s * w, len(pick))
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        ds = (((p - y[pick]) / len(pick))[o] * w).astype(np.float32)
        grad_out = np.maximum(h, 0).T @ ds
        dh = np.outer(ds, net.out) * (h > 0)
        dpool = (dh @ net.hidden.T)[:, :FILTERS] * (pooled > 0)
        seen = x[np.arange(len(c))[:, None], top]  # chunk, filter, WIDTH * EMBED
        grad_filters = np.einsum("cf,cfx->xf", dpool, seen)
        dx = (dpool[:, :, None] * net.filters.T[None]).reshape(-1, EMBED)
        at = c[np.arange(len(c))[:, None, None], (top * STRIDE)[:, :, None] + np.arange(WIDTH)].reshape(-1)
        grad_embed = np.stack([np.bincount(at, dx[:, e], 257) for e in range(EMBED)], axis=1).astype(np.float32)
        grads = [grad_embed, grad_filters, dpool.sum(0), z.T @ dh, dh.sum(0), grad_out, np.array([ds.sum()], np.float32)]
        rate = 0.004 * min(1, 2 * (1 - step / (steps + 1)))
        for q, g, (m, v) in zip(net.params(), grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            q -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    if 0 < share < 1:
        net.out_bias += np.float32(np.log(share / (1 - share)))
    return net


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 3000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Network:
    """Train on the labelled documents with the least hash of their id, `max_rows` at most."""
    known = labels.where(F.col(label_col).isNotNull()).select(id_col, F.col(label_col).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64(id_col), id_col, "y").limit(max_rows)
    rows = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("t")).join(F.broadcast(chosen), id_col).collect()
    rows.sort(key=lambda r: (r[id_col], r["y"], r["t"]))
    return train([r["t"] for r in rows], [r["y"] for r in rows])


def score_documents(df: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `df`: `id_col`, score."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in pieces(batches):
            texts = [t if t is not None else "" for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(score(net, texts), pa.float64())], names=[id_col, "score"])

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} long, score double")


def keep_good(df: DataFrame, net: Network, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """Rows of `df` with a score of at least `threshold`; columns as they are."""

    @F.arrow_udf("double")
    def scored(text):
        import pyarrow as pa

        return in_pieces(lambda texts: score(net, [t if t is not None else "" for t in texts]), pa.float64(), text)

    return df.where(scored(F.col(text_col)) >= threshold)
