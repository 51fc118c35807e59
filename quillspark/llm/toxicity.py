"""Operator 11: toxicity by multiple-instance learning. Sentences get scores, a document's is their noisy-or, and only documents have labels.

A text is a bag of sentences, cut at `.`, `!`, `?` and line ends. A sentence's score is the logistic of a bias and the weights of its distinct
lower-case words; a word's weight is the sum of its parts' (itself and its stretches of four to six letters, ends marked), so that inflected forms share what their stem has learned. A document is toxic unless none of its sentences is: 1 - prod(1 - s). The weights come from the document labels by proximal
gradient steps (Adam's step sizes, then a soft threshold at 0: no weight is negative), so that most parts weigh nothing and clean company of a bad sentence costs it nothing.
`offending_sentences` then says where the toxic ones stand.

Training uses at most `max_rows` labelled documents, those with the least hash of their id, and of these, in that order, as many as have `max_chars`
code points together (documented parameters; the bound holds for what reaches the driver). It has no random part. Scoring runs on the executors over whole texts.

Defined cases: null and empty texts, and texts without words, have no sentence and score 0; repeated rows get equal scores; an empty table gives no rows;
without labelled rows, or with one class only, every score is 0. Ids, labels, languages and sources are no inputs of a score. Only the columns named are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

SENTENCE = re.compile(r"[^.!?\n\r]+")
WORD = re.compile(r"\w+")


#: Words longer than this are one part only.
LONG_WORD = 40


def parts_of(word: str) -> set[str]:
    marked = f"^{word}$"
    out = {marked}
    if len(word) <= LONG_WORD:
        out.update(marked[i : i + n] for n in (4, 5, 6) for i in range(len(marked) - n + 1))
    return out


def in_word(c: str) -> bool:
    return c.isalnum() or c == "_"


class WordWeights(dict):
    """Word -> weight, remembered up to `limit` words; `seen_in` finds the places of a text where a weighted part stands."""

    limit = 200_000

    def __init__(self, parts: dict[str, float]):
        import ahocorasick

        self.parts, self.bare = parts, ahocorasick.Automaton()
        bare: dict[str, list[str]] = {}
        for p in parts:
            bare.setdefault(p.strip("^$"), []).append(p)
        for text, own in bare.items():
            # What has to stand around it: nothing, if any of these parts may be inside a word.
            self.bare.add_word(text, (len(text), all(p[0] == "^" for p in own), all(p[-1] == "$" for p in own)))
        self.bare.make_automaton()

    def __missing__(self, word: str) -> float:
        if len(self) >= self.limit:
            self.clear()
        out = self[word] = sum(self.parts.get(p, 0.0) for p in sorted(parts_of(word)))
        return out

    def seen_in(self, lower: str) -> list[int]:
        if not self.parts:
            return []
        padded = f" {lower} "
        return [end for end, (n, head, tail) in self.bare.iter(lower) if not (head and in_word(padded[end - n + 1])) and not (tail and in_word(padded[end + 2]))]


@dataclass
class Model:
    """Parts without a weight are left out; `bias` is a sentence's logit without any."""

    bias: float = -30.0
    weights: dict[str, float] = field(default_factory=dict)

    def word_weights(self) -> WordWeights:
        return WordWeights(self.weights)


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences that hold a word."""
    return [m.span() for m in SENTENCE.finditer(text) if WORD.search(text, *m.span())]


def words_in(text: str, start: int, end: int) -> set[str]:
    return {w.lower() for w in WORD.findall(text, start, end)}


def sentence_scores(bias: float, words: WordWeights, text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Spans and scores of the sentences; only those with a part that weighs something are cut into words."""
    spans = sentences(text)
    z = np.full(len(spans), bias)
    lower = text.lower()
    hits = words.seen_in(lower) if len(lower) == len(text) else range(len(text))  # a few letters get longer in lower case
    ends = np.array([b for _, b in spans], np.int64)
    for i in np.unique(np.searchsorted(ends, np.asarray(hits, np.int64), "right")):
        if i < len(spans):
            z[i] += sum(sorted(map(words.__getitem__, words_in(text, *spans[i]))))
    return spans, 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def noisy_or(scores: np.ndarray) -> float:
    return float(-np.expm1(np.log1p(-np.minimum(scores, 1 - 1e-12)).sum()))


def train(texts: list[str], labels: list[int], steps: int = 300, rate: float = 0.05, sparsity: float = 5e-4, min_docs: int = 3, bias: float = -6.0, lean: float = 2.5, least: float = 0.05) -> Model:
    """Fit the parts of words that at least `min_docs` texts hold. The loss is the documents' logistic loss, the mean over both classes' means."""
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        return Model()
    bags = [[sorted(words_in(t, *s)) for s in sentences(t)] for t in texts]
    words = {w: i for i, w in enumerate(sorted({w for b in bags for s in b for w in s}))}
    parts = [sorted(parts_of(w)) for w in words]
    held: dict[str, int] = {}
    for bag in bags:
        for p in {p for s in bag for w in s for p in parts[words[w]]}:
            held[p] = held.get(p, 0) + 1
    known = {p: i for i, p in enumerate(sorted(p for p, n in held.items() if n >= min_docs))}
    owner = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    rows = [[words[w] for w in s] for b in bags for s in b]
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.fromiter((c for r in rows for c in r), np.int64, len(row))
    of = [[known[p] for p in ps if p in known] for ps in parts]
    word = np.repeat(np.arange(len(of)), [len(x) for x in of])
    part = np.fromiter((c for x in of for c in x), np.int64, len(word))
    cost = np.where(y == 1, lean, 1.0) / len(y)
    w, b = np.zeros(len(known)), bias
    mean, square, mean_b, square_b = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, steps + 1):
        weight = np.bincount(word, w[part], len(words))
        s = 1 / (1 + np.exp(-np.clip(b + np.bincount(row, weight[col], len(rows)), -30, 30)))
        clean = np.bincount(owner, np.log1p(-np.minimum(s, 1 - 1e-12)), len(y))
        p = np.maximum(-np.expm1(clean), 1e-12)
        # d(loss)/d(logit of a sentence): its own score times how far its document is off.
        g = s * (cost * (p - y) / p)[owner]
        grad, grad_b = np.bincount(part, np.bincount(col, g[row], len(words))[word], len(w)), g.sum()
        mean, mean_b = 0.9 * mean + 0.1 * grad, 0.9 * mean_b + 0.1 * grad_b
        square, square_b = 0.999 * square + 0.001 * grad**2, 0.999 * square_b + 0.001 * grad_b**2
        fix, fix2 = 1 - 0.9**step, 1 - 0.999**step
        scale = rate / (np.sqrt(square / fix2) + 1e-6)
        w = w - scale * mean / fix
        w = np.maximum(w - scale * sparsity, 0)
        b -= rate * (mean_b / fix) / (np.sqrt(square_b / fix2) + 1e-6)
    return Model(float(b), {k: float(w[i]) for k, i in known.items() if w[i] >= least})


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 2500, max_chars: int = 5_000_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Train on the labelled documents with the least hash of their id: at most `max_rows` rows and `max_chars` code points."""
    known = labels.where(F.col(label_col).isNotNull()).select(id_col, F.col(label_col).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64(id_col), id_col, "y").limit(max_rows)
    texts = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("t"))
    sized = texts.select(id_col, F.length("t").alias("n")).join(F.broadcast(chosen), id_col).orderBy(F.xxhash64(id_col), id_col, "y", "n").limit(max_rows).collect()
    sizes = np.cumsum([r["n"] for r in sized])
    ids = sorted({r[id_col] for r in sized[: int(np.searchsorted(sizes, max_chars, "right"))]})
    if not ids:
        return Model()
    taken = docs.sparkSession.createDataFrame([(i,) for i in ids], f"{id_col} {docs.schema[id_col].dataType.simpleString()}")
    rows = texts.join(F.broadcast(taken), id_col).join(F.broadcast(chosen), id_col).collect()
    rows.sort(key=lambda r: (r[id_col], r["y"], r["t"]))
    return train([r["t"] for r in rows], [r["y"] for r in rows])


def score_documents(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `df`: `id_col`, score, n_sentences, and worst_start and worst_score of its most toxic sentence (null without sentences; the first of equals)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words = model.word_weights()
        for b in pieces(batches):
            out: list[tuple] = []
            for t in b.column(1).to_pylist():
                spans, s = sentence_scores(model.bias, words, t or "")
                worst = int(s.argmax()) if len(s) else None
                out.append((noisy_or(s), len(s), None if worst is None else spans[worst][0], None if worst is None else float(s[worst])))
            kinds = (pa.float64(), pa.int64(), pa.int64(), pa.float64())
            columns = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=[id_col, "score", "n_sentences", "worst_start", "worst_score"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, score double, n_sentences long, worst_start long, worst_score double")


def offending_sentences(df: DataFrame, model: Model, at_least: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per sentence that scores `at_least`: `id_col`, start and end (code points), sentence, score."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words = model.word_weights()
        for b in pieces(batches):
            at, out = [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                spans, s = sentence_scores(model.bias, words, t or "")
                hits = np.flatnonzero(s >= at_least)
                at += [k] * len(hits)
                out += [(spans[i][0], spans[i][1], t[spans[i][0] : spans[i][1]], float(s[i])) for i in hits]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64())
            columns = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *columns], names=[id_col, "start", "end", "sentence", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, start long, end long, sentence string, score double")
