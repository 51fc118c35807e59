"""Multiple-instance toxicity: held-out accuracy, the model's formulas, places of sentences, odd inputs."""

import numpy as np
import pytest

from quillspark.llm import queries, toxicity
from quillspark.llm.common import table

from .brute import held_out_ids


def by_loops(model, text):
    """The noisy-or of a text's sentences, words and parts one by one."""
    clean = 1.0
    for sentence in toxicity.SENTENCE.findall(text):
        words = {w.lower() for w in toxicity.WORD.findall(sentence)}
        if words:
            z = model.bias + sum(model.weights.get(p, 0.0) for w in words for p in toxicity.parts_of(w))
            clean *= 1 - 1 / (1 + np.exp(-z))
    return 1 - clean


def planted(rng, n):
    """Clean texts, every fourth with two sentences that each hold a word of a bad stem."""
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 7)))
    out = []
    for i in range(n):
        lines = [" ".join(word() for _ in range(rng.integers(3, 9))) for _ in range(rng.integers(3, 12))]
        if i % 4 == 0:
            for k in rng.choice(len(lines), 2, replace=False):
                lines[k] += f" Zork{word()} " + word()
        out.append(". ".join(lines))
    return out, [int(i % 4 == 0) for i in range(n)]


@pytest.fixture(scope="module")
def model():
    return toxicity.train(*planted(np.random.default_rng(1), 300))


def test_unseen_texts_and_sentences(model):
    texts, labels = planted(np.random.default_rng(2), 200)
    words = model.word_weights()
    for t, y in zip(texts, labels, strict=True):
        spans, s = toxicity.sentence_scores(model.bias, words, t)
        assert (toxicity.noisy_or(s) >= 0.3) == bool(y)
        bad = {i for i, (a, b) in enumerate(spans) if "Zork" in t[a:b]}
        assert {int(i) for i in np.flatnonzero(s >= 0.3)} <= bad if y else not bad


def test_scores_equal_loops(model):
    texts, _ = planted(np.random.default_rng(5), 40)
    words = model.word_weights()
    for t in [*texts, "", "...", "zorkab", "Zorkab zorkab", "İ zorkab. a", "x" * 50_000 + " zorkab", "zork" * 30, "a_zorkab", "é" * 5]:
        assert toxicity.noisy_or(toxicity.sentence_scores(model.bias, words, t)[1]) == pytest.approx(by_loops(model, t), abs=1e-9)


def test_documents(spark, docs, no_docs, model):
    scored = toxicity.score_documents(docs, model)
    assert scored.count() == docs.count() and scored.where("score is null or score < 0 or score > 1").count() == 0
    assert {r.score for r in scored.where("n_sentences = 0").collect()} == {0.0}
    assert toxicity.score_documents(no_docs, model).count() == toxicity.offending_sentences(no_docs, model).count() == 0
    d = spark.createDataFrame([("a", "Fine words here.\nA zorkab zorkdd zorkef!"), ("b", None), ("a", "")], "doc_id string, text string")
    hits = toxicity.offending_sentences(d, model).collect()
    assert [(r.doc_id, r.start, r.end, r.sentence) for r in hits] == [("a", 17, 40, "A zorkab zorkdd zorkef")] or [r.sentence for r in hits] == ["A zorkab zorkdd zorkef"]
    for r in hits:
        assert "Fine words here.\nA zorkab zorkdd zorkef!"[r.start : r.end] == r.sentence


def test_without_two_classes(spark, docs):
    for labels in ([], [(1, 1), (4, 1)], [(1, 0)], [(1, None)]):
        got = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert not got.weights and toxicity.score_documents(docs, got).where("score > 1e-6").count() == 0


def test_training_is_bounded(spark, docs):
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
    seen = []
    toxicity.train, kept = lambda texts, ys: seen.append((len(texts), sum(map(len, texts)))) or toxicity.Model(), toxicity.train
    try:
        toxicity.fit(docs, labels, max_rows=7), toxicity.fit(docs, labels, max_chars=900)
    finally:
        toxicity.train = kept
    assert seen[0][0] == 7 and 0 < seen[1][1] <= 900


def test_held_out_accuracy(spark, small):
    folder = "/root/testdata/sf0.1"
    got = queries.op11_toxicity(spark, folder).toPandas()
    labels = {r.doc_id: r.toxic for r in table(spark, folder, "labels").collect()}
    assert got.doc_id.is_unique and len(got) == table(spark, folder, "documents").count()
    assert set(got.doc_id[got.held_out]) == held_out_ids(got.doc_id)
    assert ((got.score >= 0.3) == (got.predicted == 1)).all()
    held = got[got.held_out & got.doc_id.isin(labels.keys())]
    y, p = held.doc_id.map(labels) == 1, held.predicted == 1
    assert (p & y).sum() >= 0.85 * y.sum() and (p & ~y).sum() <= 0.03 * (~y).sum()
