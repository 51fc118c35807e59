"""Collocation mining against plain counts, and the counting of activity by hand."""

import collections
import random
import re

import numpy as np
import pytest

from quillspark.llm import collocations, queries
from quillspark.llm.common import table

from ..oracle import compare, connect


def plain(docs, least, top, covered=80):
    f, words = collections.Counter(), collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if c < "\x80" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            w = re.findall("[^ \t]+", piece)
            words[lang] += len(w)
            for n in range(1, 5):
                f.update((lang, tuple(w[i : i + n])) for i in range(len(w) - n + 1))
    rows = collections.defaultdict(list)
    held = collections.Counter()
    often = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    for (lang, p), a in often.items():
        for n in range(2, len(p)):
            for i in range(len(p) - n + 1):
                held[lang, p[i : i + n]] = max(held[lang, p[i : i + n]], a)
    for (lang, p), a in often.items():
        if 100 * held[lang, p] >= covered * a:
            continue
        score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        rows[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, r + 1, x[2].decode(), -x[1], x[3], x[4], words[lang], -x[0]) for lang, own in rows.items() for r, x in enumerate(sorted(own)[:top]))


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "new", "york", "city", "é", "Éa", "a-b", "中文", "x" * 40, "of\x00", "\u00a0"]
    out = [(None, None), ("en", None), ("en", ""), (None, " .,;\t\n"), ("en", "new york city hall " * 30), ("fr", "a a a a a a a a"), ("", "the of the of the of")]
    for _ in range(n):
        words = rng.choices(vocabulary, [20, 5, 15, 8, 6, 4, 3, 1, 2, 2, 1, 1, 1], k=rng.randint(0, 30))
        out.append((rng.choice(["en", "en", "en", "fr", None]), "".join(w + rng.choice([" ", " ", " ", "\t ", ", ", ".\n"]) for w in words)))
    return out + [("en", "Kappa lambda mu nu.")] * 40


def found(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("shards,least,top,max_words", [(4, 8, 1000, 1 << 21), (1, 5, 10, 1 << 21), (3, 8, 50, 64), (7, 30, 1000, 256)])
def test_equal_to_plain_counts(spark, shards, least, top, max_words):
    docs = texts(shards, 150)
    df = spark.createDataFrame([(*d, 1, "z", 2) for d in docs], "lang string, text string, n int, phrase string, shard int").repartition(5)
    got = found(collocations.mine_collocations(df, least=least, top=top, shards=shards, max_words=max_words))
    assert got == plain(docs, least, top) and got


def test_no_texts(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert collocations.mine_collocations(none).count() == 0
    assert collocations.mine_collocations(spark.createDataFrame([(None, None), ("en", "..")], "lang string, text string")).count() == 0


def test_counts_are_exact_under_false_hits(spark):
    """A full filter makes every phrase active at once; each is still counted on each shard once."""
    docs = texts(9, 60)
    df = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    for max_words in (1, 1 << 21):
        counts = {(r.lang, r.phrase): r["count"] for r in collocations.phrase_counts(df, least=6, shards=3, max_words=max_words).where("n > 0 and count >= 6").collect()}
        f = collections.Counter()
        for lang, text in docs:
            for piece in re.split("[.,;:!?\n-\r]", "".join(c.lower() if c < "\x80" else c for c in text or "")):
                w = re.findall("[^ \t]+", piece)
                for n in range(1, 5):
                    f.update((lang or ("und" if lang is None else lang), " ".join(w[i : i + n])) for i in range(len(w) - n + 1))
        assert counts == {k: v for k, v in f.items() if v >= 6}


def test_slices_keep_pieces_whole(spark, monkeypatch):
    docs = texts(3, 80)
    df = spark.createDataFrame(docs, "lang string, text string").repartition(4)
    whole = found(collocations.mine_collocations(df, least=6, shards=3))
    monkeypatch.setattr(collocations, "SLICE", 25)
    assert found(collocations.mine_collocations(df, least=6, shards=3)) == whole == plain(docs, 6, 2000)


def test_equal_hashes_are_told_apart():
    ids = np.array([1, 2, 3, 1, 2, 4, 2, 3])
    at = np.array([0, 1, 3, 4, 6])
    where, count = collocations.equal_phrases(np.zeros(5, np.uint64), ids, at, 2)
    assert {(ids[i], ids[i + 1]): int(c) for i, c in zip(where, count, strict=True)} == {(1, 2): 2, (2, 3): 2, (2, 4): 1}


def test_scores_past_64_bits(spark):
    big = 3 * 10**13
    counts = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big + 1), ("en", "a b", 2, big - 5), ("en", "a b c", 3, 30), ("en", "b c", 2, 31), ("en", "c", 1, 40)], "lang string, phrase string, n int, count long")
    got = {r.phrase: (r.score, r.l, r.r) for r in collocations.score_phrases(counts).collect()}
    assert got["a b"] == (2_000_000 * (big - 5) // (2 * big + 1), big, big + 1) and "b c" not in got and got["a b c"][0] == 2_000_000 * 30 // (big + 31)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, folder):
    folder = f"/root/testdata/{folder}"
    assert compare(spark, connect(folder), queries.op13_collocations, collocations.ORACLE, folder) in ("", "no rows")


def test_query_equals_plain_counts(spark, small):
    docs = [(r.lang, r.text) for r in table(spark, small, "documents").collect()]
    assert found(queries.op13_collocations(spark, small)) == plain(docs, 30, 2000)


def test_rare_phrases_go_when_their_cycle_ends(spark, monkeypatch):
    """No written sum holds a rare phrase whose cycle is over, and no phrase is dropped before."""
    written = []
    keep = collocations.materialise

    def watched(df, label, folders=None):
        out = keep(df, label, folders)
        if label == "collocation-counts":
            written.append([tuple(r) for r in out.select("phrase", "n", "count", "until").collect()])
        return out

    monkeypatch.setattr(collocations, "materialise", watched)
    monkeypatch.setattr(collocations, "SLICE", 100)
    docs = texts(5, 120)
    df = spark.createDataFrame(docs, "lang string, text string").repartition(4)
    assert found(collocations.mine_collocations(df, least=8, shards=2)) == plain(docs, 8, 2000)
    for step, rows in enumerate(written):
        assert all(n < 2 or count >= 8 or until == step + 1 for _, n, count, until in rows)
    assert any(n > 1 and count < 8 for rows in written for _, n, count, _ in rows)
