"""The corpus operators against brute force on small inputs with every odd case, and on the driver's smallest tables."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import exact_dedup, near_dedup, packing, piece_bpe, quality_cnn, quality_rules, queries, suffix_dedup, token_counts
from quillspark.llm.common import table
from quillspark.llm.difference_cover import repeated_windows, suffix_array

from . import brute


def pairs(spark, small):
    return [(r.doc_id, r.text) for r in table(spark, small, "documents").select("doc_id", "text").collect()]


# --- 1 ---------------------------------------------------------------------------------------------------------------


def test_pieces_equal_the_library(paths, invented_docs):
    import sentencepiece

    lib, own = sentencepiece.SentencePieceProcessor(model_file=paths["piece_path"]), piece_bpe.codec(paths["piece_path"])
    rng = random.Random(1)
    alphabet = ["▁", " ", "  ", "\n", "é", "e", "́", "th", "ing", "a", "b", "0", "<s>", "</s>", "<0x41>", "\x00", "😀", "中", "ﬁ", "⁇", "aaaa", "....", "\t", "�"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + [t or "" for _, t in invented_docs]
    for t in texts:
        ids = own.encode(t)
        assert ids == lib.encode(t), t
        assert own.decode(ids + [2]) == lib.decode(ids + [2]), t


def test_piece_query(spark, docs, no_docs, paths, invented_docs):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=paths["piece_path"])
    got = {r.doc_id: r for r in piece_bpe.round_trip_digests(docs, paths["piece_path"]).collect()}
    for i, t in invented_docs:
        ids = lib.encode(t or "") + [2]
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    assert piece_bpe.round_trip_digests(no_docs, paths["piece_path"]).count() == 0
    ids = {r.doc_id: r.ids for r in piece_bpe.encode_documents(docs, paths["piece_path"]).collect()}
    assert ids[1] == [2]


def test_long_segments(paths):
    """Texts without a space are one segment."""
    import sentencepiece

    lib, own = sentencepiece.SentencePieceProcessor(model_file=paths["piece_path"]), piece_bpe.codec(paths["piece_path"])
    rng = random.Random(7)
    for t in ("a" * 20_000, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30_000)), "中é😀" * 5000, " " * 5000, "0123456789" * 2000):
        assert own.encode(t) == lib.encode(t)
        assert own.decode(own.encode(t)) == lib.decode(lib.encode(t))


# --- 2 ---------------------------------------------------------------------------------------------------------------


def test_exact_groups(spark, docs, no_docs, invented_docs):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.groups_of_equal_text(docs).collect()}
    assert got == brute.equal_groups(invented_docs)
    assert exact_dedup.groups_of_equal_text(no_docs).count() == 0
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, g in got.items() if g[2]}


def test_exact_groups_in_ranges_of_the_hash(spark, docs, invented_docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "RANGE_ROWS", 15)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.groups_of_equal_text(docs).collect()}
    assert got == brute.equal_groups(invented_docs)


def test_exact_groups_by_sql(spark, small):
    from ..oracle import compare, connect

    assert compare(spark, connect(small), queries.op2_exact_dedup, exact_dedup.ORACLE, small) == ""


# --- 3, 7 ------------------------------------------------------------------------------------------------------------


def byte_ids(paths, text):
    from tokenizers import Tokenizer

    if "tok" not in _TOK:
        _TOK["tok"] = Tokenizer.from_file(paths["json_path"])
    return _TOK["tok"].encode(text or "", add_special_tokens=False).ids


_TOK = {}


def byte_paths(paths):
    return {k: v for k, v in paths.items() if k != "piece_path"}


def check_packing(rows, docs, paths):
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == {i for i, _ in docs}
    for i, t in docs:
        ids, at = np.array([*byte_ids(paths, t), 1], "<u4"), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or at < 2048 and at & (at - 1) == 0


def test_packing(spark, docs, no_docs, paths, small, invented_docs):
    special = [(999_001, "a <|endoftext|> b")]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(special, "doc_id long, text string"))
    check_packing(packing.pack_documents(df, **byte_paths(paths)).collect(), invented_docs + special, paths)
    check_packing(queries.op3_packing(spark, small).collect(), pairs(spark, small), paths)
    assert packing.pack_documents(no_docs, **byte_paths(paths)).count() == 0


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(4)
    for _ in range(30):
        lengths, window = [rng.randint(1, 64) for _ in range(rng.randint(0, 80))], 64
        room, expect = [], []
        for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
            fits = [r for r in room if r[0] >= lengths[k]]
            if fits:
                r = min(fits, key=lambda r: r[0])
            else:
                room.append(r := [window])
            r[0] -= lengths[k]
            expect.append(r[0])
        got = packing.best_fit(lengths, window)
        assert sorted(k for w in got for k in w) == list(range(len(lengths)))
        assert sorted(window - sum(lengths[k] for k in w) for w in got) == sorted(r[0] for r in room)


def test_token_counts(spark, docs, no_docs, paths, invented_docs):
    lengths = sorted(len(byte_ids(paths, t)) for _, t in invented_docs)
    got = token_counts.context_table(token_counts.length_histogram(token_counts.token_lengths(docs, **byte_paths(paths))))
    rows = got.collect()
    assert sorted(r.context_limit for r in rows) == sorted(set(lengths))
    for r in rows:
        n = r.context_limit
        assert r.docs_fitting == sum(x <= n for x in lengths) and r.docs_cut == sum(x > n for x in lengths)
        assert r.tokens_truncated == sum(min(x, n) for x in lengths) and r.total_tokens == sum(lengths)
        assert r.tokens_of_this_or_longer == sum(x for x in lengths if x >= n)
        assert r.quantile_rank == pytest.approx(r.docs_fitting / len(lengths))
    assert token_counts.quantile(got, 0.5).first().n_tokens == lengths[(len(lengths) + 1) // 2 - 1]
    assert token_counts.context_table(token_counts.length_histogram(token_counts.token_lengths(no_docs, **byte_paths(paths)))).count() == 0


def test_limits_between_lengths(spark):
    lengths = [3, 3, 10, 5000, 9000]
    hist = token_counts.length_histogram(spark.createDataFrame([(n, 1) for n in lengths], "n_tokens long, n_docs long"))
    limits = [0, 1, 3, 4, 2048, 5000, 8999, 100_000]
    asked = spark.createDataFrame([(n,) for n in [*limits, 2048, None]], "context_limit int")
    rows = token_counts.answers_at(hist, asked).collect()
    assert sorted(r.context_limit for r in rows) == limits
    for r in rows:
        n = r.context_limit
        assert r.n_docs == lengths.count(n) and r.docs_fitting == sum(x <= n for x in lengths) and r.docs_cut == sum(x > n for x in lengths)
        assert r.tokens_of_fitting == sum(x for x in lengths if x <= n) and r.tokens_of_this_or_longer == sum(x for x in lengths if x >= n)
        assert r.tokens_truncated == sum(min(x, n) for x in lengths) and r.total_tokens == sum(lengths) and r.total_docs == len(lengths)
    assert token_counts.answers_at(hist.where("n_docs < 0"), asked).count() == 0


def test_long_runs_of_white_space(spark, paths):
    long = [(1, " " * 700_000), (2, "a" + "\n \t" * 200_000 + "b"), (3, "x" * 100_000), (4, "\u2003" * 300_000)]
    df = spark.createDataFrame(long, "doc_id long, text string")
    check_packing(packing.pack_documents(df, **byte_paths(paths)).collect(), long, paths)
    got = token_counts.token_lengths(df, **byte_paths(paths)).collect()
    assert sorted(r.n_tokens for r in got for _ in range(r.n_docs)) == sorted(len(byte_ids(paths, t)) for _, t in long)


# --- 4 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("k", [4, 5])
def test_near_groups(spark, docs, no_docs, invented_docs, k):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, k).collect()}
    assert got == brute.near_components(invented_docs, k)
    kept = near_dedup.drop_near_copies(docs, k)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, g in got.items() if g[1] == i}
    assert near_dedup.near_duplicates(no_docs, k).count() == 0


def test_near_groups_of_the_driver(spark, small):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op4_near_dedup(spark, small).collect()}
    assert got == brute.near_components(pairs(spark, small), 4)


def test_chain_of_links_and_estimates(spark):
    """Neighbours in a chain are linked, its ends are not alike at all."""
    w = [f"w{i}" for i in range(400)]
    chain = [(i, " ".join(w[i * 20 : i * 20 + 200])) for i in range(10)]
    df = spark.createDataFrame(chain, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, 4).collect()}
    assert got == {i: c for i, (_, c) in brute.near_components(chain, 4).items()} and set(got.values()) == {0}
    a, b = (near_dedup.odd_sketch(near_dedup.minhash(near_dedup.shingles(chain[i][1], 4))) for i in (0, 1))
    bits = sum(int(x).bit_count() for x in (a ^ b).view(np.uint64))
    assert bits <= near_dedup.most_differing_bits(0.8)


def test_texts_of_one_template(spark, monkeypatch):
    """Texts with most words in common, few of them linked: no block grows with their number, and all links are found."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    template = [word() for _ in range(70)]
    rows = [(i, " ".join(template + [word() for _ in range(rng.choice([8, 11, 14, 17, 20, 24]))])) for i in range(240)]
    rows += [(1000 + i, t + " " + word()) for i, t in rows[::6]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(near_dedup, "SKETCHES", 16)
    monkeypatch.setattr(near_dedup, "SHINGLES", 1000)
    sets = near_dedup.shingle_sets(df, 4, "doc_id", "text").withColumn("component", F.col("id")).withColumn("n", F.size("shingles")).withColumn("family", F.lit(1))
    blocks = near_dedup.block_pairs(sets, "family", "n", 1000)
    sizes = [r["w"] for r in blocks.groupBy("x", "y").agg(F.sum("n").alias("w")).collect()]
    assert len(sizes) > 20 and max(sizes) <= 4 * 1000
    one = near_dedup.block_pairs(sets.withColumn("component", F.when(F.col("id") < 200, 0).otherwise(F.col("id"))), "family", "n", 1000)
    assert one.where("component = 0").groupBy("x", "y").agg(F.countDistinct("block").alias("k")).where("k > 1").count() == 0
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, 4).collect()}
    want = brute.near_components(rows, 4)
    assert got == want and 1 < len({c for _, c in want.values()}) < len(rows)


# --- 5 ---------------------------------------------------------------------------------------------------------------


def test_rules(spark, docs, no_docs, small, invented_docs):
    for df, rows in ((docs, invented_docs), (table(spark, small, "documents"), pairs(spark, small))):
        got = {r.doc_id: r for r in quality_rules.judge_texts(df).collect()}
        assert len(got) == len(rows)
        for i, t in rows:
            r = got[i]
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.statistics(t), t
            assert not (r.base_failed and r.kept)
    assert quality_rules.judge_texts(no_docs).count() == 0


def test_outliers_are_found(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(80)]
        if i % 20 == 0:
            w = [x + "###" for x in w]
        rows.append((i, " ".join(w), "en", "s"))
    got = {r.doc_id: r.kept for r in quality_rules.judge_texts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert [i for i, k in got.items() if not k] == [i for i in sorted(got) if i % 20 == 0] or {i for i, k in got.items() if not k} == {i for i in got if i % 20 == 0}


def clean_texts(rng, n):
    """Texts of eight lines without symbols or repeats."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    return [[[word() for _ in range(12)] for _ in range(8)] for _ in range(n)]


def joined(lines):
    return "\n".join(" ".join(x) for x in lines)


def rejected(spark, rows):
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    got = quality_rules.judge_texts(df).collect()
    assert not any(r.base_failed for r in got)
    return {r.doc_id for r in got if not r.kept}


def test_each_statistic_alone_is_an_outlier(spark):
    rng = random.Random(6)
    rows = [(i, joined(x)) for i, x in enumerate(clean_texts(rng, 400))]
    planted = clean_texts(rng, 15)
    for i, x in enumerate(planted):
        if i < 5:  # a short line after each line: seven of sixteen lines are repeats, and no run of eight words
            t = joined([y for line in x for y in (line, ["abcd", "dcba"])])
        elif i < 10:  # sixteen words again on a line of their own: 32 of 113 words, and no line
            t = joined([*x, x[0] + x[1][:4] + ["z"]])
        else:
            t = "\n".join(" | ".join(y) for y in x)
        rows.append((1000 + i, t))
    assert rejected(spark, rows) == {1000 + i for i in range(15)}


def vectors_of(rows):
    """Statistic vectors of (text) rows by their definition; None where the base limits fail."""
    out = []
    for t in rows:
        n, chars, symbols, dup, again, failed = brute.statistics(t)
        lines = sum(1 for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r"))
        share = lambda a, b: (a / max(b, 1)) ** 0.5
        out.append(None if failed else [np.log(max(chars / max(n, 1), 1.0)), share(symbols, n), share(dup, lines), share(again, n)])
    return out


def least_determinant(x):
    """(centre, covariance) of the half with the least determinant that many random starts reach by concentration steps."""
    rng, h, best = np.random.default_rng(1), int(np.ceil(quality_rules.CORE * len(x))), None
    floor = np.diag(np.square(quality_rules.FLOOR))
    for _ in range(200):
        own = rng.choice(len(x), 6, replace=False)
        for _ in range(30):
            c, s = x[own].mean(axis=0), np.cov(x[own].T, bias=True) + floor
            d = np.einsum("ij,jk,ik->i", x - c, np.linalg.inv(s), x - c)
            own = np.argsort(d, kind="stable")[:h]
        c, s = x[own].mean(axis=0), np.cov(x[own].T, bias=True)
        det = np.linalg.slogdet(s + floor)[1]
        if best is None or det < best[0]:
            best = (det, c, s * quality_rules.CONSISTENT)
    return best


def test_verdicts_against_a_random_search(spark):
    """Determinants and verdicts of two groups, one of them small and with more junk, against many random starts and a plain shrinkage."""
    rng = random.Random(10)
    texts, keys = [], []
    for source, n, junk in (("a", 150, 20), ("b", 30, 12)):
        clean = [joined(x) for x in clean_texts(rng, n)]
        for i in range(junk):
            clean[i] = clean[i].replace(" ", " | " if i % 2 else " ## ") if i % 3 else joined([y for y in (z.split(" ") for z in clean[i].split("\n")) for y in (y, ["same", "line"])])
        texts += clean
        keys += [("en", source)] * n
    df = spark.createDataFrame([(i, t, *k) for i, (t, k) in enumerate(zip(texts, keys))], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality_rules.judge_texts(df).collect()}
    vec = vectors_of(texts)
    every = np.array([v for v in vec if v])
    groups = {s: np.array([v for v, k in zip(vec, keys) if v and k[1] == s]) for s in "ab"}
    whole = least_determinant(every)
    rows = spark.createDataFrame([(s, *map(float, v)) for s, g in groups.items() for v in g], "grp string, x0 double, x1 double, x2 double, x3 double")
    found = {r.grp: r for r in quality_rules.estimates(rows).collect()}
    for s, g in groups.items():
        best = least_determinant(g)
        own = np.linalg.slogdet(quality_rules.matrix([v / quality_rules.CONSISTENT for v in found[s].cov]))[1]
        assert own <= best[0] + 0.15 and found[s].n == len(g)
        mix = lambda n, a, b: a * n / (n + quality_rules.PRIOR) + b * quality_rules.PRIOR / (n + quality_rules.PRIOR)
        centre, cov = mix(len(g), best[1], whole[1]), mix(len(g), best[2], whole[2])
        inverse = np.linalg.inv(cov + np.diag(np.square(quality_rules.FLOOR)))
        for i, (v, k) in enumerate(zip(vec, keys)):
            if k[1] == s and v:
                d = (np.array(v) - centre) @ inverse @ (np.array(v) - centre)
                assert got[i].distance == pytest.approx(d, rel=0.25, abs=0.6)
                assert abs(d - quality_rules.CUTOFF) < 6 or got[i].kept == (d <= quality_rules.CUTOFF)
    assert {i for i, r in got.items() if not r.kept} >= {i for i, t in enumerate(texts) if "##" in t or "|" in t}


# --- 9 ---------------------------------------------------------------------------------------------------------------


def test_classifier_on_held_out_documents(spark):
    rows = queries.op9_quality_classifier(spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.quality for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [(labels[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for y, s in held if y == 1], [s for y, s in held if y == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    assert np.mean([s >= 0.7 for s in good]) > 0.95


def plain_score(net, text):
    """The network's score by loops over its definition."""
    data, step = text.encode(), quality_cnn.CHUNK - quality_cnn.OVERLAP
    starts = [0]
    while starts[-1] + quality_cnn.CHUNK < len(data):
        starts.append(starts[-1] + step)
    total = weight = 0.0
    for at in starts:
        own = data[at : at + quality_cnn.CHUNK]
        padded = list(own) + [quality_cnn.PAD] * (quality_cnn.CHUNK - len(own))
        best = [-1e9] * quality_cnn.FILTERS
        for i in range(0, quality_cnn.CHUNK - quality_cnn.WIDTH + 1, quality_cnn.STRIDE):
            seen = [float(v) for b in padded[i : i + quality_cnn.WIDTH] for v in net.embed[b]]
            best = [max(m, v) for m, v in zip(best, np.array(seen) @ net.filters.astype(float))]
        z = [max(0.0, m + float(b)) for m, b in zip(best, net.bias)] + [np.log1p(len(own)) / 7]
        hidden = [max(0.0, sum(x * float(w) for x, w in zip(z, net.hidden[:, k])) + float(net.hidden_bias[k])) for k in range(quality_cnn.HIDDEN)]
        s = sum(h * float(o) for h, o in zip(hidden, net.out)) + float(net.out_bias[0])
        total, weight = total + s * max(1, len(own)), weight + max(1, len(own))
    return 1 / (1 + np.exp(-total / weight))


def test_forward_pass_equals_loops():
    rng = random.Random(9)
    texts = ["".join(rng.choice("abc de#é") for _ in range(n)) for n in (0, 1, 40, 1000, 2500)]
    net = quality_cnn.train(texts, [1, 0, 1, 0, 1], steps=5)
    assert quality_cnn.score(net, texts).tolist() == pytest.approx([plain_score(net, t) for t in texts], abs=1e-4)


def test_classifier_edge_cases(spark, docs, no_docs):
    net = quality_cnn.train([], [])
    assert quality_cnn.score(net, ["", "abc"]).tolist() == [0.5, 0.5]
    net = quality_cnn.train(["good text", None or "", "### ###"], [1, 1, 0], steps=20)
    got = quality_cnn.score_documents(docs, net)
    assert got.count() == docs.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    assert quality_cnn.score_documents(no_docs, net).count() == 0
    assert quality_cnn.keep_good(docs, net, 0.0).columns == docs.columns


def test_chunks_cover_all_bytes():
    for n in (0, 1, 31, 32, 33, 1023, 1024, 1025, 2016, 2017, 5000):
        rows, lengths = quality_cnn.chunks_of(bytes(range(256)) * 20 if n == 5120 else bytes(i % 251 for i in range(n)))
        step = quality_cnn.CHUNK - quality_cnn.OVERLAP
        covered = {k * step + j for k in range(len(rows)) for j in range(int(lengths[k]))}
        assert covered == set(range(n))


# --- 10 --------------------------------------------------------------------------------------------------------------


def test_suffix_order():
    rng = np.random.default_rng(1)
    for n in [*range(30), 300]:
        for k in (1, 2, 3, 250):
            s = rng.integers(0, k, n).astype(np.uint8)
            assert suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())
    s = rng.integers(0, 2, 500).astype(np.uint8)
    starts = np.arange(0, 490, 3)
    count = collections.Counter(s[i : i + 8].tobytes() for i in starts)
    assert repeated_windows(s, starts, 8).tolist() == [count[s[i : i + 8].tobytes()] > 1 for i in starts]


def test_repeated_passages(spark, docs, no_docs, small, invented_docs):
    for df, rows in ((docs, invented_docs), (table(spark, small, "documents"), pairs(spark, small))):
        want = brute.repeated_bytes([(i, (t or "").encode()) for i, t in rows])
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.passage_digests(df).collect()}
        assert got == {i: w[:4] for i, w in want.items()}
    assert suffix_dedup.passage_digests(no_docs).count() == 0
    want = brute.repeated_bytes([(i, (t or "").encode()) for i, t in invented_docs])
    cut = suffix_dedup.drop_repeated_passages(docs)
    assert cut.columns == docs.columns
    text = dict(invented_docs)
    for r in cut.collect():
        assert r.text == (None if text[r.doc_id] is None else want[r.doc_id][4].decode("utf-8", "ignore"))


def test_long_text_across_blocks(spark):
    """Repeats that cross the borders of the blocks in which a long text is read."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    chars = list(" ".join(word() for _ in range(90_000)))
    passage = " ".join(word() for _ in range(50))[:260]
    places = [suffix_dedup.BLOCK - 130, suffix_dedup.BLOCK + 1000, 2 * suffix_dedup.BLOCK - 200, 2 * suffix_dedup.BLOCK + 300]
    for i in places:
        chars[i : i + len(passage)] = passage
    text = "".join(chars)
    rows = suffix_dedup.passage_digests(spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")).collect()
    gone = {r.doc_id: (r.n_removed, r.n_spans) for r in rows}
    assert len(text) > 2 * suffix_dedup.BLOCK and gone[2] == (0, 0)
    spans = []
    for i in places:
        a = i - (0 if all(text[i - 1] != text[j - 1] for j in places if j != i) else 1)
        spans.append(a)
    assert gone[1][1] == 4 and 4 * 260 <= gone[1][0] <= 4 * 264


def test_clashing_columns(spark, docs, invented_docs):
    """Columns with the names of helper columns come back as they were."""
    names = ["bf_word", "BF_BITS", "bf_mask", "bf_hit", "ranges", "__ranges", "__bf_hit", "component", "call", "anchor", "run", "_salt", "maybe", "sha"]
    df = docs.select("doc_id", "text", *(F.lit(f"own {n}").alias(n) for n in names))
    for out in (exact_dedup.drop_exact_copies(df), near_dedup.drop_near_copies(df), suffix_dedup.drop_repeated_passages(df), quality_cnn.keep_good(df, quality_cnn.train([], []), 0.0)):
        rows = out.collect()
        assert out.columns == df.columns and rows
        assert all(r[n] == f"own {n}" for r in rows for n in names)


def test_hot_anchor_path(spark, monkeypatch, small):
    """With every anchor hot, windows are counted by hash; the result is the same."""
    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", 0)
    want = brute.repeated_bytes([(i, (t or "").encode()) for i, t in pairs(spark, small)])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op10_suffix_dedup(spark, small).collect()}
    assert got == {i: w[:4] for i, w in want.items()}


def test_repeated_rows(spark, invented_docs):
    """A row that is there twice, with one id."""
    t = " ".join(f"word{i}" for i in range(100))
    df = spark.createDataFrame([(1, t), (1, t), (2, "short")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in suffix_dedup.passage_digests(df).collect()) == [(1, len(t)), (1, len(t)), (2, 0)]
    assert sorted((r.doc_id, r.group_size) for r in exact_dedup.groups_of_equal_text(df).collect()) == [(1, 2), (1, 2), (2, 1)]
    assert sorted((r.doc_id, r.component_id) for r in near_dedup.near_duplicates(df).collect()) == [(1, 1), (1, 1), (2, 2)]


def test_one_id_with_several_texts_and_null_ids(spark):
    """Rows are told apart by themselves: no link and no text is lost, and no range meets the wrong text."""
    w = [f"word{i}" for i in range(150)]
    t, u, near = " ".join(w), " ".join(f"other{i}" for i in range(60)), " ".join([*w[:149], "end"])
    rows = [(1, t), (1, u), (2, near), (None, t), (None, u + " "), (None, "alone"), (3, "alone"), (3, "x"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: tuple((x is None, x) for x in r)

    equal = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.groups_of_equal_text(df).collect()), key=key)
    want = [(1, 1, 2, True), (1, None, 2, False), (2, 2, 1, True), (None, 1, 2, False), (None, None, 2, True), (None, 3, 2, False), (3, 3, 2, True), (3, 3, 1, True), (4, 4, 1, True)]
    assert equal == sorted(want, key=key)
    kept = [tuple(r) for r in exact_dedup.drop_exact_copies(df).collect()]
    assert sorted(kept, key=key) == sorted([(1, t), (2, near), (None, u + " "), (3, "alone"), (3, "x"), (4, None)], key=key)

    groups = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, 4).collect()), key=key)
    want = [(1, 147, 1, True), (1, 57, 1, True), (2, 147, 1, False), (None, 147, 1, False), (None, 57, 1, False), (None, 1, 3, False), (3, 1, 3, True), (3, 1, 3, True), (4, 0, 4, True)]
    assert groups == sorted(want, key=key)
    kept = [tuple(r) for r in near_dedup.drop_near_copies(df, 4).collect()]
    assert sorted(kept, key=key) == sorted([(1, t), (1, u), (3, "alone"), (3, "x"), (4, None)], key=key)

    want = brute.repeated_bytes([(i, (x or "").encode()) for i, (_, x) in enumerate(rows)])
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.passage_digests(df).collect()]
    assert sorted(got, key=key) == sorted([(rows[i][0], *v[:4]) for i, v in want.items()], key=key)
    cut = [tuple(r) for r in suffix_dedup.drop_repeated_passages(df).collect()]
    assert sorted(cut, key=key) == sorted([(i, x if x is None else want[n][4].decode()) for n, (i, x) in enumerate(rows)], key=key)


def test_components(spark):
    from quillspark.llm.components import components

    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 7)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)] + [(500, 300), (500, 400)]
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == root
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_join_by_size(spark):
    """Hot groups, broadcast, and the others give what a plain join gives; rows without a group and the size of the hot part are as defined."""
    from quillspark.llm.common import HOT_SHARE, join_by_size

    rows = spark.range(6000).select("id", F.when(F.col("id") < 2500, 0).otherwise(F.col("id") % 1500).cast("long").alias("g"))
    groups = rows.where("g < 1400").groupBy("g").agg(F.count(F.lit(1)).alias("size"))
    assert 0 < groups.where(F.col("size") > groups.agg(F.sum("size")).first()[0] * HOT_SHARE).count() < 1 / HOT_SHARE
    for how in ("inner", "left"):
        key = lambda r: (r[0], r[1], r[2] or 0)
        want = sorted(map(tuple, rows.join(groups, "g", how).collect()), key=key)
        assert sorted(map(tuple, join_by_size(rows, groups, ["g"], "size", how).collect()), key=key) == want
    assert join_by_size(rows.limit(0), groups.limit(0), ["g"], "size").count() == 0


def test_semi_join_by_size(spark):
    """Rows of hot and of other groups, each once and without the group's columns, however large a group is."""
    from quillspark.llm.common import join_by_size

    data = [(0, i) for i in range(3000)] + [(1 + i % 1500, i) for i in range(3000)]
    rows = spark.createDataFrame(data, "g long, i long")
    groups = spark.createDataFrame([(0, 3000), *((g, 2) for g in range(1, 1000)), (9999, 1)], "g long, size long")
    got = join_by_size(rows, groups, ["g"], "size", "left_semi")
    assert got.columns == ["g", "i"]
    assert sorted(map(tuple, got.collect())) == sorted(r for r in data if r[0] < 1000)


def test_runs_without_a_second_kind_are_not_joined(spark, monkeypatch):
    """Only runs whose anchor has several kinds of runs are looked up, and each comes back once at most."""
    seen = []
    join = suffix_dedup.join_by_size

    def watched(rows, groups, keys, size, how="inner"):
        out = join(rows, groups, keys, size, how)
        if keys == ["anchor", "run"]:
            seen.append((rows.count(), out.count(), rows.where("equal").count()))
        return out

    monkeypatch.setattr(suffix_dedup, "join_by_size", watched)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(150))
    rows = [(i, f"{word()} {passage} {word()}" if i % 3 else f"{passage} {word()}") for i in range(60)]
    got = {r.doc_id: r.n_removed for r in suffix_dedup.passage_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute.repeated_bytes([(i, t.encode()) for i, t in rows])
    assert got == {i: w[1] for i, w in want.items()}
    (looked_up, found, equal), = seen
    assert equal == 0 and 0 < found <= looked_up


def test_lines_said_over_and_over_are_not_joined(spark, monkeypatch):
    """However often a text repeats a line, it takes one row of each kind of run to the joins; the result is that of brute force."""
    seen = []
    join = suffix_dedup.join_by_size

    def watched(rows, groups, keys, size, how="inner"):
        out = join(rows, groups, keys, size, how)
        if keys in (["anchor"], ["anchor", "run"]):
            seen.append((rows.count(), out.count()))
        return out

    monkeypatch.setattr(suffix_dedup, "join_by_size", watched)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    line, edges = " ".join(word() for _ in range(12)), [(" ".join(word() for _ in range(40)), word()) for _ in range(12)]
    counts = []
    for times in (8, 80):
        said = "\n".join([line] * times)
        rows = [(i, f"{a}\n{said}{'' if i % 4 else b}\n{b}") for i, (a, b) in enumerate(edges)] + [(50, f"{line}\n" * 3 + edges[0][1])]
        seen.clear()
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.passage_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {i: w[:4] for i, w in brute.repeated_bytes([(i, t.encode()) for i, t in rows]).items()}
        counts.append([*seen])
    assert counts[0] == counts[1]


def test_kinds_of_runs():
    """First places, counts and touching ranges, against loops; a text's runs never meet those of another text."""
    rng = np.random.default_rng(5)
    for size in (0, 1, 2, 60, 400):
        which = np.sort(rng.integers(0, 4, size))
        anchor, run = rng.integers(0, 5, size).astype(np.uint64), rng.integers(0, 3, size).astype(np.uint64)
        n = rng.integers(1, 90, size)
        s = np.cumsum(n) - n
        first, k, a, b = suffix_dedup._kinds(which, s, n, anchor, run)
        places = collections.defaultdict(list)
        for i, kind in enumerate(zip(which.tolist(), anchor.tolist(), run.tolist(), strict=True)):
            places[kind].append(i)
        assert sorted(zip(first.tolist(), k.tolist(), strict=True)) == sorted((p[0], len(p)) for p in places.values())
        inside = [i for x, y in zip(a.tolist(), b.tolist(), strict=True) for i in range(x, y + 1)]
        assert inside == sorted(i for p in places.values() if len(p) > 1 for i in p)
        assert all(which[x] == which[y] for x, y in zip(a, b, strict=True))
        assert all(which[x] != which[y] or x > y + 1 for x, y in zip(a[1:], b[:-1], strict=True))


def test_blocks_of_many_runs():
    """Blocks of all runs at once: aligned by the anchor, whole, and equal where their bytes are equal."""
    rng = random.Random(6)
    texts = ["".join(rng.choice("abc ") for _ in range(900)).encode() for _ in range(3)]
    texts += [b"x" * 700, texts[0][100:700] + texts[1][:300]]
    found = [(t, int(s), int(n), a) for t in texts for s, n, a, _ in zip(*suffix_dedup.runs(t, 200), strict=True)]
    data = [t[s : s + n + 199] for t, s, n, _ in found]
    sizes, anchors = np.array([f[2] for f in found]), np.array([f[3] for f in found], np.uint64)
    for w, (run, number, at, m, full, core, first) in zip((24, 4, 1), suffix_dedup.blocks_of_runs(data, sizes, anchors, 200), strict=True):
        assert np.bincount(run, m, len(found)).tolist() == sizes.tolist()
        assert first.tolist() == (np.cumsum(m) - m).tolist() and m.max() <= w
        whole, shared = {}, {}
        for r, b, a, k, f, c in zip(*(x.tolist() for x in (run, number, at, m, full, core)), strict=True):
            bytes_ = data[r][a : a + k + 199]
            assert whole.setdefault(f, bytes_) == bytes_
            if k == w:
                inner = data[r][a + w - 1 : a + 200]
                assert shared.setdefault(c, inner) == inner
        assert len(set(whole.values())) == len(whole)
