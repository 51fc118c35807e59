"""The segmented index against a search of the texts themselves: upserts, deletions, compaction, pruning, odd rows."""

import random

import pytest

from quillspark.operators import retrieval, text_index


def corpus(seed, ids):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    return {i: " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 60))) for i in ids}


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)


def found(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def queries(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices([f"w{j}" for j in range(64)], k=rng.randint(1, 6)))) for i in range(25)] + [(90, None), (91, ""), (92, "unknown W1"), (93, "w0 w0 w1")]
    return spark.createDataFrame(rows, "query_id long, q_text string")


def same(spark, queries, index, docs, tops=(1, 5)):
    for mode in ("any", "all"):
        for top in (*tops, None):
            assert found(text_index.search_text_index(queries, index, top, mode)) == found(retrieval.search_text(queries, frame(spark, docs), top, mode)), (mode, top)


def state(spark, index):
    """Document frequencies and totals as the log gives them."""
    log = text_index._log(spark, index)
    df = text_index._read(spark, log, "df", "term string, df long, bucket int").groupBy("term").sum("df").where("`sum(df)` != 0")
    return sum(r["n_docs"] for r in log), sum(r["n_terms"] for r in log), found(df)


def test_upserted_index_equals_a_rebuilt_one(spark, tmp_path, queries, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK_BITS", 3)
    docs = corpus(1, range(300)) | {900: None, 901: "", 902: "... !"}
    index = text_index.create_text_index(frame(spark, docs), str(tmp_path / "a"), buckets=4)
    same(spark, queries, index, docs)
    batch = corpus(2, range(250, 340)) | {900: "w1 w2 w63", 3: None, 4: "w0"}
    text_index.upsert_documents(index, frame(spark, batch))
    docs |= batch
    text_index.upsert_documents(index, frame(spark, batch))  # a replay changes nothing
    text_index.delete_documents(index, frame(spark, {5: "", 900: "", 12345: "", 251: ""}))
    docs = {k: v for k, v in docs.items() if k not in (5, 900, 251)}
    again = corpus(3, [5, 6])
    text_index.upsert_documents(index, frame(spark, again))
    docs |= again
    same(spark, queries, index, docs, (5,))
    rebuilt = text_index.create_text_index(frame(spark, docs), str(tmp_path / "b"), buckets=4)
    assert state(spark, index) == state(spark, rebuilt)
    text_index.compact(spark, index)
    assert state(spark, index) == state(spark, rebuilt) and len(text_index._log(spark, index)) == 1
    assert text_index.drop_old_segments(spark, index) == 5
    same(spark, queries, index, docs, (5,))


def test_pruning_leaves_most_postings_unscored(spark, tmp_path):
    rng = random.Random(4)
    docs = {i: " ".join(["common"] * max(0, rng.randint(-8, 4)) + rng.choices(["often", "other", "more"], k=rng.randint(5, 60)) + (["rare"] * rng.randint(1, 5) if i % 100 == 0 else [])) for i in range(6000)}
    index = text_index.create_text_index(frame(spark, docs), str(tmp_path / "a"), buckets=4)
    q = spark.createDataFrame([(1, "common rare"), (2, "common"), (3, "often rare other")], "query_id long, q_text string")
    assert found(text_index.search_text_index(q, index, 10)) == found(retrieval.search_text(q, frame(spark, docs), 10, "any"))
    cost = {r.query_id: (r.postings, r.scored) for r in text_index.search_cost(q, index, 10).collect()}
    assert all(scored < 0.4 * n for n, scored in cost.values()), cost


def test_a_load_that_dies_is_not_seen(spark, tmp_path, queries, monkeypatch):
    docs = corpus(1, range(40))
    index = text_index.create_text_index(frame(spark, docs), str(tmp_path / "a"), buckets=4)

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(text_index, "_write_blocks", broken)
        with pytest.raises(RuntimeError):
            text_index.upsert_documents(index, frame(spark, corpus(2, range(20))))
    same(spark, queries, index, docs, (5,))


def test_empty_corpus_and_text_ids(spark, tmp_path, queries):
    none = spark.createDataFrame([], "doc_id string, text string")
    index = text_index.create_text_index(none, str(tmp_path / "a"))
    assert text_index.search_text_index(queries, index, 5).count() == 0
    text_index.upsert_documents(index, spark.createDataFrame([("x", "w1 w2"), ("y", "w1")], none.schema))
    q = queries.where("query_id = 92")
    assert [r.doc_id for r in text_index.search_text_index(q, index, 5).orderBy("rank").collect()] == ["y", "x"]
    assert text_index.search_text_index(q.limit(0), index, 5).count() == 0


def test_terms_are_counted_without_a_shuffle(spark):
    tokens = spark.createDataFrame([(1, 3, ["a", "b", "a"]), (2, 0, []), (3, 1, ["b"])], "doc long, len long, terms array<string>")
    out = text_index._counted(tokens, "bigint")
    assert sorted(map(tuple, out.select("doc", "term", "tf", "len").collect())) == [(1, "a", 2, 3), (1, "b", 1, 3), (3, "b", 1, 1)]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
