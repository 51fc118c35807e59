"""The coarse-quantised index: recall and candidates at several sizes, exact search by bounds, odd vectors."""

import numpy as np
import pytest

from quillspark.operators import retrieval, vector_index
from quillspark.plans import registry, search


def grouped(spark, n, groups=100, dims=32, spread=0.25, seed=3):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(groups, dims))[np.arange(n) % groups] + spread * rng.normal(size=(n, dims))
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "doc_id long, vec array<double>").repartition(4)


def asked(corpus):
    return corpus.where("doc_id % 100 = 0").selectExpr("doc_id as query_id", "vec as q_vec")


def pairs(df):
    return {(r.query_id, r.doc_id): (r.score, r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("n", [2000, 20_000])
def test_recall_is_held_as_the_corpus_grows(spark, tmp_path, n):
    c = grouped(spark, n)
    index = vector_index.write_vector_index(c, str(tmp_path / "index"))
    exact, found = pairs(retrieval.search_vector(asked(c), c, 10)), pairs(vector_index.search_vector_index(asked(c), index, 10))
    assert len(exact.keys() & found.keys()) >= 0.9 * len(exact) and index.recall >= 0.95
    assert index.share < 0.1
    again = vector_index.open_vector_index(spark, index.path)
    assert (again.probes, again.recall, again.share) == (index.probes, index.recall, index.share)
    assert pairs(vector_index.search_vector_index(asked(c), again, 10, exact=True)) == exact


def test_recall_on_scattered_vectors(spark, small):
    """The given vectors have no groups: recall is held by reading more lists."""
    folder = "/root/testdata/sf0.1"
    exact = pairs(registry.queries()["search_cosine_topk"](spark, folder))
    index = search.vector_index_of(spark, folder)
    found = pairs(vector_index.search_vector_index(search.query_vectors(spark, folder), index, 10))
    assert len(exact.keys() & found.keys()) >= 0.9 * len(exact) and index.share <= 1
    assert pairs(vector_index.search_vector_index(search.query_vectors(spark, folder), index, 10, probes=1, exact=True)) == exact


def test_every_row_is_in_one_list_and_a_list_may_be_hot(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 0.0, 0.0] if i % 3 else rng.normal(size=3).tolist()) for i in range(900)]
    c = spark.createDataFrame(rows, "doc_id long, vec array<double>")
    index = vector_index.write_vector_index(c, str(tmp_path / "index"), lists=8)
    stored = spark.read.parquet(f"{index.path}/lists")
    assert stored.count() == 900 and stored.select("doc_id").distinct().count() == 900
    assert pairs(vector_index.search_vector_index(asked(c), index, 10, probes=1, exact=True)) == pairs(retrieval.search_vector(asked(c), c, 10))


def test_odd_vectors(spark, tmp_path):
    """Zero vectors on both sides, equal vectors, a missing query vector, fewer rows than hits, one row, none."""
    c = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [-1.0, 0.2]), (5, [0.0, 3.0])], "doc_id long, vec array<float>")
    q = spark.createDataFrame([("a", [2.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [-1.0, -1.0])], "query_id string, q_vec array<double>")
    index = vector_index.write_vector_index(c, str(tmp_path / "a"), lists=3)
    for top in (1, 2, 9):
        want = pairs(retrieval.search_vector(q.where("q_vec is not null"), c, top))
        assert pairs(vector_index.search_vector_index(q, index, top, probes=1, exact=True)) == want
    one = vector_index.write_vector_index(c.where("doc_id = 2"), str(tmp_path / "b"))
    assert len(pairs(vector_index.search_vector_index(q, one, 5))) == 3


def test_lists_are_scored_without_a_row_for_each_pair(spark, tmp_path):
    c = grouped(spark, 300)
    index = vector_index.write_vector_index(c, str(tmp_path / "index"), lists=6)
    plan = vector_index.search_vector_index(asked(c), index, 5, exact=True)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
