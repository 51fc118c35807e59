"""Every registered query of the reference's operators against its SQL, and all of them for rows."""

import pytest

from quillspark.operators import retrieval
from quillspark.plans import registry, search

from .oracle import compare, connect

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, small, name):
    said = compare(spark, con, registry.queries()[name], SQL[name], small)
    assert said in ("", "no rows")


def test_lsh_recall(spark, small):
    exact = {(r.query_id, r.doc_id) for r in registry.queries()["search_cosine_topk"](spark, small).collect()}
    found = {(r.query_id, r.doc_id) for r in registry.queries()["search_cosine_lsh"](spark, small).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


@pytest.mark.parametrize("n", [4000, 40_000])
def test_lsh_holds_recall_as_the_corpus_grows(spark, n):
    """On grouped vectors; the hyperplanes follow from measured recall, and candidates are a part of all pairs."""
    import numpy as np

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(100, 32))
    v = centres[np.arange(n) % 100] + 0.25 * rng.normal(size=(n, 32))
    c = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "doc_id long, vec array<double>")
    q = c.where(f"doc_id % {n // 40} = 0").selectExpr("doc_id as query_id", "vec as q_vec")
    exact = {(r.query_id, r.doc_id) for r in retrieval.search_vector(q, c, 10).collect()}
    found = {(r.query_id, r.doc_id) for r in retrieval.search_vector_lsh(q, c, 10).collect()}
    assert len(exact & found) >= 0.9 * len(exact)
    assert retrieval.lsh_candidates(q, c).count() < 0.35 * n * 40


def test_lsh_on_scattered_vectors(spark):
    """On sf0.1, whose vectors are nearly random, recall is held too."""
    v, q = search.vectors(spark, "/root/testdata/sf0.1"), search.query_vectors(spark, "/root/testdata/sf0.1")
    exact = {(r.query_id, r.doc_id) for r in retrieval.search_vector(q, v, 10).collect()}
    found = {(r.query_id, r.doc_id) for r in retrieval.search_vector_lsh(q, v, 10).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_deep_hops_from_every_order(spark, con, small):
    lines, after = {}, {}
    for order, part in con.execute("SELECT l_orderkey, l_partkey FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey").fetchall():
        if lines.get(order):
            after.setdefault(lines[order][-1], set()).add(part)
        lines.setdefault(order, []).append(part)
    expect = {}
    for (order,) in con.execute("SELECT o_orderkey FROM orders").fetchall():
        new = set(lines.get(order, ()))
        for hop in (1, 2, 3):
            expect |= {(order, part): hop for part in new}
            new = {x for part in new for x in after.get(part, ()) if (order, x) not in expect}
    for name, depth in (("hop_expand_all_d3", 2), ("hop_expand_all_d4", 3)):
        got = registry.queries()[name](spark, small).toPandas()
        assert not got.duplicated(["seed", "node"]).any()
        assert {(s, n): h for s, n, h in got.itertuples(index=False)} == {k: h for k, h in expect.items() if h <= depth}


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["query_id", "doc_id", "score", "rank"]


def test_no_python_in_plans_without_udfs(spark, small):
    for name in ("search_bm25_any", "chunk_windows", "resolve_refs", "context_xml", "hop_expand_d3"):
        plan = registry.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
