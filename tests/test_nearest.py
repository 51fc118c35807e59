"""Blocks of queries against blocks of rows: the same hits as scoring pair by pair, with ties, copies and odd vectors."""

import math
import random
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest

from quillspark.operators import nearest, retrieval


def score(a, b):
    """None (last) for lengths that differ; a missing vector or number counts as zero."""
    norms = [0.0 if v is None or None in v else math.sqrt(sum((x * x for x in v), 0.0)) for v in (a, b)]
    if norms[0] * norms[1] == 0:
        return 0.0
    if len(a) != len(b):
        return None
    x = sum((p * q for p, q in zip(a, b)), 0.0) / (norms[0] * norms[1])
    return float(Decimal(repr(x)).quantize(Decimal("0.000001"), ROUND_HALF_UP))


def brute(queries, rows, top):
    out = set()
    for q, a in queries:
        hits = sorted(((score(a, b), d) for d, b in rows), key=lambda h: (h[0] is None, -(h[0] or 0), h[1]))
        out |= {(q, d, s, i) for i, (s, d) in enumerate(hits[:top], 1)}
    return out


def found(df):
    return {(r.query_id, r.doc_id, r.score, r["rank"]) for r in df.collect()}


@pytest.fixture
def small_blocks(monkeypatch):
    for name, n in (("ROWS", 50), ("QUERIES", 7), ("CHUNK", 16)):
        monkeypatch.setattr(nearest, name, n)


@pytest.mark.parametrize("top", [1, 5, 400])
def test_hits_of_odd_vectors(spark, small_blocks, top):
    rng = random.Random(top)
    vec = lambda: [rng.choice([-1.0, 0.0, 0.5, 2.0, rng.gauss(0, 1)]) for _ in range(4)]
    rows = [(f"d{i:03}", vec()) for i in range(200)] + [(f"c{i:03}", [1.0, 0.5, 0.0, 2.0]) for i in range(60)]
    rows += [("z1", [0.0] * 4), ("z2", None), ("z3", [1.0, None, 0.0, 0.0]), ("z4", [1.0, 2.0]), ("z5", []), ("z6", [1.0, 0.5, 0.0, 2.0, 0.0])]
    queries = [(i, v) for i, (_, v) in enumerate(rows[::9])] + [(90, [2.0, 1.0, 0.0, 4.0]), (91, [0.0] * 4), (92, [1.0, 2.0]), (93, [-1.0, -0.5, 0.0, -2.0])]
    rng.shuffle(rows)
    c = spark.createDataFrame(rows, "doc_id string, vec array<double>").repartition(3)
    q = spark.createDataFrame(queries, "query_id int, q_vec array<double>").repartition(2)
    assert found(retrieval.search_vector(q, c, top)) == brute(queries, rows, top)


def test_no_row_for_each_pair(spark):
    c = spark.createDataFrame([(i, [1.0, i / 7]) for i in range(50)], "doc_id long, vec array<double>")
    plan = retrieval.search_vector(c.selectExpr("doc_id as query_id", "vec as q_vec"), c, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan


def test_rounding_is_sparks(spark):
    x = np.concatenate([np.random.default_rng(2).normal(size=3000), np.arange(-50, 50) / 1e6 + 0.5e-6, [0.1234565, -0.9999995, 1.0, -0.0, 0.0, math.nan, math.inf, 1.0000005, 2.5e-6]])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double").selectExpr("i", "round(x, 6) as r").toPandas().sort_values("i")
    assert np.array_equal(df["r"].to_numpy(), nearest.rounded(x), equal_nan=True)


def test_lsh_ranks_its_candidates_without_rows_for_them(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(30, 8))[np.arange(900) % 30] + 0.3 * rng.normal(size=(900, 8))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None)]
    c = spark.createDataFrame(rows, "doc_id long, vec array<double>").repartition(3)
    q = c.where("doc_id % 50 = 0 and vec is not null").selectExpr("doc_id as query_id", "vec as q_vec")
    for tables, bits in ((3, 4), (2, 9)):
        out = retrieval.search_vector_lsh(q, c, 10, tables=tables, bits=bits)
        pairs = {tuple(r) for r in retrieval.lsh_candidates(q, c, tables=tables, bits=bits).collect()}
        want = set()
        for i in sorted({p[0] for p in pairs}):
            hits = sorted((-score(rows[i][1], rows[d][1]), d) for k, d in pairs if k == i)[:10]
            want |= {(i, d, -s, n) for n, (s, d) in enumerate(hits, 1)}
        assert found(out) == want
        assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
