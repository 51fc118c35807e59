"""Fusion over stored indexes against fusion of whole legs; queries that settle early are read no deeper."""

import random

from quillspark.operators import hybrid, retrieval, text_index, vector_index


def found(df):
    return sorted(map(tuple, df.collect()))


def test_equal_to_fusion_of_whole_legs(spark, tmp_path):
    rng = random.Random(6)
    # Documents 0 to 29 are alike in words and vectors, so both legs agree on them; the others are noise for one leg each.
    rows = [(i, f"alpha beta {'gamma ' * (30 - i)}" if i < 30 else " ".join(rng.choices(["delta", "beta", "eps"], k=rng.randint(3, 30))), [1.0, 0.01 * i, 0.0] if i < 30 else [rng.gauss(0, 1) for _ in range(3)]) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, vec array<double>")
    q = spark.createDataFrame([(1, "alpha", [1.0, 0.0, 0.0]), (2, "delta eps", [0.0, 1.0, 0.3]), (3, None, [0.1, 0.1, 1.0]), (4, "gamma", None), (5, "unknown", None), (6, "beta", [0.0, 0.0, 0.0])], "query_id long, q_text string, q_vec array<double>")
    text = text_index.create_text_index(d, str(tmp_path / "t"), buckets=4)
    vectors = vector_index.write_vector_index(d, str(tmp_path / "v"), lists=12)
    for top, leg_top, first in ((3, 24, 6), (5, 20, 20)):
        want = found(retrieval.search_hybrid(q, d.select("doc_id", "text"), d.select("doc_id", "vec"), top, leg_top))
        assert found(hybrid.search_hybrid_index(q, text, vectors, top, leg_top, first)) == want
    steps = hybrid.rounds(q, text, vectors, 3, 24, 6, "any", "query_id", "q_text", "q_vec", "doc_id")
    depth = {r.query_id: n for n, df in steps for r in df.collect()}
    assert [n for n, _ in steps] == [6, 12, 24] and depth[2] == 24 and depth[4] < 24 and min(depth.values()) == 6, depth
