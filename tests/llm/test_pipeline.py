"""The pipeline's stages against brute force, each on its own input."""

import corpus_pipeline
from pyspark.sql import functions as F
from quillspark.llm import quality_cnn, suffix_dedup
from quillspark.llm.common import materialise, table

from . import brute


def test_stages(spark, small):
    docs = table(spark, small, "documents")
    columns = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, small), name)
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality_classifier":
            assert set(after) < set(before)
        elif name == "exact_dedup":
            groups = brute.equal_groups(list(before.items()))
            assert set(after) == {i for i, g in groups.items() if g[2]}
        elif name == "minhash_near_dedup":
            assert set(after) == {i for i, (_, c) in brute.near_components(list(before.items()), 5).items() if c == i}
        else:
            want = brute.repeated_bytes([(i, t.encode()) for i, t in before.items()])
            assert after == {i: w[4].decode("utf-8", "ignore") for i, w in want.items()}
        before = after
    labels = {r.doc_id: r.quality for r in table(spark, small, "labels").collect()}
    packed = corpus_pipeline.run(spark, small)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(before)
    assert quality_cnn.CHUNK and labels


def batch_sizes(batches):
    import pyarrow as pa

    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], names=["size", "n"])


def test_short_batches(spark, small):
    """Stages send all texts to Python, few at once; a session's own limit holds."""
    key = corpus_pipeline.BATCH_KEY
    long = spark.range(0, 6000, 1, 1).select("id", F.repeat(F.lit("x"), 3400).alias("text"))
    docs = table(spark, small, "documents")
    try:
        for name, stage in corpus_pipeline.STAGES:
            spark.conf.unset(key)
            stage(spark, docs, small)
            if name != "exact_dedup":
                got = long.mapInArrow(batch_sizes, "size long, n long").collect()
                assert sum(r.n for r in got) == 6000 and max(r.size for r in got) < 5 << 20
        spark.conf.set(key, "1m")
        corpus_pipeline.repeated_passages(spark, docs, small)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key)


def test_texts_without_repeats_stay_out_of_python(spark, docs):
    plan = suffix_dedup.drop_repeated_passages(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.index("Union") < plan.index("ArrowEvalPython")
