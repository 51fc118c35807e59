"""Fixture rows for what the driver's tables don't hold: quirks of sources, references, chunks and loads."""

import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.operators import audit, chunks, context, expand, ingest, links, retrieval
from quillspark.sources import json_files
from quillspark.streaming import incremental


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def ref(kind, cap, section=None, subsection=None):
    return {"type": kind, "cap": cap, "section": section, "subsection": subsection}


@pytest.fixture
def caps(spark, tmp_path):
    one = {
        "cap_no": "1",
        "language": "en",
        "interpretations": [{"term": "a", "text": "first"}, {"term": "a", "text": "second"}, {"term": "b", "text": "x"}],
        "sections": [
            {"no": "8", "name": "s8", "text": "x", "url": "u", "subsections": [{"name": "1", "text": "y", "references": [ref("subsection", "2", "s3", "1")]}], "references": [ref("section", "2", "8")]},
            {"name": "class1", "text": "\t\n", "subsections": [], "references": [ref("legislation", "9")]},
        ],
        "schedules": [{"name": "sch1", "text": "t", "sections": [{"name": "sch1_P1_s1", "text": "z", "references": [ref("schedule", "2", "1")]}]}],
    }
    (tmp_path / "1.json").write_text(json.dumps(one))
    (tmp_path / "2.json").write_text("{not json")
    (tmp_path / "notes.txt").write_text("no")
    return json_files.read_json_dir(spark, str(tmp_path), json_files.CAPS)


def test_json_dir_keeps_good_files(caps):
    got = rows(caps.select("cap_no", F.col("_corrupt_record").isNotNull()))
    assert got == [("1", False), (None, True)]


def test_json_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"nid": 1, "is_noisy": True}, {"nid": 2, "is_noisy": None}, {"nid": 3}]))
    pages = json_files.read_json_array(spark, str(tmp_path / "a.json"), json_files.PAGES)
    assert rows(ingest.drop_flagged(pages, F.col("is_noisy")).select("nid")) == [(2,), (3,)]
    (tmp_path / "b.jsonl").write_text('{"citation": "x", "summary": "1"}\n\n   \n{"citation": "y"}\n')
    assert rows(json_files.read_jsonl(spark, str(tmp_path / "b.jsonl"), json_files.SUMMARIES)) == [("x", "1"), ("y", None)]
    (tmp_path / "c.json").write_text(json.dumps([["a/1", "b"], ["c"]]))
    assert rows(json_files.read_json_rows_of_arrays(spark, str(tmp_path / "c.json"))) == [(0, ["a/1", "b"]), (1, ["c"])]


def test_sections_and_schedules(caps):
    s = ingest.explode_sections(caps)
    assert rows(s.select("path", "section_number")) == [("1/class1", "clas1"), ("1/s8", "8"), ("1/s8/1", "8")]
    assert rows(ingest.drop_blank(s, "content").select("path")) == [("1/s8",), ("1/s8/1",)]
    assert rows(ingest.explode_schedules(caps).select("path")) == [("1/sch1",), ("1/sch1/P1_s1",)]
    assert rows(ingest.first_terms(caps).select("term", "definition")) == [("a", "first"), ("b", "x")]


def test_refs(caps):
    r = links.explode_refs(caps)
    path = links.target_path(*(F.col(c) for c in ("type", "t_cap", "t_sec", "t_sub")))
    assert rows(r.select("source_path", path)) == [("1/class1", "9"), ("1/s8", "2/s8"), ("1/s8/1", "2/s3/1"), ("1/sch1", "2/sch1"), ("1/sch1/P1_s1", "2/sch1")]


def test_resolving_keeps_good_refs_beside_bad_ones(spark):
    refs = spark.createDataFrame([("a", "x", "en"), ("a", "gone", "en"), ("a", "x", "en"), ("no", "x", "en")], "s string, t string, lang string")
    sources, targets = spark.createDataFrame([("a", "en")], "s string, lang string"), spark.createDataFrame([("x", "en"), ("x", "tc")], "t string, lang string")
    assert rows(links.resolve_refs(refs, sources, targets, "s", "t", ["lang"])) == [("a", "x", "en")]


def test_page_links(spark):
    p = spark.createDataFrame([(1, "en", [1, 2, 2, None, 9]), (2, "tc", [1]), (2, "en", [])], "nid int, languageCode string, refs array<int>")
    assert rows(links.link_pages(p, "refs")) == [(1, 1, "en"), (1, 2, "en")]
    assert rows(links.missing_refs(p, "refs")) == [(1, "en", 3, 2, 1), (2, "tc", 1, 0, 1)]


def test_list_rule_and_pairs(spark):
    refs = spark.createDataFrame([(1, "A", "1"), (1, "B", "2"), (1, "C", ""), (2, "A", None)], "page int, cap string, number string")
    sections = spark.createDataFrame([("A", "1"), ("A", "2"), ("B", "2")], "cap string, number string")
    assert rows(links.link_sections_in_lists(refs, sections)) == [(1, "A", "1"), (1, "A", "2"), (1, "B", "2")]
    assert rows(links.link_sections_pairwise(refs, sections)) == [(1, "A", "1"), (1, "B", "2")]
    assert rows(links.link_caps(refs, spark.createDataFrame([("C",)], "cap string"))) == [(1, "C")]


def test_cascade_stops_at_first_hit(spark):
    r = spark.createDataFrame([(1, ["a/1", "n1", "p1"]), (2, ["a/2", "p1"]), (3, ["zz"])], "row_id int, items array<string>")
    cases = spark.createDataFrame([("a/1", []), ("a/2", [20, 21])], "act string, judgment_ids array<int>")
    j, p = spark.createDataFrame([(5, "n1")], "id int, citation string"), spark.createDataFrame([("p1", 7)], "citation string, judgment_id int")
    assert set(rows(links.cascade_match(r, cases, j, p))) == {(5,), (20,), (21,)}


def test_update_last_wins_on_all_rows(spark):
    base = spark.createDataFrame([(1, "x", "old"), (2, "x", "old"), (3, "y", None)], "id int, k string, s string")
    patch = spark.createDataFrame([("x", 1, "a"), ("x", 2, "b"), ("q", 1, "c")], "k string, n int, s string")
    assert rows(links.update_by_key(base, patch, "k", "n", ["s"]).select("id", "s", "was_updated")) == [(1, "b", True), (2, "b", True), (3, None, False)]
    assert rows(links.update_report(base, patch, "k")) == [(2, 1)]


def test_ambiguous_groups_go_whole(spark):
    d = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a")], "g int, k string")
    assert rows(ingest.reject_ambiguous(d, ["g"], ["k"])) == [(2, "a")]


def test_upsert(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, s string, n int")
    new = spark.createDataFrame([(2, None, 9, ["s"]), (3, "c", None, [])], "id int, s string, n int, nulls array<string>")
    out = ingest.upsert_by_key(base, new, ["id"], "nulls")
    assert rows(out) == [(1, "a", 1), (2, None, 9), (3, "c", None)]
    assert rows(ingest.upsert_by_key(out, new, ["id"], "nulls")) == rows(out)


def test_existing_keys_count_by_language(spark):
    new = spark.createDataFrame([(1, "en"), (1, "tc"), (2, "en")], "nid int, lang string")
    base = spark.createDataFrame([(1, "en")], "nid int, lang string")
    assert rows(ingest.skip_existing(new, base, ["nid", "lang"])) == [(1, "tc"), (2, "en")]
    assert ingest.append_new(base, new, ["nid", "lang"]).count() == 3


def test_appendix(spark):
    d = spark.createDataFrame([("app1_x", "u_1_2"), ("app1", "u_1"), ("s_1", "u_1")], "section_number string, url string")
    assert rows(ingest.normalise_appendix(d)) == [("app1", "u"), ("app1", "u_1"), ("s_1", "u_1")]


def test_batches_cover_all_rows(spark):
    d = spark.range(0, 20_000, 3).withColumnRenamed("id", "k")
    out = ingest.batch_plan(d, "k", 100).groupBy("batch_no").count().collect()
    assert sorted(r["count"] for r in out)[-1] == 100 and sum(r["count"] for r in out) == 6667
    assert {r["batch_no"] for r in out} == set(range(67))


@pytest.mark.parametrize("key", ["id", "id % 7", "if(id % 3 = 0, 5, xxhash64(id))"])
def test_batches_of_millions_with_payload(spark, key):
    """Whole rows, more of them than the sample that ranges are cut by; unique, few and hot keys."""
    n = 2_000_000
    d = spark.range(0, n, 1, 16).selectExpr(f"{key} as k", "id as payload", "concat('row ', id) as text")
    out = ingest.batch_plan(d, "k", 1000, parts=8).withColumn("before", F.lag("k").over(Window.partitionBy("batch_no").orderBy("row_no")))
    got = out.agg(F.count("*").alias("n"), F.countDistinct("row_no"), F.min("row_no"), F.max("row_no"), F.countDistinct("payload"), F.count_if(F.col("before") > F.col("k")), F.count_if(F.expr("text != concat('row ', payload)"))).first()
    assert tuple(got) == (n, n, 1, n, n, 0, 0)
    sizes = out.groupBy("batch_no").agg(F.count("*").alias("n"), F.min("k").alias("a"), F.max("k").alias("b"))
    assert sizes.where("n != 1000").count() == 0 and sizes.count() == n // 1000
    w = Window.orderBy("batch_no")
    assert sizes.withColumn("next", F.lead("a").over(w)).where("next < b").count() == 0


def test_batches_of_sparse_and_hot_keys(spark):
    """Keys far apart, and one key with a third of the rows."""
    keys = [i * 10**12 + 7 for i in range(3000)] + [10**15] * 1500
    d = spark.createDataFrame([(k,) for k in keys], "k long").repartition(7)
    out = [(r.k, r.row_no, r.batch_no) for r in ingest.batch_plan(d, "k", 100).collect()]
    assert sorted(r[1] for r in out) == list(range(1, 4501)) and all(b == (i - 1) // 100 for _, i, b in out)
    assert [k for _, k in sorted((i, k) for k, i, _ in out)] == sorted(keys)
    assert ingest.batch_plan(d.limit(0), "k", 100).count() == 0


@pytest.mark.parametrize("small", [retrieval.SMALL, 0])
def test_text_index_gives_the_same_hits(spark, tmp_path, monkeypatch, small):
    monkeypatch.setattr(retrieval, "SMALL", small)
    docs = spark.createDataFrame([(1, "a b b c"), (2, "b c d"), (3, "x"), (4, None), (5, "a a d ...")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "b c"), (2, "A"), (3, "none"), (4, None)], "query_id long, q_text string")
    retrieval.write_text_index(docs, str(tmp_path / "index"), buckets=4)
    for mode in ("any", "all"):
        found = retrieval.search_index(q, str(tmp_path / "index"), 10, mode, buckets=4)
        assert rows(found) == rows(retrieval.search_text(q, docs, 10, mode)) and found.count() >= 4


def test_chunks(spark):
    d = spark.createDataFrame([(1, "a b c d"), (2, "a b c d e"), (3, " "), (4, None), (5, "x x x x x x")], "doc int, t string")
    c = chunks.chunk_tokens(d, "t", 4, 2)
    assert rows(c.select("doc", "chunk_no", "content")) == [(1, 0, "a b c d"), (2, 0, "a b c d"), (2, 1, "c d e"), (5, 0, "x x x x"), (5, 1, "x x x x")]
    assert [r[0] for r in rows(chunks.chunk_ids(c, "doc", "first_index").where("doc = 5").select("chunk_id"))] == ["5_0", "5_0"]
    assert [r[0] for r in rows(chunks.chunk_ids(c, "doc").where("doc = 5").select("chunk_id"))] == ["5_0", "5_1"]


def test_encoder_batches(spark):
    d = spark.range(25).select(F.col("id").alias("k"), F.lit("ab").alias("t"))
    out = chunks.encode_batches(d.coalesce(1), "k", "t", lambda texts: [[float(len(texts))] for _ in texts], batch=10)
    assert sorted(r["embedding"][0] for r in out.collect()) == [5.0] * 5 + [10.0] * 20


def test_hops_nest(spark):
    seeds = spark.createDataFrame([("p",)], "seed string")
    first = spark.createDataFrame([("p", 1), ("q", 9)], "seed string, node int")
    edges = spark.createDataFrame([(1, 2), (2, 3), (2, 1), (9, 8)], "src int, dst int")
    got = {d: set(rows(expand.expand_hops(seeds, first, edges, d))) for d in (1, 2, 3, 4)}
    assert got[1] == set() and got[2] == {("p", 1, 1)}
    assert got[2] <= got[3] <= got[4] == {("p", 1, 1), ("p", 2, 2), ("p", 3, 3)}


def test_requests(spark):
    d = spark.createDataFrame([(None, None, None), ("", None, None), ("  ", None, None), ("x", "xx", None), ("x", "en", "sc"), ("x", None, None)], "q string, l string, c string")
    assert [r[0] for r in d.select(context.request_status(*(F.col(c) for c in "qlc"))).collect()] == [400, 400, 401, 401, 501, 200]


def test_costs(spark):
    d = spark.createDataFrame([(None, None, None), (1000, 100, 500)], "i int, o int, c int")
    got = rows(context.usage_cost(d, "i", "o", "c").select(F.col("total_cost").cast("double")))
    assert got == [(0.0,), (0.0004625,)]


def test_xml(spark):
    d = spark.createDataFrame([('a"<', None)], "h string, b string")
    raw = context.xml_block("s", {"h": F.col("h")}, F.col("b"))
    safe = context.xml_block("s", {"h": F.col("h")}, F.col("b"), escape=True)
    assert d.select(raw, safe).first()[:] == ('<s h="a"<"></s>', '<s h="a&quot;&lt;"></s>')


def test_captions_and_queries(spark):
    d = spark.createDataFrame([("One dog. Two cats, and dogs! Red cats dog", ["cats", "dog"]), ("nothing", ["cats"])], "text string, q_terms array<string>")
    assert rows(retrieval.captions(d).select("caption", "highlights")) == [("", ""), ("Red cats dog", "Red <em>cats</em> <em>dog</em>")]
    q = spark.createDataFrame([("CFI in Hong Kong",), ("court of first instance rules",)], "q string")
    out = retrieval.normalise_queries(q, "q", {"CFI": "Court of First Instance"}, ["Hong Kong"])
    assert rows(out) == [("CFI in Court of First Instance",), ("court of first instance rules CFI",)]


def test_audits(spark):
    child = spark.createDataFrame([(1, 1), (2, None), (3, 9)], "id int, p int")
    parent = spark.createDataFrame([(1,)], "k int")
    assert rows(audit.audit_fk(child, parent, {"p": "k"}).select("id")) == [(3,)]
    assert audit.audit_unique(child, ["id"]).count() == 0
    assert audit.audit_length(spark.createDataFrame([(1, [1.0]), (2, None)], "k int, v array<double>"), "v", 1).count() == 1


def test_clear(spark, tmp_path):
    path, link = str(tmp_path / "t"), str(tmp_path / "l")
    d = spark.range(3)
    d.write.parquet(path), d.write.parquet(link)
    json_files.clear(spark, path, d.schema, {link: d.schema})
    assert spark.read.parquet(path).count() == spark.read.parquet(link).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    from pyspark.sql import Row

    folder = tmp_path / "in"
    spark.createDataFrame([Row(k=1, v="a"), Row(k=1, v="b"), Row(k=2, v="c")]).coalesce(1).write.parquet(str(folder))
    stream = lambda: spark.readStream.schema("k long, v string").parquet(str(folder))
    incremental.incremental_ingest(stream(), "stream_t", ["k"], ["v"], str(tmp_path / "cp1"))
    assert rows(spark.table("stream_t")) == [(1, "a"), (2, "c")]
    incremental.incremental_ingest(stream(), "stream_t", ["k"], ["v"], str(tmp_path / "cp2"))
    assert spark.table("stream_t").count() == 2
    spark.createDataFrame([Row(k=2, v="z"), Row(k=3, v="n")]).write.mode("append").parquet(str(folder))
    incremental.incremental_ingest(stream(), "stream_t", ["k"], [F.desc("v")], str(tmp_path / "cp3"), mode="upsert")
    assert rows(spark.table("stream_t")) == [(1, "b"), (2, "z"), (3, "n")]
    spark.sql("drop table stream_t")


def test_replays_and_reads_between_loads(spark, tmp_path):
    """Loads after a read of the table, replays, null keys, repeated keys."""
    folder = tmp_path / "in"
    put = lambda *r: spark.createDataFrame(list(r), "k long, v string").coalesce(1).write.mode("append").parquet(str(folder))
    run = lambda n, mode: incremental.incremental_ingest(spark.readStream.schema("k long, v string").parquet(str(folder)), "replay_t", ["k"], ["v"], str(tmp_path / n), mode=mode)
    put((1, "a"), (2, "b"), (None, "x"))
    run("c1", "append")
    assert rows(spark.table("replay_t")) == [(1, "a"), (2, "b")]
    put((3, "c"), (3, "d"))
    for n in ("c1", "c2", "c3"):
        run(n, "append")
        assert rows(spark.table("replay_t")) == [(1, "a"), (2, "b"), (3, "c")]
    for n in ("c4", "c5"):
        run(n, "upsert")
        assert rows(spark.table("replay_t")) == [(1, "a"), (2, "b"), (3, "c")]
    spark.sql("drop table replay_t")


@pytest.mark.parametrize("point", ["written", "first rename", "second rename"])
def test_crash_inside_an_upsert(spark, tmp_path, point):
    """The states that a crash can leave, and the replay after it."""
    name = "crash_t"
    for t in (name, f"{name}_next", f"{name}_old"):
        spark.sql(f"drop table if exists {t}")
    spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string").write.saveAsTable(name)
    spark.createDataFrame([(1, "a"), (2, "z")], "k long, v string").write.saveAsTable(f"{name}_next")
    if point != "written":
        spark.sql(f"alter table {name} rename to {name}_old")
    if point == "second rename":
        spark.sql(f"alter table {name}_next rename to {name}")
    folder = str(tmp_path / "in")
    spark.createDataFrame([(2, "z")], "k long, v string").write.parquet(folder)
    incremental.incremental_ingest(spark.readStream.schema("k long, v string").parquet(folder), name, ["k"], ["v"], str(tmp_path / "cp"), mode="upsert")
    assert rows(spark.table(name)) == [(1, "a"), (2, "z")]
    assert not spark.catalog.tableExists(f"{name}_next") and not spark.catalog.tableExists(f"{name}_old")
    spark.sql(f"drop table {name}")


def test_sessions_of_a_stream(spark, tmp_path):
    """With a watermark, a stream gives the closed sessions of the batch form."""
    e = [("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 00:02:00"), ("u", "2024-01-01 01:00:00"), ("v", "2024-01-01 03:00:00")]
    d = spark.createDataFrame(e, "user string, t string").select("user", F.to_timestamp("t").alias("t"))
    d.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "e"))
    out = incremental.activity_sessions(stream, "user", "t", watermark="5 minutes")
    out.writeStream.format("memory").queryName("closed_sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    batch = incremental.activity_sessions(d, "user", "t").where("user = 'u'")
    assert rows(spark.table("closed_sessions")) == rows(batch)


def test_session_gap_joins(spark):
    e = spark.createDataFrame([("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 00:03:00"), ("u", "2024-01-01 00:06:01")], "user string, t string").withColumn("t", F.to_timestamp("t"))
    out = incremental.activity_sessions(e, "user", "t")
    assert sorted(r["n_events"] for r in out.collect()) == [1, 2]


def test_unfilled_link_tables(spark):
    pages = spark.createDataFrame([(1, [("HCA", "2001", "5"), ("HCA", "2001", "x")])], "nid int, cases_ref array<struct<court:string,year:string,no:string>>")
    judgments = spark.createDataFrame([(7, "HCA", 2001, 5)], "id int, courtName string, year int, number int")
    assert rows(links.link_cases(pages, judgments)) == [(1, 7)]
    caps = spark.createDataFrame([("1", [("s1", ["a", "z"])], [("a",)])], "cap_no string, sections array<struct<name:string,interp_terms:array<string>>>, interpretations array<struct<term:string>>")
    terms = links.link_terms(caps)
    assert rows(terms) == [("1", "a", "1/s1")]
    lifted = links.lift_links(terms.select("term", "path"), spark.createDataFrame([("1/s1", "1")], "path string, cap string"), "path", "cap")
    assert rows(lifted) == [("a", "1")]


def test_case_links_are_distinct_without_a_shuffle_of_all_edges(spark):
    """Repeated references and pages, judgments under several citations, twice under one, without an id or a number."""
    kind = "nid int, cases_ref array<struct<court:string,year:string,no:string>>"
    a, b, c = ("A", "2001", "5"), ("B", "2001", "6"), ("C", "1999", "1")
    pages = spark.createDataFrame([(1, [a, a, b]), (1, [a, c]), (2, [b, ("B", None, "6"), (None, "2001", "6")]), (3, [])], kind)
    judgments = spark.createDataFrame(
        [(7, "A", 2001, 5), (7, "A", 2001, 5), (8, "A", 2001, 5), (8, "B", 2001, 6), (8, "C", 1999, 1), (None, "A", 2001, 5), (None, "B", 2001, 6), (9, "B", 2001, None), (10, None, 2001, 6)], "id int, courtName string, year int, number int"
    )
    out = links.link_cases(pages, judgments)
    assert sorted(rows(out), key=repr) == sorted([(1, 7), (1, 8), (1, None), (2, 8), (2, None)], key=repr)
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert plan[0].startswith("Union") and "Aggregate" not in plan[1]
