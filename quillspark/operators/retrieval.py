"""Ranked retrieval for a table of queries over a table of documents."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import terms
from .nearest import nearest

K1, B, RRF = 1.2, 0.75, 60
#: Rows of (query, term) that are sent to all executors, after they were counted; more are met in a shuffled join.
SMALL = 500_000


def rank_top(hits: DataFrame, k: int, query: str = "query_id", score: str = "score", doc: str = "doc_id") -> DataFrame:
    """The k best hits per query with `rank` from 1; ties by document id. Spark limits each partition to k rows before it shuffles."""
    w = Window.partitionBy(query).orderBy(F.desc(score), F.asc(doc))
    return hits.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def term_postings(docs: DataFrame, doc: str, *texts: str) -> DataFrame:
    """(doc, term, tf) over one or more text columns."""
    t = F.explode(F.flatten(F.array(*(F.coalesce(terms(F.col(c)), F.array().cast("array<string>")) for c in texts))))
    return docs.select(doc, t.alias("term")).groupBy(doc, "term").agg(F.count(F.lit(1)).alias("tf"))


def doc_freq(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def doc_lengths(postings: DataFrame, doc: str) -> DataFrame:
    return postings.groupBy(doc).agg(F.sum("tf").alias("len"))


def text_index(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, doc, tf, len): postings with the document's length in each row."""
    t = docs.select(doc, F.coalesce(terms(F.col(text)), F.array().cast("array<string>")).alias("t")).withColumn("len", F.size("t").cast("bigint"))
    return t.select(doc, "len", F.explode("t").alias("term")).groupBy("term", doc, "len").agg(F.count(F.lit(1)).alias("tf"))


def write_text_index(docs: DataFrame, path: str, buckets: int = 64, doc: str = "doc_id", text: str = "text") -> None:
    """Postings and totals in Parquet, postings laid out by term hash so that a query's terms read few folders.

    A term's rows go to several files, by the document's hash, so that a stop word doesn't make one task.
    """
    lengths = docs.select(F.size(F.coalesce(terms(F.col(text)), F.array().cast("array<string>"))).cast("bigint").alias("len")).where("len > 0")
    lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("len").alias("n_terms")).write.mode("overwrite").parquet(f"{path}/totals")
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    p = text_index(docs, doc, text).withColumn("bucket", bucket).withColumn("_part", F.pmod(F.xxhash64(doc), F.lit(8)))
    p = p.repartition("bucket", "_part").drop("_part").sortWithinPartitions("bucket", "term")
    p.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")


def search_index(queries: DataFrame, path: str, top: int | None, mode: str = "all", buckets: int = 64, query: str = "query_id", q_text: str = "q_text", doc: str = "doc_id") -> DataFrame:
    """(query, doc, score, rank) by BM25 from an index of `write_text_index`; only the folders and row groups of the asked terms are read."""
    spark = queries.sparkSession
    asked = asked_terms(queries, query, q_text)
    wanted = asked.select("term").distinct().withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    used = spark.read.parquet(f"{path}/postings").join(wanted, ["bucket", "term"], "left_semi").drop("bucket")
    return score_postings(asked, used, spark.read.parquet(f"{path}/totals"), top, mode, query, doc)


def asked_terms(queries: DataFrame, query: str, q_text: str) -> DataFrame:
    return queries.select(query, F.explode(F.array_distinct(terms(F.col(q_text)))).alias("term"))


def score_postings(asked: DataFrame, used: DataFrame, totals: DataFrame, top: int | None, mode: str, query: str, doc: str) -> DataFrame:
    """BM25 of asked(query, term) over used(term, doc, tf, len); totals(n_docs, n_terms) is one row."""
    weights = doc_freq(used).join(F.broadcast(totals))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = weights.select("term", idf.alias("idf"), (F.col("n_terms") / F.col("n_docs")).alias("avg_len"))
    tf = F.col("tf")
    part = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    terms_of = asked.join(weights, "term")
    if asked.count() <= SMALL:
        # The whole table of asked terms goes to the postings, which are dealt by document: scores are summed without another shuffle.
        hits = used.repartition(doc).join(F.broadcast(terms_of), "term")
    else:
        hits = used.join(terms_of, "term")
    scored = hits.groupBy(query, doc).agg(F.round(F.sum(part), 4).alias("score"), F.count(F.lit(1)).alias("matched"))
    if mode == "all":
        need = asked.groupBy(query).agg(F.count(F.lit(1)).alias("need"))
        scored = scored.join(need, query).where("matched = need").drop("need")
    scored = scored.drop("matched")
    return scored if top is None else rank_top(scored, top, query, "score", doc)


def search_text(queries: DataFrame, docs: DataFrame, top: int | None, mode: str = "all", query: str = "query_id", q_text: str = "q_text", doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(query, doc, score, rank) by BM25; with mode "all" every distinct query term must match.

    For one table of queries against texts without an index (`search_index` reads one). A document's length comes from its own row, and other terms than the asked
    ones are dropped before anything is counted.
    """
    asked = asked_terms(queries, query, q_text)
    t = docs.select(doc, F.coalesce(terms(F.col(text)), F.array().cast("array<string>")).alias("t")).withColumn("len", F.size("t").cast("bigint"))
    totals = t.where("len > 0").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("len").alias("n_terms"))
    used = t.select(doc, "len", F.explode("t").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    used = used.groupBy("term", doc, "len").agg(F.count(F.lit(1)).alias("tf"))
    return score_postings(asked, used, totals, top, mode, query, doc)


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """To 6 places; 0 for a zero vector. Norms are given, so that none is computed anew for each pair."""
    return F.round(F.when(norm_a * norm_b > 0, dot(a, b) / (norm_a * norm_b)).otherwise(F.lit(0.0)), 6)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def search_vector(queries: DataFrame, corpus: DataFrame, top: int, query: str = "query_id", q_vec: str = "q_vec", doc: str = "doc_id", vec: str = "vec") -> DataFrame:
    """(query, doc, score, rank) by exact cosine similarity.

    All pairs are scored, as products of matrices of blocks of queries and blocks of the corpus (`nearest`); what may be among a query's best is scored anew, number by number.
    """
    return rank_top(nearest(queries, corpus, top, query, q_vec, doc, vec), top, query, "score", doc)


def lsh_bits(rows: int) -> int:
    """Most hyperplanes of a table: buckets of about 32 rows if vectors were spread evenly."""
    return max(1, min(30, round(math.log2(max(rows, 64) / 32))))


def _planes(tables: int, bits: int, dims: int, seed: int):
    import numpy as np

    return np.random.default_rng(seed).normal(size=(tables, bits, max(dims, 1))).round(6)


def measured_bits(corpus: DataFrame, tables: int = 24, flips: int = 1, seed: int = 11, target: float = 0.91, top: int = 10, sample: int = 60, doc: str = "doc_id", vec: str = "vec") -> int:
    """As many hyperplanes as keep `target` of the nearest `top` rows of `sample` rows of the corpus, at most `lsh_bits`.

    The sampled rows (those with the least hash of their id) are searched exactly once; whether two rows would meet is then worked out from their sides of the hyperplanes, for fewer and fewer of these.
    """
    import numpy as np

    rows = corpus.count()
    asked = corpus.where(F.col(vec).isNotNull()).select(F.col(doc).alias("_asked"), F.col(vec).alias("_vec")).orderBy(F.xxhash64("_asked"), "_asked").limit(sample)
    near = search_vector(asked, corpus, top + 1, "_asked", "_vec", doc, vec).where(F.col("_asked") != F.col(doc))
    # sample x top pairs of vectors at most
    pairs = near.join(corpus.select(doc, vec), doc).join(asked, "_asked").select("_vec", F.col(vec).alias("v")).collect()
    most = lsh_bits(rows)
    if not pairs:
        return most
    a, b = (np.array([r[c] for r in pairs], float) for c in ("_vec", "v"))
    for bits in range(most, 1, -1):
        planes = _planes(tables, bits, a.shape[1], seed)
        sa, sb = (np.einsum("tbd,pd->ptb", planes, x) for x in (a, b))
        apart = (sa > 0) != (sb > 0)
        crossed = np.argsort(np.abs(sa), axis=2, kind="stable")[:, :, :flips]
        # A row is found in its own bucket, or across one of the query's nearest hyperplanes.
        n = apart.sum(axis=2)
        one = (n == 1) & np.take_along_axis(apart, crossed, 2).any(axis=2)
        if ((n == 0) | one).any(axis=1).mean() >= target:
            return bits
    return 1


def lsh_candidates(queries: DataFrame, corpus: DataFrame, tables: int = 24, bits: int | None = None, flips: int = 1, seed: int = 11, query: str = "query_id", q_vec: str = "q_vec", doc: str = "doc_id", vec: str = "vec") -> DataFrame:
    """Distinct (query, doc) that share a bucket of some table of random hyperplanes.

    A corpus row is in one bucket of each table. A query also probes the buckets beside its own, those across its `flips` nearest hyperplanes. Unless `bits` is given, it is measured on the corpus, so
    that recall is held as the corpus grows.
    """
    import json

    dims = corpus.select(F.size(vec)).first()
    dims = dims[0] if dims else 0
    bits = bits or measured_bits(corpus, tables, flips, seed, doc=doc, vec=vec)
    planes = _planes(tables, bits, dims, seed).tolist()
    constant = F.from_json(F.lit(json.dumps(planes)), "array<array<array<double>>>")
    sides = lambda v: F.transform(constant, lambda rows: F.transform(rows, lambda p: dot(v, p)))
    code = lambda d: F.aggregate(d, F.lit(0).cast("bigint"), lambda a, x: a * 2 + F.when(x > 0, F.lit(1)).otherwise(F.lit(0)))
    key = lambda t, k: t.cast("bigint") * (1 << bits) + k

    c = corpus.select(doc, sides(doubles(F.col(vec))).alias("s")).select(doc, F.explode(F.transform("s", lambda d, t: key(t, code(d)))).alias("k"))
    near = lambda d: F.slice(F.array_sort(F.transform(d, lambda x, i: F.struct(F.abs(x).alias("far"), i.alias("i")))), 1, flips)
    flip = lambda d: F.transform(near(d), lambda n: code(d).bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(bits - 1) - n["i"])))
    probes = F.flatten(F.transform("s", lambda d, t: F.transform(F.concat(F.array(code(d)), flip(d)), lambda k: key(t, k))))
    q = queries.select(query, sides(doubles(F.col(q_vec))).alias("s")).select(query, F.explode(probes).alias("k"))
    return q.join(c, "k").select(query, doc).distinct()


def search_vector_lsh(
    queries: DataFrame, corpus: DataFrame, top: int, query: str = "query_id", q_vec: str = "q_vec", doc: str = "doc_id", vec: str = "vec", tables: int = 24, bits: int | None = None, flips: int = 1, seed: int = 11
) -> DataFrame:
    """Approximate neighbours: random-hyperplane buckets tell which rows are candidates, as in `lsh_candidates`, exact cosine ranks them.

    On scattered vectors few hyperplanes keep recall, and candidates are most of all pairs. So these aren't made as rows: blocks of both sides meet as in `search_vector`, and buckets are compared inside them.
    """
    import numpy as np

    bits = bits or measured_bits(corpus, tables, flips, seed, doc=doc, vec=vec)
    planes = _planes(tables, bits, corpus.agg(F.max(F.size(vec))).first()[0] or 0, seed)
    power = 1 << np.arange(bits - 1, -1, -1)

    def sides(v):
        rows = v.rows[:, : planes.shape[2]]
        d = np.einsum("nd,tbd->tnb", rows, planes[:, :, : rows.shape[1]], optimize=True)
        return d, (d > 0) @ power

    def probes_of(u):
        d, own = sides(u)
        near = np.argsort(np.abs(d), axis=2, kind="stable")[:, :, :flips]
        return np.concatenate([own[:, :, None], own[:, :, None] ^ power[near]], axis=2)

    def allowed(u, v):
        # A block meets many others: its codes are worked out once.
        u.codes = probes = probes_of(u) if u.codes is None else u.codes
        v.codes = codes = sides(v)[1] if v.codes is None else v.codes

        def may(i, j):
            left = np.arange(len(i))
            ok = np.zeros(len(i), bool)
            for t in range(tables):
                # Only pairs that no table has joined so far.
                p, c = probes[t][i[left]], codes[t][j[left]]
                hit = (p == c[:, None]).any(axis=1)
                ok[left[hit]] = True
                left = left[~hit]
            return ok

        return may

    return rank_top(nearest(queries, corpus, top, query, q_vec, doc, vec, allowed=allowed), top, query, "score", doc)


def fuse(legs: list[DataFrame], top: int, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """Reciprocal rank fusion of ranked legs."""
    both = legs[0].select(query, doc, "rank")
    for leg in legs[1:]:
        both = both.unionByName(leg.select(query, doc, "rank"))
    scored = both.groupBy(query, doc).agg(F.round(F.sum(F.lit(1.0) / (F.lit(RRF) + F.col("rank"))), 8).alias("score"))
    return rank_top(scored, top, query, "score", doc)


def search_hybrid(queries: DataFrame, docs: DataFrame, vectors: DataFrame, top: int = 10, leg_top: int = 50, mode: str = "any") -> DataFrame:
    """Text and vector legs of queries(query_id, q_text, q_vec), fused."""
    text = search_text(queries, docs, leg_top, mode)
    vector = search_vector(queries.where("q_vec is not null"), vectors, leg_top)
    return fuse([text, vector], top)


def paginate(hits: DataFrame, skip: int = 0, top: int = 10) -> DataFrame:
    """Per query: the hits ranked skip + 1 to skip + top."""
    return hits.where((F.col("rank") > skip) & (F.col("rank") <= skip + top))


def captions(hits: DataFrame, query_terms: str = "q_terms", text: str = "text") -> DataFrame:
    """Add caption and highlights: the first sentence with the most query terms, '' if none holds any.

    Sentences end at `.`, `!`, `?` or a line end; matching words are wrapped in <em>.
    """
    sentences = F.filter(F.transform(F.split(F.col(text), r"[.!?\n]"), lambda s: F.trim(s)), lambda s: s != "")
    scored = F.transform(sentences, lambda s, i: F.struct(F.size(F.array_intersect(terms(s), F.col(query_terms))).alias("n"), (-i).alias("at"), s.alias("s")))
    best = F.array_max(scored)
    caption = F.when(best["n"] > 0, best["s"]).otherwise(F.lit(""))
    caption = F.coalesce(caption, F.lit(""))
    marked = F.transform(F.split("caption", " "), lambda w: F.when(F.arrays_overlap(terms(w), F.col(query_terms)), F.concat(F.lit("<em>"), w, F.lit("</em>"))).otherwise(w))
    return hits.withColumn("caption", caption).withColumn("highlights", F.array_join(marked, " "))


def dedupe_hits(hits: DataFrame, request: str, keys: list[str], order: list[str]) -> DataFrame:
    """Across the queries of one request, the first hit of each key by a stated order."""
    w = Window.partitionBy(request, *keys).orderBy(*order)
    return hits.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def normalise_queries(df: DataFrame, text: str, full_names: dict[str, str], stop: list[str]) -> DataFrame:
    """Remove stop phrases, then name both forms where an abbreviation or its full name occurs; spaces are made single.

    The dictionary is a parameter of a few entries and becomes expressions of the plan.
    """
    out = F.col(text)
    for phrase in stop:
        out = F.regexp_replace(out, rf"(?i)\b{re.escape(phrase)}\b", " ")
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    for short, full in full_names.items():
        has_short, has_full = F.rlike(out, F.lit(rf"\b{re.escape(short)}\b")), F.contains(F.lower(out), F.lit(full.lower()))
        out = F.when(has_short & ~has_full, F.concat(out, F.lit(f" {full}"))).when(has_full & ~has_short, F.concat(out, F.lit(f" {short}"))).otherwise(out)
    return df.withColumn(text, out)


def phrase_matches(df: DataFrame, key: str, words: str, phrases: DataFrame, phrase: str, longest: int) -> DataFrame:
    """(key, at, n, *phrases): the leftmost longest matches of a table of phrases in an array column of words; matches don't overlap.

    Each query gives a row for each stretch of up to `longest` words, met with the phrases by equality, so a dictionary of any size is a join. A phrase is written with single spaces between its words.
    """
    at, n = F.explode(F.sequence(F.lit(0), F.size(words) - 1)), F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.size(words) - F.col("at"))))
    spans = df.where(F.size(words) > 0).select(key, words, at.alias("at")).select(key, words, "at", n.alias("n"))
    spans = spans.select(key, "at", "n", F.array_join(F.slice(words, F.col("at") + 1, F.col("n")), " ").alias(phrase))
    hits = spans.join(phrases, phrase)
    # Of one start the longest, then from left to right what begins after the last match has ended.
    best = hits.groupBy(key, "at").agg(F.max_by(F.struct("n", *phrases.columns), "n").alias("m"))
    lined = best.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "m"))).alias("ms"))
    kind = lined.schema["ms"].dataType.simpleString()
    start = F.struct(F.lit(0).alias("end"), F.array().cast(kind).alias("kept"))
    step = lambda acc, x: F.when(x["at"] < acc["end"], acc).otherwise(F.struct((x["at"] + x["m"]["n"]).alias("end"), F.concat(acc["kept"], F.array(x)).alias("kept")))
    kept = lined.select(key, F.explode(F.aggregate("ms", start, step)["kept"]).alias("x"))
    return kept.select(key, "x.at", "x.m.n", *[F.col(f"x.m.{c}").alias(c) for c in phrases.columns])


def normalise_by_tables(df: DataFrame, key: str, text: str, names: DataFrame, stop: DataFrame, longest: int = 8) -> DataFrame:
    """As `normalise_queries`, with dictionaries as tables: names(short, full) and stop(phrase), of thousands of entries or more.

    Matching is by whole words (runs of letters, digits and `_`) of up to `longest` words: stop phrases and full names in any case, abbreviations as written. Stop phrases go first, leftmost and longest; then each name
    that occurs in one form only gets the other one appended, in order of the abbreviation. `key` tells the queries apart.
    """
    pieces = lambda c: F.regexp_extract_all(c, F.lit(r"(?U)(\w+|\W+)"), F.lit(1))
    is_word = lambda x: F.rlike(x, F.lit(r"(?U)^\w"))
    words = lambda c: F.filter(pieces(c), is_word)
    single = lambda c: F.array_join(words(c), " ")
    lower = lambda c: F.transform(words(c), lambda w: F.lower(w))
    gone = stop.select(F.lower(single(F.col("phrase"))).alias("phrase")).where("phrase != ''").distinct()
    cut = phrase_matches(df.select(key, lower(F.col(text)).alias("w")), key, "w", gone, "phrase", longest)
    cut = cut.groupBy(key).agg(F.flatten(F.collect_list(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1))).alias("_gone"))
    # Words are numbered among all pieces: those that a phrase covers become one space, with what stands between them.
    numbered = F.aggregate(
        pieces(F.col(text)),
        F.struct(F.lit(-1).alias("i"), F.array().cast("array<string>").alias("out")),
        lambda acc, x: F.struct(
            (acc["i"] + F.when(is_word(x), 1).otherwise(0)).alias("i"),
            F.concat(acc["out"], F.array(F.when(is_word(x) & F.array_contains("_gone", acc["i"] + 1), F.lit(" ")).otherwise(x))).alias("out"),
        ),
    )["out"]
    left = df.join(cut, key, "left").withColumn("_gone", F.coalesce("_gone", F.array().cast("array<int>")))
    left = left.withColumn(text, F.when(F.col(text).isNotNull(), F.trim(F.regexp_replace(F.array_join(numbered, ""), r"\s+", " ")))).drop("_gone")
    by_short = names.select(single(F.col("short")).alias("phrase"), "short", "full")
    by_full = names.select(F.lower(single(F.col("full"))).alias("phrase"), "short", "full")
    hit = lambda rows, own, form: phrase_overlaps(rows, key, "w", own, longest).select(key, "short", "full", F.lit(form).alias("form"))
    found = hit(left.select(key, words(F.col(text)).alias("w")), by_short, "short").unionByName(hit(left.select(key, lower(F.col(text)).alias("w")), by_full, "full"))
    one = found.groupBy(key, "short", "full").agg(F.collect_set("form").alias("forms")).where(F.size("forms") == 1)
    added = F.when(F.col("forms")[0] == "short", F.col("full")).otherwise(F.col("short"))
    more = one.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("short", "full", added.alias("added")))).alias("_more"))
    out = left.join(more, key, "left").withColumn(text, F.when(F.col(text).isNotNull(), F.concat_ws(" ", F.col(text), F.transform("_more", lambda x: x["added"]))))
    return out.select(*df.columns)


def phrase_overlaps(df: DataFrame, key: str, words: str, phrases: DataFrame, longest: int) -> DataFrame:
    """(key, *phrases): all phrases that occur, overlapping or not, once for each query."""
    at, n = F.explode(F.sequence(F.lit(0), F.size(words) - 1)), F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.size(words) - F.col("at"))))
    spans = df.where(F.size(words) > 0).select(key, words, at.alias("at")).select(key, words, "at", n.alias("n"))
    spans = spans.select(key, F.array_join(F.slice(words, F.col("at") + 1, F.col("n")), " ").alias("phrase")).distinct()
    return spans.join(phrases, "phrase").select(key, *phrases.columns)


def first_n_queries(df: DataFrame, queries: str, n: int = 3) -> DataFrame:
    """Exploded generated queries of each request with query_no, the first n."""
    return df.select("*", F.posexplode(queries).alias("query_no", "query")).where(F.col("query_no") < n).drop(queries)
