"""Queries of ranked retrieval."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.keys import terms
from ..operators import hybrid, retrieval, text_index, vector_index
from ..session import shared_folder, table
from .registry import query

TERMS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
POSTINGS = f"""
p AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TERMS.format('text')}) AS term FROM documents) GROUP BY ALL),
len AS (SELECT doc_id, sum(tf) AS len FROM p GROUP BY doc_id),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
tot AS (SELECT count(*) AS n, avg(len) AS al FROM len)
"""
BM25 = f"""
{POSTINGS},
q AS (SELECT DISTINCT item_id AS query_id, unnest({TERMS.format('text')}) AS term FROM benchmark),
need AS (SELECT query_id, count(*) AS need FROM q GROUP BY query_id),
sc AS (SELECT query_id, p.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))), 4) AS score, count(*) AS matched
       FROM q JOIN p USING (term) JOIN df USING (term) JOIN len USING (doc_id), tot GROUP BY query_id, p.doc_id),
any_ AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc),
all_ AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc JOIN need USING (query_id) WHERE matched = need)
"""
VECTOR = """
u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
cs AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM u a, u b WHERE {0}),
vec AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM cs)
"""


def bench(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q_text"))


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))


def query_vectors(spark, sf_dir):
    """The stated query set of a vector search: ids divisible by 100."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q_vec"))


@query(f"WITH {POSTINGS} SELECT doc_id, term, tf FROM p")
def term_postings(spark, sf_dir):
    return retrieval.term_postings(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"WITH {POSTINGS} SELECT term, df FROM df")
def doc_freq(spark, sf_dir):
    return retrieval.doc_freq(retrieval.term_postings(table(spark, sf_dir, "documents"), "doc_id", "text"))


@query(f"WITH {BM25} SELECT query_id, doc_id, score, rank FROM any_ WHERE rank <= 10")
def search_bm25_any(spark, sf_dir):
    return retrieval.search_text(bench(spark, sf_dir), table(spark, sf_dir, "documents"), 10, "any")


@query(f"WITH {BM25} SELECT query_id, doc_id, score, rank FROM all_ WHERE rank <= 10")
def search_bm25_all(spark, sf_dir):
    return retrieval.search_text(bench(spark, sf_dir), table(spark, sf_dir, "documents"), 10, "all")


@query(f"WITH {BM25} SELECT query_id, doc_id, score, rank FROM any_ WHERE rank <= 10")
def search_bm25_index(spark, sf_dir):
    """As search_bm25_any, from postings written once to the shared folder."""
    path = f"{shared_folder(spark)}/text-index-{uuid.uuid4().hex}"
    retrieval.write_text_index(table(spark, sf_dir, "documents"), path)
    return retrieval.search_index(bench(spark, sf_dir), path, 10, "any")


def text_index_of(spark, docs):
    return text_index.create_text_index(docs, f"{shared_folder(spark)}/segments-{uuid.uuid4().hex}")


@query(f"WITH {BM25} SELECT query_id, doc_id, score, rank FROM any_ WHERE rank <= 10")
def search_bm25_blocks_any(spark, sf_dir):
    """As search_bm25_any, from stored blocks; those that can't hold one of a query's ten hits aren't scored."""
    return text_index.search_text_index(bench(spark, sf_dir), text_index_of(spark, table(spark, sf_dir, "documents")), 10, "any")


@query(f"WITH {BM25} SELECT query_id, doc_id, score, rank FROM all_ WHERE rank <= 10")
def search_bm25_blocks_all(spark, sf_dir):
    return text_index.search_text_index(bench(spark, sf_dir), text_index_of(spark, table(spark, sf_dir, "documents")), 10, "all")


@query(f"""
WITH {BM25.replace("FROM documents)", "FROM (SELECT doc_id, text FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 2 = 0))")}
SELECT query_id, doc_id, score, rank FROM any_ WHERE rank <= 10
""")
def search_bm25_upserted(spark, sf_dir):
    """An index that began with other texts, lacked a third of the documents and held some too many: two upserts and a deletion later it answers as one of today's documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    k = F.col("doc_id")
    index = text_index_of(spark, docs.where(k % 3 != 0).withColumn("text", F.when(k % 4 == 1, F.concat(F.lit("old words "), F.reverse("text"))).otherwise(F.col("text"))))
    text_index.upsert_documents(index, docs.where(k % 4 == 1))
    text_index.upsert_documents(index, docs.where((k % 3 == 0) & (k % 4 != 1)))
    text_index.delete_documents(index, docs.where((k % 5 == 0) & (k % 2 != 0)))
    return text_index.search_text_index(bench(spark, sf_dir), index, 10, "any")


@query(f"WITH {VECTOR.format('a.vec_id % 100 = 0')} SELECT query_id, doc_id, score, rank FROM vec WHERE rank <= 10")
def search_cosine_topk(spark, sf_dir):
    return retrieval.search_vector(query_vectors(spark, sf_dir), vectors(spark, sf_dir), 10)


@query()
def search_cosine_lsh(spark, sf_dir):
    return retrieval.search_vector_lsh(query_vectors(spark, sf_dir), vectors(spark, sf_dir), 10)


def vector_index_of(spark, sf_dir):
    return vector_index.write_vector_index(vectors(spark, sf_dir), f"{shared_folder(spark)}/vector-index-{uuid.uuid4().hex}")


@query()
def search_cosine_lists(spark, sf_dir):
    """Nearest vectors from the lists that hold nine tenths of the neighbours and more; not all of them, so it has no SQL. Tests measure its recall."""
    return vector_index.search_vector_index(query_vectors(spark, sf_dir), vector_index_of(spark, sf_dir), 10)


@query(f"WITH {VECTOR.format('a.vec_id % 100 = 0')} SELECT query_id, doc_id, score, rank FROM vec WHERE rank <= 10")
def search_cosine_lists_exact(spark, sf_dir):
    """As search_cosine_topk, from an index whose lists are left out only where their bounds say so."""
    return vector_index.search_vector_index(query_vectors(spark, sf_dir), vector_index_of(spark, sf_dir), 10, exact=True)


HYBRID = f"""
WITH {BM25}, {VECTOR.format('a.vec_id IN (SELECT item_id FROM benchmark)')},
legs AS (SELECT query_id, doc_id, rank FROM any_ WHERE rank <= 50 UNION ALL SELECT query_id, doc_id, rank FROM vec WHERE rank <= 50),
f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score FROM legs GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f)
SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 10
"""


@query(HYBRID)
def search_hybrid_rrf(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q_vec"))
    q = bench(spark, sf_dir).join(v, "query_id", "left")
    return retrieval.search_hybrid(q, table(spark, sf_dir, "documents"), vectors(spark, sf_dir), 10)


@query(HYBRID)
def search_hybrid_indexes(spark, sf_dir):
    """As search_hybrid_rrf, from a stored text index and a stored vector index."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q_vec"))
    q = bench(spark, sf_dir).join(v, "query_id", "left")
    return hybrid.search_hybrid_index(q, text_index_of(spark, table(spark, sf_dir, "documents")), vector_index_of(spark, sf_dir), 10, first=25)


@query(f"WITH {BM25} SELECT query_id, doc_id, score, rank FROM any_ WHERE rank > 10 AND rank <= 15")
def paginate(spark, sf_dir):
    return retrieval.paginate(retrieval.search_text(bench(spark, sf_dir), table(spark, sf_dir, "documents"), 15, "any"), 10, 5)


@query("""
WITH r AS (SELECT user_id, event_id, round(value, 6) AS score, row_number() OVER (PARTITION BY user_id ORDER BY round(value, 6) DESC, event_id) AS rank FROM events)
SELECT user_id, event_id, score, rank FROM r WHERE rank <= 8
""")
def topk_per_query(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.round("value", 6).alias("score"))
    return retrieval.rank_top(e, 8, "user_id", "score", "event_id")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def topn_offset(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(5).limit(20)


def hits_with_text(spark, sf_dir):
    q = bench(spark, sf_dir)
    hits = retrieval.search_text(q, table(spark, sf_dir, "documents"), 3, "any")
    hits = hits.join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").join(q, "query_id")
    return retrieval.captions(hits.withColumn("q_terms", F.array_distinct(terms(F.col("q_text")))))


CAPTION = f"""
WITH {BM25},
h AS (SELECT query_id, doc_id, text FROM any_ JOIN documents USING (doc_id) WHERE rank <= 3),
qt AS (SELECT query_id, list(term) AS qt FROM q GROUP BY query_id),
sl AS (SELECT query_id, doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?\\n]'), lambda s: trim(s)), lambda s: s <> '') AS ss FROM h),
s AS (SELECT query_id, doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM sl),
n AS (SELECT query_id, doc_id, s, i, len(list_intersect({TERMS.format('s')}, qt)) AS n FROM s JOIN qt USING (query_id)),
b AS (SELECT query_id, doc_id, arg_max(s, n * 1000000 - i) AS s, max(n) AS n FROM n GROUP BY query_id, doc_id),
c AS (SELECT h.query_id, h.doc_id, CASE WHEN coalesce(n, 0) > 0 THEN s ELSE '' END AS caption FROM h LEFT JOIN b ON b.query_id = h.query_id AND b.doc_id = h.doc_id)
"""


@query(CAPTION + "SELECT query_id, doc_id, caption FROM c")
def caption_best_sentence(spark, sf_dir):
    return hits_with_text(spark, sf_dir).select("query_id", "doc_id", "caption")


@query(CAPTION + f"""
SELECT query_id, doc_id, array_to_string(list_transform(string_split(caption, ' '), lambda w: CASE WHEN list_has_any({TERMS.format('w')}, qt) THEN '<em>' || w || '</em>' ELSE w END), ' ') AS highlights
FROM c JOIN qt USING (query_id)
""")
def caption_highlight(spark, sf_dir):
    return hits_with_text(spark, sf_dir).select("query_id", "doc_id", "highlights")


@query(f"""
WITH {BM25}, d AS (SELECT query_id % 5 AS request, query_id, rank, doc_id, row_number() OVER (PARTITION BY query_id % 5, doc_id ORDER BY query_id, rank) AS rn FROM any_ WHERE rank <= 10)
SELECT request, query_id, rank, doc_id FROM d WHERE rn = 1
""")
def dedupe_hits(spark, sf_dir):
    hits = retrieval.search_text(bench(spark, sf_dir), table(spark, sf_dir, "documents"), 10, "any").withColumn("request", F.col("query_id") % 5)
    return retrieval.dedupe_hits(hits, "request", ["doc_id"], ["query_id", "rank"]).select("request", "query_id", "rank", "doc_id")


@query(r"""
WITH a AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '(?i)\bthe\b', ' ', 'g'), '\s+', ' ', 'g')) AS q FROM conversations),
b AS (SELECT conv_id, turn, CASE WHEN regexp_matches(q, '\bof\b') AND NOT contains(lower(q), 'order form') THEN q || ' Order Form' WHEN contains(lower(q), 'order form') AND NOT regexp_matches(q, '\bof\b') THEN q || ' of' ELSE q END AS q FROM a)
SELECT conv_id, turn, q FROM b
""")
def normalise_queries(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("q"))
    return retrieval.normalise_queries(c, "q", {"of": "Order Form"}, ["the"])


@query("""
WITH r AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations)
SELECT conv_id, CAST(n AS BIGINT) AS query_no, text AS query FROM r WHERE n < 3
""")
def first_n_turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    texts = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("q"))
    texts = texts.select("conv_id", F.transform("q", lambda x: x["text"]).alias("queries"))
    return retrieval.first_n_queries(texts, "queries", 3).withColumn("query_no", F.col("query_no").cast("bigint"))
