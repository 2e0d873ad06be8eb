"""Search over documents and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from presswork.functions import text
from presswork.operators import search
from presswork.plans.registry import query
from presswork.sources import artifacts, search_index
from presswork.sources.logs import shared_path

TOK = "regexp_extract_all(lower({}), '[a-z0-9]+(?:''[a-z0-9]+)?')"
POSTS = f"posts AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc_id AS doc, unnest({TOK.format('text')}) AS term FROM documents) GROUP BY ALL)"
WORDS = (POSTS, "len AS (SELECT doc, sum(tf) AS length FROM posts GROUP BY doc)", "st AS (SELECT (SELECT count(*) FROM documents) AS n, greatest((SELECT sum(length) FROM len)::DOUBLE / (SELECT count(*) FROM documents), 1) AS avg_len)",
         "idf AS (SELECT term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM posts, st GROUP BY term)",
         "bm AS (SELECT query, doc, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avg_len))), 9) AS score FROM posts JOIN asked USING (term) JOIN idf USING (term) JOIN len USING (doc), st GROUP BY ALL)",
         "bm_hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM bm) WHERE rank <= 50)")
BM25 = (f"asked AS (SELECT DISTINCT item_id AS query, unnest({TOK.format('text')}) AS term FROM benchmark WHERE item_id % 50 = 0)", *WORDS)
VECTORS = ("dn AS (SELECT q.vec_id AS query, v.vec_id AS doc, round(list_sum(list_transform(range(1, 65), lambda i: q.embedding[i]::DOUBLE * v.embedding[i]::DOUBLE)), 9) AS score FROM dense_asks q, embeddings v WHERE v.vec_id <> q.vec_id)",
           "dn_hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM dn) WHERE rank <= 50)")
DENSE = ("dense_asks AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0)", *VECTORS)
FUSED = "fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(fusion, 12) DESC, doc) AS rank FROM (SELECT query, doc, a.rank AS rank_a, b.rank AS rank_b, coalesce(1.0 / (60 + a.rank), 0.0)::DOUBLE + coalesce(1.0 / (60 + b.rank), 0.0)::DOUBLE AS fusion FROM bm_hits a FULL JOIN dn_hits b USING (query, doc))) WHERE rank <= 20)"
VERDICTS = ("g AS (SELECT query, max(CASE WHEN rank = 1 THEN fusion END) - coalesce(max(CASE WHEN rank = 2 THEN fusion END), 0) AS margin FROM fused GROUP BY query)",
            "x AS (SELECT query, coalesce((SELECT max(score) FROM bm_hits b WHERE b.query = g.query), 0) AS lexical, coalesce((SELECT max(score) FROM dn_hits d WHERE d.query = g.query), 0) AS dense, margin FROM g)")

_indexes: dict[tuple[str, str, str], str] = {}


def document_index(t):
    """The stored index of the documents. Made once for a session and the files as they are; from then on searches read
    only it."""
    source = search_index.source_state(t.documents)
    key = (t.spark.sparkContext.applicationId, t.folder, source)
    if key not in _indexes:
        path = shared_path(t.spark, "search-index")
        search_index.build_index(t.documents, path, "doc_id", F.col("text"), source)
        _indexes[key] = path
    return search_index.open_index(t.spark, _indexes[key], source)


def bm25_hits(t, k=50):
    """Searches are the rows whose id is divisible by 50, here and in dense_hits."""
    return document_index(t).bm25(t.benchmark.where("item_id % 50 = 0"), "item_id", "text", k)


def dense_hits(t, k=50):
    return search.dense_top_k(t.embeddings, t.embeddings.where("vec_id % 50 = 0"), "vec_id", "embedding", k)


def hybrid(t, limit=20):
    return search.hybrid_search(lambda k: bm25_hits(t, k), lambda k: dense_hits(t, k), search.HybridConfig(), limit)


@query("f2_tokens", f"SELECT doc_id, len({TOK.format('text')})::INT AS n_tokens, array_to_string({TOK.format('text')}[1:5], ' ') AS first FROM documents")
def f2(t):
    tokens = text.search_tokens(F.col("text"))
    return t.documents.select("doc_id", F.size(tokens).alias("n_tokens"), F.array_join(F.slice(tokens, 1, 5), " ").alias("first"))


_TERMS = f"list_distinct(list_filter(list_concat([p], list_filter({TOK.format('text')}, lambda x: length(x) >= 3)[1:5]), lambda x: length(x) >= 3))"


@query("f3_search_terms", f"WITH b AS (SELECT item_id, text, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS p FROM benchmark) SELECT item_id, len({_TERMS})::INT AS n_terms, md5(array_to_string(list_sort({_TERMS}), '|')) AS terms FROM b")
def f3(t):
    terms = text.search_terms(F.col("text"))
    return t.benchmark.select("item_id", F.size(terms).alias("n_terms"), F.md5(F.array_join(F.array_sort(terms), "|")).alias("terms"))


@query("f4_lexical_score", "SELECT p_partkey, round((2.0 * contains(p_name, 'red ring')::INT + contains(p_brand, 'red ring')::INT + 2 * contains(p_name, 'red')::INT + contains(lower(p_brand), 'red')::INT + 2 * contains(p_name, 'ring')::INT + contains(lower(p_brand), 'ring')::INT)::DOUBLE / 9, 6) AS score FROM part")
def f4(t):
    score = text.lexical_score(text.search_terms(F.lit("red  Ring")), F.col("p_name"), F.col("p_brand"))
    return t.part.select("p_partkey", F.round(score, 6).alias("score"))


@query("a16_idf", f"WITH {POSTS} SELECT term, count(*)::BIGINT AS df, round(ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM posts GROUP BY term HAVING count(*) >= 20")
def a16(t):
    terms, _ = search.corpus_statistics(search.postings(t.documents, "doc_id", F.col("text")), t.documents.count())
    return terms.where("df >= 20").select("term", "df", F.round("idf", 6).alias("idf"))


@query("f5_bm25_top10", "WITH " + ", ".join(BM25) + " SELECT query, doc, round(score, 6) AS score, rank::INT AS rank FROM bm_hits WHERE rank <= 10")
def f5(t):
    return bm25_hits(t, 10).select("query", "doc", F.round("score", 6).alias("score"), "rank")


@query("l5_dense_topk", "WITH " + ", ".join(DENSE) + " SELECT query, doc, round(score, 6) AS score, rank::INT AS rank FROM dn_hits")
def l5(t):
    return dense_hits(t).select("query", "doc", F.round("score", 6).alias("score"), "rank")


@query("f6_rrf", "WITH " + ", ".join((*BM25, *DENSE, FUSED)) + " SELECT query, doc, rank_a::INT AS rank_a, rank_b::INT AS rank_b, round(fusion, 6) AS fusion, rank::INT AS rank FROM fused")
def f6(t):
    return search.fuse(bm25_hits(t), dense_hits(t), 20).select("query", "doc", "rank_a", "rank_b", F.round("fusion", 6).alias("fusion"), "rank")


@query("f7_gate", "WITH " + ", ".join((*BM25, *DENSE, FUSED, *VERDICTS)) + " SELECT query, round(lexical, 6) AS lexical, round(dense, 6) AS dense, round(margin, 6) AS margin, (dense >= 0.6 OR (dense >= 0.3 AND lexical >= 5 AND margin >= 0)) AS accepted FROM x")
def f7(t):
    return hybrid(t)[1].select("query", *(F.round(c, 6).alias(c) for c in ("lexical", "dense", "margin")), "accepted")


@query("c8_hybrid_search", "WITH " + ", ".join((*BM25, *DENSE, FUSED, *VERDICTS)) + " SELECT query, doc, f.rank::INT AS rank, round(fusion, 6) AS fusion, coalesce(round(b.score, 6), 0) AS word_score, coalesce(round(d.score, 6), 0) AS dense_score, (dense >= 0.6 OR (dense >= 0.3 AND lexical >= 5 AND margin >= 0)) AS accepted "
    "FROM fused f JOIN x USING (query) LEFT JOIN bm_hits b USING (query, doc) LEFT JOIN dn_hits d USING (query, doc)")
def c8(t):
    """The hybrid search as one operator: fused hits of both arms with their scores, and whether they are to be trusted."""
    hits, verdicts = hybrid(t)
    zero = lambda c: F.coalesce(F.round(c, 6), F.lit(0.0))
    return hits.join(verdicts.select("query", "accepted"), "query").select("query", "doc", "rank", F.round("fusion", 6).alias("fusion"), zero("score_a").alias("word_score"), zero("score_b").alias("dense_score"), "accepted")


@query("k64_verified_index", f"WITH {POSTS} SELECT term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS occurrences FROM posts GROUP BY term HAVING count(*) >= 20")
def k64(t):
    """An index made from documents that were written, and read back only as what their card says they are."""
    path, source = shared_path(t.spark, "documents"), search_index.source_state(t.documents)
    artifacts.write_artifact(t.documents.select("doc_id", "text"), path, "documents", 1, source)
    verified = artifacts.read_artifact(t.spark, path, "documents", 1, source)
    at = shared_path(t.spark, "search-index")
    search_index.build_index(verified, at, "doc_id", F.col("text"), source)
    index = search_index.open_index(t.spark, at, source)
    return index.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences")).where("df >= 20")


@query("f11_cosine", "SELECT a.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)) / sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) / sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def f11(t):
    nxt = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return t.embeddings.join(nxt, "vec_id").select("vec_id", F.round(text.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query("l17_pool", "WITH " + ", ".join((*BM25, *DENSE)) + ", u AS (SELECT query, doc, rank FROM bm_hits WHERE rank <= 10 UNION ALL SELECT query, doc, rank FROM dn_hits WHERE rank <= 10 UNION ALL SELECT item_id, item_id * 3, 0 FROM benchmark WHERE item_id % 50 = 0) SELECT query, doc, min(rank)::INT AS best, bool_or(rank = 0) AS anchor FROM u GROUP BY ALL")
def l17(t):
    """What is judged: the best hits of each arm and the anchors."""
    anchors = t.benchmark.where("item_id % 50 = 0").select(F.col("item_id").alias("query"), (F.col("item_id") * 3).alias("doc"), F.lit(0).alias("rank"))
    pool = bm25_hits(t, 10).select("query", "doc", "rank").unionByName(dense_hits(t, 10).select("query", "doc", "rank")).unionByName(anchors)
    return pool.groupBy("query", "doc").agg(F.min("rank").alias("best"), F.bool_or(F.col("rank") == 0).alias("anchor"))
