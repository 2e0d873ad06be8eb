"""The search cascade, topic lookups and hydration."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from presswork.operators import resolve, search
from presswork.plans.bindings import with_views
from presswork.plans.registry import query
from presswork.plans.relational_queries import HOT, item_counts
from presswork.plans.search_queries import FUSED, TOK, VECTORS, VERDICTS, WORDS, document_index

ART = "art AS (SELECT p_partkey AS article_id, p_name AS title, p_brand AS abstract, p_type AS category FROM part)"
AT = "atp AS (SELECT article_id, topic_id, min(source_rank) AS source_rank FROM (SELECT p_partkey AS article_id, (p_size % 25)::INT AS topic_id, 0 AS source_rank FROM part UNION ALL SELECT p_partkey, (p_partkey % 25)::INT, 1 FROM part) GROUP BY ALL)"
TP = "tp AS (SELECT n_nationkey AS topic_id, n_name AS display_name, (SELECT count(*) FROM atp WHERE topic_id = n_nationkey) AS news_count FROM nation)"
QM = "qm AS (SELECT s_suppkey AS row, (s_suppkey % 40)::VARCHAR AS query_key, s_nationkey AS topic_id, s_acctbal / 10000 AS score, (s_suppkey % 5)::INT AS match_rank, p_name AS display_query FROM supplier JOIN part ON p_partkey = s_suppkey)"
ASKS = "asks AS (SELECT p_partkey AS ask, CASE p_partkey % 5 WHEN 0 THEN ' ' || p_partkey || '  12' WHEN 1 THEN upper(p_name) WHEN 2 THEN 'nation_' || (p_partkey % 30) WHEN 3 THEN substr(p_name, 2, 4) ELSE 'zzz ' || p_name END AS asked FROM part)"
PASS = "CASE WHEN lower({n}) = q THEN 1 WHEN starts_with(lower({n}), q) THEN 2 WHEN contains(lower({n}), q) THEN 3 END"
LEFT = "lo AS (SELECT ask, lower(trim(asked)) AS q FROM asks WHERE NOT regexp_full_match(trim(regexp_replace(asked, '\\s+', ' ', 'g')), '[0-9]+( [0-9]+)*'))"
DISPLAY = (f"dm AS (SELECT ask, query_key, {PASS.format(n='display_query')} AS pass FROM lo, qm)",
           "dk AS (SELECT ask, query_key FROM (SELECT ask, query_key, row_number() OVER (PARTITION BY ask ORDER BY pass, count(*) DESC, query_key) AS k FROM dm WHERE pass IS NOT NULL GROUP BY ask, query_key, pass) WHERE k = 1)")
TOPIC = (f"tm AS (SELECT ask, topic_id, news_count, {PASS.format(n='display_name')} AS p FROM lo, tp)",
         "tx AS (SELECT ask, topic_id, s AS pass, row_number() OVER (PARTITION BY ask, s ORDER BY news_count DESC, topic_id) AS place FROM tm, (SELECT unnest([1, 2, 3]) AS s) WHERE p <= s)",
         "tk AS (SELECT ask, query_key FROM (SELECT ask, query_key, row_number() OVER (PARTITION BY ask ORDER BY pass, max(score) DESC, query_key) AS k FROM tx JOIN qm USING (topic_id) WHERE place <= 20 GROUP BY ask, query_key, pass) WHERE k = 1)")
TERMS = "trm AS (SELECT ask, unnest(list_distinct(list_filter(list_concat([p], list_filter(regexp_extract_all(p, '[a-z0-9]+(?:''[a-z0-9]+)?'), lambda x: length(x) >= 3)[1:5]), lambda x: length(x) >= 3))) AS term FROM (SELECT ask, trim(regexp_replace(lower(asked), '\\s+', ' ', 'g')) AS p FROM asks))"
TEXT = (TERMS, "th AS (SELECT DISTINCT ask, article_id FROM trm, art WHERE contains(lower(title), term) OR contains(lower(abstract), term))",
        "nk AS (SELECT ask, query_key FROM (SELECT ask, query_key, row_number() OVER (PARTITION BY ask ORDER BY max(score) DESC, query_key) AS k FROM th JOIN atp USING (article_id) JOIN qm USING (topic_id) GROUP BY ask, query_key) WHERE k = 1)")


def articles(t):
    return t.part.select(F.col("p_partkey").alias("article_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("abstract"), F.col("p_type").alias("category"))


def article_topics(t):
    both = F.array(F.struct((F.col("p_size") % 25).cast("int").alias("topic_id"), F.lit(0).alias("source_rank")), F.struct((F.col("p_partkey") % 25).cast("int").alias("topic_id"), F.lit(1).alias("source_rank")))
    return t.part.select(F.col("p_partkey").alias("article_id"), F.explode(both).alias("x")).groupBy("article_id", "x.topic_id").agg(F.min("x.source_rank").alias("source_rank"))


def topics(t):
    counts = article_topics(t).groupBy("topic_id").agg(F.count("*").alias("news_count"))
    named = t.nation.select(F.col("n_nationkey").alias("topic_id"), F.col("n_name").alias("display_name"))
    return named.join(counts, "topic_id", "left").withColumn("news_count", F.coalesce("news_count", F.lit(0)))


def query_map(t):
    rows = t.supplier.join(t.part, F.col("p_partkey") == F.col("s_suppkey"))
    return rows.select(F.col("s_suppkey").alias("row"), (F.col("s_suppkey") % 40).cast("string").alias("query_key"), F.col("s_nationkey").alias("topic_id"), (F.col("s_acctbal") / 10000).alias("score"), (F.col("s_suppkey") % 5).cast("int").alias("match_rank"), F.col("p_name").alias("display_query"))


def asks(t):
    key, name = F.col("p_partkey"), F.col("p_name")
    asked = F.when(key % 5 == 0, F.concat(F.lit(" "), key, F.lit("  12"))).when(key % 5 == 1, F.upper(name)).when(key % 5 == 2, F.concat(F.lit("nation_"), key % 30)).when(key % 5 == 3, F.substring(name, 2, 4)).otherwise(F.concat(F.lit("zzz "), name))
    return t.part.select(key.alias("ask"), asked.alias("asked"))


@query("c5_resolve", "WITH " + ", ".join((ART, AT, TP, QM, ASKS, LEFT, *DISPLAY, *TOPIC, *TEXT)) +
    " SELECT a.ask, CASE WHEN lo.ask IS NULL THEN trim(regexp_replace(asked, '\\s+', ' ', 'g')) ELSE coalesce(dk.query_key, tk.query_key, nk.query_key) END AS query_key, CASE WHEN lo.ask IS NULL THEN 'numeric_query_key' WHEN coalesce(dk.query_key, tk.query_key, nk.query_key) IS NULL THEN 'unresolved' ELSE 'lexical_v1' END AS source "
    "FROM asks a LEFT JOIN lo USING (ask) LEFT JOIN dk USING (ask) LEFT JOIN tk USING (ask) LEFT JOIN nk USING (ask)")
def c5(t):
    """What each of many typed texts resolves to, and by which stage."""
    return resolve.resolve(asks(t), query_map(t), topics(t), articles(t), article_topics(t))


#: Documents with an embedding and the topics of these; a fifth of the asks are numbers, display queries, names, blanks.
DOC_TOPICS = "dtp AS (SELECT article_id, topic_id, min(source_rank) AS source_rank FROM (SELECT vec_id AS article_id, label AS topic_id, 0 AS source_rank FROM embeddings UNION ALL SELECT vec_id, (vec_id % 25)::INT, 1 FROM embeddings) GROUP BY ALL)"
SEARCHES = "sa AS (SELECT item_id AS ask, CASE item_id % 5 WHEN 0 THEN item_id || '  7' WHEN 1 THEN (SELECT upper(any_value(display_query)) FROM qm WHERE qm.row = item_id) ELSE text END AS asked FROM benchmark UNION ALL SELECT 1000000 + n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN ' ' ELSE lower(n_name) END FROM nation)"


@query("c5_resolve_hybrid", "WITH " + ", ".join((AT, TP, QM, DOC_TOPICS, SEARCHES,
    "ln AS (SELECT ask, lower(trim(asked)) AS name FROM sa WHERE asked IS NOT NULL AND trim(asked) <> '' AND NOT regexp_full_match(trim(regexp_replace(asked, '\\s+', ' ', 'g')), '[0-9]+( [0-9]+)*'))",
    "sh AS (SELECT ask, query_key FROM (SELECT ask, query_key, row_number() OVER (PARTITION BY ask ORDER BY count(*) DESC, query_key) AS k FROM ln JOIN qm ON lower(display_query) = name GROUP BY ask, query_key) WHERE k = 1)",
    "nm AS (SELECT ask, topic_id FROM (SELECT ask, topic_id, row_number() OVER (PARTITION BY ask ORDER BY news_count DESC, topic_id) AS k FROM ln JOIN tp ON lower(display_name) = name) WHERE k <= 20)",
    "nk AS (SELECT ask, query_key FROM (SELECT ask, query_key, row_number() OVER (PARTITION BY ask ORDER BY max(score) DESC, query_key) AS k FROM nm JOIN qm USING (topic_id) GROUP BY ask, query_key) WHERE k = 1)",
    "al AS (SELECT ask, coalesce(sh.query_key, nk.query_key) AS query_key FROM ln LEFT JOIN sh USING (ask) LEFT JOIN nk USING (ask) WHERE coalesce(sh.query_key, nk.query_key) IS NOT NULL)",
    "op AS (SELECT sa.* FROM sa JOIN ln USING (ask) WHERE ask NOT IN (SELECT ask FROM al))",
    f"asked AS (SELECT DISTINCT ask AS query, unnest({TOK.format('asked')}) AS term FROM op)", "dense_asks AS (SELECT e.* FROM embeddings e JOIN op ON ask = vec_id)", *WORDS, *VECTORS, FUSED, *VERDICTS,
    "ok AS (SELECT query AS ask, dense FROM x WHERE dense >= 0.6 OR (dense >= 0.3 AND lexical >= 5 AND margin >= 0.001))",
    "vt AS (SELECT query AS ask, doc AS article_id, greatest(fusion, 1e-9) AS vote, f.rank, topic_id, source_rank FROM fused f JOIN dtp ON dtp.article_id = doc WHERE f.rank <= 10 AND query IN (SELECT ask FROM ok))",
    "vs AS (SELECT ask, topic_id, round(sum(vote * CASE WHEN source_rank > 0 THEN 1.25 ELSE 1.0 END), 12) AS vote FROM vt GROUP BY ALL)",
    "vk AS (SELECT ask, query_key FROM (SELECT ask, query_key, row_number() OVER (PARTITION BY ask ORDER BY round(vote * score, 12) DESC, match_rank, query_key) AS k FROM vs JOIN qm USING (topic_id)) WHERE k = 1)",
    "vf AS (SELECT ask, topic_id::VARCHAR AS query_key FROM (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY rank > 1, article_id, source_rank, topic_id) AS k FROM vt) WHERE k = 1)")) +
    " SELECT ask, CASE WHEN ln.ask IS NULL AND trim(coalesce(asked, '')) <> '' THEN trim(regexp_replace(asked, '\\s+', ' ', 'g')) ELSE coalesce(al.query_key, vk.query_key, vf.query_key) END AS query_key, "
    "CASE WHEN trim(coalesce(asked, '')) = '' THEN 'blank' WHEN ln.ask IS NULL THEN 'numeric_query_key' WHEN al.ask IS NOT NULL THEN 'exact_alias' WHEN ok.ask IS NULL THEN 'rejected' WHEN coalesce(vk.query_key, vf.query_key) IS NULL THEN 'unresolved' ELSE 'hybrid_v1' END AS source, "
    "round(CASE WHEN trim(coalesce(asked, '')) = '' THEN NULL WHEN ln.ask IS NULL OR al.ask IS NOT NULL THEN 1.0 WHEN coalesce(vk.query_key, vf.query_key) IS NOT NULL THEN ok.dense END, 6)::DOUBLE AS confidence "
    "FROM sa LEFT JOIN ln USING (ask) LEFT JOIN al USING (ask) LEFT JOIN ok USING (ask) LEFT JOIN vk USING (ask) LEFT JOIN vf USING (ask)")
def c5_hybrid(t):
    """What typed texts resolve to when words and vectors are searched together, from the stored index."""
    index = document_index(t)

    def find(open_):
        # the embedding of the ask's number stands for that of its text
        vectors = t.embeddings.join(open_.select(F.col("ask").alias("vec_id")), "vec_id", "left_semi")
        words = lambda k: index.bm25(open_, "ask", "asked", k)
        dense = lambda k: search.dense_top_k(t.embeddings, vectors, "vec_id", "embedding", k)
        return search.hybrid_search(words, dense, search.HybridConfig(margin_least=0.001), 20)

    out = resolve.resolve_hybrid(searches(t), query_map(t), topics(t), document_topics(t), find)
    return out.select("ask", "query_key", "source", F.round("confidence", 6).alias("confidence"))


def searches(t):
    texts = t.benchmark.select(F.col("item_id").alias("ask"), "text").join(query_map(t).select(F.col("row").alias("ask"), "display_query"), "ask", "left")
    asked = F.when(F.col("ask") % 5 == 0, F.concat(F.col("ask"), F.lit("  7"))).when(F.col("ask") % 5 == 1, F.upper("display_query")).otherwise(F.col("text"))
    names = t.nation.select((1_000_000 + F.col("n_nationkey")).alias("ask"), F.when(F.col("n_nationkey") % 5 == 0, " ").otherwise(F.lower("n_name")).alias("asked"))
    return texts.select("ask", asked.alias("asked")).unionByName(names)


def document_topics(t):
    both = F.array(F.struct(F.col("label").alias("topic_id"), F.lit(0).alias("source_rank")), F.struct((F.col("vec_id") % 25).cast("int").alias("topic_id"), F.lit(1).alias("source_rank")))
    return t.embeddings.select(F.col("vec_id").alias("article_id"), F.explode(both).alias("x")).groupBy("article_id", "x.topic_id").agg(F.min("x.source_rank").alias("source_rank"))


@query("a18_best_topic_key", "WITH " + ", ".join((ART, AT, TP, QM, ASKS, LEFT, *TOPIC)) + " SELECT ask, query_key FROM tk")
def a18(t):
    """The key of largest score among the topics whose name matches."""
    left = asks(t).where(resolve.numeric_key(F.col("asked")).isNull())
    return resolve.by_topic_name(left, topics(t), query_map(t))


@query("j7_text_match", "WITH " + ", ".join((ART, AT, QM, ASKS, *TEXT)) + " SELECT ask, query_key FROM nk")
def j7(t):
    """Articles that hold a term, their topics, and the best key of these: three joins."""
    return resolve.by_article_text(asks(t), articles(t), article_topics(t), query_map(t))


ALIAS = "al AS (SELECT DISTINCT category AS alias, topic_id FROM art JOIN atp USING (article_id) WHERE source_rank = 0)"
ALIAS_HIT = (f"am AS (SELECT ask, topic_id, {PASS.format(n='alias')} AS pass FROM ap, al)", "ak AS (SELECT ask, topic_id, pass FROM (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY pass, topic_id) AS k FROM am WHERE pass IS NOT NULL) WHERE k = 1)")
CATEGORY_ASKS = "asks AS (SELECT p_partkey AS ask, CASE p_partkey % 4 WHEN 0 THEN lower(p_type) WHEN 1 THEN substr(p_type, 1, 4) WHEN 2 THEN p_name ELSE substr(p_type, 3, 3) END AS asked FROM part), ap AS (SELECT ask, lower(trim(asked)) AS q FROM asks)"


def aliases(t):
    return articles(t).join(article_topics(t).where("source_rank = 0"), "article_id").select(F.col("category").alias("alias"), "topic_id").distinct()


def category_asks(t):
    key, kind = F.col("p_partkey"), F.col("p_type")
    asked = F.when(key % 4 == 0, F.lower(kind)).when(key % 4 == 1, F.substring(kind, 1, 4)).when(key % 4 == 2, F.col("p_name")).otherwise(F.substring(kind, 3, 3))
    return t.part.select(key.alias("ask"), asked.alias("asked"))


@query("k9_alias_index", "WITH " + ", ".join((ART, AT, ALIAS, CATEGORY_ASKS, *ALIAS_HIT)) + " SELECT ask, topic_id::INT AS topic_id, pass::INT AS pass FROM ak")
def k9(t):
    """The least topic of the first pass that matches a category's name."""
    return resolve.alias_topic(category_asks(t), aliases(t))


@query("c6_lexical_baseline", "WITH " + ", ".join((ART, AT, ALIAS, CATEGORY_ASKS, *ALIAS_HIT, TERMS,
    "ts AS (SELECT ask, list(term) AS terms FROM trm GROUP BY ask)",
    "sc AS (SELECT ask, article_id, round(list_sum(list_transform(terms, lambda x: 2 * contains(lower(title), x)::INT + contains(lower(abstract), x)::INT))::DOUBLE / (3 * len(terms)), 9) AS score FROM ts, art)",
    "lx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY score DESC, article_id) AS k FROM sc WHERE score > 0) WHERE k <= 100)",
    "lt AS (SELECT ask, min(topic_id) AS least FROM lx JOIN atp USING (article_id) GROUP BY ask)",
    "tq AS (SELECT asks.ask, coalesce(ak.topic_id, least) AS topic_id FROM asks LEFT JOIN ak USING (ask) LEFT JOIN lt USING (ask) WHERE coalesce(ak.topic_id, least) IS NOT NULL)",
    "bo AS (SELECT ask, article_id, max(score) AS score FROM (SELECT ask, article_id, 1.0 AS score FROM tq JOIN atp USING (topic_id) UNION ALL SELECT ask, article_id, score FROM lx) GROUP BY ALL)")) +
    " SELECT ask, topic_id::INT AS topic_id, article_id, round(score, 6)::DOUBLE AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY score DESC, article_id) AS rank FROM bo JOIN tq USING (ask)) WHERE rank <= 5")
def c6(t):
    out = resolve.lexical_baseline(category_asks(t), aliases(t), articles(t), article_topics(t), 5)
    return out.select("ask", "topic_id", "article_id", F.round("score", 6).alias("score"), "rank")


@query("k4_query_topics", f"WITH {QM} SELECT query_key, topic_id, score, CASE WHEN match_rank = 0 THEN k ELSE match_rank END::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_key ORDER BY match_rank, score DESC, row) AS k FROM qm) WHERE k <= 20")
def k4(t):
    """The twenty best topics of each query; a rank of 0 is filled in by the place."""
    place = F.row_number().over(Window.partitionBy("query_key").orderBy("match_rank", F.col("score").desc(), "row"))
    rows = query_map(t).withColumn("k", place).where("k <= 20")
    return rows.select("query_key", "topic_id", "score", F.when(F.col("match_rank") == 0, F.col("k")).otherwise(F.col("match_rank")).alias("rank"))


@query("k3_article_topics", f"WITH {AT} SELECT article_id, list(topic_id ORDER BY source_rank, topic_id)::VARCHAR AS topics FROM atp GROUP BY article_id")
def k3(t):
    """The topics of each article in order of source and id."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("source_rank", "topic_id"))), lambda x: x["topic_id"].cast("string"))
    return article_topics(t).groupBy("article_id").agg(F.concat(F.lit("["), F.array_join(ordered, ", "), F.lit("]")).alias("topics"))


@query("k1_hydrate", with_views("impressions", more=(HOT, ART)) + "SELECT article_id, title, abstract, coalesce(impressions, 0)::BIGINT AS impressions, coalesce(clicks, 0)::BIGINT AS clicks FROM art LEFT JOIN hot USING (article_id) WHERE article_id IN (SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '5-LOW')")
def k1(t):
    """Articles of a set of ids with their counters; 0 where there are none."""
    wanted = t.lineitem.join(t.orders.where("o_orderpriority = '5-LOW'"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_partkey").alias("article_id"))
    rows = articles(t).drop("category").join(wanted, "article_id", "left_semi").join(item_counts(t).drop("hot"), "article_id", "left")
    return rows.select("article_id", "title", "abstract", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("impressions", "clicks")))


@query("p7_category_clause", f"WITH {ART} SELECT article_id, title FROM art WHERE category = 'ECONOMY'")
def p7(t):
    return in_category(articles(t), "ECONOMY").select("article_id", "title")


def in_category(rows, category: str | None):
    """Rows of exactly this category; all of them if none is named."""
    return rows if category is None else rows.where(F.col("category") == category)


@query("p9_category_exists", f"WITH {ART} SELECT r_name AS category, EXISTS (SELECT 1 FROM art WHERE category = r_name) OR EXISTS (SELECT 1 FROM art WHERE category = upper(r_name)) AS found FROM (SELECT r_name FROM region UNION ALL SELECT DISTINCT p_type FROM part)")
def p9(t):
    """Whether any article has each category."""
    names = t.region.select(F.col("r_name").alias("category")).unionByName(t.part.select(F.col("p_type").alias("category")).distinct())
    have = articles(t).select(F.col("category").alias("_c")).distinct().withColumn("_in", F.lit(True))
    return names.join(have, F.upper("category") == F.col("_c"), "left").select("category", F.coalesce("_in", F.lit(False)).alias("found"))


@query("c7_search_scores", "WITH " + ", ".join((AT, QM, "hy AS (SELECT l_partkey AS article_id, (l_suppkey % 40)::VARCHAR AS query_key, max(l_discount) AS hybrid FROM lineitem GROUP BY ALL)",
    "cd AS (SELECT query_key, article_id, max(score) AS topic_score FROM qm JOIN atp USING (topic_id) GROUP BY ALL)")) +
    " SELECT * FROM (SELECT query_key, article_id, round(CASE WHEN hybrid > 0 THEN hybrid ELSE coalesce(topic_score, 0) END, 6)::DOUBLE AS score, row_number() OVER (PARTITION BY query_key ORDER BY round(CASE WHEN hybrid > 0 THEN hybrid ELSE coalesce(topic_score, 0) END, 6) DESC, article_id)::INT AS rank FROM cd FULL JOIN hy USING (query_key, article_id)) WHERE rank <= 20")
def c7(t):
    """The page of each query: the hybrid score where there is one above 0, else the best topic score."""
    hybrid = t.lineitem.groupBy(F.col("l_partkey").alias("article_id"), (F.col("l_suppkey") % 40).cast("string").alias("query_key")).agg(F.max("l_discount").alias("hybrid"))
    best = query_map(t).groupBy("query_key", "topic_id").agg(F.max("score").alias("score"))  # before topics bring their articles
    by_topic = best.join(article_topics(t), "topic_id").groupBy("query_key", "article_id").agg(F.max("score").alias("topic_score"))
    score = F.round(F.when(F.col("hybrid") > 0, F.col("hybrid")).otherwise(F.coalesce("topic_score", F.lit(0.0))), 6)
    rows = by_topic.join(hybrid, ["query_key", "article_id"], "full").select("query_key", "article_id", score.alias("score"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_key").orderBy(F.col("score").desc(), "article_id"))).where("rank <= 20")
