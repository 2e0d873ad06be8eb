"""Experiments over the feed's arms and over the arms of search, and the ranker with a grouped objective."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from presswork.functions import scores
from presswork.operators import evaluation, experiments, ranking, resolve, search
from presswork.plans.bindings import with_views
from presswork.plans.feed_queries import FEATURE_SQL, FEATURES, features
from presswork.plans.registry import query
from presswork.plans.resolve_queries import AT, DOC_TOPICS, QM, SEARCHES, TP, document_topics, searches, topics
from presswork.plans.search_queries import FUSED, TOK, VECTORS, VERDICTS, WORDS, document_index
from presswork.sources.logs import staged

#: Requests before the first time are learnt from, those from the second on are measured, and settings are chosen between.
CHOOSE, TEST = 850_000_000, 900_000_000
CUTOFFS, FIRST = (1, 2, 5), 5


def candidates(t):
    """All impressions with their features as of their request, the split, and what lists are judged by."""
    known = F.when(F.col("event_ts") < TEST, F.col("clicked"))
    whole = Window.partitionBy("article_id")
    rows = features(t, of_article={"total_hot": scores.hot_score(F.coalesce(F.sum(known).over(whole), F.lit(0)), F.count(known).over(whole))})
    split = F.when(F.col("event_ts") < CHOOSE, "train").when(F.col("event_ts") < TEST, "choose").otherwise("test")
    history = F.when(F.col("user_behavior_score") == 0, "cold").otherwise("warm")
    return rows.select("request_id", "article_id", "user_id", "event_ts", "label", "category", F.array("category", "subcategory").alias("topics"), split.alias("split"), history.alias("history"), "total_hot", *FEATURES)


#: What each arm without a model ranks by; to nine digits, so that ties are the same in any engine.
PLAIN_ARMS = {"popularity": "total_hot", "base": "base_score", "topic": "topic_match_score", "category_profile_manual": "base_score + topic_match_score"}
_SUMS = ", ".join(f"sum(label) FILTER (WHERE rank <= {k}) AS h{k}, sum(CASE WHEN rank <= {k} THEN label / log2(rank + 1) ELSE 0 END) AS d{k}" for k in CUTOFFS)
_MEANS = "count(*)::DOUBLE AS requests, round(avg(1.0::DOUBLE / f), 6) AS mrr, " + ", ".join(f"round(avg(h{k} / p), 6) AS recall_{k}, round(avg(d{k} / list_sum(list_transform(range(1, least(p::INT, {k}) + 1), lambda i: 1 / log2(i + 1)))), 6) AS ndcg_{k}" for k in CUTOFFS)
ARM_SQL = (*FEATURE_SQL, f"th AS (SELECT article_id, sum(clicked) * 10 + count(*) AS total_hot FROM impressions WHERE event_ts < {TEST} GROUP BY article_id)",
    f"ca AS (SELECT request_id, article_id, clicked AS label, category, [category, subcategory] AS tt, CASE WHEN hlen = 0 THEN 'cold' ELSE 'warm' END AS history, coalesce(total_hot, 0) AS total_hot, base_score, topic_match_score FROM fe LEFT JOIN th USING (article_id) WHERE event_ts >= {TEST})",
    "rk AS (SELECT *, row_number() OVER (PARTITION BY arm, request_id ORDER BY s DESC, article_id) AS rank FROM (" + " UNION ALL ".join(f"SELECT *, '{a}' AS arm, round(({s})::DOUBLE, 9) AS s FROM ca" for a, s in PLAIN_ARMS.items()) + "))",
    f"pq AS (SELECT arm, history, request_id, sum(label)::DOUBLE AS p, min(rank) FILTER (WHERE label = 1) AS f, {_SUMS} FROM rk GROUP BY ALL HAVING sum(label) > 0)",
    f"sm AS (SELECT a.arm, a.request_id, sum(len(list_intersect(a.tt, b.tt))::DOUBLE / len(list_distinct(list_concat(a.tt, b.tt)))) / count(*) AS similarity FROM rk a JOIN rk b ON a.arm = b.arm AND a.request_id = b.request_id AND a.rank < b.rank AND b.rank <= {FIRST} GROUP BY ALL)",
    f"li AS (SELECT arm, request_id, count(DISTINCT category) AS category_diversity, len(list_distinct(flatten(list(tt)))) AS topic_coverage FROM rk WHERE rank <= {FIRST} GROUP BY ALL)",
    f"me AS (SELECT arm, history, {_MEANS}, round(avg(category_diversity), 6) AS category_diversity, round(avg(topic_coverage), 6) AS topic_coverage, round(avg(coalesce(similarity, 0)), 6) AS similarity FROM pq JOIN li USING (arm, request_id) LEFT JOIN sm USING (arm, request_id) GROUP BY ALL)")


@query("c24_experiment_arms", with_views("articles", "impressions", more=ARM_SQL) + "SELECT arm, history, metric, value FROM (UNPIVOT me ON COLUMNS(* EXCLUDE (arm, history)) INTO NAME metric VALUE value)")
def c24(t):
    """The arms without a model on the held-out requests, with and without a history of the user."""
    rows = staged(candidates(t).where("split = 'test'"), "candidates")
    arms = {name: F.round(F.expr(score).cast("double"), 9) for name, score in PLAIN_ARMS.items()}
    ranked = experiments.rank_arms(rows, arms, ["label", "category", "topics", "history"])
    return experiments.measure(ranked, ["history"], CUTOFFS, FIRST)


def factors(t, rows):
    """Factors of users and articles from the clicks to learn from: (user_id, u) and (article_id, factors)."""
    from pyspark.ml.recommendation import ALS

    clicks = rows.where("split = 'train' AND label = 1").groupBy(F.col("user_id").cast("int").alias("user_id"), F.col("article_id").cast("int").alias("article_id")).agg(F.sum("label").cast("float").alias("rating"))
    model = ALS(rank=16, maxIter=5, regParam=0.05, implicitPrefs=True, seed=42, userCol="user_id", itemCol="article_id", ratingCol="rating").fit(clicks)
    number = lambda df, name, to: df.select(F.col("id").cast("long").alias(name), F.col("features").alias(to))
    return number(model.userFactors, "user_id", "u"), number(model.itemFactors, "article_id", "factors")


@query("m3_lambdarank")
def m3(t):
    """The later requests' impressions, ordered by a ranker that was trained on pairs within the earlier ones."""
    rows = staged(candidates(t), "candidates")
    ranker = ranking.fit_lambdarank(rows.where("split = 'train'"), FEATURES, rounds=8)
    return ranking.score_rows(rows.where("split = 'test'"), ranker, ["request_id", "article_id", "label"])


@query("k63_arm_comparison")
def k63(t):
    """Manual scores, these with factors, and the ranker, over one table of candidates; lists re-ranked by MMR with the
    penalty that the requests between training and test choose; and how sure each difference to the manual arm is."""
    rows = staged(candidates(t), "candidates")
    users, items = factors(t, rows)
    later = rows.where("split <> 'train'").join(users, "user_id", "left").join(items, "article_id", "left")
    later = later.withColumn("als", F.coalesce(experiments.product(F.col("u"), F.col("factors")), F.lit(0.0)))
    ranker = ranking.fit_lambdarank(rows.where("split = 'train'"), FEATURES, rounds=4)
    kept = ["request_id", "article_id", "label", "category", "topics", "factors", "split", "base_score", "topic_match_score", "als"]
    later = staged(ranking.score_rows(later, ranker, kept).withColumnRenamed("score", "lambdarank"), "scored")
    manual = F.col("base_score") + F.col("topic_match_score")
    arms = {"category_profile_manual": manual, "als_recall_manual": manual + scores.als_boost(F.col("als")), "lambdarank": F.col("lambdarank")}
    # factors go with the arm that is re-ranked by them only
    base = lambda split: experiments.rank_arms(later.where(F.col("split") == split), {"category_profile_manual": manual}, ["label", "category", "topics", "factors"])
    penalties = {f"mmr_{p}": p for p in (0.02, 0.1, 0.3)}
    tried = experiments.with_mmrs(base("choose"), penalties, FIRST, "topics", own="category_profile_manual")
    penalty = F.coalesce(*(F.when(F.col("arm") == name, F.lit(p)) for name, p in penalties.items()))
    sweep = experiments.measure(tried, [], CUTOFFS, FIRST).withColumn("penalty", penalty)
    best = experiments.choose_penalty(sweep, "category_profile_manual", FIRST).first()
    measured = lambda ranking: evaluation.request_metrics(ranking, ["arm", "request_id"], "label", CUTOFFS)
    test, compared = measured(experiments.rank_arms(later.where("split = 'test'"), arms, ["label"])), ["als_recall_manual", "lambdarank"]
    if best:
        test = test.unionByName(measured(experiments.with_mmr(base("test"), best.arm, best.penalty, FIRST, "topics")))
        compared.append(best.arm)
    return experiments.compare_measured(test, "category_profile_manual", compared)


_ARM_HITS = ("al AS (SELECT ask, topic_id FROM (SELECT ask, topic_id, row_number() OVER (PARTITION BY ask ORDER BY news_count DESC, topic_id) AS k FROM sa JOIN tp ON lower(display_name) = lower(trim(asked))) WHERE k = 1)",
    "op AS (SELECT * FROM sa WHERE trim(coalesce(asked, '')) <> '' AND ask NOT IN (SELECT ask FROM al))", f"asked AS (SELECT DISTINCT ask AS query, unnest({TOK.format('asked')}) AS term FROM op)", "dense_asks AS (SELECT e.* FROM embeddings e JOIN op ON ask = vec_id)", *WORDS, *VECTORS, FUSED, *VERDICTS,
    "ah AS (SELECT ask, article_id AS doc, 1.0 AS score, row_number() OVER (PARTITION BY ask ORDER BY article_id) AS rank FROM al JOIN dtp USING (topic_id) QUALIFY rank <= 20)",
    "hits AS (SELECT 'bm25' AS arm, query AS ask, doc, score, rank, max(score) OVER (PARTITION BY query) >= 5 AS accepted FROM bm_hits UNION ALL SELECT 'dense', query, doc, score, rank, max(score) OVER (PARTITION BY query) >= 0.3 FROM dn_hits UNION ALL "
    "SELECT 'hybrid', query, doc, fusion, rank, (dense >= 0.6 OR (dense >= 0.3 AND lexical >= 5 AND margin >= 0)) FROM fused JOIN x USING (query))")  # fmt: skip


@query("e10_search_arms", "WITH " + ", ".join((AT, TP, QM, DOC_TOPICS, SEARCHES, *_ARM_HITS)) + " SELECT arm, ask, 'exact_alias' AS source, doc, rank::INT AS rank, score::DOUBLE AS score FROM ah, (SELECT unnest(['bm25', 'dense', 'hybrid']) AS arm) UNION ALL "
    "SELECT arm, ask, CASE WHEN accepted THEN arm ELSE 'unresolved' END, doc, rank::INT, round(score, 6)::DOUBLE FROM hits WHERE rank <= 20")
def e10(t):
    """The arms of search over one set of asks: words, vectors, both. An exact alias answers for every arm; hits of a search
    that its arm does not trust are candidates only (source unresolved)."""
    asks = searches(t)
    index = document_index(t)

    def arms(open_):
        vectors = t.embeddings.join(open_.select(F.col("ask").alias("vec_id")), "vec_id", "left_semi")
        words = lambda k: index.bm25(open_, "ask", "asked", k)
        dense = lambda k: search.dense_top_k(t.embeddings, vectors, "vec_id", "embedding", k)
        return words, dense

    return search.run_arms(asks, resolve.exact_topic(asks, topics(t)), document_topics(t), arms, search.HybridConfig(), 20)
