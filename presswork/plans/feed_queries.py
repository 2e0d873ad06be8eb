"""Recall, feed, re-ranking and sponsored queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from presswork.functions import scores
from presswork.operators import feed, search
from presswork.operators.ordered import prior_counts, running_before
from presswork.plans.bindings import with_views
from presswork.plans.registry import query
from presswork.plans.relational_queries import HOT, item_counts
from presswork.sources.logs import staged

#: What a request's user clicked strictly before it.
PAST = ("past AS (SELECT r.request_id, category, count(*) AS n FROM requests r JOIN impressions i ON i.user_id = r.user_id AND i.clicked = 1 AND i.event_ts < r.event_ts JOIN articles USING (article_id) GROUP BY ALL)",
        "p AS (SELECT request_id, category, n::DOUBLE / sum(n) OVER (PARTITION BY request_id) AS weight, sum(n) OVER (PARTITION BY request_id) AS history_length FROM past)")
ASKED = "r AS (SELECT request_id, user_id, event_ts FROM requests)"
ART = "art AS (SELECT article_id, category, subcategory, title, coalesce(hot, 0) AS hot FROM articles LEFT JOIN hot USING (article_id))"
RECALL = (HOT, *PAST, ASKED, ART,
          "tops AS (SELECT * FROM (SELECT category, article_id, hot, row_number() OVER (PARTITION BY category ORDER BY hot DESC, article_id) AS k FROM art) WHERE k <= 10)",
          "ch AS (SELECT request_id, article_id, hot::DOUBLE AS recall_score, false AS fb, 'profile' AS source FROM p JOIN tops USING (category) UNION ALL "
          "SELECT request_id, article_id, hot::DOUBLE, true, 'hot' FROM r, (SELECT article_id, hot FROM art ORDER BY hot DESC, article_id LIMIT 20))",
          "seen AS (SELECT user_id, article_id, min(event_ts) AS first_ts FROM impressions WHERE clicked = 1 GROUP BY ALL)",
          "rc AS (SELECT request_id, article_id, list_sort(list(DISTINCT source)) AS sources, max(recall_score) AS recall_score, bool_and(fb) AS is_fallback FROM ch GROUP BY ALL)",
          "rec AS (SELECT rc.*, user_id FROM rc JOIN r USING (request_id) WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = r.user_id AND s.article_id = rc.article_id AND s.first_ts < r.event_ts))")
#: What profiles are joined on: a user has one for each time of a request.
MOMENT = ["user_id", "event_ts"]


def asked(t):
    return t.requests


def catalog(t):
    return t.articles.join(item_counts(t).select("article_id", "hot"), "article_id", "left").withColumn("hot", F.coalesce("hot", F.lit(0)))


def past_profile(t, shown=None):
    """The profile of each request's user, of clicks before the request only."""
    clicks = (t.impressions if shown is None else shown).where("clicked = 1").join(t.articles, "article_id").select("user_id", "category", "event_ts")
    return feed.profile_as_of(clicks, t.requests)


def partitions(t) -> int:
    return t.request_partitions()


def profiles_and_shelf(t):
    """Each request's profile, the articles that recall can find with what their scores take, and the clicks on these."""
    articles = catalog(t).join(F.broadcast(default_shares(t, "default_weight")), "category", "left").select("article_id", "category", "subcategory", "hot", "default_weight")
    shelf = staged(feed.shelves(articles, 10, 20), "shelves")  # read twice; a row for each topic
    clicks = t.impressions.where("clicked = 1").select("user_id", "article_id", "event_ts")
    n = partitions(t)
    profiles = feed.request_profiles(clicks.join(t.articles.select("article_id", "category"), "article_id"), asked(t), n)
    found = shelf.select(F.explode("items.article_id").alias("article_id")).distinct()
    return profiles, shelf, clicks.join(F.broadcast(found), "article_id"), n


def recalled(t, keep=()):
    """Profile topics and the hottest articles for each request, less what the user had clicked before it."""
    profiles, shelf, clicked, n = profiles_and_shelf(t)
    return feed.recall_from(profiles, shelf, clicked, n, list(keep))


@query("c1_recall_union", with_views("articles", "impressions", more=RECALL) + "SELECT request_id, article_id, array_to_string(sources, '+') AS sources, recall_score, is_fallback FROM rec")
def c1(t):
    return recalled(t).select("request_id", "article_id", F.array_join("sources", "+").alias("sources"), "recall_score", "is_fallback")


@query("f45_selected_reason", with_views("articles", "impressions", more=RECALL) + "SELECT CASE WHEN is_fallback THEN 'popular right now' WHEN list_contains(sources, 'profile') THEN 'matches your interests' ELSE 'popular right now' END AS reason, count(*)::BIGINT AS n FROM rec GROUP BY 1")
def f45(t):
    return recalled(t).groupBy(feed.selected_reason(F.col("sources"), F.col("is_fallback")).alias("reason")).agg(F.count("*").alias("n"))


FEED = (*RECALL, "dw AS (SELECT category, count(*)::DOUBLE / sum(count(*)) OVER () AS default_weight FROM articles GROUP BY category)",
        "hl AS (SELECT DISTINCT request_id, history_length FROM p)",
        "x AS (SELECT request_id, article_id, hot, coalesce(history_length, 0) AS hlen, coalesce(weight, 0) AS weight, default_weight FROM rec JOIN art USING (article_id) JOIN dw USING (category) LEFT JOIN hl USING (request_id) LEFT JOIN (SELECT request_id, category, weight FROM p) USING (request_id, category))",
        "y AS (SELECT *, CASE WHEN hot > 0 THEN round(hot / (hot + 100.0), 6) ELSE 0.0 END::DOUBLE AS base_score, (0.1 + hlen / (hlen + 30.0) * 0.85)::DOUBLE AS alpha FROM x)",
        "m AS (SELECT *, floor((alpha * round(weight, 6) + (1 - alpha) * round(default_weight, 6)) * 1e6 + 0.5000001) / 1e6 AS topic_match_score FROM y)",
        "f AS (SELECT *, (round(base_score * 1e6) + round(topic_match_score * 1e6)) / 1e6 AS final_score FROM m)",
        "o AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY final_score DESC, article_id) AS rank FROM f)")


def default_shares(t, name):
    return t.articles.groupBy("category").agg(F.count("*").alias("n")).select("category", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).alias(name))


def scored(t):
    rows = feed.manual_scores(recalled(t, ("category", "subcategory", "hot", "default_weight")))
    # partitions hold whole users, so that ranking needs no shuffle
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("user_id", "request_id").orderBy(F.col("final_score").desc(), "article_id")))


@query("c2_feed_manual", with_views("articles", "impressions", more=FEED) + "SELECT request_id, article_id, base_score, topic_match_score, final_score, rank::INT AS rank FROM o WHERE rank <= 20")
def c2(t):
    return scored(t).where("rank <= 20").select("request_id", "article_id", "base_score", "topic_match_score", "final_score", "rank")


@query("l8_mmr_page")
def l8(t):
    """Ten of each request's thirty best, with articles of one topic or brand held apart."""
    rows = scored(t).where("rank <= 30").select("request_id", "article_id", F.col("final_score").alias("relevance"), F.array("category", "subcategory").alias("topics"))
    return feed.rerank_mmr(rows, 10, 0.2, together=True)


@query("j21_pairwise_similarity", with_views("articles", "impressions", more=(*FEED, "tp AS (SELECT request_id, rank, [category, subcategory] AS tt FROM o JOIN articles USING (article_id) WHERE rank <= 5)")) +
    "SELECT a.request_id, round(avg(len(list_intersect(a.tt, b.tt))::DOUBLE / len(list_distinct(list_concat(a.tt, b.tt)))), 6) AS similarity FROM tp a JOIN tp b ON a.request_id = b.request_id AND a.rank < b.rank GROUP BY a.request_id")
def j21(t):
    """Mean topic similarity of the pairs of a page's first five."""
    from presswork.functions.text import jaccard

    top = scored(t).where("rank <= 5").groupBy("user_id", "request_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.array("category", "subcategory").alias("topics")))).alias("x")).where("size(x) > 1")
    later = lambda a: F.filter("x", lambda b: b["rank"] > a["rank"])
    pairs = F.flatten(F.transform("x", lambda a: F.transform(later(a), lambda b: jaccard(a["topics"], b["topics"]))))
    return top.select("request_id", F.round(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / F.size(pairs), 6).alias("similarity"))


@query("j22_candidate_recall", with_views("articles", "impressions", more=RECALL) + "SELECT count(*)::BIGINT AS requests, round(avg(hit::DOUBLE / n), 6) AS recall FROM (SELECT i.request_id, count(*) AS n, count(rc.article_id) AS hit FROM impressions i JOIN r USING (request_id) LEFT JOIN rc ON rc.request_id = i.request_id AND rc.article_id = i.article_id WHERE clicked = 1 GROUP BY 1)")
def j22(t):
    """Share of each request's clicked articles that recall finds, whether seen before or not."""
    profiles, shelf, _, n = profiles_and_shelf(t)
    items = shelf.select(F.explode("items").alias("i")).select("i.article_id", "i.category", "i.on_topic", "i.on_all").distinct()
    relevant = t.impressions.where("clicked = 1").select("user_id", "request_id", "article_id").join(F.broadcast(items), "article_id", "left")
    own = relevant.groupBy("user_id", "request_id").agg(F.count("*").alias("n"), F.count_if("on_all").alias("all"), F.collect_list(F.when(F.col("on_topic") & ~F.col("on_all"), F.col("category"))).alias("c"))
    per = own.join(profiles.select("user_id", "request_id", "topics"), ["user_id", "request_id"])
    hits = F.col("all") + F.size(F.filter("c", lambda k: F.map_contains_key("topics", k)))
    return per.agg(F.count("*").alias("requests"), F.round(F.avg(hits / F.col("n")), 6).alias("recall"))


#: The features that rankers see, in their fixed order. Those of the second line have no source in these tables and stay 0.
FEATURES = [
    "base_score", "personalized_topic_score", "default_topic_score", "topic_match_score", "query_recall_boost", "user_behavior_score", "user_topic_count", "article_hot_score", "article_click_count", "article_impression_count", "article_age_hours",
    "article_has_picture", "article_has_video", "article_is_high_value", "article_is_editor_recommended", "source_is_preferred",
]
ABSENT = [*FEATURES[4:5], *FEATURES[11:]]


FEATURE_SQL = (*PAST, "dw AS (SELECT category, count(*)::DOUBLE / sum(count(*)) OVER () AS default_weight FROM articles GROUP BY category)", "hl AS (SELECT request_id, any_value(history_length) AS hl, count(*) AS topics FROM p GROUP BY request_id)",
    "fs AS (SELECT article_id, min(event_ts) AS first_ts FROM impressions GROUP BY article_id)",
    "w AS (SELECT *, count(*) OVER z AS pi, coalesce(sum(clicked) OVER z, 0) AS pc FROM impressions WINDOW z AS (PARTITION BY article_id ORDER BY event_ts, request_id, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))",
    "q AS (SELECT w.*, category, subcategory, pc * 10 + pi AS hot, coalesce(weight, 0)::DOUBLE AS personal, default_weight, coalesce(hl, 0) AS hlen, coalesce(topics, 0) AS topics, first_ts FROM w JOIN articles USING (article_id) JOIN dw USING (category) JOIN fs USING (article_id) LEFT JOIN hl USING (request_id) LEFT JOIN (SELECT request_id, category, weight FROM p) USING (request_id, category))",
    "fe AS (SELECT *, hot / (hot + 100.0) AS base_score, (0.1 + hlen / (hlen + 30.0) * 0.85) * personal + (1 - (0.1 + hlen / (hlen + 30.0) * 0.85)) * default_weight AS topic_match_score FROM q)")


@query("f22_features", with_views("articles", "impressions", more=FEATURE_SQL) +
    "SELECT request_id, article_id, clicked AS label, round(base_score, 6)::DOUBLE AS base_score, round(personal, 6) AS personalized_topic_score, round(default_weight, 6) AS default_topic_score, "
    "round(topic_match_score, 6)::DOUBLE AS topic_match_score, hlen::BIGINT AS user_behavior_score, topics::BIGINT AS user_topic_count, hot::BIGINT AS article_hot_score, pc::BIGINT AS article_click_count, pi::BIGINT AS article_impression_count, round(greatest(0, event_ts - first_ts) / 3600.0, 6)::DOUBLE AS article_age_hours, "
    + ", ".join(f"0.0::DOUBLE AS {c}" for c in ABSENT) + " FROM fe")
def f22(t):
    rounded = ("base_score", "personalized_topic_score", "default_topic_score", "topic_match_score", "article_age_hours")
    return features(t).select("request_id", "article_id", "label", *(scores.to_millionths(F.col(c)).alias(c) if c in rounded else c for c in FEATURES))


def features(t, shown=None, of_article=None):
    """The features of each impression, from what was known before it: counts of the article up to the place before, the
    user's clicks at earlier times. shown: the impressions, if they are staged already; they are read twice. of_article:
    further columns, of sums over all impressions of the article.

    Impressions go to their articles' partitions once and to their users' once; each of these holds a bounded number of rows.
    """
    shown = staged(t.dealt_impressions(), "impressions") if shown is None else shown
    n = t.impression_partitions()
    rows = prior_counts(shown.repartition(n, "article_id"), "article_id", ["event_ts", "request_id", "position"], first="first_ts")
    rows = rows.join(t.articles.select("article_id", "category", "subcategory").repartition(n, "article_id"), "article_id").withColumns(of_article or {})
    rows = feed.with_past_shares(rows.repartition(n, "user_id")).join(F.broadcast(default_shares(t, "default_topic_score")), "category")
    rows = rows.withColumnsRenamed({"weight": "personalized_topic_score", "history_length": "user_behavior_score", "topics": "user_topic_count"})
    alpha = scores.personal_share(F.col("user_behavior_score"))
    rows = rows.withColumn("article_hot_score", scores.hot_score(F.col("prior_clicks"), F.col("prior_impressions")))
    return rows.withColumns({
        "label": F.col("clicked"), "base_score": scores.base_score(F.col("article_hot_score")),
        "topic_match_score": alpha * F.col("personalized_topic_score") + (1 - alpha) * F.col("default_topic_score"),
        "article_click_count": F.col("prior_clicks"), "article_impression_count": F.col("prior_impressions"),
        "article_age_hours": F.greatest(F.lit(0), F.col("event_ts") - F.col("first_ts")) / 3600.0, **{c: F.lit(0.0) for c in ABSENT},
    })


@query("m1_als_topk")
def m1(t):
    """Articles for each user by factors of the clicks, with repeated clicks as confidence."""
    from pyspark.ml.recommendation import ALS

    clicks = t.impressions.where("clicked = 1").groupBy(F.col("user_id").cast("int").alias("user_id"), F.col("article_id").cast("int").alias("article_id")).agg(F.sum("clicked").cast("float").alias("rating"))
    clicks = staged(clicks, "clicks")  # read twice
    # checkpoints let go of the shuffle files of the rounds before; they change no factor
    model = ALS(rank=32, maxIter=10, regParam=0.05, implicitPrefs=True, alpha=1.0, seed=42, userCol="user_id", itemCol="article_id", ratingCol="rating", checkpointInterval=1).fit(clicks)
    best = search.factor_top_k(model.userFactors, model.itemFactors, 20)
    return best.select(F.col("id").alias("user_id"), "rank", F.col("doc").alias("article_id"), F.col("score").cast("float").alias("rating"))


@query("m2_gbt_scores")
def m2(t):
    """Boosted trees over the features, trained on the earlier requests and scored on the later ones."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    made = staged(features(t).select("request_id", "article_id", "event_ts", "label", *FEATURES), "features")  # trees read them many times
    rows = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(made)
    model = GBTClassifier(featuresCol="x", labelCol="label", maxIter=10, maxDepth=4, stepSize=0.1, seed=42).fit(rows.where("event_ts < 900000000"))
    return model.transform(rows.where("event_ts >= 900000000")).select("request_id", "article_id", "label", vector_to_array("probability")[1].alias("score"))


#: Users that go through the campaigns of their topic together, about, and rows of the result that a task makes.
USERS_EACH, PAIRS_EACH = 64, 1 << 24
CAMPAIGNS = "cp AS (SELECT s_suppkey AS campaign_id, s_nationkey AS topic_id, greatest(s_acctbal, 0) * 100 AS budget, 40 + s_suppkey % 60 AS bid, 0.01 + (s_suppkey % 7) / 100.0 AS ctr FROM supplier)"


def campaigns(t):
    return t.supplier.select(
        F.col("s_suppkey").alias("campaign_id"), F.col("s_nationkey").alias("topic_id"), (F.greatest("s_acctbal", F.lit(0.0)) * 100).alias("budget"),
        (40 + F.col("s_suppkey") % 60).alias("bid"), (0.01 + F.col("s_suppkey") % 7 / 100.0).alias("ctr"),
    )


@query("c9_ad_eligibility", f"WITH {CAMPAIGNS}, sp AS (SELECT l_suppkey AS campaign_id, sum(l_quantity) AS spent FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), fq AS (SELECT l_suppkey AS campaign_id, o_custkey AS user_id, count(*) AS served FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL) "
    "SELECT c_custkey AS user_id, campaign_id, round(bid * ctr, 6)::DOUBLE AS score FROM customer JOIN cp ON topic_id = c_nationkey LEFT JOIN sp USING (campaign_id) LEFT JOIN fq ON fq.campaign_id = cp.campaign_id AND fq.user_id = c_custkey WHERE budget - coalesce(spent, 0) > 0 AND coalesce(served, 0) < 2")
def c9(t):
    """Campaigns that may be shown to each user: topic met, budget and frequency left.

    Each user carries the few campaigns that its frequency rules out, and the campaigns are broadcast (three numbers
    each), so that no pair of a user and a campaign is ever shuffled. The result itself grows with their product: users of
    a topic go together, USERS_EACH at a time, through its campaigns, so that a campaign and its score are runs in a file and
    the users a pattern that repeats, and blocks of users are dealt so that a task makes a bounded number of rows.
    """
    spent = t.lineitem.where("l_returnflag = 'A'").groupBy(F.col("l_suppkey").alias("campaign_id")).agg(F.sum("l_quantity").alias("spent"))
    shown = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("l_suppkey").alias("campaign_id"), F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("served"))
    live = campaigns(t).join(spent, "campaign_id", "left").where(F.col("budget") - F.coalesce("spent", F.lit(0.0)) > 0)
    offers = staged(live.select("topic_id", "campaign_id", F.round(F.col("bid") * F.col("ctr"), 6).alias("score")), "offers")
    full = shown.where("served >= 2").groupBy("user_id").agg(F.collect_list("campaign_id").alias("full"))
    users = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("topic_id"))
    of_topic = users.groupBy("topic_id").agg(F.count("*").alias("n")).join(offers.groupBy("topic_id").agg(F.count("*").alias("m")), "topic_id")
    size = of_topic.agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0)).alias("pairs"), F.coalesce(F.max("n"), F.lit(1)).alias("most")).first()
    n = max(int(t.spark.conf.get("spark.sql.shuffle.partitions")), -(-size.pairs // PAIRS_EACH))
    block = F.pmod(F.xxhash64("user_id"), F.lit(-(-size.most // USERS_EACH)))
    together = users.join(full, "user_id", "left").withColumn("block", block).repartition(n, "topic_id", "block")
    blocks = together.groupBy("topic_id", "block").agg(F.collect_list(F.struct("user_id", "full")).alias("users"))
    each = blocks.join(F.broadcast(offers), "topic_id").select("campaign_id", "score", F.explode("users").alias("u"))
    return each.where(F.col("u.full").isNull() | ~F.array_contains("u.full", F.col("campaign_id"))).select("u.user_id", "campaign_id", "score")


@query("f42_pacing_limit", f"WITH {CAMPAIGNS} SELECT campaign_id, greatest(greatest(1, round_even(bid * ctr, 0)), round_even(budget * least(1.0, (campaign_id * 700 + 3600) / 86400.0), 0))::BIGINT AS allowed FROM cp")
def f42(t):
    spend = scores.expected_spend(F.col("bid"), F.col("ctr"))
    return campaigns(t).select("campaign_id", scores.pacing_limit(spend, F.col("budget"), F.col("campaign_id") * 700).alias("allowed"))


@query("c10_ad_reservation")
def c10(t):
    """Every campaign takes part; each user's events ask the campaign at their number, counted round."""
    n = max(1, t.supplier.count())
    one = running_before(campaigns(t).withColumn("one", F.lit(1)), "campaign_id", ["one"])
    numbered = one.withColumnRenamed("before_one", "number")
    limits = numbered.select("number", "campaign_id", scores.expected_spend(F.col("bid") * 10, F.col("ctr")).alias("spend"), F.lit(200).alias("daily_budget"), F.lit(3).alias("frequency_cap"))
    rows = t.events.select((F.col("user_id") % n).alias("number"), F.to_date("ts").alias("day"), F.col("event_id").alias("request_id"), "user_id", (F.hour("ts") * 3600 + F.minute("ts") * 60).alias("second"))
    rows = rows.join(limits.select("number", "campaign_id"), "number").drop("number")  # Spark broadcasts it if it is small
    limits = limits.drop("number")
    return feed.reserve(rows, limits)


@query("c11_first_write", "SELECT user_id, min(event_id) FILTER (WHERE event_type = 'view') AS impression, min(event_id) FILTER (WHERE event_type = 'click') AS click, CASE WHEN min(event_id) FILTER (WHERE event_type = 'click') IS NOT NULL THEN 'clicked' WHEN min(event_id) FILTER (WHERE event_type = 'view') IS NOT NULL THEN 'confirmed' ELSE 'served' END AS status FROM events GROUP BY user_id")
def c11(t):
    """The first impression and click of each delivery count; later ones change nothing."""
    first = lambda k: F.min(F.when(F.col("event_type") == k, F.col("event_id")))
    per = t.events.groupBy("user_id").agg(first("view").alias("impression"), first("click").alias("click"))
    return per.withColumn("status", F.when(F.col("click").isNotNull(), "clicked").when(F.col("impression").isNotNull(), "confirmed").otherwise("served"))
