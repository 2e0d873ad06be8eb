"""Frames, set operations, metrics one by one, gates, paging and the feed's smaller parts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from presswork.functions import scores, text
from presswork.operators import evaluation, feed, ordered
from presswork.plans.bindings import with_views
from presswork.plans.feed_queries import FEED, catalog, scored
from presswork.plans.metric_queries import popularity
from presswork.plans.profile_queries import NOW, SCORED, SIGNALS, closed
from presswork.plans.registry import query
from presswork.plans.relational_queries import HOT, item_counts


@query("w7_ranked_hits", "SELECT l_orderkey, l_linenumber, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank FROM lineitem) WHERE rank <= 3")
def w7(t):
    """Hits 1 to k by descending score, ties by id."""
    return ordered.top_per_group(t.lineitem, ["l_orderkey"], [F.col("l_extendedprice").desc(), "l_linenumber"], 3, "rank").select("l_orderkey", "l_linenumber", "rank")


@query("w8_top_margin", "SELECT l_orderkey, round(max(CASE WHEN k = 1 THEN l_extendedprice END) - coalesce(max(CASE WHEN k = 2 THEN l_extendedprice END), 0), 4) AS margin FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS k FROM lineitem) GROUP BY l_orderkey")
def w8(t):
    """How far the best score is above the second (above 0, if there is none)."""
    rows = ordered.top_per_group(t.lineitem, ["l_orderkey"], [F.col("l_extendedprice").desc(), "l_linenumber"], 2, "k")
    place = lambda k: F.max(F.when(F.col("k") == k, F.col("l_extendedprice")))
    return rows.groupBy("l_orderkey").agg(F.round(place(1) - F.coalesce(place(2), F.lit(0.0)), 4).alias("margin"))


@query("w16_rank_frames", "SELECT o_orderkey, rank() OVER w::INT AS rank, dense_rank() OVER w::INT AS dense, ntile(4) OVER u::INT AS quarter, lag(o_totalprice) OVER u AS before, lead(o_totalprice, 2) OVER u AS after, "
    "count(*) OVER (PARTITION BY o_custkey ORDER BY epoch_us(o_orderdate) // 86400000000 RANGE BETWEEN 90 PRECEDING AND CURRENT ROW)::BIGINT AS in_90_days FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority), u AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def w16(t):
    """Rank, dense rank, quarters, neighbours and a range of days, all over one partitioning."""
    w, u = Window.partitionBy("o_custkey").orderBy("o_orderpriority"), Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    days = Window.partitionBy("o_custkey").orderBy(F.unix_date(F.col("o_orderdate").cast("date"))).rangeBetween(-90, 0)
    return t.orders.select("o_orderkey", F.rank().over(w).alias("rank"), F.dense_rank().over(w).alias("dense"), F.ntile(4).over(u).alias("quarter"), F.lag("o_totalprice").over(u).alias("before"), F.lead("o_totalprice", 2).over(u).alias("after"), F.count("*").over(days).alias("in_90_days"))


@query("a33_cube", "SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus)::INT AS level, count(*)::BIGINT AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus) HAVING count(*) > 10")
def a33(t):
    rows = t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return rows.where("n > 10")


@query("a33_rollup", "SELECT c_mktsegment, c_nationkey, count(*)::BIGINT AS n, count(DISTINCT o_orderpriority)::BIGINT AS priorities FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
def a33_rollup(t):
    rows = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    return rows.rollup("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"), F.count_distinct("o_orderpriority").alias("priorities"))


@query("a27_seed_topics", with_views("articles", "impressions", more=("c AS (SELECT user_id, category, count(*) AS n FROM impressions JOIN articles USING (article_id) WHERE clicked = 1 GROUP BY ALL)",)) +
    "SELECT user_id, '[' || string_agg('{\"topic\":\"' || category || '\",\"weight\":' || n || '}', ',' ORDER BY n DESC, category) || ']' AS seed FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, category) AS k FROM c) WHERE k <= 6 GROUP BY user_id")
def a27(t):
    """Each user's six strongest topics as JSON, strongest first."""
    per = t.impressions.where("clicked = 1").join(t.articles, "article_id").groupBy("user_id", "category").agg(F.count("*").alias("n"))
    top = ordered.top_per_group(per, ["user_id"], [F.col("n").desc(), "category"], 6, "k")
    members = F.transform(F.array_sort(F.collect_list(F.struct("k", "category", "n"))), lambda x: F.struct(x["category"].alias("topic"), x["n"].alias("weight")))
    return top.groupBy("user_id").agg(F.to_json(members).alias("seed"))


@query("j12_paired_requests", with_views("impressions", more=("a AS (SELECT request_id, min(position) AS m FROM impressions GROUP BY 1)", "b AS (SELECT request_id, min(position) FILTER (WHERE clicked = 1) AS m FROM impressions GROUP BY 1)")) + "SELECT count(*)::BIGINT AS pairs, (SELECT count(*) FROM a)::BIGINT AS requests, count(*) FILTER (WHERE b.m IS NULL)::BIGINT AS unscored, round(avg(b.m - a.m), 6) AS delta FROM a JOIN b USING (request_id)")
def j12(t):
    """Two runs paired by request; complete if there are as many pairs as requests."""
    one = t.impressions.groupBy("request_id").agg(F.min("position").alias("a"))
    two = t.impressions.groupBy("request_id").agg(F.min(F.when(F.col("clicked") == 1, F.col("position"))).alias("b"))
    n = one.agg(F.count("*").alias("requests"))
    out = one.join(two, "request_id").agg(F.count("*").alias("pairs"), F.count_if(F.col("b").isNull()).alias("unscored"), F.round(F.avg(F.col("b") - F.col("a")), 6).alias("delta"))
    return out.join(F.broadcast(n))  # one row each


RANKS = ("ra AS (SELECT l_suppkey AS query, l_partkey AS doc, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_partkey, l_orderkey) AS rank FROM lineitem QUALIFY rank <= 5)", "rb AS (SELECT l_suppkey AS query, l_partkey AS doc, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_partkey, l_orderkey) AS rank FROM lineitem QUALIFY rank <= 5)",
         "r1 AS (SELECT query, doc, min(rank) AS rank_a FROM ra GROUP BY ALL)", "r2 AS (SELECT query, doc, min(rank) AS rank_b FROM rb GROUP BY ALL)")


def rank_lists(t):
    for by, name in (("l_extendedprice", "rank_a"), ("l_quantity", "rank_b")):
        top = ordered.top_per_group(t.lineitem, ["l_suppkey"], [F.col(by).desc(), "l_partkey", "l_orderkey"], 5, "k")
        yield top.groupBy(F.col("l_suppkey").alias("query"), F.col("l_partkey").alias("doc")).agg(F.min("k").alias(name))


@query("j13_rank_merge", "WITH " + ", ".join(RANKS) + " SELECT query, doc, rank_a::INT AS rank_a, rank_b::INT AS rank_b FROM r1 FULL JOIN r2 USING (query, doc)")
def j13(t):
    """The union of two rank lists, with null where a list does not have the document."""
    a, b = rank_lists(t)
    return a.join(b, ["query", "doc"], "full").select("query", "doc", "rank_a", "rank_b")


@query("u6_channel_union", "WITH " + ", ".join(RANKS) + " SELECT query, doc, array_to_string(list_sort(list(DISTINCT source)), '+') AS sources, max(score)::DOUBLE AS score, bool_and(fb) AS is_fallback FROM (SELECT query, doc, 'price' AS source, 1.0 / rank_a AS score, false AS fb FROM r1 UNION ALL SELECT query, doc, 'quantity', 1.0 / rank_b, true FROM r2) GROUP BY query, doc")
def u6(t):
    """Channels merged by item: the set of sources, the best score, and fallback only if every channel is one."""
    a, b = rank_lists(t)
    channel = lambda rows, rank, back: rows.select(F.col("query").alias("request_id"), F.col("doc").alias("article_id"), (1.0 / F.col(rank)).alias("recall_score"), F.lit(back).alias("is_fallback"))
    out = feed.merge_channels({"price": channel(a, "rank_a", False), "quantity": channel(b, "rank_b", True)})
    return out.select(F.col("request_id").alias("query"), F.col("article_id").alias("doc"), F.array_join(F.array_sort("sources"), "+").alias("sources"), F.col("recall_score").alias("score"), "is_fallback")


@query("j15_day_pairs", "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'purchase' AND a.event_id < b.event_id AND abs(epoch_us(a.ts) // 1000000 - epoch_us(b.ts) // 1000000) <= 3600")
def j15(t):
    """Purchases of one user within an hour: each meets those of its own and the next hour, not all of the user's."""
    rows = t.events.where("event_type = 'purchase'").select("user_id", "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at")).withColumn("hour", F.floor(F.col("at") / 3600))
    other = rows.select("user_id", F.col("event_id").alias("id_b"), F.col("at").alias("at_b"), F.explode(F.array(F.col("hour") - 1, F.col("hour"), F.col("hour") + 1)).alias("hour"))
    near = rows.join(other, ["user_id", "hour"]).where("event_id < id_b and abs(at - at_b) <= 3600")
    return near.select(F.col("event_id").alias("a"), F.col("id_b").alias("b"))


@query("j19_job_status", "SELECT p_partkey, coalesce(status, 'none') AS status FROM part LEFT JOIN (SELECT l_partkey, max(l_linestatus) AS status FROM lineitem WHERE l_quantity > 48 GROUP BY 1) ON l_partkey = p_partkey")
def j19(t):
    """Articles with the status of their job, if there is one."""
    jobs = t.lineitem.where("l_quantity > 48").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_linestatus").alias("status"))
    return t.part.select("p_partkey").join(jobs, "p_partkey", "left").select("p_partkey", F.coalesce("status", F.lit("none")).alias("status"))


@query("u7_except_intersect", "SELECT 'only_orders' AS side, k FROM (SELECT o_custkey AS k FROM orders EXCEPT SELECT user_id FROM events) UNION ALL SELECT 'both', k FROM (SELECT o_custkey AS k FROM orders INTERSECT SELECT user_id FROM events)")
def u7(t):
    a, b = t.orders.select(F.col("o_custkey").alias("k")), t.events.select(F.col("user_id").alias("k"))
    return a.subtract(b).select(F.lit("only_orders").alias("side"), "k").unionByName(a.intersect(b).select(F.lit("both").alias("side"), "k"))


REL = ("rk AS (SELECT request_id, clicked, row_number() OVER (PARTITION BY request_id ORDER BY hot DESC, article_id) AS rank FROM impressions JOIN hot USING (article_id))",)


def metric(t, column: str):
    """One metric of every request; 0 without a relevant item."""
    ranking = popularity(t)
    per = evaluation.request_metrics(ranking, "request_id", "clicked", (5,)).select("request_id", F.round(column, 6).alias("value"))
    return ranking.select("request_id").distinct().join(per, "request_id", "left").select("request_id", F.coalesce("value", F.lit(0.0)).alias("value"))


@query("e1_recall_at_5", with_views("impressions", more=(HOT, *REL)) + "SELECT request_id, round(coalesce(sum(clicked) FILTER (WHERE rank <= 5)::DOUBLE / nullif(sum(clicked), 0), 0), 6) AS value FROM rk GROUP BY request_id")
def e1(t):
    return metric(t, "recall_5")


@query("e2_ndcg_at_5", with_views("impressions", more=(HOT, *REL)) + "SELECT request_id, round(coalesce(sum(clicked / log2(rank + 1)) FILTER (WHERE rank <= 5) / nullif(list_sum(list_transform(range(1, 1 + least(5, sum(clicked))::BIGINT), lambda i: 1 / log2(i + 1))), 0), 0), 6) AS value FROM rk GROUP BY request_id")
def e2(t):
    return metric(t, "ndcg_5")


@query("e4_mrr", with_views("impressions", more=(HOT, *REL)) + "SELECT request_id, round(coalesce(1.0 / min(rank) FILTER (WHERE clicked = 1), 0), 6)::DOUBLE AS value FROM rk GROUP BY request_id")
def e4(t):
    return metric(t, "mrr")


def launch_gate(runs, interval_lower):
    """The four checks that the new arm must pass to become the default, and the default that follows.

    runs: one row with recall_a, recall_b, reject_b, false_reject_a, false_reject_b; interval_lower: the lower end of the
    confidence interval of the difference in NDCG.
    """
    checks = {
        "ndcg_positive": interval_lower > 0, "recall_not_lower": F.col("recall_b") >= F.col("recall_a"), "rejects_all": F.col("reject_b") == 1.0,
        "false_rejects_not_higher": F.col("false_reject_b") <= F.col("false_reject_a"),
    }
    passed = F.lit(True)
    for check in checks.values():
        passed = passed & check
    return runs.select("*", *(c.alias(k) for k, c in checks.items()), F.when(passed, "hybrid_v1").otherwise("lexical_v1").alias("default_arm"))


@query("e7_launch_gate", "SELECT n_nationkey, n_nationkey % 5 > 0 AS ndcg_positive, n_nationkey % 3 >= 1 AS recall_not_lower, n_nationkey % 4 <> 3 AS rejects_all, n_nationkey % 7 <= 4 AS false_rejects_not_higher, CASE WHEN n_nationkey % 5 > 0 AND n_nationkey % 3 >= 1 AND n_nationkey % 4 <> 3 AND n_nationkey % 7 <= 4 THEN 'hybrid_v1' ELSE 'lexical_v1' END AS default_arm FROM nation")
def e7(t):
    k = F.col("n_nationkey")
    runs = t.nation.select("n_nationkey", (k % 3 / 3).alias("recall_b"), F.lit(1 / 3).alias("recall_a"), F.when(k % 4 == 3, 0.9).otherwise(1.0).alias("reject_b"), (k % 7 / 10).alias("false_reject_b"), F.lit(0.4).alias("false_reject_a"))
    return launch_gate(runs, k % 5 / 100).select("n_nationkey", "ndcg_positive", "recall_not_lower", "rejects_all", "false_rejects_not_higher", "default_arm")


@query("e8_direction", "SELECT n_nationkey, CASE WHEN lo > 0 THEN 'improvement' WHEN hi < 0 THEN 'regression' ELSE 'inconclusive' END AS direction FROM (SELECT n_nationkey, n_nationkey % 9 - 5 AS lo, n_nationkey % 9 - 5 + n_nationkey % 4 AS hi FROM nation)")
def e8(t):
    """What the ends of an interval say of a difference."""
    lo = F.col("n_nationkey") % 9 - 5
    return t.nation.select("n_nationkey", direction(lo, lo + F.col("n_nationkey") % 4).alias("direction"))


def direction(lower, upper):
    return F.when(lower > 0, "improvement").when(upper < 0, "regression").otherwise("inconclusive")


def slot_reachable(organic: str, sponsored: str, candidate, slot, placed):
    """Whether enough organic items are left to fill the places before a slot, once those that are sponsored already
    and the candidate itself are out."""
    left = F.size(F.array_except(F.array_except(organic, sponsored), F.array(candidate)))
    return left >= slot - 1 - placed


@query("l11_slot_reachable", "SELECT l_orderkey, len(list_filter(list(DISTINCT l_partkey), lambda x: x % 7 <> 0 AND x <> min(l_partkey))) >= 4 - 1 - 1 AS reachable FROM lineitem GROUP BY l_orderkey")
def l11(t):
    """Slot 4 of each page, one slot placed before it."""
    part = F.col("l_partkey")
    pages = t.lineitem.groupBy("l_orderkey").agg(F.collect_set(part).alias("organic"), F.collect_set(F.when(part % 7 == 0, part)).alias("sponsored"), F.min(part).alias("candidate"))
    return pages.select("l_orderkey", slot_reachable("organic", "sponsored", F.col("candidate"), F.lit(4), F.lit(1)).alias("reachable"))


@query("l13_cursor_page", with_views("impressions", more=(HOT, "sn AS (SELECT DISTINCT user_id, article_id FROM impressions WHERE position = 1)",
    "o AS (SELECT i.user_id, article_id, row_number() OVER (PARTITION BY i.user_id ORDER BY hot DESC, article_id) AS k, count(*) OVER (PARTITION BY i.user_id) AS n FROM (SELECT DISTINCT user_id, article_id FROM impressions) i JOIN hot USING (article_id) WHERE NOT EXISTS (SELECT 1 FROM sn WHERE sn.user_id = i.user_id AND sn.article_id = i.article_id))")) +
    "SELECT user_id, article_id, (k - 3)::INT AS place, n > 6 AS has_more, to_base64((user_id || ':6')::BLOB) AS next_cursor FROM o WHERE k > 3 AND k <= 6")
def l13(t):
    """The second page of three of each user, less what the session has shown; an opaque cursor leads to the next."""
    shown = t.impressions.where("position = 1").select("user_id", "article_id")
    rows = t.impressions.select("user_id", "article_id").distinct().join(shown, ["user_id", "article_id"], "left_anti").join(item_counts(t).select("article_id", "hot"), "article_id")
    return page_after(rows, "user_id", [F.col("hot").desc(), "article_id"], 3, 3).select("user_id", "article_id", "place", "has_more", "next_cursor")


def page_after(rows, group: str, order: list, offset: int, size: int):
    """The rows of each group from offset on: place, has_more (whether any follow) and the cursor of the next page."""
    w = Window.partitionBy(group)
    placed = rows.withColumn("k", F.row_number().over(w.orderBy(*order))).withColumn("n", F.count("*").over(w)).where(F.col("k").between(offset + 1, offset + size))
    cursor = F.base64(F.encode(F.concat_ws(":", F.col(group).cast("string"), F.lit(offset + size)), "utf-8"))
    return placed.withColumns({"place": (F.col("k") - offset).cast("int"), "has_more": F.col("n") > offset + size, "next_cursor": cursor})


@query("l16_config_ranking", "SELECT p_partkey, row_number() OVER (ORDER BY p_size % 2 DESC, p_retailprice DESC, p_size, p_brand, p_type, p_name, p_size % 7, p_partkey % 9, p_partkey)::INT AS rank FROM part QUALIFY rank <= 20")
def l16(t):
    """The best of many settings by nine keys."""
    keys = [(F.col("p_size") % 2).desc(), F.col("p_retailprice").desc(), "p_size", "p_brand", "p_type", "p_name", F.col("p_size") % 7, F.col("p_partkey") % 9, "p_partkey"]
    best = t.part.orderBy(*keys).limit(20)
    return best.select("p_partkey", F.row_number().over(Window.orderBy(*keys)).alias("rank"))


@query("c4_v2_boost", with_views("user_events", "articles", "impressions", more=(SIGNALS, *closed("s"), SCORED, "t10 AS (SELECT user_id, topic_id, round(score, 9) AS score FROM sc WHERE round(score, 9) > 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, topic_id) <= 10)",
    "x AS (SELECT i.request_id, i.article_id, i.user_id, (p_size % 16) AS ta, (i.article_id % 16) AS tb FROM impressions i JOIN part ON p_partkey = i.article_id)")) +
    "SELECT request_id, article_id, round(0.5 + 0.1 * (coalesce(a.score, 0) + CASE WHEN ta <> tb THEN coalesce(b.score, 0) ELSE 0 END), 6)::DOUBLE AS final_score FROM x LEFT JOIN t10 a ON a.user_id = x.user_id AND a.topic_id = ta LEFT JOIN t10 b ON b.user_id = x.user_id AND b.topic_id = tb")
def c4(t):
    """Final scores lifted by a tenth of the user's ten best positive topic scores among the article's topics."""
    from presswork.operators import profile

    state = profile.at_time(profile.in_order_profile(t.user_events, ["user_id", "topic_id"]), F.lit(NOW)).withColumn("score", F.round("score", 9)).where("score > 0")
    best = ordered.top_per_group(state, ["user_id"], [F.col("score").desc(), "topic_id"], 10, "k").groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("topic_id", "score"))).alias("topics"))
    of = t.part.select(F.col("p_partkey").alias("article_id"), F.array_distinct(F.array((F.col("p_size") % 16).cast("int"), (F.col("p_partkey") % 16).cast("int"))).alias("own"))
    rows = t.impressions.select("request_id", "article_id", "user_id").join(of, "article_id").join(best, "user_id", "left")
    lift = F.aggregate("own", F.lit(0.0), lambda s, x: s + F.coalesce(F.try_element_at("topics", x), F.lit(0.0)))
    return rows.select("request_id", "article_id", F.round(0.5 + 0.1 * lift, 6).alias("final_score"))


@query("k67_article_cards", with_views("articles", "impressions", more=(HOT,)) + "SELECT article_id, title, category || ' / ' || subcategory AS label, coalesce(clicks, 0)::BIGINT AS clicks, title = 'small ring' AS featured FROM articles LEFT JOIN hot USING (article_id)")
def k67(t):
    """What a card shows of an article."""
    rows = t.articles.join(item_counts(t), "article_id", "left")
    return rows.select("article_id", "title", F.concat_ws(" / ", "category", "subcategory").alias("label"), F.coalesce("clicks", F.lit(0)).alias("clicks"), (F.col("title") == "small ring").alias("featured"))


@query("k61_item_cosine", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)) / sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) / sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id AND a.vec_id // 50 = b.vec_id // 50")
def k61(t):
    """Cosines of items of one label and one shelf of fifty."""
    left = t.embeddings.select(F.col("vec_id").alias("a"), "label", F.floor(F.col("vec_id") / 50).alias("shelf"), F.col("embedding").alias("x"))
    right = left.select(F.col("a").alias("b"), "label", "shelf", F.col("x").alias("y"))
    return left.join(right, ["label", "shelf"]).where("a < b").select("a", "b", F.round(text.cosine(F.col("x"), F.col("y")), 5).alias("cosine"))


@query("k69_penalty_grid", "SELECT * FROM (VALUES (1, 0.2), (2, 0.0), (3, 0.5)) AS g(place, penalty)")
def k69(t):
    """Penalties from text: repeats and negative ones dropped, order kept."""
    raw = t.spark.createDataFrame([("0.2, 0,0.5,-1,0.20,x",)], "raw string")
    numbers = F.array_distinct(F.transform(F.split("raw", ","), lambda x: F.trim(x).try_cast("double")))
    fine = F.filter(numbers, lambda x: x.isNotNull() & (x >= 0))
    return raw.select(F.posexplode(fine).alias("p", "penalty")).select((F.col("p") + 1).alias("place"), "penalty")


@query("c13_catalog_merge", "SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'insert' WHEN b.id IS NULL THEN 'delete' WHEN a.k IS DISTINCT FROM b.k THEN 'update' ELSE 'keep' END AS action, (SELECT count(*) FROM part WHERE p_partkey % 11 = 0 OR p_partkey % 13 = 0) > 0 AS topics_changed FROM (SELECT p_partkey AS id, p_type AS k FROM part WHERE p_partkey % 11 <> 0) a FULL JOIN (SELECT p_partkey AS id, CASE WHEN p_partkey % 13 = 0 THEN 'NEW' ELSE p_type END AS k FROM part WHERE p_partkey % 17 <> 0) b USING (id)")
def c13(t):
    """What importing a new catalog does to each row, and whether profiles must be reset for it."""
    old = t.part.where("p_partkey % 11 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("old"), F.lit(1).alias("in_old"))
    new = t.part.where("p_partkey % 17 <> 0").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 13 == 0, "NEW").otherwise(F.col("p_type")).alias("new"), F.lit(1).alias("in_new"))
    both = merge_actions(old, new)
    changed = both.agg((F.count_if(F.col("action") != "keep") > 0).alias("topics_changed"))
    return both.select("id", "action").join(F.broadcast(changed))  # one row


def merge_actions(old, new):
    """insert, delete, update or keep for each id of two versions (id, old, in_old) and (id, new, in_new)."""
    action = F.when(F.col("in_old").isNull(), "insert").when(F.col("in_new").isNull(), "delete").when(~F.col("old").eqNullSafe(F.col("new")), "update").otherwise("keep")
    return old.join(new, "id", "full").withColumn("action", action)


HEALTH = "CASE WHEN age > 3 * 86400 THEN 'down' WHEN failed * 10 > n THEN 'degraded' ELSE 'ready' END"


@query("c29_readiness", f"SELECT event_type, {HEALTH} AS status FROM (SELECT event_type, {NOW} - max(epoch_us(ts) // 1000000) AS age, count(*) FILTER (WHERE value > 45) AS failed, count(*) AS n FROM events GROUP BY 1)")
def c29(t):
    """Readiness of each queue from the age of its last entry and its share of failures."""
    per = t.events.groupBy("event_type").agg((F.lit(NOW) - F.max(F.unix_timestamp(F.col("ts").cast("timestamp")))).alias("age"), F.count_if(F.col("value") > 45).alias("failed"), F.count("*").alias("n"))
    return per.select("event_type", F.when(F.col("age") > 3 * 86_400, "down").when(F.col("failed") * 10 > F.col("n"), "degraded").otherwise("ready").alias("status"))


@query("k58_collector_health", f"SELECT user_id, {NOW} - max(epoch_us(ts) // 1000000) > greatest(300, 5 * (user_id % 90 + 30)) OR bool_or(event_type = 'error' AND value > 49) AS unhealthy FROM events GROUP BY user_id")
def k58(t):
    """A collector is ill if it has been silent for five polls (five minutes at least) or its last poll failed badly."""
    age = F.lit(NOW) - F.max(F.unix_timestamp(F.col("ts").cast("timestamp")))
    failed = F.bool_or((F.col("event_type") == "error") & (F.col("value") > 49))
    return t.events.groupBy("user_id").agg(((age > F.greatest(F.lit(300), 5 * (F.first("user_id") % 90 + 30))) | failed).alias("unhealthy"))


@query("k5_active_catalog", "SELECT r_regionkey, count(n_nationkey) FILTER (WHERE n_nationkey % 5 = 0)::BIGINT AS active, count(n_nationkey) FILTER (WHERE n_nationkey % 5 = 0) = 1 AS valid FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def k5(t):
    """Whether exactly one catalog of each space is active."""
    rows = t.region.join(t.nation, F.col("n_regionkey") == F.col("r_regionkey"), "left").groupBy("r_regionkey").agg(F.count_if(F.col("n_nationkey") % 5 == 0).alias("active"))
    return rows.withColumn("valid", F.col("active") == 1)


@query("k17_topic_seed_guard", "SELECT coalesce(a.id, b.id) AS topic_id, CASE WHEN a.id IS NULL THEN 'seed' WHEN b.id IS NULL THEN 'foreign' WHEN a.name <> b.name THEN 'collision' ELSE 'same' END AS state FROM (SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey < 20) a FULL JOIN (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 6 = 0 THEN 'OTHER' ELSE n_name END AS name FROM nation WHERE n_nationkey > 4) b USING (id)")
def k17(t):
    """Ids of a taxonomy to be seeded against those that are there: what is new, foreign, the same or taken."""
    there = t.nation.where("n_nationkey < 20").select(F.col("n_nationkey").alias("topic_id"), F.col("n_name").alias("a"))
    seed = t.nation.where("n_nationkey > 4").select(F.col("n_nationkey").alias("topic_id"), F.when(F.col("n_nationkey") % 6 == 0, "OTHER").otherwise(F.col("n_name")).alias("b"))
    state = F.when(F.col("a").isNull(), "seed").when(F.col("b").isNull(), "foreign").when(F.col("a") != F.col("b"), "collision").otherwise("same")
    return there.join(seed, "topic_id", "full").select("topic_id", state.alias("state"))


@query("k18_live_topics", "SELECT l_partkey AS article_id, list_sort(list(DISTINCT l_suppkey % 15))::VARCHAR AS topics FROM lineitem WHERE l_linestatus = 'F' AND l_suppkey % 15 <> 14 GROUP BY 1")
def k18(t):
    """Topics of articles whose job is complete, without the general topic."""
    rows = t.lineitem.where("l_linestatus = 'F'").select(F.col("l_partkey").alias("article_id"), (F.col("l_suppkey") % 15).alias("topic")).where("topic <> 14")
    names = F.transform(F.array_sort(F.collect_set("topic")), lambda x: x.cast("string"))
    return rows.groupBy("article_id").agg(F.concat(F.lit("["), F.array_join(names, ", "), F.lit("]")).alias("topics"))


@query("k14_content_enqueue", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'blocked' WHEN n > 0 THEN 'available' ELSE 'pending' END AS state FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY 1) ON l_partkey = p_partkey")
def k14(t):
    """Content asked for on demand: blocked by policy, there already, or queued."""
    have = t.lineitem.where("l_quantity > 45").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    state = F.when(F.col("p_size") % 4 == 0, "blocked").when(F.col("n") > 0, "available").otherwise("pending")
    return t.part.join(have, "p_partkey", "left").select("p_partkey", state.alias("state"))


@query("k40_topic_text", "SELECT p_partkey, lower(p_name) AS topic, p_partkey % 9 = 0 AS rejected FROM part WHERE p_partkey % 9 <> 0 UNION ALL SELECT p_partkey, NULL, true FROM part WHERE p_partkey % 9 = 0")
def k40(t):
    """Topic names trimmed, in lower case with single blanks; blank ones are rejected."""
    raw = F.when(F.col("p_partkey") % 9 == 0, F.lit(" \t ")).otherwise(F.concat(F.lit("  "), F.regexp_replace("p_name", " ", " \t "), F.lit(" ")))
    topic = F.nullif(text.search_text(raw), F.lit(""))
    return t.part.select("p_partkey", topic.alias("topic"), topic.isNull().alias("rejected"))


@query("k43_live_candidates", "SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 = 0 THEN p_size END, p_size + 100)::INT AS at, coalesce(CASE WHEN p_brand = 'Brand#2' THEN 0.8 WHEN p_brand = 'Brand#3' THEN 0.6 END, 0)::DOUBLE AS quality, coalesce(CASE WHEN p_partkey % 2 = 0 THEN p_name END, lower(p_brand)) AS publisher FROM part")
def k43(t):
    """Rows as candidates: time of publication or else of discovery, quality of the policy or 0, publisher or domain."""
    policies = t.spark.createDataFrame([("Brand#2", 0.8), ("Brand#3", 0.6)], "p_brand string, quality double")
    rows = t.part.join(F.broadcast(policies), "p_brand", "left")  # two rows
    published, publisher = (F.when(F.col("p_partkey") % k == 0, F.col(c)) for k, c in ((3, "p_size"), (2, "p_name")))
    return rows.select("p_partkey", F.coalesce(published, F.col("p_size") + 100).alias("at"), F.coalesce("quality", F.lit(0.0)).alias("quality"), F.coalesce(publisher, F.lower("p_brand")).alias("publisher"))


@query("p16_visible_document", "SELECT p_partkey, p_size % 3 = 0 AND p_partkey % 5 <> 0 AND p_partkey % 4 = p_size % 4 AS visible FROM part")
def p16(t):
    """A structured document is shown if the policy lets it, it is complete, and it has the version that is read."""
    key, size = F.col("p_partkey"), F.col("p_size")
    return t.part.select("p_partkey", ((size % 3 == 0) & (key % 5 != 0) & (key % 4 == size % 4)).alias("visible"))


@query("c3_arm_table", with_views("articles", "impressions", more=FEED) + "SELECT arm, request_id, article_id FROM (SELECT 'base' AS arm, request_id, article_id, row_number() OVER (PARTITION BY request_id ORDER BY base_score DESC, article_id) AS k FROM m UNION ALL SELECT 'topic', request_id, article_id, row_number() OVER (PARTITION BY request_id ORDER BY topic_match_score DESC, article_id) FROM m UNION ALL SELECT 'manual', request_id, article_id, rank FROM o) WHERE k = 1")
def c3(t):
    """The first article of each request under the arms that differ in what they rank by."""
    rows = scored(t)
    arms = {"base": ["base_score"], "topic": ["topic_match_score"], "manual": ["final_score"]}
    first = [F.min_by("article_id", F.struct(*(-F.col(c) for c in columns), "article_id")).alias(arm) for arm, columns in arms.items()]
    best = rows.groupBy("user_id", "request_id").agg(*first)
    return best.drop("user_id").unpivot("request_id", list(arms), "arm", "article_id")
