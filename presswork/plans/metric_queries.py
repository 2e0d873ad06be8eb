"""Ranking arms and metrics over impressions, and metrics of scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from presswork.operators import evaluation, feed
from presswork.plans.bindings import with_views
from presswork.plans.feed_queries import PAST
from presswork.plans.registry import query
from presswork.plans.relational_queries import HOT, item_counts

RANKED = "k AS (SELECT request_id, article_id, clicked, hot, row_number() OVER (PARTITION BY request_id ORDER BY hot DESC, article_id) AS rank FROM impressions JOIN hot USING (article_id))"
PER = "m AS (SELECT request_id, sum(clicked)::DOUBLE AS p, min(rank) FILTER (WHERE clicked = 1) AS f, " + ", ".join(
    f"sum(clicked) FILTER (WHERE rank <= {k}) AS h{k}, sum(CASE WHEN rank <= {k} THEN clicked / log2(rank + 1) ELSE 0 END) AS d{k}" for k in (1, 2, 5)) + " FROM k GROUP BY request_id HAVING sum(clicked) > 0)"
METRICS = "e AS (SELECT request_id, 1.0::DOUBLE / f AS mrr, " + ", ".join(
    f"h{k} / p AS recall_{k}, d{k} / list_sum(list_transform(range(1, least(p::INT, {k}) + 1), lambda i: 1 / log2(i + 1))) AS ndcg_{k}" for k in (1, 2, 5)) + " FROM m)"
_ALL = ("mrr", "recall_1", "ndcg_1", "recall_2", "ndcg_2", "recall_5", "ndcg_5")


def popularity(t):
    return evaluation.ranked(t.impressions.join(item_counts(t).select("article_id", "hot"), "article_id"), "request_id", "hot", "article_id")


def _mean(per):
    return per.agg(F.count("*").alias("requests"), *(F.round(F.avg(c), 6).alias(c) for c in _ALL))


@query("a25_request_metrics", with_views("impressions", more=(HOT, RANKED, PER, METRICS)) + "SELECT request_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in _ALL) + " FROM e")
def a25(t):
    per = evaluation.request_metrics(popularity(t), "request_id", "clicked", (1, 2, 5))
    return per.select("request_id", *(F.round(c, 6).alias(c) for c in _ALL))


@query("a24_popularity_arm", with_views("impressions", more=(HOT, RANKED, PER, METRICS)) + "SELECT count(*)::BIGINT AS requests, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in _ALL) + " FROM e")
def a24(t):
    return _mean(evaluation.request_metrics(popularity(t), "request_id", "clicked", (1, 2, 5)))


_CATEGORY = (*PAST,
             "hot AS (SELECT request_id, article_id, clicked, round(coalesce(weight, 0), 9) AS hot FROM impressions JOIN articles USING (article_id) LEFT JOIN (SELECT request_id, category, weight FROM p) USING (request_id, category))",
             "k AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY hot DESC, article_id) AS rank FROM hot)", PER, METRICS)


@query("a24_category_arm", with_views("articles", "impressions", more=_CATEGORY) + "SELECT count(*)::BIGINT AS requests, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in _ALL) + " FROM e")
def a24b(t):
    """Candidates ranked by the weight of their category in the user's history before the request. Impressions are dealt to
    their articles and to their users, a bounded number to a partition; profiles, ranks and metrics stay with the user."""
    n = t.impression_partitions()
    rows = t.dealt_impressions().select("request_id", "article_id", "user_id", "event_ts", "clicked").repartition(n, "article_id").join(t.articles.select("article_id", "category").repartition(n, "article_id"), "article_id")
    rows = feed.with_past_shares(rows.repartition(n, "user_id")).withColumn("score", F.round("weight", 9))
    place = Window.partitionBy("user_id", "request_id").orderBy(F.col("score").desc(), "article_id")
    return _mean(evaluation.request_metrics(rows.withColumn("rank", F.row_number().over(place)), ["user_id", "request_id"], "clicked", (1, 2, 5)))


@query("a24_category_diversity", with_views("articles", "impressions", more=(HOT, RANKED)) + "SELECT round(avg(d), 6) AS diversity FROM (SELECT request_id, count(DISTINCT category) AS d FROM k JOIN articles USING (article_id) WHERE rank <= 10 GROUP BY request_id HAVING sum(clicked) >= 0)")
def a24c(t):
    top = popularity(t).where("rank <= 10").join(t.articles, "article_id")
    return top.groupBy("request_id").agg(F.countDistinct("category").alias("d")).agg(F.round(F.avg("d"), 6).alias("diversity"))


GRADES = "g AS (SELECT request_id, article_id, rank, clicked + CASE WHEN position = 1 THEN 1 ELSE 0 END AS grade FROM k JOIN impressions USING (request_id, article_id, clicked))"


@query("e3_graded_ndcg", with_views("impressions", more=(HOT, RANKED, GRADES, "b AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY grade DESC, rank) AS best FROM g)",
    "s AS (SELECT request_id, sum(CASE WHEN rank <= 5 THEN (pow(2, grade) - 1) / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN best <= 5 THEN (pow(2, grade) - 1) / log2(best + 1) ELSE 0 END) AS ideal FROM b GROUP BY request_id)")) + "SELECT request_id, round(dcg / ideal, 6) AS ndcg FROM s WHERE ideal > 0")
def e3(t):
    rows = popularity(t).withColumn("grade", F.col("clicked") + (F.col("position") == 1).cast("int"))
    return evaluation.graded_ndcg(rows, "request_id", "grade", 5).select("request_id", F.round("ndcg", 6).alias("ndcg"))


@query("a31_auc", with_views("impressions", more=(HOT, RANKED, "s AS (SELECT hot, count(*) AS n, sum(clicked) AS p FROM k GROUP BY hot)", "r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY hot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0 AS rank FROM s)")) + "SELECT round(((sum(rank * p) - sum(p) * (sum(p) + 1) / 2.0) / (sum(p) * (sum(n) - sum(p))))::DOUBLE, 6) AS auc FROM r")
def a31(t):
    return evaluation.roc_auc(popularity(t), "hot", "clicked").select(F.round("auc", 6).alias("auc"))


@query("a31_average_precision", with_views("impressions", more=(HOT, RANKED, "s AS (SELECT hot, count(*) AS n, sum(clicked) AS p FROM k GROUP BY hot)", "r AS (SELECT *, sum(p) OVER (ORDER BY hot DESC) AS tp, sum(n) OVER (ORDER BY hot DESC) AS seen FROM s)")) + "SELECT round(sum(tp::DOUBLE / seen * p) / sum(p), 6) AS ap FROM r")
def a31b(t):
    return evaluation.average_precision(popularity(t), "hot", "clicked").select(F.round("ap", 6).alias("ap"))


@query("a31_log_loss", with_views("impressions", more=(HOT, RANKED)) + "SELECT round(avg(CASE WHEN clicked = 1 THEN -ln(hot / (hot + 100.0)) ELSE -ln(1 - hot / (hot + 100.0)) END), 6) AS log_loss FROM k")
def a31c(t):
    rows = popularity(t).withColumn("p", F.col("hot") / (F.col("hot") + 100.0))
    return evaluation.log_loss(rows, "p", "clicked").select(F.round("log_loss", 6).alias("log_loss"))


GRID = [(k, s) for k in (1, 2, 5) for s in (0, 20, 60)]
_GRID_SQL = "c AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {s})" for k, s in GRID) + ") v(k, floor))"


@query("e9_grid_calibration", with_views("impressions", more=(HOT, RANKED, _GRID_SQL, "x AS (SELECT c.k, c.floor, request_id, sum(clicked) AS p, sum(CASE WHEN rank <= c.k AND hot >= floor THEN clicked ELSE 0 END) AS h, sum(CASE WHEN rank <= c.k AND hot >= floor THEN 1 ELSE 0 END) AS shown FROM impressions_k, c GROUP BY ALL)".replace("impressions_k", "k AS kk"))) +
    "SELECT k::INT AS k, floor::INT AS floor, round(avg(h::DOUBLE / p) FILTER (WHERE p > 0), 6) AS recall, round(avg(shown), 6)::DOUBLE AS shown FROM x GROUP BY ALL")
def e9(t):
    """Every setting of a grid against rankings computed once. The grid is small and broadcast."""
    grid = F.broadcast(t.spark.createDataFrame(GRID, "k int, floor int"))
    rows = popularity(t).select("request_id", "rank", "hot", "clicked").crossJoin(grid)
    inside = (F.col("rank") <= F.col("k")) & (F.col("hot") >= F.col("floor"))
    per = rows.groupBy("k", "floor", "request_id").agg(F.sum("clicked").alias("p"), F.sum(F.when(inside, F.col("clicked")).otherwise(0)).alias("h"), F.count_if(inside).alias("shown"))
    return per.groupBy("k", "floor").agg(F.round(F.avg(F.when(F.col("p") > 0, F.col("h") / F.col("p"))), 6).alias("recall"), F.round(F.avg("shown"), 6).alias("shown"))


@query("a26_eval_slices", with_views("requests", "impressions", more=(HOT, RANKED, PER, METRICS, "z AS (SELECT e.*, CASE WHEN event_ts < 900000000 THEN 'train' ELSE 'test' END AS split, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS slice FROM e JOIN requests USING (request_id))")) +
    "SELECT split, slice, count(*)::BIGINT AS n, round(avg(mrr), 6) AS mrr, round(avg(recall_2), 6) AS recall FROM z GROUP BY GROUPING SETS ((), (split), (slice))")
def a26(t):
    per = evaluation.request_metrics(popularity(t), "request_id", "clicked", (2,)).join(t.requests, "request_id")
    per = per.withColumn("split", F.when(F.col("event_ts") < 900_000_000, "train").otherwise("test")).withColumn("slice", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd"))
    return per.groupingSets([[], ["split"], ["slice"]], "split", "slice").agg(F.count("*").alias("n"), F.round(F.avg("mrr"), 6).alias("mrr"), F.round(F.avg("recall_2"), 6).alias("recall")).select("split", "slice", "n", "mrr", "recall")


@query("e5_paired_bootstrap")
def e5(t):
    """Popularity against the order in which candidates were shown."""
    a = evaluation.request_metrics(popularity(t), "request_id", "clicked", (2,))
    shown = t.impressions.withColumn("rank", F.col("position"))
    b = evaluation.request_metrics(evaluation.ranked(shown.withColumn("s", -F.col("position")), "request_id", "s", "article_id"), "request_id", "clicked", (2,))
    pair = a.join(b.select("request_id", *(F.col(c).alias(f"b_{c}") for c in ("mrr", "recall_2", "ndcg_2"))), "request_id")
    deltas = pair.select("request_id", *((F.col(c) - F.col(f"b_{c}")).alias(c) for c in ("mrr", "recall_2", "ndcg_2")))
    limits = evaluation.paired_bootstrap(deltas, ["mrr", "recall_2", "ndcg_2"])
    return limits.withColumn("direction", F.when(F.col("low") > 0, "increase").when(F.col("high") < 0, "decrease").otherwise("no clear change"))
