"""The driver's tables under the engine's names, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Requests of one partition, where it is to be bounded: each has some seventy candidates in the feed.
REQUESTS_EACH = 1 << 15
#: Impressions of one partition, where they lie by article or by user.
IMPRESSIONS_EACH = 1 << 18


class Tables:
    """Lazily read tables of a folder, and the views that bind the engine's operators to them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def articles(self) -> DataFrame:
        return self.part.select(F.col("p_partkey").alias("article_id"), F.col("p_name").alias("title"), F.col("p_type").alias("category"), F.col("p_brand").alias("subcategory"))

    @property
    def requests(self) -> DataFrame:
        return self.orders.select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("user_id"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("event_ts"))

    @property
    def impressions(self) -> DataFrame:
        clicked = F.max((F.col("l_returnflag") == "R").cast("int"))
        per = self.lineitem.groupBy(F.col("l_orderkey").alias("request_id"), F.col("l_partkey").alias("article_id")).agg(F.min("l_linenumber").alias("position"), clicked.alias("clicked"))
        return per.join(self.requests, "request_id")

    def dealt_impressions(self) -> DataFrame:
        """The same rows, shuffled once, by request, to partitions of a bounded number of requests: what is counted, joined
        or ranked by request stays in them, and the memory of a task does not grow with the table."""
        n, clicked = self.request_partitions(), F.max((F.col("l_returnflag") == "R").cast("int"))
        rows = self.lineitem.select(F.col("l_orderkey").alias("request_id"), F.col("l_partkey").alias("article_id"), "l_linenumber", "l_returnflag").repartition(n, "request_id")
        per = rows.groupBy("request_id", "article_id").agg(F.min("l_linenumber").alias("position"), clicked.alias("clicked"))
        return per.join(self.requests.repartition(n, "request_id"), "request_id")

    def impression_partitions(self) -> int:
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-self.lineitem.count() // IMPRESSIONS_EACH))

    def request_partitions(self) -> int:
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-self.orders.count() // REQUESTS_EACH))

    @property
    def user_events(self) -> DataFrame:
        kind = F.col("event_type")
        return self.events.select(
            "event_id", "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("event_ts"),
            F.when(kind == "click", "recommendation_click").when(kind == "purchase", "upvote").when(kind == "error", "downvote").when(kind == "view", "dwell").otherwise(kind).alias("event_type"),
            F.when(kind == "view", F.floor(F.col("value") * 1000)).cast("long").alias("dwell_ms"),
            (F.regexp_extract("props", "[0-9]+", 0).cast("int") % 16).alias("topic_id"),
        )


SQL = {
    "articles": "articles AS (SELECT p_partkey AS article_id, p_name AS title, p_type AS category, p_brand AS subcategory FROM part)",
    "requests": "requests AS (SELECT o_orderkey AS request_id, o_custkey AS user_id, (epoch_us(o_orderdate) // 1000000)::BIGINT AS event_ts FROM orders)",
    "impressions": "impressions AS (SELECT request_id, article_id, position, clicked, user_id, event_ts FROM (SELECT l_orderkey AS request_id, l_partkey AS article_id, min(l_linenumber) AS position, "
    "max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::INT AS clicked FROM lineitem GROUP BY ALL) JOIN requests USING (request_id))",
    "user_events": "user_events AS (SELECT event_id, user_id, (epoch_us(ts) // 1000000)::BIGINT AS event_ts, CASE event_type WHEN 'click' THEN 'recommendation_click' WHEN 'purchase' THEN 'upvote' "
    "WHEN 'error' THEN 'downvote' WHEN 'view' THEN 'dwell' ELSE event_type END AS event_type, CASE WHEN event_type = 'view' THEN floor(value * 1000)::BIGINT END AS dwell_ms, "
    "regexp_extract(props, '[0-9]+')::INT % 16 AS topic_id FROM events)",
}


def with_views(*views: str, more: tuple[str, ...] = ()) -> str:
    """A WITH clause of the named views, in the order in which they build on each other, and further ones."""
    needed = set(views) | ({"requests"} if "impressions" in views else set())
    return "WITH " + ",\n".join([SQL[v] for v in SQL if v in needed] + list(more)) + "\n"
