"""The contract of user events as they travel: decoding, migration of old versions, checks, encoding.

Works on batch and streaming frames alike; messages have key and value as a broker gives them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an event may be, and which of them are about an article.
EVENT_TYPES = ("search_query", "recommendation_click", "search_result_click", "feed_impression", "detail_view", "dwell", "upvote", "downvote", "share", "outbound_click")
ARTICLE_EVENTS = tuple(t for t in EVENT_TYPES if t != "search_query")
WIRE = (
    "schema_version int, event_id string, event_type string, user_id long, source_space string, article_id string, news_id string, answer_id long, query_key string, query_text string, request_id string, "
    "sponsored_delivery_id string, campaign_id long, creative_id long, surface string, event_ts long, producer_ts long, source string, dwell_ms long"
)
CURRENT = 5
DAY_MS = 86_400_000


def decode(messages: DataFrame) -> DataFrame:
    """Messages (value: binary or string) as event columns, with raw (the text) and malformed (no JSON object)."""
    text = F.decode("value", "utf-8") if dict(messages.dtypes)["value"] == "binary" else F.col("value")
    rows = messages.select(text.alias("raw")).withColumn("e", F.from_json("raw", WIRE + ", _broken string", {"columnNameOfCorruptRecord": "_broken"}))
    return rows.select("raw", (F.col("e._broken").isNotNull() | ~F.coalesce(F.ltrim("raw").startswith("{"), F.lit(False))).alias("malformed"), "e.*").drop("_broken")


def migrate(events: DataFrame) -> DataFrame:
    """Versions 2 to 4 as version 5: they are all about the mind space; 2 and 3 number their articles."""
    version = F.coalesce("schema_version", F.lit(CURRENT))
    numbered = F.when(version == 2, F.col("answer_id")).otherwise(F.col("article_id").try_cast("long"))
    article = F.when(version.isin(2, 3), F.concat(F.lit("N"), numbered)).when(version == 4, F.col("news_id")).otherwise(F.col("article_id"))
    return events.withColumns({
        "article_id": article, "news_id": F.when(version.isin(2, 3), F.lit(None).cast("string")).otherwise(F.col("news_id")),
        "source_space": F.when(version.isin(2, 3, 4), "mind").otherwise(F.col("source_space")), "surface": F.coalesce("surface", F.lit("feed")), "source": F.coalesce("source", F.lit("api")), "schema_version": version,
    }).drop("answer_id")


def violations() -> Column:
    """Names of the rules that a migrated event breaks, joined by commas; empty if it breaks none."""
    kind, space, article = F.col("event_type"), F.col("source_space"), F.col("article_id")
    shape = F.when(space == "live", article.rlike("^L[0-9a-f]{32}$")).otherwise(article.rlike(r"^N\d+$"))
    ads = F.coalesce("sponsored_delivery_id", F.col("campaign_id").cast("string"), F.col("creative_id").cast("string")).isNotNull()
    rules = {
        "schema_version": ~F.col("schema_version").isin(2, 3, 4, 5),
        "event_type": kind.isNull() | ~kind.isin(*EVENT_TYPES),
        "required": F.col("event_id").isNull() | F.col("user_id").isNull() | F.col("event_ts").isNull(),
        "source_space": space.isNull() | ~space.isin("mind", "live"),
        "news_id": F.col("news_id").isNotNull() & ((space == "live") | ~F.col("news_id").eqNullSafe(article)),
        "article_shape": article.isNotNull() & ~shape,
        "article_required": kind.isin(*ARTICLE_EVENTS) & article.isNull(),
        "query_required": kind.isin("search_query", "search_result_click") & (F.coalesce("query_key", F.lit("")) == ""),
        "sponsored_live": (space == "live") & ads,
        "dwell_required": (kind == "dwell") & F.col("dwell_ms").isNull(),
        "dwell_range": F.col("dwell_ms").isNotNull() & ~F.col("dwell_ms").between(0, DAY_MS),
    }
    return F.array_join(F.array_compact(F.array(*(F.when(broken, F.lit(name)) for name, broken in rules.items()))), ",")


def accept(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events that keep the contract, dead letters: payload in base64 and error)."""
    rows = migrate(decode(messages)).withColumn("error", F.when(F.col("malformed"), "malformed").otherwise(violations()))
    good = rows.where("error = ''").drop("raw", "malformed", "error")
    return good, rows.where("error <> ''").select(F.base64(F.encode("raw", "utf-8")).alias("payload"), "error")


def idempotency_key() -> Column:
    """A digest of what an event says, without its times: an event sent twice has the same one."""
    said = ("event_type", "user_id", "source_space", "article_id", "query_key", "query_text", "request_id", "sponsored_delivery_id", "surface", "dwell_ms", "source")
    return F.sha2(F.to_json(F.struct(*said), {"ignoreNullFields": "false"}), 256)


def encode(events: DataFrame) -> DataFrame:
    """Events as messages: keyed by space and user, so that a user's events stay in order."""
    return events.select(F.concat_ws(":", "source_space", "user_id").cast("binary").alias("key"), F.encode(F.to_json(F.struct(*events.columns)), "utf-8").alias("value"))


def training_labels(events: DataFrame) -> DataFrame:
    """What each event says about its article: 1 liked, 0 disliked, null shown; other events are left out."""
    label = F.when(F.col("event_type").isin("recommendation_click", "search_result_click", "upvote"), 1).when(F.col("event_type") == "downvote", 0)
    rows = events.where(F.col("event_type").isin("recommendation_click", "search_result_click", "upvote", "downvote", "feed_impression"))
    return rows.select("event_id", "user_id", "source_space", "article_id", "request_id", "event_ts", label.alias("label"))


def read_broker(spark, servers: str, topic: str, streaming: bool = True) -> DataFrame:
    """The messages of a Kafka topic. Needs Spark's Kafka package on the class path."""
    reader = spark.readStream if streaming else spark.read
    return reader.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load()


def write_broker(messages: DataFrame, servers: str, topic: str, checkpoint: str):
    """Starts a stream of messages into a Kafka topic; at least once, with idempotent producers."""
    out = messages.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
    return out.option("kafka.acks", "all").option("kafka.enable.idempotence", "true").option("checkpointLocation", checkpoint).start()
