"""Streams run to their end over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from presswork.plans.bindings import Tables, with_views
from presswork.plans.profile_queries import COLUMNS, SIGNALS, closed
from presswork.plans.registry import query
from presswork.plans.relational_queries import p18
from presswork.sources.logs import shared_path
from presswork.streaming import events as ev


def _folder(t) -> str:
    return shared_path(t.spark, "stream")


class _Streamed(Tables):
    """The same views, with events read as a stream."""

    @property
    def events(self):
        schema = self.spark.read.parquet(f"{self.folder}/events.parquet").schema
        return self.spark.readStream.schema(schema).parquet(f"{self.folder}/events.parquet*")


@query("ts1_dedup_conflict", "WITH e AS (SELECT event_id % 4000 AS k, event_type, event_id, first_value(event_type) OVER (PARTITION BY event_id % 4000 ORDER BY event_id) AS first, row_number() OVER (PARTITION BY event_id % 4000 ORDER BY event_id) AS n FROM events) "
    "SELECT k AS event_id, event_id AS arrival, CASE WHEN n = 1 THEN 'first' WHEN event_type = first THEN 'duplicate' ELSE 'conflict' END AS outcome FROM e")
def ts1(t):
    """Events sent again under the same id, some with other content; ids are remembered for a year."""
    stream = _Streamed(t.spark, t.folder).events
    rows = stream.select((F.col("event_id") % 4000).alias("event_id"), F.col("event_id").alias("arrival"), "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return ev.run_to_end(ev.claim_events(rows, ["event_type"], "ts", 365 * 86_400), _folder(t), "append").select("event_id", "arrival", "outcome")


@query("ts3_profile_state", with_views("user_events", more=(SIGNALS, *closed("s"))) + f"SELECT {COLUMNS} FROM st")
def ts3(t):
    """The stateful fold ends where the closed form does."""
    out = ev.latest(ev.run_to_end(ev.profile_state(_Streamed(t.spark, t.folder).user_events), _folder(t), "update"), ["user_id", "topic_id"])
    rounded = (F.round(c, 6).alias(c) for c in ("short_positive", "short_negative", "long_positive", "long_negative"))
    return out.select("user_id", "topic_id", *rounded, "positive_evidence", "negative_evidence", "last_event_ts")


@query("s18_dead_letters", with_views("user_events") + "SELECT event_id % 1000000007 AS event_id, 'event_type' AS error FROM user_events WHERE event_type = 'signup'")
def s18(t):
    broken = p18(t).where("violations <> ''").select("event_id", F.col("violations").alias("v"))
    _, dead = ev.split_valid(t.user_events.join(broken, "event_id", "left").withColumn("v", F.coalesce("v", F.lit(""))), F.col("v"))
    payload = F.decode(F.unbase64("payload"), "utf-8")
    return dead.select((F.get_json_object(payload, "$.event_id").cast("long") % 1000000007).alias("event_id"), "error")


@query("ts_event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def ts_windows(t):
    stream = _Streamed(t.spark, t.folder).events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.lit(0).alias("dwell_ms"))
    out = ev.run_to_end(ev.event_windows(stream), _folder(t), "complete")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("ts16_sliding_windows", "SELECT date_trunc('hour', ts) - k * INTERVAL 15 MINUTE + floor(date_part('minute', ts) / 15) * INTERVAL 15 MINUTE AS start, event_type, count(*)::BIGINT AS n FROM events, range(0, 4) r(k) GROUP BY ALL")
def ts_sliding(t):
    """Hours that begin every fifteen minutes."""
    stream = _Streamed(t.spark, t.folder).events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.lit(0).alias("dwell_ms"))
    out = ev.run_to_end(ev.event_windows(stream, "1 hour", "15 minutes"), _folder(t), "complete")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("ts16_session_windows", "WITH e AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 30 MINUTE, true)::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, count(*)::BIGINT AS n FROM s GROUP BY user_id, k")
def ts_sessions(t):
    """Sessions of half an hour's quiet at most."""
    stream = _Streamed(t.spark, t.folder).events.select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    out = ev.run_to_end(ev.sessions(stream), _folder(t), "complete")
    return out.select("user_id", F.col("window.start").cast("timestamp_ntz").alias("start"), "n")
