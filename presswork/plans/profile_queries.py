"""Profiles from the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from presswork.functions import scores
from presswork.operators import profile
from presswork.plans.bindings import with_views
from presswork.plans.registry import query

STRENGTH = "CASE event_type WHEN 'recommendation_click' THEN 1.0 WHEN 'search_result_click' THEN 1.25 WHEN 'upvote' THEN 2.0 WHEN 'downvote' THEN -2.0 WHEN 'dwell' THEN CASE WHEN dwell_ms >= 120000 THEN 0.75 WHEN dwell_ms >= 30000 THEN 0.5 WHEN dwell_ms >= 10000 THEN 0.25 ELSE 0.0 END ELSE 0.0 END::DOUBLE"
SIGNALS = f"s AS (SELECT *, {STRENGTH} AS d FROM user_events)"
NOW = 1_706_659_200


def closed(source: str) -> tuple[str, ...]:
    part = lambda x, h: f"sum({x} * pow(2.0, -(last_ts - event_ts) / {h}.0))"
    return (
        f"l AS (SELECT *, max(event_ts) OVER (PARTITION BY user_id, topic_id) AS last_ts FROM {source} WHERE d <> 0)",
        f"st AS (SELECT user_id, topic_id, {part('greatest(d, 0)', 21600)} AS sp, {part('greatest(-d, 0)', 21600)} AS sn, 0.25 * {part('greatest(d, 0)', 2592000)} AS lp, 0.25 * {part('greatest(-d, 0)', 2592000)} AS ln_, "
        "count(*) FILTER (WHERE d > 0)::BIGINT AS pe, count(*) FILTER (WHERE d < 0)::BIGINT AS ne, max(last_ts)::BIGINT AS last_ts FROM l GROUP BY ALL)",
    )


COLUMNS = "user_id, topic_id, round(sp, 6) AS short_positive, round(sn, 6) AS short_negative, round(lp, 6) AS long_positive, round(ln_, 6) AS long_negative, pe AS positive_evidence, ne AS negative_evidence, last_ts AS last_event_ts"


def _rounded(state):
    return state.select("user_id", "topic_id", *(F.round(c, 6).alias(c) for c in ("short_positive", "short_negative", "long_positive", "long_negative")), "positive_evidence", "negative_evidence", "last_event_ts")


@query("f14_event_strength", with_views("user_events", more=(SIGNALS,)) + "SELECT event_type, d AS strength, count(*)::BIGINT AS n FROM s GROUP BY ALL")
def f14(t):
    return t.user_events.select("event_type", scores.event_strength(F.col("event_type"), F.col("dwell_ms")).alias("strength")).groupBy("event_type", "strength").agg(F.count("*").alias("n"))


@query("w13_decay_closed_form", with_views("user_events", more=(SIGNALS, *closed("s"))) + f"SELECT {COLUMNS} FROM st")
def w13(t):
    return _rounded(profile.in_order_profile(t.user_events, ["user_id", "topic_id"]))


SCORED = f"sc AS (SELECT *, 0.7 * tanh((sp - sn) * pow(2.0, -greatest({NOW} - last_ts, 0) / 21600.0)) + 0.3 * tanh((lp - ln_) * pow(2.0, -greatest({NOW} - last_ts, 0) / 2592000.0)) AS score FROM st)"


@query("c17_read_time_profile", with_views("user_events", more=(SIGNALS, *closed("s"), SCORED)) + "SELECT user_id, topic_id, round(score, 6) AS score FROM sc WHERE abs(score) > 0.01")
def c17(t):
    state = profile.at_time(profile.in_order_profile(t.user_events, ["user_id", "topic_id"]), F.lit(NOW))
    return state.where(F.abs("score") > 0.01).select("user_id", "topic_id", F.round("score", 6).alias("score"))


@query("w14_profile_layers", with_views("user_events", more=(SIGNALS, *closed("s"), SCORED.replace("AS score FROM", "AS raw FROM"), "r AS (SELECT user_id, topic_id, round(raw, 9) AS score FROM sc)", "z AS (SELECT *, sum(greatest(score, 0)) OVER (PARTITION BY user_id) AS total FROM r)",
    "y AS (SELECT user_id, topic_id, score, total, 'interest' AS layer, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, topic_id) AS rank FROM z WHERE score > 0.01 UNION ALL SELECT user_id, topic_id, score, total, 'reduced', row_number() OVER (PARTITION BY user_id ORDER BY score, topic_id) FROM z WHERE score < -0.01)")) +
    "SELECT user_id, topic_id, layer, rank::INT AS rank, round(score, 6) AS score, round(total, 6) AS positive_total FROM y WHERE rank <= 10")
def w14(t):
    state = profile.at_time(profile.in_order_profile(t.user_events, ["user_id", "topic_id"]), F.lit(NOW)).withColumn("score", F.round("score", 9))
    return profile.layers(state, "user_id", "topic_id").select("user_id", "topic_id", "layer", "rank", F.round("score", 6).alias("score"), F.round("positive_total", 6).alias("positive_total"))


@query("f16_confidence", with_views("user_events", more=(SIGNALS, "c AS (SELECT user_id, count(*) FILTER (WHERE d <> 0) / 20 AS n FROM s GROUP BY user_id)")) + "SELECT user_id, round(1 - exp(-floor(n) / 8.0), 6) AS confidence, CASE WHEN 1 - exp(-floor(n) / 8.0) < 0.25 THEN 'cold' WHEN 1 - exp(-floor(n) / 8.0) < 0.75 THEN 'learning' ELSE 'established' END AS status FROM c")
def f16(t):
    strength = scores.event_strength(F.col("event_type"), F.col("dwell_ms"))
    per = t.user_events.groupBy("user_id").agg(F.floor(F.count_if(strength != 0) / 20).alias("n"))
    conf = scores.confidence(F.col("n"))
    return per.select("user_id", F.round(conf, 6).alias("confidence"), scores.profile_status(conf).alias("status"))


LATE = "a AS (SELECT *, event_id * 7919 % 10007 AS arrival FROM s)"
OUTCOME = "o AS (SELECT *, CASE WHEN d = 0 THEN 'no_signal' WHEN max(CASE WHEN d <> 0 THEN event_ts END) OVER (PARTITION BY user_id, topic_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > event_ts THEN 'out_of_order' ELSE 'applied' END AS outcome FROM a)"


@query("ts4_late_outcomes", with_views("user_events", more=(SIGNALS, LATE, OUTCOME)) + "SELECT event_id, outcome FROM o")
def ts4(t):
    """Events in an arrival order that is not their own: what becomes of each."""
    rows = t.user_events.withColumn("arrival", F.col("event_id") * 7919 % 10007)
    return profile.late_events(rows, ["user_id", "topic_id"], "event_ts", "arrival").select("event_id", "outcome")


RESETS = "rs AS (SELECT user_id, 1705276800 AS reset_ts, max(event_id) FILTER (WHERE event_ts < 1705276800) AS reset_event_id FROM user_events WHERE user_id % 3 = 0 GROUP BY user_id)"


@query("c16_replay_closed_form", with_views("user_events", more=(SIGNALS, RESETS, "k AS (SELECT s.* FROM s LEFT JOIN rs USING (user_id) WHERE reset_ts IS NULL OR (event_ts >= reset_ts AND event_id > reset_event_id))",
    "o AS (SELECT *, CASE WHEN max(CASE WHEN d <> 0 THEN event_ts END) OVER (PARTITION BY user_id, topic_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > event_ts THEN 1 ELSE 0 END AS late FROM k)", "ok AS (SELECT * FROM o WHERE late = 0)", *closed("ok"))) + f"SELECT {COLUMNS} FROM st")
def c16(t):
    before = F.max(F.when(F.col("event_ts") < 1_705_276_800, F.col("event_id")))
    resets = t.user_events.where("user_id % 3 = 0").groupBy("user_id").agg(F.lit(1_705_276_800).alias("reset_ts"), before.alias("reset_event_id"))
    return _rounded(profile.replay(t.user_events, resets, ["user_id", "topic_id"]))


@query("w12_weight_fold")
def w12(t):
    deltas = t.user_events.where("event_type in ('recommendation_click', 'upvote')").withColumn("delta", F.lit(0.08))
    return profile.truncated_fold(deltas, "user_id", "topic_id", "delta", ["event_ts", "event_id"])


@query("f19_query_decay", with_views("user_events") + f"SELECT event_id, round(CASE WHEN {NOW} - event_ts >= 4 * 86400 THEN 0.0 ELSE pow(2.0, -({NOW} - event_ts) / 86400.0) END, 6) AS weight FROM user_events WHERE event_type = 'signup'")
def f19(t):
    age = F.lit(NOW) - F.col("event_ts")
    return t.user_events.where("event_type = 'signup'").select("event_id", F.round(scores.recent_query_multiplier(age, F.lit(None).cast("long"), 86400.0), 6).alias("weight"))


@query("f18_alpha", with_views("user_events") + "SELECT user_id, round(0.1 + n / (n + 30.0) * 0.85, 6)::DOUBLE AS alpha FROM (SELECT user_id, count(*)::DOUBLE AS n FROM user_events GROUP BY user_id)")
def f18(t):
    return t.user_events.groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", F.round(scores.personal_share(F.col("n")), 6).alias("alpha"))


@query("ts7_training_labels", with_views("user_events") + "SELECT event_id, user_id, topic_id, CASE WHEN event_type IN ('recommendation_click', 'upvote') THEN 1 WHEN event_type = 'downvote' THEN 0 END::INT AS label FROM user_events WHERE event_type <> 'dwell'")
def ts7(t):
    label = F.when(F.col("event_type").isin("recommendation_click", "upvote"), 1).when(F.col("event_type") == "downvote", 0)
    return t.user_events.where("event_type <> 'dwell'").select("event_id", "user_id", "topic_id", label.alias("label"))
