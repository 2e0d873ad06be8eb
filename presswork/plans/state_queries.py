"""Profile handlers, resets, guards and the outcomes of events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from presswork.functions import scores
from presswork.operators import profile
from presswork.plans.bindings import with_views
from presswork.plans.profile_queries import LATE, NOW, SIGNALS, closed
from presswork.plans.registry import query

EFFECTS = (
    "ev AS (SELECT event_id, user_id, CASE event_type WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'search_result_click' ELSE 'search_query' END ELSE event_type END AS event_type, [topic_id, (topic_id + 5) % 16] AS ats, CASE WHEN event_id % 4 = 0 THEN [topic_id, (topic_id + 3) % 16] ELSE [(topic_id + 3) % 16] END AS qt FROM user_events)",
    "ef AS (SELECT event_id, user_id, 3 AS behaviour, unnest(ats) AS topic_id, 0.08 AS delta FROM ev WHERE event_type IN ('recommendation_click', 'upvote') "
    "UNION ALL SELECT event_id, user_id, 5, x, CASE WHEN list_contains(ats, x) AND list_contains(qt, x) THEN 0.20 ELSE 0.12 END FROM (SELECT *, unnest(list_distinct(list_concat(ats, qt))) AS x FROM ev WHERE event_type = 'search_result_click') "
    "UNION ALL SELECT event_id, user_id, 1, NULL, 0 FROM ev WHERE event_type = 'search_query')",
)


def handled(t):
    """Sign-ups stand for searches, every other one for a click on a result."""
    kind, topic = F.col("event_type"), F.col("topic_id")
    events = t.user_events.withColumn("event_type", F.when(kind != "signup", kind).when(F.col("event_id") % 2 == 0, "search_result_click").otherwise("search_query"))
    asked = F.when(F.col("event_id") % 4 == 0, F.array(topic, (topic + 3) % 16)).otherwise(F.array((topic + 3) % 16))
    return profile.event_effects(events.withColumns({"article_topics": F.array(topic, (topic + 5) % 16), "query_topics": asked}).drop("topic_id"))


@query("k28_event_handlers", with_views("user_events", more=EFFECTS) + "SELECT user_id, topic_id::INT AS topic_id, round(sum(delta), 6)::DOUBLE AS weight, count(*)::BIGINT AS n FROM ef WHERE topic_id IS NOT NULL GROUP BY ALL")
def k28(t):
    weights, _ = profile.apply_effects(handled(t))
    return weights.select("user_id", "topic_id", F.round("weight", 6).alias("weight"), "n")


@query("k28_behaviour_points", with_views("user_events", more=EFFECTS) + "SELECT user_id, sum(b)::BIGINT AS behaviour FROM (SELECT user_id, event_id, max(behaviour) AS b FROM ef GROUP BY ALL) GROUP BY user_id")
def k28_points(t):
    return profile.apply_effects(handled(t))[1]


@query("k29_twin_state", with_views("user_events", more=EFFECTS) + "SELECT (SELECT count(*) FROM (SELECT DISTINCT user_id, topic_id FROM ef WHERE topic_id IS NOT NULL))::BIGINT AS rows, 0::BIGINT AS different")
def k29(t):
    """Events taken at once and in two batches, whose states are added, give the same state: rows, and those that differ."""
    whole = profile.apply_effects(handled(t))[0]
    parts = [profile.apply_effects(handled(t).where(F.col("event_id") % 3 == 0 if k else F.col("event_id") % 3 != 0))[0] for k in (0, 1)]
    added = parts[0].unionByName(parts[1]).groupBy("user_id", "topic_id").agg(F.sum("weight").alias("weight_b"), F.sum("n").alias("n_b"))
    both = whole.join(added, ["user_id", "topic_id"], "full")
    same = (F.abs(F.col("weight") - F.col("weight_b")) < 1e-9) & (F.col("n") == F.col("n_b"))
    return both.agg(F.count("*").alias("rows"), F.count_if(~F.coalesce(same, F.lit(False))).alias("different"))


PARTS = (("short_positive", "sp", 21600), ("short_negative", "sn", 21600), ("long_positive", "lp", 2592000), ("long_negative", "ln_", 2592000))


@query("k30_read_time_decay", with_views("user_events", more=(SIGNALS, *closed("s"))) + "SELECT user_id, topic_id, " + ", ".join(f"round({b} * pow(2.0, -greatest({NOW} - last_ts, 0) / {h}.0), 6) AS {a}" for a, b, h in PARTS) + ", pe AS positive_evidence, ne AS negative_evidence FROM st")
def k30(t):
    """The four components at reading time; evidence stays as it is."""
    state = profile.in_order_profile(t.user_events, ["user_id", "topic_id"])
    age = F.lit(NOW) - F.col("last_event_ts")
    return state.select("user_id", "topic_id", *(F.round(scores.decayed(F.col(a), age, h), 6).alias(a) for a, _, h in PARTS), "positive_evidence", "negative_evidence")


@query("k31_state_names", with_views("user_events", more=(SIGNALS, *closed("s"))) + "SELECT user_id, topic_id, n_name AS display_name, pe AS positive_evidence FROM st JOIN nation ON n_nationkey = topic_id WHERE n_regionkey = 1")
def k31(t):
    """The state's topics by name, those of one space only."""
    names = t.nation.where("n_regionkey = 1").select(F.col("n_nationkey").alias("topic_id"), F.col("n_name").alias("display_name"))
    return profile.in_order_profile(t.user_events, ["user_id", "topic_id"]).join(names, "topic_id").select("user_id", "topic_id", "display_name", "positive_evidence")


@query("k33_gated_recall", with_views("user_events") + "SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'legacy' WHEN 1 THEN 'decay' ELSE 'gated' END AS mode, user_id % 3 <> 2 OR event_id % 4 = 0 AS opens FROM user_events WHERE event_type = 'signup'")
def k33(t):
    """Whether a recent query may open recall: in gated mode only a confirmed one."""
    mode = F.when(F.col("user_id") % 3 == 0, "legacy").when(F.col("user_id") % 3 == 1, "decay").otherwise("gated")
    confirmed = F.when(F.col("event_id") % 4 == 0, F.col("event_ts"))
    return t.user_events.where("event_type = 'signup'").select("event_id", mode.alias("mode"), ((mode != "gated") | confirmed.isNotNull()).alias("opens"))


def space_problem(space, article_id):
    """Why an article's id can't be written in a space: each has a shape of its own."""
    fits = F.when(space == "mind", article_id.rlike("^N[0-9]+$")).when(space == "live", article_id.rlike("^L[0-9a-f]{32}$")).otherwise(False)
    return F.when(article_id.isNull(), "missing_article").when(~fits, "other_space")


@query("k34_space_guard", with_views("user_events") + "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'missing_article' WHEN (event_id % 3 = 0) <> (event_id % 5 = 0) THEN 'other_space' END AS problem FROM user_events")
def k34(t):
    key = F.col("event_id")
    article = F.when(key % 10 == 0, F.lit(None).cast("string")).when(key % 5 == 0, F.concat(F.lit("L"), F.md5(key.cast("string")))).otherwise(F.concat(F.lit("N"), key))
    space = F.when(key % 3 == 0, "live").otherwise("mind")
    return t.user_events.select("event_id", space_problem(space, article).alias("problem"))


@query("k11_topic_state_upsert", with_views("user_events", more=("o AS (SELECT user_id, topic_id, count(*) AS n FROM user_events WHERE event_id % 2 = 0 GROUP BY ALL)", "w AS (SELECT user_id, topic_id, count(*) AS n FROM user_events WHERE event_id % 2 = 1 GROUP BY ALL)",
    "ok AS (SELECT w.* FROM w JOIN nation ON n_nationkey = topic_id AND n_regionkey < 3)")) + "SELECT user_id, topic_id, coalesce(ok.n, o.n)::BIGINT AS n FROM o FULL JOIN ok USING (user_id, topic_id)")
def k11(t):
    """New state replaces old of the same key; rows whose topic belongs to another space are not written."""
    state = lambda r: t.user_events.where(F.col("event_id") % 2 == r).groupBy("user_id", "topic_id").agg(F.count("*").alias("n"))
    own = t.nation.where("n_regionkey < 3").select(F.col("n_nationkey").alias("topic_id"))
    fresh = state(1).join(own, "topic_id", "left_semi").withColumnRenamed("n", "fresh")
    return state(0).join(fresh, ["user_id", "topic_id"], "full").select("user_id", "topic_id", F.coalesce("fresh", "n").alias("n"))


SEEDS = "sd AS (SELECT r_name AS seed_key, n_nationkey AS topic_id, 0.1 + n_nationkey / 100.0 AS weight FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_nationkey < 16)"


def seeds(t):
    rows = t.region.join(t.nation, F.col("n_regionkey") == F.col("r_regionkey")).where("n_nationkey < 16")
    return rows.select(F.col("r_name").alias("seed_key"), F.col("n_nationkey").alias("topic_id"), (0.1 + F.col("n_nationkey") / 100.0).alias("weight"))


@query("k12_cold_start", with_views("user_events", more=(SEEDS,)) + "SELECT c_custkey AS user_id, topic_id, round(weight, 6)::DOUBLE AS weight FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey JOIN sd ON seed_key = r_name WHERE c_custkey NOT IN (SELECT user_id FROM user_events)")
def k12(t):
    """Users without an event start from the seed of their region."""
    home = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    strangers = home.select(F.col("c_custkey").alias("user_id"), F.col("r_name").alias("seed_key")).join(t.user_events.select("user_id"), "user_id", "left_anti")
    return strangers.join(seeds(t), "seed_key").select("user_id", "topic_id", F.round("weight", 6).alias("weight"))


@query("c15_profile_reset", with_views("user_events", more=(SEEDS, "b AS (SELECT user_id, topic_id, count(*)::DOUBLE AS weight FROM user_events GROUP BY ALL)", "rs AS (SELECT user_id, CASE user_id % 2 WHEN 0 THEN 'ASIA' ELSE 'EUROPE' END AS seed_key, max(event_id) AS last FROM user_events WHERE user_id % 4 = 1 OR user_id % 4 = 2 GROUP BY user_id)")) +
    "SELECT user_id, topic_id, round(weight, 6)::DOUBLE AS weight, NULL::BIGINT AS reset_before_event_id FROM b WHERE user_id NOT IN (SELECT user_id FROM rs) UNION ALL SELECT user_id, topic_id, round(weight, 6), last FROM rs JOIN sd USING (seed_key)")
def c15(t):
    """Half of the users are reset to a seed; the boundary is their last event."""
    state = t.user_events.groupBy("user_id", "topic_id").agg(F.count("*").cast("double").alias("weight"))
    resets = t.user_events.where("user_id % 4 in (1, 2)").groupBy("user_id").agg(F.max("event_id").alias("reset_before_event_id")).withColumn("seed_key", F.when(F.col("user_id") % 2 == 0, "ASIA").otherwise("EUROPE"))
    out = profile.reset(state, resets, seeds(t)).join(resets.select("user_id", "reset_before_event_id"), "user_id", "left")
    return out.select("user_id", "topic_id", F.round("weight", 6).alias("weight"), "reset_before_event_id")


ROUTE = {"recommendation_click": "article", "upvote": "article", "downvote": "article", "dwell": "article", "search_query": "query", "search_result_click": "query"}


@query("ts2_event_router", with_views("user_events") + "SELECT CASE WHEN event_type IN ('recommendation_click', 'upvote', 'downvote', 'dwell') THEN 'article' ELSE 'log_only' END AS handler, event_type, count(*)::BIGINT AS n FROM user_events GROUP BY ALL")
def ts2(t):
    """Which handler takes an event; types that none takes are logged only."""
    handler = F.lit("log_only")
    for kind, name in ROUTE.items():
        handler = F.when(F.col("event_type") == kind, name).otherwise(handler)
    return t.user_events.groupBy(handler.alias("handler"), "event_type").agg(F.count("*").alias("n"))


RESET = "rs AS (SELECT DISTINCT user_id, 1705276800 AS reset_ts FROM user_events WHERE user_id % 3 = 0)"


def resets(t):
    return t.user_events.where("user_id % 3 = 0").select("user_id").distinct().withColumn("reset_ts", F.lit(1_705_276_800))


@query("ts5_pre_reset_drop", with_views("user_events", more=(RESET,)) + "SELECT user_id, count(*)::BIGINT AS n FROM user_events LEFT JOIN rs USING (user_id) WHERE reset_ts IS NULL OR event_ts >= reset_ts GROUP BY user_id")
def ts5(t):
    """Events of each user that are left when those from before the reset are dropped."""
    rows = t.user_events.join(resets(t), "user_id", "left").where("reset_ts is null or event_ts >= reset_ts")
    return rows.groupBy("user_id").agg(F.count("*").alias("n"))


@query("ts6_outcomes", with_views("user_events", more=(SIGNALS, RESET, LATE, "pr AS (SELECT a.*, coalesce(d <> 0 AND event_ts < reset_ts, false) AS old FROM a LEFT JOIN rs USING (user_id))",
    "oc AS (SELECT *, CASE WHEN old THEN 'pre_reset' WHEN d = 0 THEN 'no_signal' WHEN max(CASE WHEN d <> 0 AND NOT old THEN event_ts END) OVER (PARTITION BY user_id, topic_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > event_ts THEN 'out_of_order' ELSE 'applied' END AS outcome FROM pr)")) + "SELECT user_id, outcome, count(*)::BIGINT AS n FROM oc GROUP BY ALL")
def ts6(t):
    rows = t.user_events.withColumn("arrival", F.col("event_id") * 7919 % 10007)
    return profile.outcomes(rows, resets(t), ["user_id", "topic_id"], "event_ts", "arrival").groupBy("user_id", "outcome").agg(F.count("*").alias("n"))


@query("k60_replay_topics", with_views("user_events") + "SELECT event_id, CASE WHEN event_type = 'signup' OR event_id % 5 = 0 OR event_id % 7 = 0 THEN (topic_id + 1) % 16 ELSE topic_id END::INT AS topic_id FROM user_events")
def k60(t):
    """Replay takes the topics stored with an event, except for searches, for the live space and where none were stored."""
    key, now = F.col("event_id"), (F.col("topic_id") + 1) % 16
    stored = F.when(key % 7 != 0, F.col("topic_id"))
    use = (key % 5 != 0) & (F.col("event_type") != "signup")
    return t.user_events.select("event_id", F.coalesce(F.when(use, stored), now).alias("topic_id"))


@query("k59_rebuild_targets", with_views("user_events", more=(RESET,)) + "SELECT user_id, coalesce(reset_ts, 0)::BIGINT AS since, count(*)::BIGINT AS events FROM user_events LEFT JOIN rs USING (user_id) WHERE event_type <> 'signup' AND event_ts >= coalesce(reset_ts, 0) GROUP BY ALL")
def k59(t):
    """The users to rebuild, from when, and how many events that takes."""
    rows = t.user_events.where("event_type <> 'signup'").join(resets(t), "user_id", "left").withColumn("since", F.coalesce(F.col("reset_ts").cast("long"), F.lit(0)))
    return rows.where("event_ts >= since").groupBy("user_id", "since").agg(F.count("*").alias("events"))


RECENT = "re AS (SELECT user_id, event_id, event_ts, CASE event_id % 4 WHEN 0 THEN 'N' || topic_id WHEN 1 THEN topic_id::VARCHAR WHEN 2 THEN 'X' || topic_id END AS raw FROM user_events WHERE event_type = 'recommendation_click')"


def repaired_id(raw):
    """A bare number gets its N; ids of another shape are null."""
    full = F.when(raw.rlike("^[0-9]+$"), F.concat(F.lit("N"), raw)).otherwise(raw)
    return F.when(full.rlike("^N[0-9]+$"), full)


def recents(t):
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.concat(F.lit("N"), "topic_id")).when(k == 1, F.col("topic_id").cast("string")).when(k == 2, F.concat(F.lit("X"), "topic_id"))
    return t.user_events.where("event_type = 'recommendation_click'").select("user_id", "event_id", "event_ts", raw.alias("raw"))


@query("k8_id_repair", with_views("user_events", more=(RECENT,)) + "SELECT event_id, CASE WHEN starts_with(raw, 'N') THEN raw ELSE 'N' || raw END AS news_id FROM re WHERE raw IS NOT NULL AND NOT starts_with(raw, 'X')")
def k8(t):
    """Legacy ids of recent clicks; members of a bad shape are left out."""
    return recents(t).select("event_id", repaired_id(F.col("raw")).alias("news_id")).where("news_id is not null")


@query("k6_recent_titles", with_views("user_events", more=(RECENT,)) + "SELECT user_id, rank::INT AS rank, coalesce(n_name, '(untitled)') AS title FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_ts DESC, event_id DESC) AS rank FROM re WHERE raw IS NOT NULL AND NOT starts_with(raw, 'X')) LEFT JOIN nation ON n_nationkey = regexp_extract(raw, '[0-9]+')::INT AND n_nationkey % 3 <> 0 WHERE rank <= 5")
def k6(t):
    """The latest five clicks with their titles; a fallback where there is none."""
    rows = recents(t).withColumn("news_id", repaired_id(F.col("raw"))).where("news_id is not null")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("event_ts").desc(), F.col("event_id").desc()))
    rows = rows.withColumn("rank", place).where("rank <= 5").withColumn("number", F.substring("news_id", 2, 20).cast("int"))
    titles = t.nation.where("n_nationkey % 3 <> 0").select(F.col("n_nationkey").alias("number"), F.col("n_name").alias("title"))
    return rows.join(titles, "number", "left").select("user_id", "rank", F.coalesce("title", F.lit("(untitled)")).alias("title"))


@query("k7_json_weights", with_views("user_events") + "SELECT user_id, sum(topic_id)::BIGINT AS topics, count(*)::BIGINT AS n FROM user_events WHERE event_id % 5 <> 0 GROUP BY user_id")
def k7(t):
    """Weights from JSON text: members that are no objects or lack a whole topic id are skipped."""
    member = F.when(F.col("event_id") % 5 == 0, F.lit('{"topic_id": "x"}')).otherwise(F.concat(F.lit('{"topic_id": '), "topic_id", F.lit(', "weight": 0.5}')))
    raw = t.user_events.groupBy("user_id").agg(F.concat(F.lit("["), F.array_join(F.collect_list(member), ","), F.lit("]")).alias("raw"))
    rows = raw.select("user_id", F.explode(F.from_json("raw", "array<struct<topic_id:string,weight:double>>")).alias("w")).select("user_id", F.col("w.topic_id").try_cast("long").alias("topic_id"))
    return rows.where("topic_id is not null").groupBy("user_id").agg(F.sum("topic_id").alias("topics"), F.count("*").alias("n"))


@query("f20_query_topic_scores", with_views("user_events") + f"SELECT user_id, s_nationkey AS topic_id, round(max(s_acctbal / 10000 * pow(2.0, -({NOW} - event_ts) / 86400.0)), 9) AS score FROM user_events JOIN supplier ON s_suppkey % 16 = topic_id WHERE event_type = 'signup' AND {NOW} - event_ts < 4 * 86400 GROUP BY ALL")
def f20(t):
    """For each topic of a user's recent queries the largest score times the query's weight."""
    age = F.lit(NOW) - F.col("event_ts")
    recent = t.user_events.where("event_type = 'signup'").withColumn("weight", scores.recent_query_multiplier(age, F.lit(None).cast("long"), 86_400.0)).where("weight > 0")
    mapped = t.supplier.select((F.col("s_suppkey") % 16).cast("int").alias("topic_id"), F.col("s_nationkey").alias("to_topic"), (F.col("s_acctbal") / 10000).alias("score"))
    # weights of a user's queries for one topic are reduced before they meet that topic's map
    recent = recent.groupBy("user_id", "topic_id").agg(F.max("weight").alias("high"), F.min("weight").alias("low"))
    best = F.max(F.greatest(F.col("score") * F.col("high"), F.col("score") * F.col("low")))
    return recent.join(mapped, "topic_id").groupBy("user_id", F.col("to_topic").alias("topic_id")).agg(F.round(best, 9).alias("score"))


@query("k10_event_log", with_views("user_events") + "SELECT event_type, CASE WHEN dwell_ms IS NOT NULL THEN 'measured' WHEN event_type IN ('upvote', 'downvote') THEN 'explicit' ELSE 'implicit' END AS confidence, count(*)::BIGINT AS n, max(event_id)::BIGINT AS last FROM user_events GROUP BY ALL")
def k10(t):
    """Events appended to a log by type, tagged with how sure they are; read back and counted."""
    from presswork.sources.logs import append_events

    tagged = t.user_events.withColumn("confidence", F.when(F.col("dwell_ms").isNotNull(), "measured").when(F.col("event_type").isin("upvote", "downvote"), "explicit").otherwise("implicit"))
    log = append_events(tagged, "event_type")
    return log.groupBy("event_type", "confidence").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


@query("a30_article_users", with_views("impressions") + "SELECT article_id, count(DISTINCT user_id)::BIGINT AS users FROM impressions WHERE clicked = 1 GROUP BY article_id")
def a30(t):
    """How many users an article has."""
    return t.impressions.where("clicked = 1").groupBy("article_id").agg(F.count_distinct("user_id").alias("users"))


@query("k16_job_failures", with_views("impressions") + "SELECT article_id, CASE WHEN n >= 5 THEN 'failed' ELSE 'pending' END AS status, CASE WHEN n >= 5 THEN users ELSE 0 END::BIGINT AS rebuilds FROM (SELECT article_id, count(*) FILTER (WHERE clicked = 0) AS n, count(DISTINCT user_id) AS users FROM impressions GROUP BY 1)")
def k16(t):
    """A topic job that failed five times is given up, and the profiles of the article's users are rebuilt."""
    per = t.impressions.groupBy("article_id").agg(F.count_if(F.col("clicked") == 0).alias("attempts"), F.count_distinct("user_id").alias("users"))
    failed = F.col("attempts") >= 5
    return per.select("article_id", F.when(failed, "failed").otherwise("pending").alias("status"), F.when(failed, F.col("users")).otherwise(0).alias("rebuilds"))
