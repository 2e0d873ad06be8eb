"""Interest profiles from events: closed form, ordered folds, layers and replay."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presswork.functions import scores

SHORT_HALF_LIFE, LONG_HALF_LIFE, LONG_FACTOR = 21_600, 2_592_000, 0.25
FOLD_DECAY, FOLD_KEEP = 0.92, 10


def signals(events: DataFrame) -> DataFrame:
    """Events that say something about taste, with their strength."""
    rows = events.withColumn("strength", scores.event_strength(F.col("event_type"), F.col("dwell_ms")))
    return rows.where("strength <> 0")


def in_order_profile(events: DataFrame, keys: list[str], time: str = "event_ts") -> DataFrame:
    """Decayed scores per key at the time of its last event, where no event counts as late.

    An event of strength d at time t adds d * 2^(-(T - t) / half-life): a sum, so it needs no order and is
    combined map-side.
    """
    rows = signals(events)
    last = rows.groupBy(*keys).agg(F.max(time).alias("last_event_ts"))
    met = rows.join(last, keys)
    age = F.col("last_event_ts") - F.col(time)
    up, down = F.greatest("strength", F.lit(0.0)), F.greatest(-F.col("strength"), F.lit(0.0))
    part = lambda x, h: F.sum(scores.decayed(x, age, h))
    return met.groupBy(*keys).agg(
        part(up, SHORT_HALF_LIFE).alias("short_positive"), part(down, SHORT_HALF_LIFE).alias("short_negative"),
        (LONG_FACTOR * part(up, LONG_HALF_LIFE)).alias("long_positive"), (LONG_FACTOR * part(down, LONG_HALF_LIFE)).alias("long_negative"),
        F.count_if(F.col("strength") > 0).alias("positive_evidence"), F.count_if(F.col("strength") < 0).alias("negative_evidence"), F.max("last_event_ts").alias("last_event_ts"),
    )


def at_time(state: DataFrame, now: F.Column) -> DataFrame:
    """The state's scores decayed to a time of reading, and the combined score; counts stay."""
    age = now - F.col("last_event_ts")
    out = state
    for name, half_life in (("short", SHORT_HALF_LIFE), ("long", LONG_HALF_LIFE)):
        for sign in ("positive", "negative"):
            out = out.withColumn(f"{name}_{sign}", scores.decayed(F.col(f"{name}_{sign}"), age, half_life))
    net = lambda n: F.col(f"{n}_positive") - F.col(f"{n}_negative")
    return out.withColumn("score", scores.combined_interest(net("short"), net("long")))


def layers(state: DataFrame, user: str, topic: str, score: str = "score", least: float = 0.01, k: int = 10) -> DataFrame:
    """Each user's k strongest interests and k most reduced topics, with the total interest before the cut."""
    total = F.sum(F.greatest(F.col(score), F.lit(0.0))).over(Window.partitionBy(user))
    rows = state.select(user, topic, score, total.alias("positive_total"))
    liked = rows.where(F.col(score) > least).withColumn("layer", F.lit("interest")).withColumn("rank", F.row_number().over(Window.partitionBy(user).orderBy(F.col(score).desc(), topic)))
    less = rows.where(F.col(score) < -least).withColumn("layer", F.lit("reduced")).withColumn("rank", F.row_number().over(Window.partitionBy(user).orderBy(F.col(score), topic)))
    return liked.unionByName(less).where(F.col("rank") <= k)


def late_events(events: DataFrame, keys: list[str], time: str, arrival: str, tie: str = "event_id") -> DataFrame:
    """Adds outcome: out_of_order if an event of its key with a later time has arrived before, no_signal if it says
    nothing, else applied. Equal times are in order; events of equal arrival come in order of `tie`. Events without a signal do not move a key's clock."""
    rows = events.withColumn("strength", scores.event_strength(F.col("event_type"), F.col("dwell_ms")))
    clock = F.max(F.when(F.col("strength") != 0, F.col(time))).over(Window.partitionBy(*keys).orderBy(arrival, tie).rowsBetween(Window.unboundedPreceding, -1))
    outcome = F.when(F.col("strength") == 0, "no_signal").when(clock > F.col(time), "out_of_order").otherwise("applied")
    return rows.withColumn("outcome", outcome)


def replay(events: DataFrame, resets: DataFrame, keys: list[str], user: str = "user_id") -> DataFrame:
    """The profile rebuilt from stored events: those at or after the user's reset (by time, and by id if equal or later)."""
    after = events.join(resets, user, "left")
    kept = after.where(F.col("reset_ts").isNull() | ((F.col("event_ts") >= F.col("reset_ts")) & (F.col("event_id") > F.col("reset_event_id"))))
    ordered = late_events(kept, keys, "event_ts", "event_id").where("outcome = 'applied'")
    return in_order_profile(ordered.drop("strength", "outcome"), keys)


def truncated_fold(events: DataFrame, user: str, topic: str, delta: str, order: list[str]) -> DataFrame:
    """Weights of at most ten topics per user: each event decays all, adds its delta, drops what is not positive,
    rounds to six digits and keeps the ten largest. The cut at each step makes the order matter, so each user's
    events are folded in turn; a user's events are the unit of work, and the state is ten numbers.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        weights: dict[int, float] = {}
        for t, d in zip(*(rows.sort_values(order)[c] for c in (topic, delta)), strict=True):
            weights = {k: w * FOLD_DECAY for k, w in weights.items()}
            weights[t] = weights.get(t, 0.0) + d
            best = sorted(((round(w, 6), k) for k, w in weights.items() if w > 0), key=lambda x: (-x[0], x[1]))[:FOLD_KEEP]
            weights = {k: w for w, k in best}
        return pd.DataFrame({user: rows[user].iloc[:1].repeat(len(weights)).to_numpy(), topic: list(weights), "weight": list(weights.values())})

    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    return events.groupBy(user).applyInPandas(fold, f"{user} {kinds[user]}, {topic} {kinds[topic]}, weight double")


def event_effects(events: DataFrame) -> DataFrame:
    """What each event does to the profile: one row for each topic, with its delta and the event's behaviour points.

    events: event_id, event_type, article_topics and query_topics (arrays). A recommendation click or an upvote moves the
    article's topics by 0.08 and is worth 3; a click on a search result moves the topics of query and article by 0.12,
    those of both by 0.20, and is worth 5; a search moves no topic and is worth 1; other events do nothing and have no
    row. An event without topics has one row with a null topic.
    """
    kind, article, asked = F.col("event_type"), F.coalesce("article_topics", F.array().cast("array<int>")), F.coalesce("query_topics", F.array().cast("array<int>"))
    click = kind.isin("recommendation_click", "upvote")
    found = kind == "search_result_click"
    topics = F.when(click, F.array_distinct(article)).when(found, F.array_union(article, asked)).otherwise(F.array().cast("array<int>"))
    points = F.when(click, 3).when(found, 5).when(kind == "search_query", 1)
    rows = events.withColumn("behaviour", points).where("behaviour is not null").withColumn("_both", F.array_intersect(article, asked)).withColumn("topic_id", F.explode_outer(topics))
    delta = F.when(F.col("topic_id").isNull(), 0.0).when(~found, 0.08).when(F.array_contains("_both", F.col("topic_id")), 0.20).otherwise(0.12)
    return rows.withColumn("delta", delta).drop("_both")


def apply_effects(effects: DataFrame, user: str = "user_id") -> tuple[DataFrame, DataFrame]:
    """(user, topic_id, weight, n) and (user, behaviour): the sums of the deltas and, once an event, of the points."""
    weights = effects.where("topic_id is not null").groupBy(user, "topic_id").agg(F.sum("delta").alias("weight"), F.count("*").alias("n"))
    points = effects.groupBy(user, "event_id").agg(F.first("behaviour").alias("behaviour")).groupBy(user).agg(F.sum("behaviour").alias("behaviour"))
    return weights, points


def outcomes(events: DataFrame, resets: DataFrame, keys: list[str], time: str, arrival: str, user: str = "user_id") -> DataFrame:
    """late_events with one more outcome, pre_reset, for signals from before their user's reset (user, reset_ts); these
    do not make others late."""
    marked = events.join(resets.select(user, "reset_ts"), user, "left")
    before = F.col("reset_ts").isNotNull() & (F.col(time) < F.col("reset_ts")) & (scores.event_strength(F.col("event_type"), F.col("dwell_ms")) != 0)
    old = marked.where(before).drop("reset_ts").withColumn("outcome", F.lit("pre_reset"))
    return late_events(marked.where(~F.coalesce(before, F.lit(False))).drop("reset_ts"), keys, time, arrival).select(*events.columns, "outcome").unionByName(old.select(*events.columns, "outcome"))


def reset(state: DataFrame, resets: DataFrame, seeds: DataFrame, user: str = "user_id") -> DataFrame:
    """State rows (user, topic_id, weight) after the resets: users in it lose their rows and get their seed's."""
    kept = state.select(user, "topic_id", "weight").join(resets, user, "left_anti")
    fresh = resets.join(seeds, "seed_key").select(user, "topic_id", "weight")
    return kept.unionByName(fresh)
