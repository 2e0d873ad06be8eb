"""Scoring formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def six_digits(x: Column) -> Column:
    """Rounded to six digits; what lies within a ten-millionth of a half of the last one goes up, so that the noise of
    the last bits does not decide."""
    return F.floor(x * 1e6 + 0.5000001) / 1e6


def to_millionths(x: Column) -> Column:
    """Rounded to six digits by the double's own millionths, not by its shortest decimal form: a half goes up only if
    the product is one."""
    return F.round(x * 1e6) / 1e6


def hot_score(clicks: Column, impressions: Column) -> Column:
    """Clicks count ten times an impression (serving and training features)."""
    return clicks * 10 + impressions


def catalog_hot_score(clicks: Column, impressions: Column) -> Column:
    """ln(1 + clicks) plus the click-through rate; without impressions the rate is 0."""
    return F.log1p(clicks) + F.coalesce(F.try_divide(clicks.cast("double"), impressions.cast("double")), F.lit(0.0))


def base_score(hot: Column) -> Column:
    return F.when(hot > 0, hot / (hot + 100.0)).otherwise(0.0)


def personal_share(strength: Column) -> Column:
    """How far the personal profile outweighs the default one: 0.1 for a stranger, towards 0.95."""
    s = F.greatest(strength.cast("double"), F.lit(0.0))
    return 0.1 + s / (s + 30.0) * 0.85


def decayed(score: Column, elapsed: Column, half_life: float) -> Column:
    return score * F.pow(F.lit(2.0), -F.greatest(elapsed, F.lit(0)) / F.lit(float(half_life)))


def dwell_strength(dwell_ms: Column) -> Column:
    return F.when(dwell_ms >= 120_000, 0.75).when(dwell_ms >= 30_000, 0.5).when(dwell_ms >= 10_000, 0.25).otherwise(0.0)


def event_strength(event_type: Column, dwell_ms: Column) -> Column:
    """Signal of an event; 0 for those that say nothing about taste."""
    fixed = {"recommendation_click": 1.0, "search_result_click": 1.25, "upvote": 2.0, "downvote": -2.0}
    out = F.when(event_type == "dwell", dwell_strength(dwell_ms))
    for kind, strength in fixed.items():
        out = out.when(event_type == kind, strength)
    return out.otherwise(0.0)


def confidence(evidence: Column) -> Column:
    return 1 - F.exp(-evidence / F.lit(8.0))


def profile_status(conf: Column) -> Column:
    return F.when(conf < 0.25, "cold").when(conf < 0.75, "learning").otherwise("established")


def combined_interest(short_net: Column, long_net: Column) -> Column:
    return 0.7 * F.tanh(short_net) + 0.3 * F.tanh(long_net)


def freshness(age_seconds: Column) -> Column:
    """Halves each day."""
    return F.exp(-F.log(F.lit(2.0)) * F.greatest(age_seconds, F.lit(0)) / 86400.0)


def completeness(summary: Column, image: Column, publisher: Column, domain: Column) -> Column:
    full = lambda c: (F.coalesce(F.trim(c), F.lit("")) != "").cast("double")
    return 0.5 * full(summary) + 0.3 * full(image) + 0.2 * (~publisher.eqNullSafe(domain)).cast("double")


def live_score(fresh: Column, quality: Column, complete: Column) -> Column:
    return 0.65 * fresh + 0.20 * quality + 0.15 * complete


def recent_query_multiplier(age: Column, confirmed_age: Column, half_life: float) -> Column:
    """Decay of a recent query from its time, or doubled from its confirmation; nothing after four half-lives."""
    since = F.coalesce(confirmed_age, age)
    weight = F.when(confirmed_age.isNotNull(), 2.0).otherwise(1.0)
    return F.when(since >= 4 * half_life, 0.0).otherwise(weight * decayed(F.lit(1.0), since, half_life))


def als_boost(raw: Column) -> Column:
    return 0.15 / (1 + F.exp(-F.least(F.lit(20.0), F.greatest(F.lit(-20.0), raw))))


def expected_spend(bid_micros: Column, ctr: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(bid_micros * ctr)).cast("long")


def pacing_limit(spend: Column, budget: Column, second_of_day: Column, headroom: float = 3600.0) -> Column:
    """What may have been spent by now if a day's budget is paced evenly, with some headroom."""
    share = F.least(F.lit(1.0), (second_of_day + headroom) / 86400.0)
    return F.greatest(spend, F.bround(budget * share)).cast("long")


def retry_delay(attempts: Column) -> Column:
    return F.least(F.lit(300.0), F.pow(F.lit(2.0), F.least(attempts, F.lit(8)))).cast("long")


def live_search_score(title: Column, summary: Column, publisher: Column, asked: Column, fresh: Column) -> Column:
    """0.8 of the tier in which the text is found (title as a whole 1, in the title 0.7, summary 0.5, publisher 0.4)
    and 0.2 of the freshness; null where it is found nowhere."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    tier = F.when(low(title) == F.lower(asked), 1.0).when(F.contains(low(title), F.lower(asked)), 0.7).when(F.contains(low(summary), F.lower(asked)), 0.5).when(F.contains(low(publisher), F.lower(asked)), 0.4)
    return F.round(0.8 * tier + 0.2 * fresh, 8)


def sponsored_score(bid: Column, ctr: Column, quality: Column) -> Column:
    return bid * ctr * quality


def content_retry(attempts: Column, jitter: Column, retry_after: Column) -> Column:
    """Seconds until a document is fetched again: doubling from 30 to 1,800 with up to a fifth of jitter (0 to 1), unless
    the server names a time, of which an hour counts at most."""
    wait = F.least(F.lit(1800.0), 30.0 * F.pow(F.lit(2.0), attempts - 1))
    return F.when(retry_after.isNotNull(), F.least(retry_after.cast("double"), F.lit(3600.0))).otherwise(wait * (1 + 0.2 * jitter))
