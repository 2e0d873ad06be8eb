"""Operators that depend on an order: point-in-time counts, splits, islands, top-k, sampling, slots and paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prior_counts(impressions: DataFrame, key: str, order: list[str], clicked: str = "clicked", first: str | None = None) -> DataFrame:
    """Impressions and clicks of the key strictly before each row in the given order, as prior_impressions, prior_clicks;
    under the name `first`, if there is one, the key's first time.

    Rows are first counted per (key, first order column), so the running sum of a popular key runs over its
    distinct times, and only rows of the same time are ordered among themselves.
    """
    time, *rest = order
    per_time = impressions.groupBy(key, time).agg(F.count("*").alias("_n"), F.sum(clicked).alias("_c"))
    before = Window.partitionBy(key).orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    earlier = per_time.select(key, time, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_c0"), *([F.min(time).over(Window.partitionBy(key)).alias(first)] if first else []))
    same = Window.partitionBy(key, time).orderBy(*rest).rowsBetween(Window.unboundedPreceding, -1)
    out = impressions.join(earlier, [key, time])
    out = out.withColumn("prior_impressions", F.col("_n0") + F.count("*").over(same))
    return out.withColumn("prior_clicks", (F.col("_c0") + F.coalesce(F.sum(clicked).over(same), F.lit(0))).cast("long")).drop("_n0", "_c0")


def chronological_cutoff(requests: DataFrame, ratio: float, time: str = "event_ts") -> int | None:
    """Time of the request at position clamp(round(n * ratio), 1, n - 1): earlier ones train, the others test.

    Found from the counts per distinct time, not by sorting the requests in one place.
    """
    n = requests.count()
    if n < 2:
        return None
    place = min(max(round(n * ratio), 1), n - 1)
    times = running_before(requests.groupBy(time).agg(F.count("*").alias("n")), time, ["n"])
    return times.where(F.col("before_n") + F.col("n") > place).agg(F.min(time)).first()[0]


def islands(rows: DataFrame, partition: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of neighbouring rows with the same value: adds island, their number within the partition from 1."""
    w = Window.partitionBy(*partition).orderBy(*order)
    changed = (~F.col(value).eqNullSafe(F.lag(value).over(w))) | (F.row_number().over(w) == 1)
    return rows.withColumn("island", F.sum(changed.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


def top_per_group(rows: DataFrame, group: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group in the order, numbered from 1."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def hashed_sample(rows: DataFrame, id_col: str, seed: str, n: int) -> DataFrame:
    """n rows in an order that the seed fixes."""
    return rows.orderBy(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(seed))), id_col).limit(n)


def blend_slots(organic: DataFrame, sponsored: DataFrame, request: str, page_size: int) -> DataFrame:
    """Pages of items with the sponsored ones at their slots and the organic ones, in rank order, at the others.

    organic: request, item, rank (from 1, no gaps). sponsored: request, item, slot; of several at a slot the smallest.
    Returns request, position, item, is_sponsored. A page ends where no organic item is left. Requests are joined as one
    row each, so rows that are dealt by request already are not shuffled.
    """
    first = organic.where(F.col("rank").between(1, page_size) & F.col("item").isNotNull()).groupBy(request).agg(F.array_sort(F.collect_list(F.struct("rank", "item"))).alias("_organic"))
    taken = sponsored.where(F.col("slot").between(1, page_size) & F.col("item").isNotNull()).groupBy(request).agg(F.array_sort(F.collect_list(F.struct("slot", "item"))).alias("_ads"))
    empty = lambda c, df: F.coalesce(c, F.array().cast(df.schema[c].dataType)).alias(c)
    pages = first.join(taken, request, "full").select(request, empty("_organic", first), empty("_ads", taken))
    slots, left = F.array_distinct(F.col("_ads.slot")), F.size(F.filter("_organic", lambda x, i: x["rank"] == i + 1))
    place = lambda p, free: F.struct(p.alias("position"), free.alias("free"), F.get(F.filter("_ads", lambda a: a["slot"] == p), F.lit(0))["item"].alias("ad"))
    places = F.transform(F.sequence(F.lit(1), F.lit(page_size)), lambda p: place(p, p - F.size(F.filter(slots, lambda s: s <= p))))
    filled = pages.select(request, "_organic", F.explode(F.filter(places, lambda x: x["free"] <= left)).alias("x"))
    item = F.coalesce("x.ad", F.get(F.col("_organic"), F.col("x.free") - 1)["item"])
    return filled.select(request, "x.position", item.alias("item"), F.col("x.ad").isNotNull().alias("is_sponsored"))


def latest_k(rows: DataFrame, user: str, time: str, key: str, k: int, distinct: bool, tie: str) -> DataFrame:
    """The newest k rows of each user, newest first as rank 1; with distinct, only the newest of each key counts."""
    if distinct:
        newest = Window.partitionBy(user, key).orderBy(F.col(time).desc(), F.col(tie).desc())
        rows = rows.withColumn("_k", F.row_number().over(newest)).where("_k = 1").drop("_k")
    return top_per_group(rows, [user], [F.col(time).desc(), F.col(tie).desc()], k)


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, right_time: str, values: list[str]) -> DataFrame:
    """Adds to each left row the values of the latest right row of its keys whose time is not later.

    Both sides are merged into one ordered stream per key, so nothing is multiplied. Ties on the right go to the
    row whose values are largest.
    """
    names = [c for c in left.columns if c not in keys]
    l = left.select(*keys, F.col(time).alias("_t"), F.lit(1).alias("_side"), F.struct(*names).alias("_left"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_right"))  # noqa: E741
    r = right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(l.schema["_left"].dataType).alias("_left"), F.struct(*values).alias("_right"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side", "_right").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r).withColumn("_match", F.last("_right", ignorenulls=True).over(w))
    return both.where("_side = 1").select(*keys, "_left.*", *(F.col(f"_match.{v}").alias(v) for v in values))



def running_before(rows: DataFrame, by: str, values: list[str], descending: bool = False, buckets: int = 512) -> DataFrame:
    """Adds before_<value>: the sum of the value over all rows that come before in order of the number `by`, of which
    each occurs once.

    Rows are cut into buckets at approximate quantiles; the buckets' sums are added up (there are few), then each
    bucket on its own, so no task sees all rows.
    """
    edges = sorted(set(rows.approxQuantile(by, [k / buckets for k in range(1, buckets)], 1 / (4 * buckets))))
    bucket = F.size(F.filter(F.array(*(F.lit(e) for e in edges)) if edges else F.array().cast("array<double>"), lambda e: e <= F.col(by)))
    way = -1 if descending else 1
    placed = rows.withColumn("_bucket", way * bucket)
    sums = placed.groupBy("_bucket").agg(*(F.sum(v).alias(f"_sum_{v}") for v in values))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_bucket", *(F.coalesce(F.sum(f"_sum_{v}").over(earlier), F.lit(0)).alias(f"_base_{v}") for v in values))
    order = F.col(by).desc() if descending else F.col(by).asc()
    inside = Window.partitionBy("_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(F.broadcast(sums), "_bucket")
    added = {f"before_{v}": F.col(f"_base_{v}") + F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values}
    return out.withColumns(added).drop("_bucket", *(f"_base_{v}" for v in values))
