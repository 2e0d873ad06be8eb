"""Experiments: all arms over one staged table of candidates, compared by the metrics of their rankings."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.operators import evaluation, feed
from presswork.sources.logs import staged


def rank_arms(candidates: DataFrame, arms: dict[str, Column], keep: list[str], request: str = "request_id", item: str = "article_id") -> DataFrame:
    """arm, request, item, the kept columns and rank under each arm's score: highest first, ties by item. All arms are
    ranked in one pass over the candidates, which are shuffled once, by request, before there is a row for each arm."""
    each = F.array(*(F.struct(F.lit(name).alias("arm"), score.cast("double").alias("score")) for name, score in arms.items()))
    long = candidates.select(request, item, *keep, each.alias("_arms")).repartition(request).select(request, item, *keep, F.explode("_arms").alias("x")).select(request, item, *keep, "x.arm", "x.score")
    order = Window.partitionBy("arm", request).orderBy(F.col("score").desc(), item)
    return long.withColumn("rank", F.row_number().over(order))


def with_mmr(ranking: DataFrame, name: str, penalty: float, limit: int, topics: str, request: str = "request_id", item: str = "article_id") -> DataFrame:
    """An arm that re-ranks the first `limit` of a ranking by MMR; what is not chosen keeps its order behind them.

    ranking: one arm of rank_arms with score, the topics column and, if similarity is to come from them, factors.
    """
    return with_mmrs(ranking, {name: penalty}, limit, topics, request)


def with_mmrs(ranking: DataFrame, penalties: dict[str, float], limit: int, topics: str, request: str = "request_id", own: str | None = None) -> DataFrame:
    """with_mmr for several arms, name -> penalty, in one pass over the ranking; with own, the ranking is an arm of that name
    as well. Rows are dealt by request before there is a row for each arm, as by rank_arms."""
    rows = ranking.drop("arm").withColumns({"relevance": F.col("score"), "topics": F.col(topics)})
    placed = feed.rerank_lists(rows, limit, list(penalties.values()), request).repartition(request)
    arms = {**({own: F.col("rank")} if own else {}), **{name: F.col("ranks")[k] for k, name in enumerate(penalties)}}
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("arm"), rank.alias("rank")) for name, rank in arms.items())))
    return placed.withColumn("_x", each).withColumns({"arm": F.col("_x.arm"), "rank": F.col("_x.rank")}).select(*ranking.columns)


def list_quality(ranking: DataFrame, by: list[str], topics: str, k: int) -> DataFrame:
    """Of each list's first k: category_diversity, topic_coverage, and similarity, the mean over its pairs (0 without).

    Similarity is the factors' cosine in [0, 1] where both have them, else the topics' Jaccard. Pairs are formed within
    the k first only.
    """
    lists = ranking.where(F.col("rank") <= k).groupBy(*by).agg(_first(ranking.columns, topics, k).alias("x"))
    return lists.select(*by, *_quality("factors" in ranking.columns, topics))


def _first(columns: list[str], topics: str, k: int) -> Column:
    """The aggregate of a list's first k."""
    fields = ["rank", topics, "category", *(["factors"] if "factors" in columns else [])]
    return F.array_sort(F.collect_list(F.when(F.col("rank") <= k, F.struct(*fields))))


def _quality(with_factors: bool, topics: str) -> list[Column]:
    """What list_quality gives, of the lists x."""
    each = lambda c: F.transform("x", lambda a: a[c])
    # ten thousand lists at a time
    mean = F.arrow_udf(_mean_hybrid, "double")(each(topics), each("factors")) if with_factors else F.arrow_udf(_mean_jaccard, "double")(each(topics))
    return [
        F.size(F.array_distinct(F.transform("x", lambda a: a["category"]))).alias("category_diversity"),
        F.size(F.array_distinct(F.flatten(F.transform("x", lambda a: a[topics])))).alias("topic_coverage"), mean.alias("similarity"),
    ]


def _mean_jaccard(lists: pa.Array) -> pa.Array:
    """The mean of text.jaccard over each list's pairs of topics, 0 without a pair."""
    return _mean_over_pairs(lists)


def _mean_hybrid(lists: pa.Array, vectors: pa.Array) -> pa.Array:
    """The mean of text.hybrid_similarity over each list's pairs of topics and vectors, 0 without a pair."""
    return _mean_over_pairs(lists, feed._unit(pa.chunked_array([pc.list_flatten(vectors)])))


def _mean_over_pairs(lists: pa.Array, unit: np.ndarray | None = None) -> pa.Array:
    size, topics = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)), pc.list_flatten(lists)
    start, total = np.cumsum(size) - size, np.zeros(len(size))
    codes, parent = np.asarray(pc.list_flatten(topics).dictionary_encode(null_encoding="encode").indices), np.asarray(pc.list_parent_indices(topics))
    each = np.unique(np.c_[parent, codes].astype(np.int64), axis=0) if len(codes) else np.empty((0, 2), np.int64)
    count = np.bincount(each[:, 0], minlength=len(topics))
    held = np.full((len(topics), max(1, int(count.max(initial=0)))), -1, np.int64)
    held[each[:, 0], np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)] = each[:, 1]
    for i, j in itertools.combinations(range(int(size.max(initial=0))), 2):
        row = np.flatnonzero(size > j)
        a, b = held[start[row] + i], held[start[row] + j]
        both = ((a[:, :, None] == b[:, None, :]) & (a >= 0)[:, :, None]).sum((1, 2))
        union = (a >= 0).sum(1) + (b >= 0).sum(1) - both
        alike = np.divide(both, union, out=np.zeros(len(row)), where=union > 0)
        if unit is not None:
            cosine = np.clip((unit[start[row] + i] * unit[start[row] + j]).sum(1), 0, 1)
            alike = np.where(np.isnan(cosine), alike, cosine)
        total[row] += alike
    return pa.array(np.divide(total, size * (size - 1) / 2, out=np.zeros(len(size)), where=size > 1))


def measure(ranking: DataFrame, splits: list[str], cutoffs: tuple[int, ...], k: int, topics: str = "topics", request: str = "request_id", label: str = "label") -> DataFrame:
    """arm, splits, metric, value: means over the requests that have a relevant item, and `requests`, how many these are.

    Metrics and lists come from one grouping, which needs no shuffle of rows that rank_arms dealt by request."""
    keys = ["arm", *splits, request]
    per = evaluation.request_metrics(ranking, keys, label, cutoffs, (_first(ranking.columns, topics, k).alias("x"),))
    per = per.select(*(c for c in per.columns if c != "x"), *_quality("factors" in ranking.columns, topics))
    names = [c for c in per.columns if c not in keys]
    means = per.groupBy("arm", *splits).agg(F.count("*").cast("double").alias("requests"), *(F.round(F.avg(c), 6).alias(c) for c in names))
    return means.unpivot(["arm", *splits], ["requests", *names], "metric", "value")


def choose_penalty(sweep: DataFrame, base: str, k: int, drop: float = 0.002) -> DataFrame:
    """The penalty arm that is kept: of those whose recall is at most `drop` below the base arm's and whose lists are more
    diverse than its (less similar, or covering more topics), the least similar, then the most topics, the highest
    recall, the smallest penalty. sweep: arm, penalty (null for the base), metric, value. No row if none qualifies.
    """
    wide = sweep.groupBy("arm", "penalty").pivot("metric", ["similarity", "topic_coverage", f"recall_{k}"]).agg(F.first("value"))
    first = wide.where(F.col("arm") == base).select(F.col("similarity").alias("s0"), F.col("topic_coverage").alias("t0"), F.col(f"recall_{k}").alias("r0"))
    able = wide.where(F.col("penalty") > 0).crossJoin(F.broadcast(first))  # one row
    better = (F.col("similarity") < F.col("s0") - 1e-9) | (F.col("topic_coverage") > F.col("t0") + 1e-9)
    able = able.where((F.col(f"recall_{k}") >= F.col("r0") - drop) & better)
    return able.orderBy("similarity", F.col("topic_coverage").desc(), F.col(f"recall_{k}").desc(), "penalty").limit(1).select("arm", "penalty")


def compare_arms(ranking: DataFrame, base: str, other: str, cutoffs: tuple[int, ...], iterations: int = 2000, request: str = "request_id", label: str = "label") -> DataFrame:
    """metric, delta (other less base, mean over requests), low, high and direction of the difference, by a paired
    bootstrap over requests. Both arms must rank the same requests."""
    per = evaluation.request_metrics(ranking.where(F.col("arm").isin(base, other)), ["arm", request], label, cutoffs)
    return compare_measured(per, base, [other], iterations, request).drop("arm")


def compare_measured(per: DataFrame, base: str, others: list[str], iterations: int = 2000, request: str = "request_id") -> DataFrame:
    """compare_arms of several arms with the base, with arm in front. per: request_metrics by arm and request. The requests are
    resampled once for all arms and metrics."""
    names, arms = [c for c in per.columns if c not in ("arm", request)], [base, *others]
    of = lambda k, m: F.max(F.when(F.col("arm") == arms[k], F.col(m))).alias(f"a{k}_{m}")
    wide = staged(per.groupBy(request).agg(*(of(k, m) for k in range(len(arms)) for m in names)), "arms")
    if not wide.where(F.greatest(*(F.col(f"a{k}_{names[0]}").isNull() for k in range(len(arms))), F.lit(False))).isEmpty():
        raise ValueError("the arms do not rank the same requests")
    columns = {f"d{k}_{m}": (F.lit(arms[k]).alias("arm"), F.lit(m).alias("metric")) for k in range(1, len(arms)) for m in names}
    deltas = wide.select(F.col(request).alias("request_id"), *((F.col(f"a{c[1:]}") - F.col(f"a0_{c.split('_', 1)[1]}")).alias(c) for c in columns))
    mean = deltas.agg(*(F.avg(c).alias(c) for c in columns)).unpivot([], list(columns), "metric", "delta")
    limits = evaluation.paired_bootstrap(deltas, list(columns), iterations)
    what = F.create_map(*(x for c, names_ in columns.items() for x in (F.lit(c), F.struct(*names_))))
    direction = F.when(F.col("low") > 0, "better").when(F.col("high") < 0, "worse").otherwise("open")
    return mean.join(limits, "metric").withColumn("direction", direction).select(what[F.col("metric")].alias("w"), "delta", "low", "high", "direction").select("w.arm", "w.metric", "delta", "low", "high", "direction")


def product(a: Column, b: Column) -> Column:
    """The product of two arrays of numbers, of many rows at a time; null where one is missing or their lengths differ."""
    return F.arrow_udf(_products, "double")(a, b)


def _products(a: pa.Array, b: pa.Array) -> pa.Array:
    size = [np.asarray(pc.fill_null(pc.list_value_length(x), -1)) for x in (a, b)]
    fits, out = (size[0] == size[1]) & (size[0] >= 0), np.zeros(len(a))
    rows = np.flatnonzero(fits)
    one, two = (np.asarray(pc.list_flatten(x.take(pa.array(rows))), np.float64) for x in (a, b))
    row = np.repeat(rows, size[0][rows])
    out += np.bincount(row, one * two, len(a)) if len(row) else 0
    return pa.array(out, mask=~fits)
