"""Ranking and classification metrics, per request and averaged."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presswork.operators.ordered import running_before


def ranked(scored: DataFrame, request: str, score: str, item: str) -> DataFrame:
    """Adds rank: highest score first, ties by item."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(request).orderBy(F.col(score).desc(), item)))


def ideal_dcg(n) -> F.Column:
    """Discounted gain of n relevant items in the first n places."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1.0)))


def _ideal_within(n, most: int) -> F.Column:
    """ideal_dcg of at most `most` items, from numbers that Spark works out once."""
    upto = list(itertools.accumulate((1 / F.log2(F.lit(i + 1.0)) for i in range(1, most + 1)), initial=F.lit(0.0)))[1:]
    return F.array(*upto)[(F.greatest(n, F.lit(1)) - 1).cast("int")]


def request_metrics(ranking: DataFrame, request: str | list[str], label: str, cutoffs: tuple[int, ...], more: tuple[F.Column, ...] = ()) -> DataFrame:
    """Recall and NDCG at each cutoff, and the reciprocal rank of the first relevant item.

    One row per request (or per combination of several columns) that has a relevant item; others say nothing about a
    ranking and are left out. more: further aggregates of the same groups, which stand behind the keys.
    """
    keys = [request] if isinstance(request, str) else request
    sums = [F.sum(label).alias("positives"), F.min(F.when(F.col(label) == 1, F.col("rank"))).alias("first")]
    for k in cutoffs:
        inside = F.when(F.col("rank") <= k, F.col(label)).otherwise(0)
        sums += [F.sum(inside).alias(f"hits_{k}"), F.sum(inside / F.log2(F.col("rank") + 1.0)).alias(f"dcg_{k}")]
    per = ranking.groupBy(*keys).agg(*sums, *more).where("positives > 0")
    out = [*keys, *per.columns[len(keys) + len(sums) :], (1.0 / F.col("first")).alias("mrr")]
    for k in cutoffs:
        out += [(F.col(f"hits_{k}") / F.col("positives")).alias(f"recall_{k}"), (F.col(f"dcg_{k}") / _ideal_within(F.least("positives", F.lit(k)), k)).alias(f"ndcg_{k}")]
    return per.select(*out)


def graded_ndcg(ranking: DataFrame, request: str, grade: str, k: int) -> DataFrame:
    """NDCG with gain 2^grade - 1; the ideal order is that of the grades."""
    gain = F.pow(F.lit(2.0), F.col(grade)) - 1
    best = F.row_number().over(Window.partitionBy(request).orderBy(F.col(grade).desc(), "rank"))
    rows = ranking.withColumn("best", best)
    per = rows.groupBy(request).agg(F.sum(F.when(F.col("rank") <= k, gain / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"), F.sum(F.when(F.col("best") <= k, gain / F.log2(F.col("best") + 1.0)).otherwise(0.0)).alias("ideal"))
    return per.where("ideal > 0").select(request, (F.col("dcg") / F.col("ideal")).alias("ndcg"))


def roc_auc(scored: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve from mean ranks, so that ties count half. Ranks run over distinct scores."""
    per = scored.groupBy(F.col(score).cast("double").alias("_score")).agg(F.count("*").alias("n"), F.sum(label).alias("p"))
    rows = running_before(per, "_score", ["n"]).withColumn("rank", F.col("before_n") + (F.col("n") + 1) / 2)
    total = rows.agg(F.sum(F.col("rank") * F.col("p")).alias("s"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return total.select(F.try_divide(F.col("s") - F.col("p") * (F.col("p") + 1) / 2, (F.col("p") * (F.col("n") - F.col("p"))).cast("double")).alias("auc"))


def average_precision(scored: DataFrame, score: str, label: str) -> DataFrame:
    """Sum over thresholds of precision times the gain in recall (no interpolation)."""
    per = scored.groupBy(F.col(score).cast("double").alias("_score")).agg(F.count("*").alias("n"), F.sum(label).alias("p"))
    rows = running_before(per, "_score", ["n", "p"], descending=True)
    rows = rows.withColumn("tp", F.col("before_p") + F.col("p")).withColumn("seen", F.col("before_n") + F.col("n"))
    return rows.agg(F.try_divide(F.sum(F.col("tp") / F.col("seen") * F.col("p")), F.sum("p").cast("double")).alias("ap"))


def log_loss(scored: DataFrame, probability: str, label: str) -> DataFrame:
    p = F.least(F.lit(1 - 1e-15), F.greatest(F.lit(1e-15), F.col(probability)))
    return scored.agg(F.avg(F.when(F.col(label) == 1, -F.log(p)).otherwise(-F.log(1 - p))).alias("log_loss"))


#: P(X <= x) of a Poisson distribution of mean 1, and for each number of 16 bits which x it gives, or 255 if further bits decide.
_UP_TO = np.cumsum([math.exp(-1) / math.factorial(x) for x in range(20)])
_OF_BITS = np.searchsorted(_UP_TO, np.arange(1 << 16) / (1 << 16), "right").astype(np.uint8)
_OF_BITS[np.searchsorted(_UP_TO, np.arange(1, (1 << 16) + 1) / (1 << 16), "left") != _OF_BITS] = 255


def _poisson_of_one(rng: np.random.Generator, shape: tuple[int, int]) -> np.ndarray:
    """Draws from a Poisson distribution of mean 1 by its inverse, several times as fast as those for any mean."""
    n = shape[0] * shape[1]
    bits = rng.integers(0, 1 << 64, -(-n // 4), np.uint64).view(np.uint16)[:n]
    out = _OF_BITS.take(bits)
    open_ = np.flatnonzero(out == 255)
    out[open_] = np.searchsorted(_UP_TO, (bits[open_] + rng.random(len(open_))) / (1 << 16), "right")
    return out.reshape(shape)


def paired_bootstrap(deltas: DataFrame, metrics: list[str], iterations: int = 2000, seed: int = 42, buckets: int = 1000) -> DataFrame:
    """Confidence limits (2.5 and 97.5 %) of the mean of each delta, resampling requests.

    Each bucket of requests draws Poisson weights for every iteration and adds up; so nothing is gathered, and the
    resampled means are those of a bootstrap whose sample size varies a little.
    """
    schema = ", ".join(["iteration int", "n double", *(f"{m} double" for m in metrics)])

    def draw(key, rows: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, int(key[0])])
        values = np.c_[np.ones(len(rows)), rows[metrics].to_numpy(float)]
        sums = sum(_poisson_of_one(rng, (iterations, len(v))).astype(float) @ v for v in (values[i : i + 4096] for i in range(0, len(values), 4096)))
        return pd.DataFrame({"iteration": np.arange(iterations, dtype=np.int32), **dict(zip(("n", *metrics), sums.T, strict=True))})

    keyed = deltas.withColumn("_bucket", F.pmod(F.xxhash64("request_id"), F.lit(buckets)).cast("int"))
    parts = keyed.groupBy("_bucket").applyInPandas(draw, schema)
    sums = parts.groupBy("iteration").agg(F.sum("n").alias("n"), *(F.sum(m).alias(m) for m in metrics))
    long = sums.select("iteration", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.try_divide(F.col(m), F.col("n")).alias("mean")) for m in metrics))).alias("x")).select("x.*")
    return long.groupBy("metric").agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"))
