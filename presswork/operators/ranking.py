"""Boosted trees with a grouped objective: pairs within a request pull their scores apart (LambdaRank).

Rows of a request lie together in one row of arrays, so that pairs need no join. Each level of a tree takes one pass: every
task computes its requests' scores and pair gradients, sends its rows down the tree so far, and adds up gradients by
node, feature and bin; Spark adds up the tasks' histograms. What reaches the driver has the size of nodes x features x
bins. Trees are broadcast with the tasks' code; they are as small as their number of leaves.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.sources.logs import shared_path, write_once


def pair_gradients(labels: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of a request's pairwise loss by the scores: each pair counts by how much NDCG changes
    if its two change places. Ranks go by score, ties by place."""
    n = len(labels)
    order = np.argsort(-scores, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    gain, discount = 2.0**labels - 1, 1 / np.log2(rank + 2.0)
    ideal = (np.sort(gain)[::-1] / np.log2(np.arange(n) + 2.0)).sum()
    g, h = np.zeros(n), np.zeros(n)
    if ideal <= 0:
        return g, h
    for level in np.unique(labels)[1:]:  # each label against all smaller ones, a row of pairs at a time
        low = np.flatnonzero(labels < level)
        for i in np.flatnonzero(labels == level):
            weight = np.abs(gain[i] - gain[low]) * np.abs(discount[i] - discount[low]) / ideal
            p = 1 / (1 + np.exp(np.clip(scores[i] - scores[low], -50, 50)))
            g[i] -= (p * weight).sum()
            g[low] += p * weight
            h[i] += (p * (1 - p) * weight).sum()
            h[low] += p * (1 - p) * weight
    return g, h


def gradients(labels: np.ndarray, scores: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """pair_gradients of many requests, which lie one behind the other: all those of one size together."""
    start, g, h = np.cumsum(size) - size, np.zeros(len(labels)), np.zeros(len(labels))
    for n in np.unique(size).tolist():
        of_size = start[size == n]
        if n > 256:  # a square of pairs would be large
            for a in of_size.tolist():
                g[a : a + n], h[a : a + n] = pair_gradients(labels[a : a + n], scores[a : a + n])
            continue
        step = max(1, (1 << 18) // max(1, n * n))
        for i in range(0, len(of_size), step):
            at = of_size[i : i + step, None] + np.arange(n)
            y, s = labels[at], scores[at]
            rank = np.argsort(np.argsort(-s, 1, kind="stable"), 1, kind="stable")
            gain, discount = 2.0**y - 1, 1 / np.log2(rank + 2.0)
            ideal = (np.sort(gain, 1)[:, ::-1] / np.log2(np.arange(n) + 2.0)).sum(1)
            pairs = lambda x: x[:, :, None] - x[:, None, :]
            above = (y[:, :, None] > y[:, None, :]) & (ideal > 0)[:, None, None]
            weight = np.abs(pairs(gain)) * np.abs(pairs(discount)) * above / np.where(ideal > 0, ideal, 1)[:, None, None]
            p = 1 / (1 + np.exp(np.clip(pairs(s), -50, 50)))
            first, second = p * weight, p * (1 - p) * weight
            g[at], h[at] = first.sum(1) - first.sum(2), second.sum(1) + second.sum(2)
    return g, h


@dataclass
class Tree:
    """Splits by node (feature, bin: rows up to the bin go left to 2i + 1, others to 2i + 2) and values of the leaves."""

    splits: dict[int, tuple[int, int]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        for node in sorted(self.splits):
            f, b = self.splits[node]
            here = at == node
            at[here] = np.where(bins[here, f] <= b, 2 * node + 1, 2 * node + 2)
        return at

    def score(self, bins: np.ndarray) -> np.ndarray:
        value = np.zeros(2 * max(self.splits, default=0) + 3)
        for node, v in self.values.items():
            value[node] = v
        return value[self.nodes(bins)]


@dataclass
class Ranker:
    features: list[str]
    edges: list[np.ndarray]
    trees: list[Tree]

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1).astype(np.uint8)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        return sum((t.score(bins) for t in self.trees), np.zeros(len(bins)))


def _matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([np.asarray(batch.column(c).fill_null(0), np.float64) for c in names], 1) if len(batch) else np.empty((0, len(names)))


def fit_lambdarank(
    rows: DataFrame, features: list[str], request: str = "request_id", label: str = "label", rounds: int = 20, depth: int = 3, rate: float = 0.1, least: int = 50, ridge: float = 1.0, bins: int = 64
) -> Ranker:
    """A ranker of the rows' features, trained on whole requests. Null features count as 0; requests with equal labels only
    have no pairs. A split leaves `least` rows on either side; an empty table gives a ranker without trees."""
    spark = rows.sparkSession
    if len(features) == 0 or bins > 256:
        raise ValueError("features are needed, and no more than 256 bins")
    filled = rows.select(request, F.col(label).cast("int").alias("label"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features))
    quantiles = filled.approxQuantile(features, [k / bins for k in range(1, bins)], 1 / (4 * bins))
    ranker = Ranker(features, [np.unique(q) for q in quantiles], [])

    def pack(batches):
        for batch in batches:
            packed = ranker.binned(_matrix(batch, features))
            yield pa.RecordBatch.from_arrays([batch.column(request), batch.column("label"), pa.array([r.tobytes() for r in packed], pa.binary())], names=[request, "label", "bins"])

    kind = rows.schema[request].dataType.simpleString()
    packed = filled.mapInArrow(pack, f"{request} {kind}, label int, bins binary")
    each = F.collect_list(F.struct("label", "bins"))
    path = shared_path(spark, "ranker-rows")
    pairs = packed.groupBy(request).agg(F.array_sort(each).alias("x")).where(F.size(F.array_distinct(F.transform("x", lambda r: r["label"]))) > 1).select(
        F.transform("x", lambda r: r["label"]).alias("labels"), F.transform("x", lambda r: r["bins"]).alias("bins")
    )
    write_once(pairs, path)
    staged = spark.read.parquet(path)

    def histograms(tree: Tree, open_: list[int]) -> dict[int, np.ndarray]:
        def run(batches):
            total = np.zeros((len(open_), len(features), bins, 3))
            for batch in batches:
                cells = np.frombuffer(b"".join(b for b in batch.column("bins").flatten().to_pylist()), np.uint8).reshape(-1, len(features))
                labels = np.asarray(batch.column("labels").flatten())
                size = np.asarray(batch.column("labels").value_lengths())
                g, h = gradients(labels, ranker.margin(cells), size)
                at = tree.nodes(cells)
                for k, node in enumerate(open_):
                    here = at == node
                    for j in range(len(features)):
                        c = cells[here, j]
                        for s, w in enumerate((g[here], h[here], None)):
                            total[k, j, :, s] += np.bincount(c, w, bins)
            flat = total.reshape(len(open_) * len(features), -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(list(flat))], names=["cell", "sums"])

        cells = staged.mapInArrow(run, "cell int, sums array<double>").select("cell", F.posexplode("sums").alias("i", "v")).where("v <> 0")
        sums = cells.groupBy("cell", "i").agg(F.sum("v").alias("v")).toPandas()
        flat = np.zeros((len(open_) * len(features), bins * 3))
        flat[sums.cell, sums.i] = sums.v
        return dict(zip(open_, flat.reshape(len(open_), len(features), bins, 3), strict=True))

    for _ in range(rounds):
        tree, open_ = Tree(), [0]
        for level in range(depth):
            following = []
            for node, histogram in histograms(tree, open_).items():
                split = _split(histogram, least, ridge)
                if split is None:
                    tree.values[node] = _value(histogram[0].sum(0), rate, ridge)
                    continue
                tree.splits[node] = split
                left = histogram[split[0], : split[1] + 1].sum(0)
                for child, sums in ((2 * node + 1, left), (2 * node + 2, histogram[0].sum(0) - left)):
                    if level + 1 < depth:
                        following.append(child)
                    else:  # the sums of a leaf are known from its parent's histogram
                        tree.values[child] = _value(sums, rate, ridge)
            open_ = following
            if not open_:
                break
        if not tree.splits:
            break  # nothing left to tell requests' rows apart
        ranker.trees.append(tree)
    return ranker


def _value(sums: np.ndarray, rate: float, ridge: float) -> float:
    return float(-rate * sums[0] / (sums[1] + ridge))


def _split(histogram: np.ndarray, least: int, ridge: float) -> tuple[int, int] | None:
    """The feature and bin whose split gains most; the first of several. None if none gains."""
    left = np.cumsum(histogram, 1)[:, :-1]
    whole = histogram.sum(1)[:, None]
    right = whole - left
    worth = lambda x: x[..., 0] ** 2 / (x[..., 1] + ridge)
    gain = worth(left) + worth(right) - worth(whole)
    gain = np.where((left[..., 2] >= least) & (right[..., 2] >= least), gain, -np.inf)
    f, b = np.unravel_index(gain.argmax(), gain.shape)
    return (int(f), int(b)) if gain[f, b] > 1e-12 else None


def score_rows(rows: DataFrame, ranker: Ranker, keep: list[str]) -> DataFrame:
    """The kept columns of each row and its score, which orders the rows of a request and is no probability."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches):
        for batch in batches:
            score = ranker.margin(ranker.binned(_matrix(batch, ranker.features)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(score)], names=[*keep, "score"])

    wanted = rows.select(*keep, *(F.col(c).cast("double").alias(c) for c in ranker.features if c not in keep))
    return wanted.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", score double")
