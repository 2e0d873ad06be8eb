"""Nearest vectors by collision counting over query-centred windows.

Each of PROJECTIONS random projections keeps the vectors of a block in one sorted array. A query looks at the
stretch of each array around its own value; the vectors that lie in enough of these windows are verified, and no
product with any other vector is computed. If too few are near, all windows grow (virtual rehashing: the arrays stay
as they are) and only what is new in them is counted. The search of a block ends once the k-th verified vector is no
farther than the radius that the windows stand for, at which every vector within it has been met with probability
RECALL or more.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from presswork.llm.common import table

PROJECTIONS = 128
HALF_WIDTH = 2.0  # of a window, in radii: wide windows tell near from far best, as few near vectors lie outside
GROWTH = 1.25
FIRST_RADIUS = 0.6  # in the largest norm
RECALL = 0.93


def _threshold() -> int:
    """The largest number of collisions that a vector at the radius reaches with probability RECALL."""
    p = math.erf(HALF_WIDTH / math.sqrt(2))
    tail, need = 0.0, PROJECTIONS
    for k in range(PROJECTIONS, -1, -1):
        tail += math.comb(PROJECTIONS, k) * p**k * (1 - p) ** (PROJECTIONS - k)
        need = k
        if tail >= RECALL:
            break
    return need


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = column.combine_chunks()
    values = flat.flatten() if not isinstance(flat, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return np.asarray(values, np.float64).reshape(len(column), dims)


class _Windows:
    """The windows of one query: how many of them each vector of the block lies in, as they grow."""

    def __init__(self, ordered: np.ndarray, order: np.ndarray, place: np.ndarray, centre: np.ndarray):
        self.ordered, self.order, self.place, self.centre = ordered, order, place, centre
        self.count = np.zeros(order.shape[1], np.uint8)
        self.lo = [int(a.searchsorted(c)) for a, c in zip(ordered, centre, strict=True)]
        self.hi = list(self.lo)
        self._from, self._in = np.empty_like(place[0]), np.empty(order.shape[1], bool)

    def grow(self, half_width: float) -> np.ndarray:
        """Widens all windows and counts what is new in them; the counts."""
        left, right = self.centre - np.float32(half_width), self.centre + np.float32(half_width)
        bounds = []
        for values, x, y, lo, hi in zip(self.ordered, left, right, self.lo, self.hi, strict=True):
            bounds.append((min(int(values.searchsorted(x)), lo), max(int(values.searchsorted(y, "right")), hi)))
        new = sum(b - a for a, b in bounds) - sum(self.hi) + sum(self.lo)
        if new < self.place.size // 16:
            for j, (a, b) in enumerate(bounds):
                self.count[self.order[j, a : self.lo[j]]] += 1
                self.count[self.order[j, self.hi[j] : b]] += 1
        else:  # much is new: a pass over all places costs less than a look-up for each new one
            self.count[:] = 0
            for place, (a, b) in zip(self.place, bounds, strict=True):
                np.subtract(place, place.dtype.type(a), out=self._from)
                np.less(self._from, place.dtype.type(b - a), out=self._in)
                np.add(self.count, self._in.view(np.uint8), out=self.count)
        self.lo, self.hi = (list(x) for x in zip(*bounds, strict=True))
        return self.count


def _search_block(k: int, dims: int, scale: float):
    """Cogroup of a block of vectors and a block of queries: each query's k nearest of the block, with the number of
    vectors that were verified. scale: the largest component of all vectors, which brings them into a range that
    squares neither leave nor vanish from."""
    need = _threshold()
    axes = np.random.default_rng(5).normal(size=(dims + 1, PROJECTIONS)).astype(np.float32)

    def run(data: pa.Table, queries: pa.Table) -> pa.Table:
        found: dict[str, list[np.ndarray]] = {"query_id": [np.empty(0, np.int64)], "vec_id": [np.empty(0, np.int64)], "score": [np.empty(0)], "verified": [np.empty(0, np.int64)]}
        if len(data) and len(queries):
            ids, x = np.asarray(data["vec_id"]), _matrix(data["vec"], dims)
            q_ids, q = np.asarray(queries["asked_id"]), _matrix(queries["asked"], dims)
            small = x / scale
            squared = (small * small).sum(1)
            norm = max(float(np.sqrt(squared.max())), 1e-150)
            # one more component makes all vectors equally long, so that the nearest are those with the largest product
            values = (np.c_[small / norm, np.sqrt(np.maximum(0, 1 - squared / norm / norm))].astype(np.float32) @ axes).T
            order = np.argsort(values, axis=1, kind="stable").astype(np.int32)
            ordered = np.take_along_axis(values, order, 1)
            small_int = np.uint16 if len(ids) < 1 << 16 else np.uint32
            place = np.empty(order.shape, small_int)
            np.put_along_axis(place, order, np.arange(len(ids), dtype=small_int)[None, :], 1)
            way = q / np.abs(q).max(1, keepdims=True)
            way /= np.sqrt((way * way).sum(1, keepdims=True))
            centre = np.c_[way, np.zeros(len(q))].astype(np.float32) @ axes
            for i in range(len(q)):
                own = ids == q_ids[i]
                candidates = len(ids) - int(own.sum())
                windows, radius = _Windows(ordered, order, place, centre[i]), FIRST_RADIUS
                met, near = np.empty(0, np.int64), np.empty(0)
                known = own.copy()
                while len(met) < candidates:
                    # vectors of length 1 are never farther apart than 2: from there on all are met
                    new = np.flatnonzero(~known if radius >= 2 else (windows.grow(HALF_WIDTH * radius) >= need) & ~known)
                    known[new] = True
                    met, near = np.r_[met, new], np.r_[near, (small[new] * way[i]).sum(1)]
                    if len(met) < min(k, candidates):
                        radius *= GROWTH
                        continue
                    least = np.partition(near, len(near) - k)[len(near) - k] if len(near) > k else near.min()
                    farthest = math.sqrt(max(0.0, 2 - 2 * least / norm))  # the distance of the k-th so far
                    if farthest <= radius:
                        break
                    radius = min(radius * GROWTH, farthest * (1 + 1e-6))  # farther than that nothing is worth meeting
                if not len(met):
                    continue
                if len(met) > k:
                    met = met[near >= least - 1e-9 * norm]
                with np.errstate(over="ignore", invalid="ignore"):
                    score = (x[met] * q[i]).sum(1)  # on the original vectors, in double precision
                best = np.lexsort((ids[met], -score))[:k]
                for column, v in zip(found.values(), (np.full(len(best), q_ids[i]), ids[met][best], score[best], np.full(len(best), len(near))), strict=True):
                    column.append(v)
        return pa.table({name: pa.array(np.concatenate(v)) for name, v in found.items()})

    return lambda key, data, queries: run(data, queries)


def _usable(vec: Column) -> Column:
    fine = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & fine & F.exists(vec, lambda v: v != 0)


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", dims: int | None = None,
    block: int = 32768, query_block: int = 1024,
) -> DataFrame:
    """For each row where is_query holds, the k other rows of largest inner product: query_id, rank, vec_id, score, and
    verified (how many vectors of the row's block were verified for the query).

    Ties go to the smaller id. Vectors that are null, zero, of another length than `dims` (by default the most common
    length, of several the least), or that hold a null or non-finite component take no part; nor do rows with a null
    id. Rows of equal id are one vector: the least in order of components, which asks if one of them does. Blocks of
    about `block` vectors meet blocks of about `query_block` queries in one task each, so memory is bounded; each
    block gives its k best and the best of these are kept. A vector missed by its block's windows is missed: see
    RECALL. Other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & _usable(F.col("vec")))
    if dims is None:
        lengths = rows.groupBy(F.size("vec").alias("dims")).count().orderBy(F.col("count").desc(), "dims").first()
        dims = lengths.dims if lengths else 1
    rows = rows.where(F.size("vec") == dims)
    n, asking, scale = rows.agg(F.count("*"), F.count_if("asks"), F.max(F.array_max(F.transform("vec", F.abs)))).first()
    rows = rows.groupBy("vec_id").agg(F.min("vec").alias("vec"), F.bool_or("asks").alias("asks"))
    blocks, query_blocks = -(-n // block) or 1, -(-asking // query_block) or 1
    place = lambda seed, m: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(m)).cast("int")
    spread = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    data = rows.select("vec_id", "vec", place(1, blocks).alias("d"), spread(query_blocks).alias("q"))
    # new names, as Spark loses columns of a cogroup of two sides with the same ones if not all of its output is read
    queries = rows.where("asks").select(F.col("vec_id").alias("asked_id"), F.col("vec").alias("asked"), place(2, query_blocks).alias("q"), spread(blocks).alias("d"))
    search = _search_block(k, dims, scale or 1.0)
    found = data.groupBy("d", "q").cogroup(queries.groupBy("d", "q")).applyInArrow(search, "query_id long, vec_id long, score double, verified long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "verified")


def op2_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of each embedding whose number is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)
