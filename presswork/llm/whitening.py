"""Whitening of embeddings by LOBPCG.

The leading eigenvectors of the covariance are found without the covariance: each round multiplies it with a block of
directions by one distributed pass over the centred rows, and solves the small problem that is left on the span of
the iterate, its residuals and the directions of the round before (Rayleigh-Ritz). Rounds end when the residual of
each wanted eigenvector is certified to be at rounding level. What reaches the driver has the size of the dimensions
times the block, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.llm.common import staged, table

SCALE, SHIFT = 64, 1_000_000
LARGEST = 2.0**52  # scaled components from here on are no whole numbers of their own any more
GUARD = 8  # directions beyond the wanted ones, which speed up the last of them
TOLERANCE = 1e-13  # of a residual, as a share of the largest eigenvalue
ROUNDS = 500
_LOW = 26  # sums are kept as two halves, so that no batch overflows


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), dims)


@dataclass
class Centre:
    """The mean of whole numbers, exactly: whole + rest / n in each dimension."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    def off(self, x: np.ndarray) -> np.ndarray:
        """x less the mean; the whole part is taken off first, so that large means cost no digits."""
        return (x - self.whole).astype(np.float64) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n * x - sum)^2; None where that is no long."""
        y = self.off(x) * self.n
        near = (y * y).sum(1)
        with np.errstate(over="ignore"):
            exact = self.n * (x - self.whole) - self.rest
            out: list[int | None] = (exact * exact).sum(1).tolist()
        for i in np.flatnonzero(near > 4e18):  # close to the largest long or beyond: with Python's integers
            value = sum((self.n * (int(a) - int(w)) - int(r)) ** 2 for a, w, r in zip(x[i], self.whole, self.rest, strict=True))
            out[i] = value if value < 1 << 63 else None
        return out


def _sums(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for batch in batches:
            x = _matrix(batch.column("x"), dims)
            n, high, low = n + len(x), high + (x >> _LOW).sum(0), low + (x & ((1 << _LOW) - 1)).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array(np.full(dims, n)), pa.array(high), pa.array(low)], names=["dim", "n", "high", "low"])

    return run


def centre_of(rows: DataFrame, dims: int) -> Centre | None:
    sums = rows.select("x").mapInArrow(_sums(dims), "dim int, n long, high long, low long")
    total = sums.groupBy("dim").agg(F.sum("n").alias("n"), *(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low"))).collect()
    if not total:
        return None
    n = total[0].n
    exact = {t.dim: (int(t.high) << _LOW) + int(t.low) for t in total}
    parts = [divmod(exact[i], n) for i in range(dims)]
    return Centre(n, np.array([p[0] for p in parts], np.int64), np.array([p[1] for p in parts], np.int64))


def _added_up(rows: DataFrame, work: Callable[[np.ndarray], np.ndarray], dims: int) -> np.ndarray:
    """The sum of work(x) over all batches: each task adds up its own, Spark the tasks'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                part = work(_matrix(batch.column("x"), dims))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total))], names=["i", "row"])

    cells = rows.select("x").mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((cells.i.max() + 1, cells.j.max() + 1))
    out[cells.i, cells.j] = cells.v
    return out


def _directions(x: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Orthonormal directions that span what `more` adds to the orthonormal x."""
    new = [m / np.linalg.norm(m, axis=0) for m in more if m.shape[1]]
    if not new:
        return np.empty((len(x), 0))
    w = np.hstack(new)
    for floor in (1e-6, 0.5):  # the second time only rounding is left to take off
        w = w - x @ (x.T @ w)
        u, s, _ = np.linalg.svd(w, full_matrices=False)
        w = u[:, s > floor] if floor < 0.5 else u
        w = w[:, : len(x) - x.shape[1]]
    return np.linalg.qr(w - x @ (x.T @ w))[0]


@dataclass
class Components:
    """Unit eigenvectors (columns) by falling eigenvalue, and the norm of each one's residual V x - e x."""

    vectors: np.ndarray
    values: np.ndarray
    residuals: np.ndarray
    rounds: int


def lobpcg(product: Callable[[np.ndarray], np.ndarray], dims: int, k: int, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> Components:
    """The k leading eigenvectors of a symmetric positive matrix that is only given by its product with a block.

    A residual that is not at `tolerance` of the largest eigenvalue after `rounds` products is an error.
    """
    k, m = min(k, dims), min(k + GUARD, dims)
    basis = np.linalg.qr(np.random.default_rng(11).normal(size=(dims, m)))[0]
    for done in range(1, rounds + 1):
        by_basis = product(basis)
        small = basis.T @ by_basis
        e, c = np.linalg.eigh((small + small.T) / 2)
        e, c = e[::-1][:m], c[:, ::-1][:, :m]
        x, residual = basis @ c, by_basis @ c - basis @ c * e
        norms = np.linalg.norm(residual, axis=0)
        if not e[0] > 0 or norms[:k].max() <= tolerance * e[0]:
            return Components(x[:, :k], e[:k], norms[:k], done)
        before = basis[:, m:] @ c[m:]
        x = np.linalg.qr(x)[0]
        open_ = norms > tolerance * e[0] / 10
        more = _directions(x, residual[:, open_], before[:, np.linalg.norm(before, axis=0) > 0])
        basis = np.hstack([x, more])
    raise ArithmeticError(f"a residual of {norms[:k].max() / e[0]:.1e} of the largest eigenvalue is left after {rounds} rounds")


def _fits(vec: Column) -> Column:
    return vec.isNotNull() & F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) * SCALE < LARGEST))


def whiten(vectors: DataFrame, k: int = 32, id_col: str = "vec_id", vec_col: str = "embedding", dims: int | None = None) -> DataFrame:
    """For each vector and each of the k leading components: id, component, n, deviation, whitened, explained,
    identity_error and residual (of the component's eigenvector, as a share of the largest eigenvalue).

    A component c counts as the whole number floor(64 * c) + 1000000. Vectors that are null or hold a null, non-finite
    or (scaled) 2^52 or larger component take no part, nor do those of another length than `dims`, by default the most
    common one (of several the least). Rows with equal or null ids are vectors like all others. Components without
    variance (up to rounding) can't be whitened and are left out; an empty table, or one in which all vectors are
    equal, gives no rows. The deviation is null where it exceeds a long. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where(_fits(F.col("vec")))
    rows = rows.select("id", F.transform("vec", lambda v: F.floor(v * SCALE).cast("long") + SHIFT).alias("x"))
    rows = staged(rows)
    if dims is None:
        lengths = rows.groupBy(F.size("x").alias("dims")).count().orderBy(F.col("count").desc(), "dims").first()
        dims = lengths.dims if lengths else 0
    rows = rows.where(F.size("x") == dims)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"{id_col} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"
    centre = centre_of(rows, dims) if dims else None
    if centre is None:
        return spark.createDataFrame([], schema)

    def product(basis: np.ndarray) -> np.ndarray:
        def work(x: np.ndarray) -> np.ndarray:
            y = centre.off(x)
            return y.T @ (y @ basis)

        return _added_up(rows, work, dims) / centre.n

    # the trace is the product of each dimension with itself
    trace = float(_added_up(rows, lambda x: (centre.off(x) ** 2).sum(0, keepdims=True), dims).sum()) / centre.n
    if not trace > 0:
        return spark.createDataFrame([], schema)
    found = lobpcg(product, dims, k)
    kept = found.values > found.values[0] * dims * np.finfo(float).eps
    k = int(kept.sum())
    way = found.vectors[:, :k] / np.sqrt(found.values[:k])

    def spread(x: np.ndarray) -> np.ndarray:
        w = centre.off(x) @ way
        return np.vstack([w.T @ w, w.sum(0, keepdims=True)])

    sums = _added_up(rows, spread, dims) / centre.n
    error = float(np.abs(sums[:k] - np.outer(sums[k], sums[k]) - np.eye(k)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = _matrix(batch.column("x"), dims)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(centre.deviation(x), pa.int64()), pa.array(list(centre.off(x) @ way), pa.list_(pa.float64()))], names=["id", "deviation", "w"])

    out = rows.mapInArrow(project, f"id {kind}, deviation long, w array<double>").select("id", "deviation", F.posexplode("w").alias("i", "whitened"))
    share = F.array(*(F.lit(float(e) / trace) for e in found.values[:k]))
    rest = F.array(*(F.lit(float(r / found.values[0])) for r in found.residuals[:k]))
    return out.select(
        F.col("id").alias(id_col), (F.col("i") + 1).alias("component"), F.lit(centre.n).cast("long").alias("n"), "deviation", "whitened",
        share[F.col("i")].alias("explained"), F.lit(error).alias("identity_error"), rest[F.col("i")].alias("residual"),
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 32 leading components of each embedding, whitened."""
    return whiten(table(spark, sf_dir, "embeddings"))
