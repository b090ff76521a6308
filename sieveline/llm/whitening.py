"""Embedding whitening by LOBPCG, with products of covariance and block on the cluster.

The leading eigenvectors of the covariance V of the distinct vectors are found
without V: an iteration holds a block X of directions, the residuals R of its
Ritz pairs and the previous directions P, multiplies one block by V, and does
Rayleigh-Ritz on the span of all three.  A product V B is a pass over the rows:
each task centres its rows c and sums c^T (c B) over batches, and the cells of
the result are summed by an aggregation, so neither rows nor anything that
grows with them leaves the cluster; the driver holds blocks of (dimensions x
directions).

Iteration ends when a product made anew shows residuals |V u - e u| of at most
TOLERANCE times the largest eigenvalue for every wanted pair; where it does not
(the running products of X are carried along and gather rounding errors), it
goes on from the new product.  Where that cannot be reached in ITERATIONS, the
operator fails rather than return directions it cannot vouch for.

Components become x = floor(scale * c) + shift as integers.  Sums S of x and
the count n are exact, and a row is centred exactly as (n x - S) / n.

Defined edge cases: rows whose vector is null or holds null or non-finite
entries are dropped; repeated vectors count once in the fit, and each of their
rows has a result; null ids stay; there are as many components as asked for, but
no more than V has eigenvalues above 1e-12 of its largest (one distinct vector
alone, equal vectors or an empty table have none, so the result is empty);
vectors of several lengths, entries of 2**40 and more, count times largest entry
from 2**62 on and a deviation beyond 64 bits are errors; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table
from .kernels import trimmed

#: Directions carried beside the wanted ones; residual asked for, as a share of the
#: largest eigenvalue; eigenvalues below this share of the largest count as zero.
GUARD, TOLERANCE, ITERATIONS, RANK = 8, 1e-13, 300, 1e-12
#: Largest entry; rows multiplied at once.
LARGEST, STEP = 2**40, 4096


def integral(vectors: DataFrame, scale: int, shift: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, x): the usable vectors with whole components."""
    c = F.col(vector_col).cast("array<double>")
    usable = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    whole = lambda v: F.when(F.abs(v) < LARGEST / scale, F.floor(F.lit(float(scale)) * v)).otherwise(F.raise_error(F.lit("a vector's entry is too large"))) + F.lit(shift)
    return vectors.where(F.col(vector_col).isNotNull() & usable).select(F.col(id_col).cast("long").alias("id"), F.transform(c, lambda v: whole(v).cast("long")).alias("x"))


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), dim)


class Fit:
    """Count, sums and centred products of the distinct vectors."""

    def __init__(self, rows: DataFrame):
        self.rows = rows  # (x)
        most = F.max(F.array_max(F.transform("x", lambda v: F.abs(v))))
        sizes = rows.agg(F.count(F.lit(1)), F.min(F.size("x")), F.max(F.size("x")), most).first()
        self.n, self.dim = sizes[0], sizes[2] or 0
        if self.n and sizes[1] != sizes[2]:
            raise ValueError(f"vectors of {sizes[1]} to {sizes[2]} entries")
        if self.n * (sizes[3] or 0) >= 2**62:
            raise OverflowError(f"{self.n} vectors with entries of {sizes[3]}: sums do not fit into 64 bits")
        told = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("s")).collect() if self.n else []
        self.sums = np.zeros(self.dim, np.int64)
        for r in told:  # one row a dimension
            self.sums[r["i"]] = r["s"]

    def centring(self) -> Callable[[np.ndarray], np.ndarray]:
        """x to x - S / n; the difference n x - S is made in whole numbers."""
        n, sums = self.n, self.sums  # tasks need no more of a fit
        return lambda x: (x * n - sums) / n

    def summed(self, of: Callable[[np.ndarray], np.ndarray], cells: int) -> np.ndarray:
        """The sum over all rows of ``of`` (centred rows): ``cells`` numbers."""
        dim, centred = self.dim, self.centring()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(cells)
            for batch in batches:
                x = _rows(batch.column(0), dim)
                for i in range(0, len(x), STEP):
                    total += of(centred(x[i : i + STEP])).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells), pa.int64()), pa.array(total)], names=["cell", "v"])

        parts = self.rows.mapInArrow(trimmed(run), "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(cells)
        for r in parts:  # dimensions x directions
            out[r["cell"]] = r["v"]
        return out

    def product(self, block: np.ndarray) -> np.ndarray:
        """V block."""
        return self.summed(lambda c: c.T @ (c @ block), block.size).reshape(block.shape) / self.n

    def trace(self) -> float:
        return float(self.summed(lambda c: np.array([(c * c).sum()]), 1)[0]) / self.n

    def covariance(self, project: Callable[[np.ndarray], np.ndarray], k: int) -> np.ndarray:
        """The covariance of projected rows, centred."""

        def moments(c: np.ndarray) -> np.ndarray:
            z = project(c)
            return np.concatenate(((z.T @ z).ravel(), z.sum(axis=0)))

        found = self.summed(moments, k * k + k)
        mean = found[k * k :] / self.n
        return found[: k * k].reshape(k, k) / self.n - np.outer(mean, mean)


def _against(block: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``block`` adds to the orthonormal ``bases``."""
    size = np.linalg.norm(block, axis=0)
    block = block[:, size > 0] / size[size > 0]
    for _ in range(2):  # twice is enough
        for basis in bases:
            block = block - basis @ (basis.T @ block)
        if block.shape[1]:
            u, s, _ = np.linalg.svd(block, full_matrices=False)
            block = u[:, s > 1e-10]
    return block


def leading(product: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns), the ``wanted`` largest of a symmetric
    non-negative operator, certified by a product of their own."""
    m = min(dim, wanted + GUARD)
    x = np.linalg.qr(np.random.default_rng(0).standard_normal((dim, m)))[0]
    none = np.zeros((dim, 0))
    ax, p, ap = product(x), none, none
    fresh = True  # ax is a product of x as it is
    for _ in range(ITERATIONS):
        e, turn = np.linalg.eigh((x.T @ ax + ax.T @ x) / 2)
        e, turn = e[::-1], turn[:, ::-1]
        x, ax = x @ turn, ax @ turn
        r = ax - x * e
        off = np.linalg.norm(r, axis=0)
        if (off[:wanted] <= TOLERANCE * max(e[0], 0)).all():
            if fresh:
                return e[:wanted], x[:, :wanted]
            x = np.linalg.qr(x)[0]
            ax, p, ap, fresh = product(x), none, none, True
            continue
        r = _against(r, x, p)
        if not r.shape[1]:  # X and P span all that can be reached
            if fresh:
                raise ArithmeticError(f"residuals of {off[:wanted].max() / e[0]:.1e} of the largest eigenvalue, and no direction left")
            x = np.linalg.qr(x)[0]
            ax, p, ap, fresh = product(x), none, none, True
            continue
        q, aq = np.hstack((x, p, r)), np.hstack((ax, ap, product(r)))
        _, c = np.linalg.eigh((q.T @ aq + aq.T @ q) / 2)
        c = c[:, ::-1][:, :m]
        # the part of the new directions outside the old X, orthogonal to the new ones
        step = c.copy()
        step[:m] = 0
        step = _against(step, c)
        x, ax, p, ap, fresh = q @ c, aq @ c, q @ step, aq @ step, False
    raise ArithmeticError(f"no certified residuals after {ITERATIONS} iterations")


def _told(fit: Fit, e: np.ndarray, u: np.ndarray, trace: float, error: float):
    n, dim, k = fit.n, fit.dim, len(e)
    centred, sums, scale = fit.centring(), fit.sums, np.sqrt(e)

    def deviations(x: np.ndarray) -> list[int]:
        d = x * n - sums
        if (d.astype(float) ** 2).sum(axis=1).max(initial=0) >= 2.0**62:
            exact = [sum(v * v for v in row) for row in d.tolist()]
            if max(exact) >= 2**63:
                raise OverflowError("a deviation does not fit into 64 bits")
            return exact
        return (d * d).sum(axis=1).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, STEP):
                part = batch.slice(lo, STEP)
                x = _rows(part.column(1), dim)
                m = len(x)
                cols = [
                    part.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n), pa.int64()),
                    pa.array(np.repeat(np.array(deviations(x), np.int64), k)), pa.array((centred(x) @ u / scale).ravel()), pa.array(np.tile(e / trace, m)), pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


RESULT = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, *, components: int = 16, scale: int = 64, shift: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each usable row of ``vectors`` and component: id, component (from 1, by
    falling eigenvalue), n, deviation (sum of (n x - S)^2), whitened, explained (share of
    the trace), identity_error (of the whitened fit list's covariance, largest entry)."""
    spark = vectors.sparkSession
    rows = integral(vectors, scale, shift, id_col, vector_col)
    fit = Fit(settle(rows.select("x").distinct(), "distinct"))
    trace = fit.trace() if fit.n else 0.0
    if not trace > 0:
        return spark.createDataFrame([], RESULT).withColumnRenamed("id", id_col)
    e, u = leading(fit.product, fit.dim, min(components, fit.dim))
    k = int((e > RANK * e[0]).sum())
    e, u = e[:k], u[:, :k]
    error = float(np.abs(fit.covariance(lambda c: c @ u / np.sqrt(e), k) - np.eye(k)).max())
    return rows.mapInArrow(trimmed(_told(fit, e, u, trace, error)), RESULT).withColumnRenamed("id", id_col)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
