"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred points, in blocks of right vectors.

The fit list X (each distinct point once, centred) stays distributed.  From an orthonormal block V1 the recursion

    X Vj  = U(j-1) T(j-1)' + Uj Aj          X' Uj = Vj Aj' + V(j+1) Tj

alternates one pass for X V and one for X' U.  A left block Uj has a row per point and is never gathered or written: it equals X Pj for a
small matrix Pj, so a task makes the rows it needs from its own points.  Both sides are reorthogonalised in full, twice: the left side
through the sums U'Z and Z'Z that a pass brings along, the right side on the driver.  The coefficients form an upper (block) bidiagonal
matrix whose singular values and vectors give the components.  ``block=1`` is the plain vector recursion with two passes per component
direction; the default of 16 needs 16 times fewer passes over the points for the same space.

The recursion ends when the right vectors span the whole space (exact then), when they hold all of the variance, or when the residuals of
the wanted triplets are below ``TOLERANCE`` of the largest singular value.  Driver and tasks hold d x k matrices for d dimensions and k
right vectors, k at most d: bounded by the dimension alone.  Every sum is over points centred exactly: with integer points,
n*x - S is an integer.

Defined cases: rows whose vector is null or empty, or has a null or non-finite entry, are left out; repeated points count once in the fit;
vectors of several lengths are refused with a ValueError.  Components without variance (below ``NOTHING`` of the largest) cannot be scaled
and are left out, so a table of one distinct point, like an empty one, gives no rows.  Signs are fixed by the largest entry of a component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickloom.llm.text import bounded, stored

COMPONENTS, BLOCK = 16, 16
TOLERANCE, NOTHING = 1e-12, 1e-13


@dataclass(frozen=True)
class Whitening:
    """``basis`` (d x k) and ``variance`` (k) of the components; ``count`` and ``sums`` of the fit list, ``total`` is its variance."""
    count: int
    sums: np.ndarray
    basis: np.ndarray
    variance: np.ndarray
    total: float
    identity_error: float


def usable(vector: Column) -> Column:
    """Whether a vector is there, has entries, and all of them are finite."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & fine


def grid(vector: Column, scale: int, shift: int = 0) -> Column:
    """floor(scale * c) + shift of every entry, as long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long") + F.lit(shift).cast("long"))


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list<int64> column without nulls as a matrix."""
    rows = len(column)
    if not rows:
        return np.zeros((0, 0), dtype=np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths != lengths[0]).any():
        raise ValueError("vectors of several lengths")
    return flat.reshape(rows, lengths[0])


def _shifted(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n*x - S, exact: int64 where that is wide enough, else Python's integers."""
    if n * (int(np.abs(x).max(initial=0)) + int(np.abs(sums).max(initial=0)) // max(n, 1) + 1) < 1 << 62:
        return x * n - sums
    return x.astype(object) * n - sums.astype(object)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (_shifted(x, n, sums) / n).astype(np.float64)


def _summed(points: DataFrame, make: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """The sum of ``make`` over blocks of points.  Tasks add up their own blocks, sums meet per entry; the driver gets one array."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                part = make(matrix(b.column(0)))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "v"])

    got = bounded(points).select("x").mapInArrow(run, f"i int, v {kind}").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(got), dtype=np.int64 if kind == "long" else np.float64)
    for i, v in got:
        out[i] = v
    return out


def _factor(gram: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(A, C) with A'A = gram on what is larger than ``least``, and Z C orthonormal for a Z whose Gram matrix this is."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    keep = values > least
    root = np.sqrt(values[keep])
    return root[:, None] * vectors[:, keep].T, vectors[:, keep] / root


def _away(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """``v`` without its part in the span of ``basis``; a second round removes what rounding left."""
    for _ in range(2):
        v = v - basis @ (basis.T @ v)
    return v


def _right(x: np.ndarray, small: tuple) -> list[np.ndarray]:
    p, z = small
    y = x @ z
    return [(x @ p).T @ y, y.T @ y]


def _left(x: np.ndarray, small: tuple) -> list[np.ndarray]:
    p, z = small
    u = x @ z
    return [x.T @ u, (x @ p).T @ u, u.T @ u]


def _gram(x: np.ndarray, small: tuple) -> list[np.ndarray]:
    y = x @ small[0]
    return [y.T @ y]


class _Bidiagonal:
    """State of the recursion: right vectors V, left vectors as P, the matrix B, and the products over the points."""

    def __init__(self, spark: SparkSession, points: DataFrame, n: int, sums: np.ndarray, total: float, block: int):
        self.spark, self.points, self.n, self.sums, self.total = spark, points, n, sums, total
        self.d, self.block, self.random = len(sums), min(block, len(sums)), np.random.default_rng(20)
        self.v, self.p, self.b = np.zeros((self.d, 0)), np.zeros((self.d, 0)), np.zeros((0, 0))
        self.least = total * n * NOTHING * 0.01

    def _product(self, make: Callable[[np.ndarray, tuple], list[np.ndarray]], *small: np.ndarray) -> np.ndarray:
        n, sums, shared = self.n, self.sums, self.spark.sparkContext.broadcast(small)

        def of(x: np.ndarray) -> np.ndarray:
            return np.concatenate([m.ravel() for m in make(_centred(x, n, sums), shared.value)])

        try:
            return _summed(self.points, of, "double")
        finally:
            shared.unpersist()

    def fresh(self, k: int, beside: np.ndarray) -> np.ndarray:
        """Up to k orthonormal directions outside V and ``beside``."""
        held = np.hstack((self.v, beside))
        k = min(k, self.d - held.shape[1])
        v = self.random.standard_normal((self.d, k))
        for _ in range(2 if k else 0):
            v = np.linalg.qr(_away(v, held))[0]
        return v

    def step(self, v: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Take the block ``v``, which hangs on the left vectors before it by ``t``; return the next one and its own ``t``."""
        k, m, before = self.p.shape[1], v.shape[1], t.shape[1]
        z = v - self.p[:, k - before:] @ t.T
        # X V: with the left vectors so far, and with itself.
        got = self._product(_right, self.p, z)
        c, gram = got[:k * m].reshape(k, m), got[k * m:].reshape(m, m)
        a, scale = _factor(gram - c.T @ c, self.least)
        z, r = (z - self.p @ c) @ scale, a.shape[0]
        w, c2, a2 = np.zeros((self.d, r)), np.zeros((k, r)), np.zeros((r, r))
        if r:
            # X' U: the same products come again, and what rounding left of them is taken off.
            got = self._product(_left, self.p, z)
            w, c2, gram = got[:self.d * r].reshape(self.d, r), got[self.d * r:-r * r].reshape(k, r), got[-r * r:].reshape(r, r)
            a2, scale = _factor(gram - c2.T @ c2, 0.0)
            z, w = (z - self.p @ c2) @ scale, w @ scale
        b = np.zeros((k + r, self.v.shape[1] + m))
        b[:k, :-m], b[:k, -m:], b[k:, -m:] = self.b, c + c2 @ a, a2 @ a
        b[k - before:k, -m:] += t.T
        self.b, self.v, self.p = b, np.hstack((self.v, v)), np.hstack((self.p, z))
        y, t = np.zeros((self.d, 0)), np.zeros((0, r))
        if r:
            y, s, q = np.linalg.svd(_away(w, self.v), full_matrices=False)
            keep = s > 0.01 * TOLERANCE * np.sqrt(self.total * self.n)
            y, t = _away(y[:, keep], self.v), s[keep, None] * q[keep]
        # A block is filled up with fresh directions; without them a value that several components share could stay unseen.
        more = self.fresh(self.block - y.shape[1], y)
        return np.hstack((y, more)), np.vstack((t, np.zeros((more.shape[1], r))))

    def triplets(self, k: int, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """The k largest singular values, their right vectors, and the largest residual of them."""
        q, s, z = np.linalg.svd(self.b, full_matrices=False)
        last = q[self.b.shape[0] - t.shape[1]:, :k]
        return s[:k], (self.v @ z[:k].T), float(np.linalg.norm(t @ last, axis=0).max(initial=0.0)) if t.size else 0.0


def fit(points: DataFrame, components: int = COMPONENTS, block: int = BLOCK) -> Whitening | None:
    """Components of the distinct points of the long array column ``x``; None where there are none."""
    spark = points.sparkSession
    points = stored(points.select("x").distinct(), "points")
    least, most = points.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if least != most:
        raise ValueError(f"vectors of several lengths: {least} to {most}")
    sums = _summed(points, lambda x: np.concatenate(([len(x)], x.sum(axis=0))), "long")
    if not len(sums):
        return None
    n, sums = int(sums[0]), sums[1:]
    total = float(_summed(points, lambda x: np.array([np.square(_centred(x, n, sums)).sum()]), "double")[0]) / n
    if total == 0.0:
        return None
    state = _Bidiagonal(spark, points, n, sums, total, block)
    v = state.fresh(state.block, state.v)
    t = np.zeros((v.shape[1], 0))
    while True:
        v, t = state.step(v, t)
        values, basis, residual = state.triplets(components, t)
        whole = np.square(state.b).sum() >= total * n * (1 - 1e-13)
        if not v.shape[1] or whole or (len(values) == components and residual <= TOLERANCE * values[0]):
            break
    variance = np.square(values) / n
    keep = variance > NOTHING * variance[0]
    variance, basis = variance[keep], basis[:, keep]
    basis = basis * np.where(basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])] < 0, -1.0, 1.0)
    k, scaled = len(variance), basis / np.sqrt(variance)
    cov = state._product(_gram, scaled).reshape(k, k) / n
    return Whitening(n, sums, basis, variance, total, float(np.abs(cov - np.eye(k)).max()))


def whiten(rows: DataFrame, model: Whitening | None, key: str = "vec_id") -> DataFrame:
    """One row per row of ``rows`` (key, x) and component: its whitened coordinate, and the row's exact deviation as decimal."""
    schema = (f"`{key}` {rows.schema[key].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, "
              "explained double, identity_error double")
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        k, scaled, part = len(w.variance), w.basis / np.sqrt(w.variance), w.variance / w.total
        for b in batches:
            m = b.num_rows
            if not m:
                continue
            x = _shifted(matrix(b.column(1)), w.count, w.sums)
            wide = x.dtype == object or int(np.abs(x).max(initial=0)) ** 2 * x.shape[1] >= 1 << 62
            square = np.square(x.astype(object) if wide else x).sum(axis=1)
            deviation = pa.array([Decimal(int(s)) for s in square], pa.decimal128(38, 0))
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                 pa.array(np.full(m * k, w.count, dtype=np.int64)), deviation.take(each),
                 pa.array(((x / w.count).astype(np.float64) @ scaled).ravel()), pa.array(np.tile(part, m)),
                 pa.array(np.full(m * k, w.identity_error))],
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return bounded(rows.select(key, "x")).mapInArrow(run, schema)


def report(embeddings: DataFrame, components: int = COMPONENTS, block: int = BLOCK) -> DataFrame:
    """Whitened coordinates of all usable rows of (vec_id, embedding), on the grid floor(64*c) + 1000000."""
    rows = embeddings.where(usable(F.col("embedding"))).select("vec_id", grid(F.col("embedding"), 64, 1_000_000).alias("x"))
    return whiten(rows, fit(rows, components, block)).withColumn("deviation", F.col("deviation").cast("long"))
