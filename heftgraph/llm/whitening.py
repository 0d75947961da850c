"""Whitening of embeddings: Welford statistics of distinct vectors, symmetric QR, projection of every row.

A component c of a vector becomes the integer floor(256 c). Every distinct integer vector counts once
in the fit. Each task of the fit runs over its vectors and updates count, mean and the matrix of
centred products by one rank-one step a vector; the tasks' rows are merged by the parallel update
formula, MERGED at a time, until few are left for the driver, which solves the d x d eigenproblem by
Householder reduction and QR steps with Wilkinson's shift. A second run of the same kind over the
whitened vectors of the fit gives identity_error. All rows are then projected where they are read,
without a shuffle. What the driver and a task hold is a few d x d matrices, whatever the number of rows.

Results for odd input: rows whose vector is null or holds a null, NaN or infinite entry are left out;
floors beyond a long are its bounds; shorter vectors are filled up with 0 to the longest one's width,
and vectors of no entries at all have no components and so no rows; repeated rows and rows of null or
equal vec_id stand for themselves; other columns aren't read. A component without variance has null
in whitened (and null in explained, if there is no variance at all) and takes no part in
identity_error, which is null if no component has any. deviation is null where it is beyond a long;
deviation_wide holds it up to 38 digits, and is null beyond. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heftgraph.llm.common import bounded_batches, column, settle

#: Rows of statistics that one task, or at the end the driver, merges.
MERGED = 16
PARTIAL = "part long, n long, sums array<decimal(38,0)>, mean binary, products binary"
WHITENED = "vec_id long, component int, n long, deviation long, deviation_wide decimal(38,0), whitened double, explained double, identity_error double"


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, x (array of longs) of the rows that take part, all of one width."""
    bounded_batches(vectors.sparkSession)
    e = F.col("embedding").cast("array<double>")
    bad = F.exists(e, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("embedding").isNotNull() & ~bad)
    least, most = good.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    x = F.transform(e, lambda c: F.floor(c * 256).cast("long"))
    if least != most:
        x = F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(most) - F.size("embedding")))
    return good.select("vec_id", x.alias("x")).filter(F.size("x") > 0)


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The integer vectors of a batch as rows."""
    lists = column(batch, "x")
    return lists.flatten().to_numpy().reshape(len(lists), -1)


class Moments:
    """Count, exact sums, mean and centred products of vectors."""

    def __init__(self, width: int):
        self.n, self.sums = 0, [0] * width
        self.mean, self.products = np.zeros(width), np.zeros((width, width))
        self._step = np.empty((width, width))

    def add(self, row: np.ndarray) -> None:
        """Welford's update by one vector."""
        self.n += 1
        before = row - self.mean
        self.mean += before / self.n
        np.multiply(before[:, None], (row - self.mean)[None, :], out=self._step)
        self.products += self._step

    def merge(self, other: Moments) -> None:
        """The parallel update by the statistics of other vectors."""
        n = self.n + other.n
        if other.n:
            apart = other.mean - self.mean
            self.mean = self.mean + apart * (other.n / n)
            self.products = self.products + other.products + np.outer(apart, apart) * (self.n * (other.n / n))
            self.sums = [a + b for a, b in zip(self.sums, other.sums, strict=True)]
            self.n = n

    def covariance(self) -> np.ndarray:
        return (self.products + self.products.T) / (2 * self.n)

    def row(self, part: int) -> pa.RecordBatch:
        sums = pa.array([[Decimal(s) for s in self.sums]], pa.list_(pa.decimal128(38, 0)))
        arrays = [pa.array([part], pa.int64()), pa.array([self.n], pa.int64()), sums, pa.array([self.mean.tobytes()], pa.binary()), pa.array([self.products.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["part", "n", "sums", "mean", "products"])


def _moments(n: int, sums: list, mean: bytes, products: bytes) -> Moments:
    out = Moments(len(sums))
    out.n, out.sums, out.mean = n, [int(s) for s in sums], np.frombuffer(mean).copy()
    out.products = np.frombuffer(products).reshape(len(sums), len(sums)).copy()
    return out


def _exact_sums(x: np.ndarray) -> list[int]:
    if len(x) and max(abs(int(x.min())), abs(int(x.max()))) * len(x) >= 1 << 62:
        x = x.astype(object)
    return [int(s) for s in x.sum(axis=0)]


def _merged(rows: list) -> Moments:
    first, *others = (_moments(*r) for r in rows)
    for x in others:
        first.merge(x)
    return first


def moments(vectors: DataFrame, seen) -> Moments | None:
    """Statistics of what seen makes of the integer vectors x (rows of doubles), None without rows."""

    def run(batches: Iterator[pa.RecordBatch]):
        held = None
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch)
                rows = seen(x)
                held = held or Moments(rows.shape[1])
                if rows.shape[1] == x.shape[1]:
                    held.sums = [a + b for a, b in zip(held.sums, _exact_sums(x), strict=True)]
                for row in rows:
                    held.add(row)
        if held:
            yield held.row(TaskContext.get().partitionId())

    def merge(_, part: pa.Table) -> pa.Table:
        rows = sorted(part.to_pylist(), key=lambda r: r["part"])
        return pa.Table.from_batches([_merged([(r["n"], r["sums"], r["mean"], r["products"]) for r in rows]).row(rows[0]["part"] // MERGED)])

    parts = settle(vectors.mapInArrow(run, PARTIAL), "moments")
    while parts.count() > MERGED:
        # the numbers of parts that saw no rows are missing, so a group may be smaller, but never larger
        parts = settle(parts.groupBy(F.expr(f"part div {MERGED}")).applyInArrow(merge, PARTIAL), "moments")
    rows = parts.orderBy("part").collect()
    return _merged([(r["n"], r["sums"], r["mean"], r["products"]) for r in rows]) if rows else None


def _tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal, and the rows of Q^T of a = Q T Q^T, by Householder reflections."""
    a, n = a.copy(), len(a)
    basis = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        length = np.sqrt(v @ v)
        if length == 0 or not np.any(v[1:]):
            continue
        v[0] += np.copysign(length, v[0])
        v /= np.sqrt(v @ v)
        rest = a[k + 1 :, k + 1 :]
        w = rest @ v
        w = 2 * (w - (v @ w) * v)
        rest -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
        basis[k + 1 :] -= 2 * np.outer(v, v @ basis[k + 1 :])
    return np.diag(a).copy(), np.diag(a, -1).copy(), basis


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as rows, of a symmetric matrix."""
    scale = float(np.abs(a).max(initial=0.0))
    if not scale:
        return np.zeros(len(a)), np.eye(len(a))
    d, e, z = _tridiagonal(np.asarray(a, np.float64) / scale)
    hi, steps, eps = len(d) - 1, 0, np.finfo(np.float64).eps
    while hi > 0:
        e[np.abs(e) <= eps * (np.abs(d[:-1]) + np.abs(d[1:])) + 1e-300] = 0
        if e[hi - 1] == 0:
            hi -= 1
            continue
        lo = hi - 1
        while lo > 0 and e[lo - 1] != 0:
            lo -= 1
        steps += 1
        if steps > 60 * len(d):
            raise ArithmeticError("the QR steps don't converge")
        half = (d[hi - 1] - d[hi]) / 2
        shift = d[hi] - e[hi - 1] ** 2 / (half + np.copysign(np.hypot(half, e[hi - 1]), half))
        x, y = d[lo] - shift, e[lo]
        for k in range(lo, hi):
            r = np.hypot(x, y)
            c, s = (x / r, -y / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            p, q, off = d[k], d[k + 1], e[k]
            d[k] = c * c * p - 2 * c * s * off + s * s * q
            d[k + 1] = s * s * p + 2 * c * s * off + c * c * q
            e[k] = c * s * (p - q) + (c * c - s * s) * off
            if k < hi - 1:
                x, y = e[k], -s * e[k + 1]
                e[k + 1] *= c
            z[k], z[k + 1] = c * z[k] - s * z[k + 1], s * z[k] + c * z[k + 1]
    order = np.argsort(-d, kind="stable")
    return d[order] * scale, z[order] / np.sqrt((z[order] ** 2).sum(axis=1, keepdims=True))


class Whitener:
    """The first components of a fit."""

    def __init__(self, fit: Moments, most: int):
        values, vectors = symmetric_qr(fit.covariance())
        k = min(most, len(values))
        self.n, self.sums, self.trace = fit.n, fit.sums, float(np.trace(fit.covariance()))
        self.values, self.vectors = values[:k], vectors[:k]
        # what rounding leaves of a component without variance
        self.live = self.values > max(float(values[0]), 0.0) * len(values) * np.finfo(np.float64).eps
        self.error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: longs where they fit, else Python's integers."""
        top = max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
        bound = self.n * top + max(map(abs, self.sums))
        if bound * bound * max(x.shape[1], 1) < 1 << 63:
            return self.n * x - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        """Values of the components that have variance."""
        return ((centred / self.n).astype(np.float64) @ self.vectors[self.live].T) / np.sqrt(self.values[self.live])

    def rows(self, ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        m, k = len(x), len(self.values)
        apart = self.centred(x)
        squares = (apart * apart).sum(axis=1)
        if apart.dtype == object:
            deviation = pa.array([int(s) if s < 1 << 63 else None for s in squares], pa.int64())
            wide = pa.array([Decimal(int(s)) if s < 10**38 else None for s in squares], pa.decimal128(38, 0))
        else:
            deviation = pa.array(squares, pa.int64())
            wide = deviation.cast(pa.decimal128(38, 0))
        values = np.full((m, k), np.nan)
        values[:, self.live] = self.whitened(apart)
        each = pa.array(np.repeat(np.arange(m), k))
        dead = np.tile(~self.live, m)
        explained = np.tile(self.values / self.trace if self.trace else np.zeros(k), m)
        arrays = [ids.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, self.n)), deviation.take(each), wide.take(each), pa.array(values.ravel(), mask=dead)]
        arrays += [pa.array(explained, mask=np.full(m * k, not self.trace)), pa.array([self.error] * (m * k), pa.float64())]
        return pa.RecordBatch.from_arrays(arrays, names=["vec_id", "component", "n", "deviation", "deviation_wide", "whitened", "explained", "identity_error"])


def fitted(x: DataFrame, most: int) -> Whitener | None:
    """The first components of the distinct vectors of x, None without vectors."""
    distinct = settle(x.select("x").distinct(), "distinct-vectors")
    found = moments(distinct, lambda v: v.astype(np.float64))
    if found is None:
        return None
    model = Whitener(found, most)
    if model.live.any():
        seen = moments(distinct, lambda v: model.whitened(model.centred(v)))
        model.error = float(np.abs(seen.covariance() - np.eye(int(model.live.sum()))).max())
    return model


def whiten(vectors: DataFrame, most: int = 4) -> DataFrame:
    """A row for every vector and each of the first components, see WHITENED."""
    spark = vectors.sparkSession
    x = integer_vectors(vectors)
    model = fitted(x, most)
    if model is None:
        return spark.createDataFrame([], WHITENED)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if batch.num_rows:
                yield model.rows(column(batch, "vec_id"), matrix(batch))

    return x.mapInArrow(run, WHITENED)
