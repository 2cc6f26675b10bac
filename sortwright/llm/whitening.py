"""Whitening of embeddings by principal components from a cyclic Jacobi method.

Entries become integers (``floor(scale * c) + shift``), so sums do not depend on the order of partitions. Vectors are centred
by the integer next to their mean before they are multiplied; what the integer leaves of the mean, at most one half,
is taken off the sums exactly. So the scatter matrix is that of the centred vectors without rounding. It has one
row for each pair of dimensions and is all that reaches the driver, which turns it by Jacobi rotations, sweep after sweep over all pairs in
rounds of disjoint ones, until no entry off the diagonal matters beside its row's and column's; small eigenvalues
stay accurate. The whitening matrix goes back to the executors with the closure and a last pass measures the covariance of what it makes.

Sums travel as decimals of 38 places. Entries of 2^31 or more after scaling are refused, as their products would not fit.

Defined cases: vectors that are null, or hold a null or non-finite entry, are dropped, and so are those of another length
than the most frequent one (ties: the longest); repeated vectors and ids count as often as they stand, ids may be null; other columns are
ignored. Components whose eigenvalue is zero (below 1e-14 of the trace) cannot be whitened and are left out, as
with one vector or equal vectors; without vectors the result is empty. A deviation beyond a long is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Rows handled at a time.
ROWS = 2048
#: Scaled entries lie below this.
REACH = 2.0**31
LEAST = 1e-14


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and, in columns, unit eigenvectors of a symmetric positive semidefinite matrix, in no order.

    A sweep visits every pair once, in rounds of disjoint pairs as in a round-robin tournament; all
    rotations of a round are done together. It ends with a sweep that finds no pair to turn.
    """
    a = np.array(matrix, np.longdouble)
    n = len(a)
    vectors = np.eye(n, dtype=np.longdouble)
    if n < 2:
        return np.diag(a).copy(), vectors
    tiny = np.finfo(np.longdouble).eps
    seats = np.arange(n + n % 2)  # the last is a pause if n is odd
    floor = tiny * tiny * np.trace(a)
    for _ in range(sweeps):
        turned = False
        for _ in range(len(seats) - 1):
            p, q = seats[: len(seats) // 2], seats[len(seats) // 2 :][::-1]
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
            p, q = p[(p < n) & (q < n)], q[(p < n) & (q < n)]
            off, x, y = a[p, q], a[p, p], a[q, q]
            go = np.abs(off) > np.maximum(tiny * np.sqrt(np.abs(x * y)), floor)
            if not go.any():
                continue
            turned = True
            p, q, off, x, y = p[go], q[go], off[go], x[go], y[go]
            tau = (y - x) / (2 * off)
            t = np.where(tau >= 0, 1, -1) / (np.abs(tau) + np.sqrt(1 + tau * tau))
            c = 1 / np.sqrt(1 + t * t)
            s = t * c
            for m in (a, vectors):
                left, right = m[:, p].copy(), m[:, q]
                m[:, p], m[:, q] = c * left - s * right, s * left + c * right
            left, right = a[p].copy(), a[q]
            a[p], a[q] = c[:, None] * left - s[:, None] * right, s[:, None] * left + c[:, None] * right
            a[p, q] = a[q, p] = 0
        if not turned:
            break
    return np.diag(a).copy(), vectors


@dataclass
class Whitening:
    """What a fit found; ``components`` has a unit eigenvector in each row, by falling eigenvalue."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float
    covariance: np.ndarray

    @property
    def middle(self) -> np.ndarray:
        """The integers next to the means."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    @property
    def matrix(self) -> np.ndarray:
        """Projects a centred vector on the components, each scaled to variance one."""
        return self.components / np.sqrt(self.eigenvalues)[:, None]

    @property
    def explained(self) -> np.ndarray:
        return self.eigenvalues / self.trace


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows of ``vec_id`` and ``v`` whose vector has only finite entries and the most frequent length."""
    finite = F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = vectors.where(F.col("v").isNotNull() & finite)
    lengths = rows.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    return rows.where(F.size("v") == (lengths[0]["length"] if lengths else 0))


def _blocks(batches: Iterator[pa.RecordBatch], size: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows and their integers without the shift."""
    for batch in batches:
        for i in range(0, len(batch), ROWS):
            part = batch.slice(i, ROWS)
            found = np.floor(part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(part), size) * scale)
            if len(part) and np.abs(found).max(initial=0) >= REACH:
                raise ValueError(f"an entry is {REACH / scale} or more")
            yield part, found.astype(np.int64)


def _exact(y: np.ndarray) -> np.ndarray:
    """y' y in integers: in floating point while every sum stays below 2^53, else in Python's integers."""
    if float(np.abs(y).max(initial=0)) ** 2 * max(len(y), 1) < 2.0**53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    o = y.astype(object)
    return o.T.dot(o)


def _sums(size: int, scale: int, shift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(size, object)
        for _, x in _blocks(batches, size, scale):
            n, total = n + len(x), total + x.sum(axis=0).astype(object) + len(x) * shift
        yield pa.record_batch([pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array([str(t) for t in total])], names=["i", "n", "total"])

    return run


def _scatter(size: int, scale: int, shift: int, middle: np.ndarray):
    at = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size), object)
        for _, x in _blocks(batches, size, scale):
            total = total + _exact(x + (shift - middle))
        yield pa.record_batch([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array([str(t) for t in total[at]])], names=["i", "j", "total"])

    return run


def fit(vectors: DataFrame, size: int, scale: int = SCALE, shift: int = SHIFT, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the usable rows (see ``usable``), all of length ``size``; None without any variance."""
    only = vectors.select("v")
    # One row for each dimension, and then one for each pair of dimensions, comes to the driver.
    rows = only.mapInArrow(_sums(size, scale, shift), "i int, n long, total string").groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    rows = sorted((r["i"], r["n"], int(r["total"])) for r in rows)
    n, sums = (rows[0][1], [t for _, _, t in rows]) if rows else (0, [])
    if not n:
        return None
    middle = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    left = [s - n * int(m) for s, m in zip(sums, middle)]
    found = only.mapInArrow(_scatter(size, scale, shift, middle), "i int, j int, total string").groupBy("i", "j").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    covariance = np.zeros((size, size), np.longdouble)
    for r in found:
        i, j = r["i"], r["j"]
        whole = n * int(r["total"]) - left[i] * left[j]  # n^2 times the covariance
        covariance[i, j] = covariance[j, i] = _ratio(whole, n * n)
    trace = np.trace(covariance)
    if trace <= 0:
        return None
    values, columns = jacobi(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > LEAST * trace]
    own = columns[:, order].T
    own *= np.sign(own[np.arange(len(own)), np.abs(own).argmax(axis=1)])[:, None]
    return Whitening(n, sums, values[order].astype(np.float64), own.astype(np.float64), float(trace), covariance.astype(np.float64))


def _ratio(a: int, b: int) -> np.longdouble:
    """a / b with the precision of a long double."""
    exact = Fraction(a, b)
    high = float(exact)
    return np.longdouble(high) + np.longdouble(float(exact - Fraction(high)))


def _whitened(found: Whitening, scale: int, shift: int):
    size, n, k = len(found.sums), found.n, len(found.eigenvalues)
    middle = found.middle
    left = [s - n * int(m) for s, m in zip(found.sums, middle)]
    rest, matrix = np.array([float(Fraction(x, n)) for x in left]), found.matrix

    def deviations(y: np.ndarray) -> list[int | None]:
        if (float(np.abs(y).max(initial=0)) + 1.0) ** 2 * n * n * size < 2.0**62:
            d = n * y - np.array(left, np.int64)
            return (d * d).sum(axis=1).tolist()
        d = n * y.astype(object) - np.array(left, object)
        return [int(x) if x < 1 << 63 else None for x in (d * d).sum(axis=1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, size, scale):
            y = x + (shift - middle)
            w = (y - rest) @ matrix.T
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * k, pa.int32()), pa.array(np.ascontiguousarray(w).ravel()))
            yield pa.record_batch([part.column("vec_id"), pa.array(deviations(y), pa.int64()), lists], names=["vec_id", "deviation", "whitened"])

    return run


def _moments(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                part = batch.slice(i, ROWS).column("whitened")
                w = part.flatten().to_numpy().reshape(len(part), k)
                first, second = first + w.sum(axis=0), second + w.T @ w
        row, column = np.indices((k, k)).reshape(2, -1)
        yield pa.record_batch([pa.array(row, pa.int32()), pa.array(column, pa.int32()), pa.array(second.ravel()), pa.array(np.repeat(first, k))], names=["i", "j", "product", "total"])

    return run


def identity_error(whitened: DataFrame, found: Whitening) -> float:
    """The largest absolute entry of the covariance of the whitened rows minus the identity, measured on the rows."""
    n, k = found.n, len(found.eigenvalues)
    rows = whitened.select("whitened").mapInArrow(_moments(k), "i int, j int, product double, total double").groupBy("i", "j").agg(F.sum("product").alias("product"), F.sum("total").alias("total")).collect()
    mean = {r["i"]: r["total"] / n for r in rows}
    return max(abs(r["product"] / n - mean[r["i"]] * mean[r["j"]] - (r["i"] == r["j"])) for r in rows)


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE, shift: int = SHIFT, components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None]:
    """One row per usable vector: vec_id, deviation (squared distance of n times the vector from the sum of all) and
    whitened (its components in an array); and the fit."""
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")), "v")
    kind = "vec_id long, deviation long, whitened array<double>"
    first = rows.select(F.size("v").alias("size")).limit(1).collect()
    found = fit(rows, first[0]["size"], scale, shift, components) if first and first[0]["size"] else None
    if found is None:
        return spark.createDataFrame([], kind), None
    return rows.mapInArrow(_whitened(found, scale, shift), kind), found
