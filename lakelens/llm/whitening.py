"""Whitening of vectors by principal components: a distributed centred scatter and cyclic Jacobi rotations.

Vectors are taken as integers, floor(256 c). The fit list, each distinct vector once, is written to the shared folder; one
pass over it counts and sums, the next sums products of centred vectors, each task giving one d x d matrix that further
tasks add in groups of FAN. The driver, which holds that one matrix, turns pairs of axes until what is off the diagonal
vanishes; rotations keep small eigenvalues accurate relative to their size on the diagonal. The whitening matrix, d by the
number of components, goes to the tasks that project all rows, and a last pass over the fit list measures its covariance.

Defined results: rows whose vector is null or holds null or non-finite entries are dropped; of vectors of several lengths,
missing last entries count as zeros; entries beyond 64 bits count as the nearest 64-bit ones; null and repeated ids and
repeated rows keep their rows; a component without variance (a relative 1e-12 of the largest or less) is whitened to 0 and is not
part of identity_error; a deviation beyond 64 bits is null; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.llm.common import arrow_schema, map_arrow
from lakelens.session import cut

SCALE = 256
#: Matrices that one task adds.
FAN = 64
#: Share of the largest eigenvalue below which a component counts as without variance, and sweeps of rotations at most.
FLAT = 1e-12
SWEEPS = 60
WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and x of the rows whose vector has only finite entries."""
    c = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    finite = F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), c.alias("c")).filter(F.col("c").isNotNull() & finite)
    return rows.select("vec_id", F.transform("c", lambda v: F.floor(v * SCALE).cast("long")).alias("x"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of integers of a list column, shorter ones filled with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy()
    if (lengths == d).all():
        return values.reshape(len(lengths), d)
    out = np.zeros((len(lengths), d), np.int64)
    out[np.arange(d) < lengths[:, None]] = values
    return out


class Fit(NamedTuple):
    """Number of vectors and their sums for each dimension, both exact."""

    n: int
    sums: list[int]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, whose integer part is taken off before anything is rounded."""
        whole = [s // self.n for s in self.sums]
        part = np.array([(s % self.n) / self.n for s in self.sums])
        if all(abs(w) < 1 << 62 for w in whole) and np.abs(x).max(initial=0) < 1 << 62:
            return (x - np.array(whole, np.int64)).astype(float) - part
        return np.array([[float(int(v) - w) for v, w in zip(row, whole, strict=True)] for row in x]).reshape(x.shape) - part

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2 in whole numbers; None where that needs more than 64 bits."""
        most = max(map(abs, self.sums), default=0) + self.n * int(np.abs(x).max(initial=0).astype(object))
        if most**2 * max(1, x.shape[1]) < 1 << 63:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x]
        return [e if e < 1 << 63 else None for e in exact]


def fit_sums(fit_list: DataFrame) -> Fit:
    """One row of exact sums for each task's dimension, added by Spark."""
    d = fit_list.agg(F.max(F.size("x"))).first()[0] or 0
    schema = arrow_schema("at int, n long, total string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * d
        for batch in batches:
            x = matrix(batch.column(0), d)
            part = x.sum(axis=0) if np.abs(x).max(initial=0) < 1 << 40 else x.astype(object).sum(axis=0)
            n, sums = n + len(x), [s + int(p) for s, p in zip(sums, part, strict=True)]
        # dimension -1 carries the number of vectors
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([n] * (d + 1)), pa.array([str(s) for s in (0, *sums)])], schema=schema)

    found = map_arrow(fit_list.select("x"), run, "at int, n long, total string")
    rows = found.groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # d + 1 rows
    total = {r["at"]: r for r in rows}
    return Fit(total[-1]["n"] if total else 0, [int(total[k]["total"]) for k in range(d)])


def _added(parts: DataFrame, size: int) -> np.ndarray:
    """Sum of the square matrices in ``parts`` (at, m: bytes), FAN of them in a task at a time."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, at = np.zeros(size * size), 0
        for batch in batches:
            for one in batch.column(1):
                total += np.frombuffer(one.as_buffer(), float)
            at = batch.column(0)[0].as_py() if batch.num_rows else at
        yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([total.tobytes()], pa.binary())], schema=arrow_schema("at long, m binary"))

    parts = cut(parts)
    while (n := parts.count()) > FAN:
        parts = cut(map_arrow(parts.repartition(-(-n // FAN)), add, "at long, m binary"))
    rows = parts.collect()  # FAN matrices at most
    return sum((np.frombuffer(r["m"], float) for r in rows), np.zeros(size * size)).reshape(size, size)


def covariance(fit_list: DataFrame, fit: Fit, onto: np.ndarray | None = None) -> np.ndarray:
    """Covariance (divisor n) of the centred vectors, or of their projections on the columns of ``onto``."""
    d = len(fit.sums)
    size = d if onto is None else onto.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            x = fit.centred(matrix(batch.column(0), d))
            x = x if onto is None else x @ onto
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([total.tobytes()], pa.binary())], schema=arrow_schema("at long, m binary"))

    return _added(map_arrow(fit_list.select("x"), run, "at long, m binary"), size) / fit.n


def jacobi(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns, by cyclic Jacobi rotations."""
    a, d = (v + v.T) / 2, len(v)
    q = np.eye(d)
    for _ in range(SWEEPS):
        turned = False
        for i in range(d - 1):
            for j in range(i + 1, d):
                off, left, right = a[i, j], a[i, i], a[j, j]
                if abs(off) <= np.finfo(float).eps * np.sqrt(abs(left)) * np.sqrt(abs(right)):  # rotations below it change nothing
                    continue
                turned = True
                theta = (right - left) / (2 * off)
                t = np.copysign(1.0, theta) / (abs(theta) + np.hypot(theta, 1.0))
                c = 1 / np.hypot(t, 1.0)
                s = t * c
                a[:, [i, j]] = a[:, [i, j]] @ (turn := np.array([[c, s], [-s, c]]))
                a[[i, j], :] = turn.T @ a[[i, j], :]
                a[i, i], a[j, j], a[i, j], a[j, i] = left - t * off, right + t * off, 0.0, 0.0
                q[:, [i, j]] = q[:, [i, j]] @ turn
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], q[:, order] / np.linalg.norm(q[:, order], axis=0)


class Whitening(NamedTuple):
    """What projects x: eigenvalues, unit eigenvectors over the roots of the eigenvalues, and what was measured."""

    fit: Fit
    values: np.ndarray
    axes: np.ndarray
    explained: np.ndarray
    identity_error: float


def fit_whitening(fit_list: DataFrame, components: int) -> Whitening | None:
    """Components of the written ``fit_list`` (x), as many as asked for or as there are dimensions; None if it is empty."""
    fit = fit_sums(fit_list)
    if not fit.n or not fit.sums:
        return None
    v = covariance(fit_list, fit)
    values, vectors = jacobi(v)
    k, trace = min(components, len(values)), float(np.trace(v))
    lives = values[:k] > max(0.0, FLAT * float(values[0]))
    axes = np.where(lives, vectors[:, :k] / np.sqrt(np.where(lives, values[:k], 1.0)), 0.0)
    error = 0.0
    if lives.any():
        error = float(np.abs(covariance(fit_list, fit, axes[:, lives]) - np.eye(int(lives.sum()))).max())
    return Whitening(fit, values[:k], axes, values[:k] / trace if trace > 0 else np.zeros(k), error)


def whiten(embeddings: DataFrame, components: int = 4) -> DataFrame:
    """Every row with finite entries on each component."""
    rows = integer_vectors(embeddings)
    model = fit_whitening(cut(rows.select("x").distinct()), components)
    if model is None:
        return rows.sparkSession.createDataFrame([], WHITENED)
    d, k = model.axes.shape
    schema = arrow_schema(WHITENED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), d)
            n = len(x)
            each = pa.array(np.repeat(np.arange(n), k))
            columns = [batch.column(0).take(each), np.tile(np.arange(1, k + 1, dtype=np.int32), n), np.full(n * k, model.fit.n), pa.array(model.fit.deviations(x), pa.int64()).take(each), (model.fit.centred(x) @ model.axes).ravel(), np.tile(model.explained, n), np.full(n * k, model.identity_error)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return map_arrow(rows, run, WHITENED)


def op11_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 4)
