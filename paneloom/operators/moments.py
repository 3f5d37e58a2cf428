"""Means and cross products of vector columns, and the principal components that follow from them.

Tasks reduce their rows to one small matrix each; its cells are summed by Spark, so no task sees
more than its share of them. Only the k x k matrix of k columns reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Moments:
    """Number of rows, means and sample covariances of the components of a vector."""

    n: int
    mean: np.ndarray
    covariance: np.ndarray

    @property
    def deviation(self) -> np.ndarray:
        """Population standard deviations."""
        return np.sqrt(np.diag(self.covariance) * (self.n - 1) / max(self.n, 1))

    @property
    def correlation(self) -> np.ndarray:
        d = np.sqrt(np.diag(self.covariance))
        safe = np.where(d > 0, d, 1.0)
        return self.covariance / safe[:, None] / safe[None, :]


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        if len(batch):
            yield batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)


def moments(df: DataFrame, vector: Column) -> Moments:
    """Moments of an array expression of doubles (runs two aggregates now); rows with a null, or a null inside, are left out."""
    rows = df.select(vector.cast("array<double>").alias("v")).where("v is not null and not exists(v, x -> x is null or isnan(x))")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for m in _matrices(batches):
            total, n = (0 if total is None else total) + m.sum(0), n + len(m)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total), pa.array(np.full(len(total), n))], names=["i", "s", "n"])

    first = rows.mapInArrow(sums, "i long, s double, n long").groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    size = len(first)
    mean, n = np.zeros(size), int(first[0]["n"]) if first else 0
    for r in first:
        mean[r["i"]] = r["s"] / r["n"]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for m in _matrices(batches):
            total += (m - mean).T @ (m - mean)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size)), pa.array(total.ravel())], names=["i", "s"])

    cells = rows.mapInArrow(products, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect() if size else []
    covariance = np.zeros(size * size)
    for r in cells:
        covariance[r["i"]] = r["s"] / max(n - 1, 1)
    return Moments(n, mean, covariance.reshape(size, size))


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (largest first) and eigenvectors (columns) of a symmetric matrix, by plane rotations."""
    a, v = np.array(matrix, float), np.eye(len(matrix))
    scale = max(float(np.abs(a).max()), 1e-300) if a.size else 1.0
    for _ in range(sweeps):
        off = np.abs(np.triu(a, 1))
        if not off.size or off.max() <= 1e-15 * scale:
            break
        for p in range(len(a) - 1):
            for q in range(p + 1, len(a)):
                if abs(a[p, q]) <= 1e-18 * scale:
                    continue
                theta = (a[q, q] - a[p, p]) / (2 * a[p, q])
                t = (1.0 if theta >= 0 else -1.0) / (abs(theta) + np.hypot(theta, 1.0))
                c = 1 / np.hypot(t, 1.0)
                turn = np.array([[c, t * c], [-t * c, c]])
                a[:, [p, q]] = a[:, [p, q]] @ turn
                a[[p, q], :] = turn.T @ a[[p, q], :]
                v[:, [p, q]] = v[:, [p, q]] @ turn
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], v[:, order]


def first_component(df: DataFrame, cols: Sequence[str], out: str) -> DataFrame:
    """Adds the score on the first principal component of the standardised columns; its largest loading is positive.

    Rows with a null in ``cols`` get a null score and take no part in the fit. Rows are only projected.
    """
    m = moments(df, F.array(*cols))
    if not m.n:
        return df.withColumn(out, F.lit(None).cast("double"))
    loading = jacobi(m.correlation)[1][:, 0]
    if loading[np.argmax(np.abs(loading))] < 0:
        loading = -loading
    terms = [
        (F.col(c).cast("double") - float(mean)) * float(w / d) for c, mean, w, d in zip(cols, m.mean, loading, m.deviation) if d > 0
    ]
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    return df.withColumn(out, F.when(known, reduce(lambda a, b: a + b, terms, F.lit(0.0))))


def explained_variance(df: DataFrame, vector: str, k: int) -> list[float]:
    """Share of variance of each of the ``k`` leading principal components of an array column."""
    values = np.clip(jacobi(moments(df, F.col(vector)).covariance)[0], 0, None)
    total = values.sum()
    return [float(x / total) if total else 0.0 for x in values[:k]]
