"""Shared pieces of the model estimators."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from ..stats import gather

FEATURES = "features"


def assemble(df: DataFrame, columns: Sequence[str], output: str = FEATURES) -> DataFrame:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"Missing features: {absent}")
    return VectorAssembler(inputCols=list(columns), outputCol=output, handleInvalid="error").transform(df)


def linear(terms: Sequence[tuple[str | Column, float]], intercept: float = 0.0) -> Column:
    """Σ weight·column + intercept as one expression."""
    total = F.lit(float(intercept))
    for c, w in terms:
        total = total + (F.col(c) if isinstance(c, str) else c) * F.lit(float(w))
    return total


WIDE = 60


def second_moments(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, population deviations and correlation matrix of complete rows.

    Up to ``WIDE`` columns this is one aggregation; wider sets use the vector form.
    """
    p = len(columns)
    wanted = {("m", c): F.avg(c) for c in columns} | {("s", c): F.stddev_pop(c) for c in columns}
    if p <= WIDE:
        wanted |= {(i, j): F.covar_pop(columns[i], columns[j]) for i in range(p) for j in range(i)}
    got = gather(df, wanted)
    if any(got["m", c] is None for c in columns):
        raise ValueError("no complete rows to fit on")
    mean = np.array([got["m", c] for c in columns], dtype=float)
    std = np.array([got["s", c] for c in columns], dtype=float)
    safe = np.where(std > 0, std, 1.0)
    correlation = np.diag((std > 0).astype(float))
    if p <= WIDE:
        for i in range(p):
            for j in range(i):
                correlation[i, j] = correlation[j, i] = got[i, j] / (safe[i] * safe[j])
    else:
        found = Correlation.corr(assemble(df, columns, "_wide"), "_wide").first()[0].toArray()
        correlation = np.where(np.isnan(found), correlation, found)
    return mean, std, correlation


def principal_axes(correlation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues from the largest down and their unit vectors, largest entry positive."""
    values, vectors = np.linalg.eigh(correlation)
    values, vectors = values[::-1], vectors[:, ::-1]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), range(len(values))])
    return np.maximum(values, 0.0), vectors * np.where(signs == 0, 1.0, signs)


#: Rows of a task that fits trees: it holds them in memory.
ROWS_PER_TASK = 500_000


def stored(df: DataFrame) -> DataFrame:
    """Rows that are read many times, written once and dealt to tasks of bounded size whatever the files' sizes."""
    kept = materialise(df)
    parts = -(-kept.count() // ROWS_PER_TASK)
    return kept.repartition(parts) if parts > kept.rdd.getNumPartitions() else kept


def at_least_parallel(df: DataFrame) -> DataFrame:
    """Spread rows for costly Python scoring when the input has fewer partitions than cores."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
