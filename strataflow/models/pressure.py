"""Latent-variable regressions: principal components and partial least squares.

Both end up as one linear expression over the input columns, so scoring is a plain
projection.  Only p × p matrices reach the driver.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import require_columns
from ..stats import literal_table
from .common import linear, principal_axes, second_moments


@dataclass
class LinearModel:
    """prediction = intercept + Σ coefficient · column, with the latent diagnostics."""

    kind: str
    features: list[str]
    target: str
    intercept: float
    coefficients: list[float]
    loadings: list[list[float]] = field(default_factory=list)
    component_weights: list[float] = field(default_factory=list)
    explained: list[float] = field(default_factory=list)

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        require_columns(df, self.features)
        return df.withColumn(output, linear(list(zip(self.features, self.coefficients)), self.intercept))

    def importance(self) -> list[tuple[str, float]]:
        pairs = [(f, abs(c)) for f, c in zip(self.features, self.coefficients)]
        return sorted(pairs, key=lambda t: (-t[1], t[0]))

    def coefficient_table(self, spark: SparkSession) -> DataFrame:
        return literal_table(spark, list(zip(self.features, self.coefficients)), "feature string, coefficient double")

    def loading_table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (f, f"PC{j + 1}", float(self.loadings[i][j]))
            for i, f in enumerate(self.features)
            for j in range(len(self.component_weights))
        ]
        return literal_table(spark, rows, "feature string, component string, loading double")

    def variance_table(self, spark: SparkSession) -> DataFrame:
        total = np.cumsum(self.explained)
        rows = [(f"PC{j + 1}", float(v), float(total[j])) for j, v in enumerate(self.explained)]
        return literal_table(spark, rows, "component string, explained double, cumulative double")

    def save(self, path: str, spark: SparkSession, **metadata: object) -> None:
        about = {"model": asdict(self), "metadata": metadata}
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(path: str, spark: SparkSession) -> "LinearModel":
        return LinearModel(**json.loads(spark.read.text(path).first()[0])["model"])


def _to_inputs(kind, features, target, mean, std, weights: np.ndarray, intercept: float, **extra) -> LinearModel:
    """Rewrite coefficients over scaled inputs as coefficients over the raw inputs."""
    raw = weights / np.where(std > 0, std, 1.0)
    return LinearModel(kind, list(features), target, float(intercept - mean @ raw), [float(v) for v in raw], **extra)


def _moments(df: DataFrame, features: list[str], target: str):
    """Scaled second moments of the inputs and their covariance with the target, in one pass."""
    known = require_columns(df, [*features, target]).select(
        *[F.col(c).cast("double").alias(c) for c in features], F.col(target).cast("double").alias(target)
    ).dropna()
    mean, std, correlation = second_moments(known, [*features, target])
    gram, cross = correlation[:-1, :-1], correlation[:-1, -1] * std[-1]
    return mean[:-1], std[:-1], gram, cross, mean[-1]


def fit_pcr(df: DataFrame, features: Sequence[str], target: str, components: int = 4) -> LinearModel:
    """Standardise, project on the leading principal components, ordinary least squares.

    The components are uncorrelated, so each has its own least-squares coefficient.
    """
    features = list(features)
    mean, std, gram, cross, middle = _moments(df, features, target)
    values, axes = principal_axes(gram)
    k = min(components, int((values > 1e-12).sum()))
    axes_k = axes[:, :k]
    gamma = (axes_k.T @ cross) / values[:k]
    return _to_inputs(
        "pcr", features, target, mean, std, axes_k @ gamma, middle, loadings=axes_k.tolist(),
        component_weights=[float(v) for v in gamma], explained=[float(v) for v in values[:k] / values.sum()],
    )


def fit_pls(df: DataFrame, features: Sequence[str], target: str, components: int = 4) -> LinearModel:
    """Partial least squares on the same moments."""
    features = list(features)
    p = len(features)
    mean, std, gram, cross, middle = _moments(df, features, target)
    directions, loads, gains = [], [], []
    for _ in range(min(components, p)):
        length = np.linalg.norm(cross)
        if length < 1e-12:
            break
        w = cross / length
        r = w.copy()
        for d, load in zip(directions, loads):
            r = r - (load @ w) * d
        spread = r @ gram @ r
        if spread < 1e-12:
            break
        load, gain = gram @ r / spread, (r @ cross) / spread
        cross = cross - load * gain * spread
        directions.append(r)
        loads.append(load)
        gains.append(gain)
    weights = np.array(directions).T @ np.array(gains) if directions else np.zeros(p)
    return _to_inputs(
        "pls", features, target, mean, std, weights, middle,
        loadings=np.array(loads).T.tolist() if loads else [], component_weights=[float(g) for g in gains],
    )


def explained_variance(df: DataFrame, features: Sequence[str], components: int = 10) -> DataFrame:
    """Explained and cumulative variance of the principal components of scaled columns."""
    features = list(features)
    values, _ = principal_axes(second_moments(require_columns(df, features).dropna(), features)[2])
    shares = (values / values.sum())[:components]
    rows = [(f"PC{j + 1}", float(v), float(c)) for j, (v, c) in enumerate(zip(shares, np.cumsum(shares)))]
    return literal_table(df.sparkSession, rows, "component string, explained double, cumulative double")
