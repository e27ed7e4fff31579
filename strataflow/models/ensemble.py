"""Combining models through their prediction and score columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..channels import EPSILON
from ..operators.scale import unit_range
from ..quantiles import quantiles
from ..session import materialise
from ..stats import gather, literal_table
from .common import linear


def inverse_error_weights(df: DataFrame, label: str, predictions: Mapping[str, str]) -> dict[str, float]:
    """Weights proportional to 1 / validation MAE; a member without predictions gets 0."""
    got = gather(df, {m: F.avg(F.abs(F.col(label) - F.col(c))) for m, c in predictions.items()})
    raw = {m: 0.0 if v is None or v != v else 1.0 / (v + EPSILON) for m, v in got.items()}
    total = sum(raw.values())
    return {m: w / total if total else 0.0 for m, w in raw.items()}


@dataclass
class WeightedEnsemble:
    """Fitted members and their weights; ``transform`` adds a column per member and the weighted mean."""

    members: dict[str, object]
    weights: dict[str, float]

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        for name, model in self.members.items():
            df = model.transform(df, output=name)
        return weighted_mean(df, {m: m for m in self.members}, self.weights, output)


def fit_weighted(
    df: DataFrame, fitters: Mapping[str, Callable[[DataFrame], object]], target: str, keys: Sequence[str], folds: int = 5
) -> WeightedEnsemble:
    """Members fitted on all rows, weighed by their error on rows that they had not seen (out-of-fold)."""
    from .evaluate import out_of_fold

    scored = out_of_fold(df, fitters, keys, folds, "_fold")
    weights = inverse_error_weights(scored, target, {m: m for m in fitters})
    return WeightedEnsemble({m: fitter(df) for m, fitter in fitters.items()}, weights)


def _weights(members: Mapping[str, str], weights: Mapping[str, float] | None) -> dict[str, float]:
    chosen = {m: 1.0 for m in members} if weights is None else {m: weights.get(m, 0.0) for m in members}
    total = sum(chosen.values())
    if not total:
        raise ValueError("no models available for prediction")
    return {m: w / total for m, w in chosen.items() if w > 0}


def weighted_mean(
    df: DataFrame, predictions: Mapping[str, str], weights: Mapping[str, float] | None = None, name: str = "prediction"
) -> DataFrame:
    used = _weights(predictions, weights)
    return df.withColumn(name, linear([(predictions[m], w) for m, w in used.items()]))


def contributions(
    df: DataFrame, predictions: Mapping[str, str], weights: Mapping[str, float], keep: Sequence[str] = ()
) -> DataFrame:
    """One row per sample and member: prediction and weight."""
    cells = [
        F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("prediction"), F.lit(float(weights.get(m, 0.0))).alias("weight"))
        for m, c in predictions.items()
    ]
    return df.select(*keep, F.explode(F.array(*cells)).alias("m")).select(*keep, "m.*")


def vote(
    df: DataFrame, predictions: Mapping[str, str], weights: Mapping[str, float] | None = None, name: str = "prediction"
) -> DataFrame:
    """1 where the weighted share of members that see a kick exceeds one half."""
    used = _weights(predictions, weights)
    return df.withColumn(name, (linear([(predictions[m], w) for m, w in used.items()]) > 0.5).cast("int"))


def mean_score(
    df: DataFrame, scores: Mapping[str, str], weights: Mapping[str, float] | None = None, name: str = "score"
) -> DataFrame:
    """Weighted mean of the members' scores, each mapped to 0..1; rows are stored once, as the scores are read for their range first."""
    used = _weights(scores, weights)
    work = unit_range(materialise(df), {scores[m]: f"_unit_{m}" for m in used})
    return work.withColumn(name, linear([(f"_unit_{m}", w) for m, w in used.items()])).drop(*[f"_unit_{m}" for m in used])


def threshold_table(df: DataFrame, label: str, score: str, candidates: int = 100) -> list[dict]:
    """Precision, recall and F1 at candidate percentiles 50 to 99.9 of the score.

    Rows are counted by how many thresholds they exceed, so the data is read once
    and ``candidates + 1`` counts return.
    """
    shares = [round(float(p) / 100, 12) for p in np.linspace(50, 99.9, candidates)]
    found = quantiles(df, [score], shares)[score]
    levels = sorted({v for v in found if v is not None})
    if not levels:
        return []
    splits = [float("-inf"), *[-v for v in reversed(levels)], float("inf")]
    cut = Bucketizer(splits=splits, inputCol="_down", outputCol="_above", handleInvalid="skip")
    rows = cut.transform(df.select(F.col(label).alias("y"), (-F.col(score).cast("double")).alias("_down")))
    counted = rows.groupBy("_above").agg(F.count_if(F.col("y") == 1).alias("p"), F.count(F.lit(1)).alias("n")).collect()
    positives, flagged = np.zeros(len(levels)), np.zeros(len(levels))
    for bucket, p, n in counted:
        exceeded = len(levels) - int(bucket)
        positives[:exceeded] += p
        flagged[:exceeded] += n
    total = sum(p for _, p, _ in counted)
    table = []
    for t, tp, n in zip(levels, positives, flagged):
        precision, recall = (tp / n if n else 0.0), (tp / total if total else 0.0)
        f1 = 2 * tp / (n + total) if n + total else 0.0
        table.append({"threshold": float(t), "precision": float(precision), "recall": float(recall), "f1": float(f1)})
    return table


def best_threshold(df: DataFrame, label: str, score: str, metric: str = "f1", candidates: int = 100) -> DataFrame:
    """The first candidate with the best value of ``metric``."""
    if metric not in ("f1", "recall", "precision"):
        raise ValueError(f"unknown metric {metric}")
    table = threshold_table(df, label, score, candidates)
    best = max(table, key=lambda t: t[metric])
    return literal_table(
        df.sparkSession, [(best["threshold"], best["precision"], best["recall"], best["f1"])],
        "threshold double, precision double, recall double, f1 double",
    )
