"""Regressors and classifiers: Spark ML estimators behind one fit/transform surface."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import classification as mc
from pyspark.ml import regression as mr
from pyspark.ml.base import Estimator
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import require_columns
from ..stats import gather, literal_table
from .common import FEATURES, assemble, stored

# fixed values: published default hyper-parameters
BOOSTING = {"maxIter": 100, "maxDepth": 6, "stepSize": 0.1, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}
FOREST = {"numTrees": 200, "maxDepth": 10}
SEED = 42


@dataclass
class FittedModel:
    """A fitted Spark ML model with its input columns."""

    kind: str
    features: list[str]
    model: object
    target: str
    score: bool = False

    def transform(self, df: DataFrame, output: str = "prediction", score: str | None = None) -> DataFrame:
        require_columns(df, self.features)
        vector = "_features_in"
        scored = self.model.copy(
            {self.model.featuresCol: vector, self.model.predictionCol: "_predicted"}
        ).transform(assemble(df, self.features, vector))
        added = {output: F.col("_predicted")}
        if score:
            added[score] = self._positive(scored)
        keep = [F.col(c) for c in df.columns if c not in added]
        return scored.select(*keep, *[c.alias(n) for n, c in added.items()])

    def _positive(self, scored: DataFrame):
        from pyspark.ml.functions import vector_to_array

        column = "probability" if "probability" in scored.columns else "rawPrediction"
        return vector_to_array(F.col(column))[1]

    def importance(self) -> list[tuple[str, float]]:
        """Tree importances, or absolute coefficients, largest first."""
        if hasattr(self.model, "featureImportances"):
            values = self.model.featureImportances.toArray()
        elif hasattr(self.model, "coefficients"):
            values = np.abs(self.model.coefficients.toArray())
        else:
            raise ValueError(f"{self.kind} has no feature importances")
        return sorted(zip(self.features, map(float, values)), key=lambda t: (-t[1], t[0]))

    def importance_table(self, spark: SparkSession, k: int | None = None) -> DataFrame:
        return literal_table(spark, self.importance()[:k], "feature string, importance double")

    def save(self, path: str, spark: SparkSession, **metadata: object) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        about = {
            "kind": self.kind, "features": self.features, "target": self.target,
            "class": f"{type(self.model).__module__}.{type(self.model).__name__}", "metadata": metadata,
        }
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load_model(path: str, spark: SparkSession) -> FittedModel:
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    reader = DefaultParamsReader.loadParamsInstance(f"{path}/model", spark)
    return FittedModel(about["kind"], about["features"], reader, about["target"])


def model_metadata(path: str, spark: SparkSession) -> dict:
    return json.loads(spark.read.text(f"{path}/about").first()[0])


def _regressor(kind: str, target: str, df: DataFrame, params: Mapping) -> Estimator:
    common = {"featuresCol": FEATURES, "labelCol": target}
    if kind == "linear":
        return mr.LinearRegression(**common, **params)
    if kind in ("ridge", "lasso"):
        alpha = dict(params).get("alpha", 1.0)
        if kind == "lasso":
            return mr.LinearRegression(**common, regParam=alpha, elasticNetParam=1.0, standardization=False)
        got = gather(df, {"n": F.count(target), "s": F.stddev_samp(target)})
        return mr.LinearRegression(**common, regParam=alpha * got["s"] / got["n"], standardization=False, solver="l-bfgs")
    if kind == "decision_tree":
        return mr.DecisionTreeRegressor(**common, seed=SEED, **params)
    if kind == "random_forest":
        return mr.RandomForestRegressor(**common, seed=SEED, **{**FOREST, **params})
    if kind in ("gradient_boosting", "xgboost"):
        return mr.GBTRegressor(**common, seed=SEED, **{**BOOSTING, **params})
    raise ValueError(f"unknown regressor {kind}")


def _classifier(kind: str, target: str, df: DataFrame, params: Mapping) -> Estimator:
    common = {"featuresCol": FEATURES, "labelCol": target}
    params = dict(params)
    if kind == "logistic":
        c = params.pop("C", 1.0)
        n = gather(df, {"n": F.count(target)})["n"] or 1
        return mc.LogisticRegression(**common, regParam=1.0 / (c * n), **params)
    if kind == "decision_tree":
        return mc.DecisionTreeClassifier(**common, seed=SEED, **params)
    if kind == "random_forest":
        return mc.RandomForestClassifier(**common, seed=SEED, weightCol="_weight", **{**FOREST, **params})
    if kind in ("gradient_boosting", "xgboost"):
        return mc.GBTClassifier(**common, seed=SEED, **{**BOOSTING, **params})
    if kind == "svc":
        return mc.LinearSVC(**common, weightCol="_weight", **params)
    raise ValueError(f"unknown classifier {kind}")


REGRESSORS = ["linear", "ridge", "lasso", "decision_tree", "random_forest", "gradient_boosting", "xgboost"]
TREES = ["decision_tree", "random_forest", "gradient_boosting", "xgboost"]
CLASSIFIERS = ["logistic", "decision_tree", "random_forest", "gradient_boosting", "xgboost", "svc"]


def fit_regressor(df: DataFrame, features: Sequence[str], target: str, kind: str = "linear", **params) -> FittedModel:
    require_columns(df, [*features, target])
    rows = df.select(*features, F.col(target).cast("double").alias(target))
    train = assemble(stored(rows) if kind in TREES else rows, features)
    return FittedModel(kind, list(features), _regressor(kind, target, train, params).fit(train), target)


def balanced_weights(df: DataFrame, label: str, name: str = "_weight") -> DataFrame:
    """n / (2 · size of the row's class)."""
    got = gather(df, {"n": F.count(label), "p": F.count_if(F.col(label) == 1)})
    n, p = got["n"], got["p"]
    positive, negative = n / (2 * max(p, 1)), n / (2 * max(n - p, 1))
    return df.withColumn(name, F.when(F.col(label) == 1, F.lit(positive)).otherwise(F.lit(negative)))


def fit_classifier(df: DataFrame, features: Sequence[str], label: str, kind: str = "logistic", **params) -> FittedModel:
    require_columns(df, [*features, label])
    rows = df.select(*features, F.col(label).cast("double").alias(label))
    train = assemble(balanced_weights(stored(rows) if kind in TREES else rows, label), features)
    return FittedModel(kind, list(features), _classifier(kind, label, train, params).fit(train), label, True)
