"""Searches compute their rows once and hold no more of them in memory with more trials."""

import threading

import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import functions as F

from strataflow.models import evaluate, supervised
from strataflow.models.common import assemble

GRID = {"maxDepth": [1, 2], "minInstancesPerNode": [1, 30]}


def _rows(spark, parts=1):
    df = spark.range(0, 300, 1, parts).withColumn("a", (F.hash("id") % 50).cast("double")).withColumn("b", (F.col("id") % 7).cast("double"))
    return df.withColumn("y", F.col("a") * 2 + F.col("b"))


def test_a_search_computes_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    df = _rows(spark).mapInPandas(count, "id long, a double, b double, y double")
    evaluate.grid_search(df, ["a", "b"], "y", "decision_tree", GRID)
    assert seen.value == 300


def test_a_search_scores_as_train_validation_split_does(spark):
    df = _rows(spark)
    best, history = evaluate.grid_search(df, ["a", "b"], "y", "decision_tree", GRID)
    data = assemble(df.select("a", "b", "y"), ["a", "b"])
    estimator = supervised._regressor("decision_tree", "y", data, {})
    maps = ParamGridBuilder().addGrid(estimator.maxDepth, [1, 2]).addGrid(estimator.minInstancesPerNode, [1, 30]).build()
    want = TrainValidationSplit(estimator=estimator, estimatorParamMaps=maps, evaluator=RegressionEvaluator(labelCol="y"), trainRatio=0.8, seed=supervised.SEED).fit(data)
    assert [r.rmse for r in history.orderBy("trial").collect()] == pytest.approx(want.validationMetrics)
    assert best.model.toDebugString.split("\n")[1:] == want.bestModel.toDebugString.split("\n")[1:]


@pytest.mark.parametrize("parts", [1, 8])
def test_fits_that_fill_the_cores_run_one_after_the_other(spark, parts, monkeypatch):
    lock, running, most = threading.Lock(), [0], [0]

    class Fitting:
        maxDepth = minInstancesPerNode = None

        def __init__(self, real):
            self.real = real

        def getParam(self, name):
            return self.real.getParam(name)

        def fit(self, data, params):
            with lock:
                running[0] += 1
                most[0] = max(most[0], running[0])
            try:
                return self.real.fit(data, params)
            finally:
                with lock:
                    running[0] -= 1

    make = supervised._regressor
    monkeypatch.setattr(supervised, "_regressor", lambda *a: Fitting(make(*a)))
    monkeypatch.setattr(evaluate, "_grid", lambda e, grid: [{e.getParam("maxDepth"): d} for d in (1, 2, 3, 4)])
    monkeypatch.setattr(evaluate, "stored", lambda df: df)
    evaluate.grid_search(_rows(spark, parts), ["a", "b"], "y", "decision_tree", GRID)
    assert most[0] == 1 if parts == 8 else most[0] > 1
