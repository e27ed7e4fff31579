"""Permutation importance moves values as slices of blocks, a bounded number of copies at a time."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataflow.models import evaluate
from strataflow.operators.split import hash_number


class _Sum:
    features = ["f", "b", "c"]

    def __init__(self):
        self.seen = []

    def transform(self, df):
        self.seen.append(df)
        return df.withColumn("prediction", F.col("f") * 3 + F.col("b") * F.col("c"))


def _rows(spark, n):
    df = spark.range(n).select("id", (F.hash("id") % 40).cast("double").alias("f"), (F.col("id") % 5).cast("double").alias("b"), (F.col("id") % 7).cast("int").alias("c"))
    return df.withColumn("y", F.col("f") * 3 + F.col("b"))


def _want(df, model, repeats=5):
    rows = df.withColumn("h", hash_number("id")).orderBy("h", "id").toPandas()
    predict = lambda t: t.f * 3 + t.b * t.c
    error = lambda t: float(np.mean((t.y - predict(t)) ** 2))
    rng, n, out = random.Random(evaluate.supervised.SEED), len(rows), {}
    for f in model.features:
        rises = []
        for _ in range(repeats):
            step = 1 + math.floor(rng.random() * (n - 1))
            rises.append(error(rows.assign(**{f: np.roll(rows[f].to_numpy(), -step)})) - error(rows))
        out[f] = (np.mean(rises), np.std(rises))
    return out


@pytest.mark.parametrize("n", [1, 2, 63, 64, 200, 333])
def test_every_row_gets_the_value_a_distance_further_on(spark, monkeypatch, n):
    monkeypatch.setattr(evaluate, "BLOCK_ROWS", 64, raising=False)
    monkeypatch.setattr(evaluate, "COPIES_PER_PASS", 6 * n, raising=False)
    df, model = _rows(spark, n), _Sum()
    got = {r.feature: (r.importance, r.deviation) for r in evaluate.permutation_importance(df, model, "y", ["id"]).collect()}
    want = _want(df, model)
    assert set(got) == set(want)
    for f in want:
        assert got[f] == pytest.approx(want[f], abs=1e-6)
    assert len(model.seen) == 3  # 15 cells, six at a time


def test_copies_are_formed_after_the_shuffle(spark, capsys):
    model = _Sum()
    evaluate.permutation_importance(_rows(spark, 300), model, "y", ["id"])
    capsys.readouterr()
    model.seen[-1].explain()
    plan = capsys.readouterr().out
    assert plan.index("posexplode") < plan.index("ShuffledHashJoin")
