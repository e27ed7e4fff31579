"""Permutation importance joins its many copies without sorting them."""

import pytest
from pyspark.sql import functions as F

from strataflow.models import evaluate


class _Sum:
    features = ["a", "b", "c"]

    def __init__(self):
        self.seen = None

    def transform(self, df):
        self.seen = df
        return df.withColumn("prediction", F.col("a") * 3 + F.col("b"))


def test_copies_are_joined_by_hash_in_bounded_tasks(spark, capsys, monkeypatch):
    monkeypatch.setattr(evaluate, "COPIES_PER_TASK", 500, raising=False)
    df = spark.range(800).select("id", (F.hash("id") % 40).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"), F.lit(1.0).alias("c"))
    df = df.withColumn("y", F.col("a") * 3 + F.col("b"))
    model = _Sum()
    own = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.feature: r for r in evaluate.permutation_importance(df, model, "y", ["id"]).collect()}
        capsys.readouterr()
        model.seen.explain()
        plan = capsys.readouterr().out
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", own)
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "Sort [" not in plan
    # 800 rows x 3 features x 5 repeats, 500 a task
    assert "24)" in plan
    assert got["a"].importance > got["b"].importance > 0 and got["c"].importance == pytest.approx(0, abs=1e-9)
