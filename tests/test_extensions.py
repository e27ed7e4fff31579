"""What users add: window functions, models, files of any state, a log written twice."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataflow.models import evaluate
from strataflow.models.pressure import LinearModel
from strataflow.operators import domain, ordered
from strataflow.series import Series


def test_user_window_on_both_paths(spark):
    df = spark.range(200).select("id", F.when(F.col("id") % 17 != 0, F.sin("id")).alias("x"), (F.col("id") % 5 == 0).alias("well")).repartition(4)
    spread = lambda v: float((v - v.median()).abs().mean())
    told = []
    for limit in (1000, 30):
        series = Series("well", "id", rows_per_task=limit)
        assert series.measure(df).chunked == (limit == 30)
        told.append(ordered.rolling_apply(df, series, ["x"], 4, spread, "spread").orderBy("id").toPandas())
    want = told[0].sort_values(["well", "id"])
    plain = want.groupby("well").x.transform(lambda v: v.rolling(4).apply(spread))
    for got in told:
        got = got.set_index("id").x_spread_4
        assert np.allclose(got.loc[want.id], plain, equal_nan=True)


def test_user_model_by_name(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"))

    class Twice:
        def transform(self, data):
            return data.withColumn("prediction", F.col("x") * 2)

    evaluate.register("formation_pressure", "twice", lambda data, features, target, **p: Twice())
    try:
        model = evaluate.fit("formation_pressure", "twice", df, ["x"], "y")
        assert evaluate.evaluate(model.transform(df), "y").first()["rmse"] == 0
        assert "pcr" in evaluate.registry()["formation_pressure"]
        with pytest.raises(ValueError, match="there is"):
            evaluate.register("formation_pressure", "pcr", None)
    finally:
        evaluate._ADDED.clear()


def test_one_bad_file_takes_none_with_it(spark, tmp_path):
    files = {
        "a.csv": "x,y\n1,2\n,3\n\n4,5\n", "b.csv": 'note,y,x\n"one, two",7,8\n', "words.csv": "x,y\n1,2\nmany,3\n", "lacks.csv": "x,z\n1,2\n",
        "empty.csv": "", "head.csv": "x,y\n", "odd.csv": "x,y\n1\n2,3,4\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    model = LinearModel("pls", ["x", "y"], "p", 1.0, [10.0, 1.0])
    summary, errors = evaluate.score_csv_files(spark, f"{tmp_path}/*.csv", model, ["x", "y"])
    assert {r["source_file"]: r["error"] for r in errors.collect()} == {"words.csv": "1 rows with values that are no numbers", "lacks.csv": "no column y"}
    got = {r["source_file"]: (r["count"], r["max"]) for r in summary.collect()}
    assert got == {"a.csv": (2, 46.0), "b.csv": (1, 88.0), "odd.csv": (1, 24.0)}


def test_a_folder_of_parts_is_one_file(spark, tmp_path):
    """Parts have headers of their own; a bad part takes its whole folder with it. No line is sorted or shuffled by its file."""
    parts = {
        "good.csv": ["x,y\n1,2\n", "y,x\n5,4\n", ""], "words.csv": ["x,y\n1,2\n", "x,y\nmany,3\nmore,3\n", "x,y\nmuch,3\n"],
        "lacks.csv": ["x,y\n1,2\n", "x\n1\nmany\n", "z\n1\n"],
    }
    for folder, texts in parts.items():
        (tmp_path / folder).mkdir()
        for i, text in enumerate(texts):
            (tmp_path / folder / f"part-{i}.csv").write_text(text)
    model = LinearModel("pls", ["x", "y"], "p", 1.0, [10.0, 1.0])
    summary, errors = evaluate.score_csv_files(spark, f"{tmp_path}/*.csv", model, ["x", "y"], folders=True)
    assert {r["source_file"]: r["error"] for r in errors.collect()} == {"words.csv": "3 rows with values that are no numbers", "lacks.csv": "no column x, y"}
    assert {r["source_file"]: (r["count"], r["max"]) for r in summary.collect()} == {"good.csv": (2, 46.0)}
    plan = summary._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "SortAggregate" not in plan


def test_log_holds_a_batch_once(spark, tmp_path):
    rows = spark.range(10).select("id", F.lit("pcr").alias("model_type"), F.lit("success").alias("status"), F.lit(1.0).alias("latency_ms"))
    for batch in (0, 1, 1, 0):
        domain.append_prediction_log(rows, str(tmp_path / "log"), batch)
    got = domain.service_statistics(spark.read.parquet(str(tmp_path / "log"))).first()
    assert got["predictions"] == 20
