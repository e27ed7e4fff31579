import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strataflow.models import anomaly, ensemble, evaluate, pressure, supervised
from strataflow.operators import metrics, ordered
from strataflow.plans import preparation
from strataflow.series import Series
from strataflow.sources import files
from strataflow.streaming import live

X = ["WellDepth", "WoBit", "RoPen", "BTBR", "WBoPress"]


@pytest.fixture(scope="module")
def formation(spark):
    rng = np.random.default_rng(42)
    n = 200
    pdf = pd.DataFrame(
        {
            "seq": np.arange(n), "WellDepth": 2000 + np.cumsum(rng.normal(10, 1, n)), "WoBit": rng.normal(25, 5, n),
            "RoPen": rng.normal(15, 3, n), "BTBR": rng.normal(120, 10, n), "WBoPress": rng.normal(2000, 200, n),
        }
    )
    pdf["FPress"] = 0.5 * pdf.WellDepth + 0.5 * pdf.WBoPress + rng.normal(0, 50, n)
    return spark.createDataFrame(pdf).cache()


@pytest.fixture(scope="module")
def kick(spark):
    rng = np.random.default_rng(7)
    n = 500
    pdf = pd.DataFrame(
        {
            "seq": np.arange(n), "FIn": rng.normal(300, 10, n), "ActiveGL": rng.normal(100, 3, n), "WBoPress": rng.normal(2000, 50, n),
        }
    )
    pdf["FOut"] = pdf.FIn + rng.normal(2, 1, n)
    pdf["label"] = 0
    at = rng.choice(n, 25, replace=False)
    pdf.loc[at, "label"] = 1
    pdf.loc[at, "FOut"] += 25
    pdf.loc[at, "ActiveGL"] += 15
    return spark.createDataFrame(pdf).cache()


K = ["FIn", "FOut", "ActiveGL", "WBoPress"]


def r2_of(model, df):
    return metrics.regression_metrics(model.transform(df), "FPress", "prediction").first()["r2"]


def test_latent_models_match_least_squares(spark, formation):
    p = formation.toPandas()
    a = np.column_stack([np.ones(len(p)), p[X]])
    want = np.linalg.lstsq(a, p.FPress, rcond=None)[0]
    for fit in (pressure.fit_pcr, pressure.fit_pls):
        model = fit(formation, X, "FPress", len(X))
        assert np.allclose([model.intercept, *model.coefficients], want, rtol=1e-6, atol=1e-6)
    assert r2_of(pressure.fit_pls(formation, X, "FPress", 2), formation) > 0.8
    # few components follow numpy's own decomposition
    z = (p[X] - p[X].mean()) / p[X].std(ddof=0)
    _, _, vt = np.linalg.svd(z, full_matrices=False)
    t = z.to_numpy() @ vt[:3].T
    b = np.linalg.lstsq(np.column_stack([np.ones(len(t)), t]), p.FPress, rcond=None)[0]
    got = pressure.fit_pcr(formation, X, "FPress", 3).transform(formation).orderBy("seq").toPandas().prediction
    assert np.allclose(got, b[0] + t @ b[1:])


def test_wide_moments_agree(spark, formation, monkeypatch):
    from strataflow.models import common

    a = common.second_moments(formation, X)
    monkeypatch.setattr(common, "WIDE", 2)
    b = common.second_moments(formation, X)
    for u, v in zip(a, b):
        assert np.allclose(u, v)


@pytest.mark.parametrize("kind", ["linear", "ridge", "lasso", "decision_tree"])
def test_regressors_reach_their_floor(formation, kind):
    model = supervised.fit_regressor(formation, X, "FPress", kind)
    assert r2_of(model, formation) > 0.6
    if kind == "decision_tree":  # raw coefficients depend on the units of their columns, tree importances do not
        assert model.importance()[0][0] in ("WellDepth", "WBoPress")
    else:
        assert model.importance()[0][1] == pytest.approx(np.abs(model.model.coefficients.toArray()).max())


def test_ridge_matches_the_closed_form(formation):
    p = formation.toPandas()
    x, y = p.WellDepth - p.WellDepth.mean(), p.FPress - p.FPress.mean()
    got = supervised.fit_regressor(formation, ["WellDepth"], "FPress", "ridge", alpha=1000.0).model.coefficients[0]
    assert got == pytest.approx((x @ y) / (x @ x + 1000.0), rel=1e-4)


def test_models_save_and_load(spark, formation, tmp_path):
    model = supervised.fit_regressor(formation, X, "FPress", "linear")
    model.save(str(tmp_path / "m"), spark, note="t")
    back = supervised.load_model(str(tmp_path / "m"), spark)
    assert back.features == X and supervised.model_metadata(str(tmp_path / "m"), spark)["metadata"] == {"note": "t"}
    a = model.transform(formation).orderBy("seq").toPandas().prediction
    assert np.allclose(a, back.transform(formation).orderBy("seq").toPandas().prediction)
    with pytest.raises(ValueError, match="Missing features"):
        back.transform(formation.drop("WoBit"))
    pca = pressure.fit_pcr(formation, X, "FPress", 3)
    pca.save(str(tmp_path / "p"), spark)
    assert pressure.LinearModel.load(str(tmp_path / "p"), spark).coefficients == pca.coefficients


def test_detectors_find_the_kicks(spark, kick, tmp_path):
    pca = anomaly.fit_pca_detector(kick, K, "label", variance=0.8, percentile=99)
    forest = anomaly.fit_isolation_forest(kick, K, "label", trees=40, contamination=0.02)
    margin = anomaly.fit_one_class(kick, K, "label", nu=0.05, rounds=8)
    for model in (pca, forest, margin):
        got = metrics.kick_metrics(model.transform(kick), "label", "prediction").first()
        assert got.detection_rate >= 0.8, type(model)
        assert got.false_alarm_rate <= 0.12, type(model)
        model.save(str(tmp_path / type(model).__name__), spark)
        again = type(model).load(str(tmp_path / type(model).__name__), spark).transform(kick)
        assert metrics.kick_metrics(again, "label", "prediction").first() == got
    spe = pca.transform(kick).select("seq", "spe").toPandas().set_index("seq").spe
    parts = pca.contributions(kick, ["seq"]).toPandas().set_index("seq").sum(axis=1)
    assert np.allclose(spe.sort_index(), parts.sort_index())


def test_isolation_forest_samples_are_bounded(kick):
    forest = anomaly.fit_isolation_forest(kick, K, trees=10, sample=64)
    assert forest.sample == 64 and len(forest.nodes) == 10
    assert all(len(t["feature"]) <= 127 and max(t["depth"]) < 20 for t in forest.nodes)


def test_threshold_table_equals_brute_force(kick):
    df = kick.withColumn("s", F.col("FOut") - F.col("FIn"))
    p = df.select("label", "s").toPandas()
    for row in ensemble.threshold_table(df, "label", "s", 20):
        flag = p.s > row["threshold"]
        tp = int((flag & (p.label == 1)).sum())
        assert row["recall"] == pytest.approx(tp / 25)
        assert row["precision"] == pytest.approx(tp / flag.sum() if flag.sum() else 0)


def test_permutation_importance_ranks_the_inputs(formation):
    model = supervised.fit_regressor(formation, X, "FPress", "linear")
    got = evaluate.permutation_importance(formation, model, "FPress", ["seq"]).collect()
    assert {got[0].feature, got[1].feature} == {"WellDepth", "WBoPress"}


def test_confidence_and_robustness(formation):
    model = pressure.fit_pcr(formation, X, "FPress", 5)
    conf = evaluate.noise_confidence(formation, model).toPandas()
    assert conf.confidence.between(0.99, 1.0).all() and list(conf.columns) == [*formation.columns, "confidence"]
    curve = {r.level: r.r2 for r in evaluate.robustness(formation, model, "FPress").collect()}
    assert curve[0.01] > curve[0.2]


def test_batch_run_records_a_failing_model(formation):
    fitted, table, failed = preparation.run_batch(formation, [], ["seq"], "formation_pressure", "FPress", ["linear", "pcr", "nonsense"], X)
    assert set(fitted) == {"linear", "pcr"} and set(failed) == {"nonsense"} and table.count() == 2


# ---- files --------------------------------------------------------------------------


def test_csv_encodings_and_cleaning(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Depth ,Mud Weight,Name\n100,1.2,Forêt\n100,1.2,Forêt\n,,\n200,x,B\n".encode("latin-1"))
    df = files.read_formation_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["Depth", "Mud_Weight", "Name"] and dict(df.dtypes)["Depth"] == "double"
    assert sorted(r.Name for r in df.collect()) == ["B", "Forêt"]
    assert files.detect_encoding(spark, str(tmp_path / "a.csv")) == "iso-8859-1"


def test_many_files_with_different_columns(spark, tmp_path):
    (tmp_path / "kick_1.csv").write_text("FlowRateIn,IsKick\n1,0\n2,1\n")
    (tmp_path / "formation_1.csv").write_text("Depth,FlowRateIn\n10,5\n")
    df = files.read_many_csv(spark, str(tmp_path / "*.csv"))
    got = {(r.source_file, r.FlowRateIn, r.Kick, r.Depth) for r in df.collect()}
    assert got == {("kick_1.csv", 1.0, 0.0, None), ("kick_1.csv", 2.0, 1.0, None), ("formation_1.csv", 5.0, None, 10.0)}


def test_json_array_and_envelope(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1},\n {"x": 2}]')
    (tmp_path / "b.json").write_text('{"data": [\n{"x": 3}, {"x": 4}], "status": "ok"}')
    assert sorted(r.x for r in files.read_json_records(spark, str(tmp_path / "a.json")).collect()) == [1, 2]
    assert sorted(r.x for r in files.read_json_records(spark, str(tmp_path / "b.json")).collect()) == [3, 4]
    assert files.load_configured(spark, {"type": "api", "path": str(tmp_path / "a.json")}).count() == 2
    with pytest.raises(ValueError):
        files.load_configured(spark, {"type": "queue"})


LAS = """~Version Information
 VERS.   2.0 : CWLS log
 WRAP.   {wrap} : one line per depth
~Well Information Block
 STRT.M  100.0 : start
 NULL.   -999.25 : null
 WELL.   Anna 7 : well
 LOC.    North field : location
~Curve Information
 DEPT.M   : depth
 GR  .API : gamma
# a comment
 RHOB.G/C3 : density
~A  DEPTH  GR  RHOB
 100.0  45.5  2.35
 100.5  -999.25  2.40
 101.0  1e2  -999.25
"""


def test_las_files(spark, tmp_path):
    (tmp_path / "w.las").write_text(LAS.format(wrap="NO"))
    df = files.las_table(files.read_las(spark, str(tmp_path / "w.las")), ["GR", "RHOB"]).orderBy("depth")
    rows = df.collect()
    assert [(r.depth, r.GR, r.RHOB) for r in rows] == [(100.0, 45.5, 2.35), (100.5, None, 2.4), (101.0, 100.0, None)]
    assert rows[0].well_name == "Anna 7" and rows[0].location == "North field"
    (tmp_path / "x.las").write_text(LAS.format(wrap="YES"))
    with pytest.raises(Exception, match="wrapped"):
        files.read_las(spark, str(tmp_path / "x.las")).collect()


def test_las_samples_are_found_by_place(spark, tmp_path):
    """Text, NaN, short rows and number-like lines of other sections."""
    extra = LAS.format(wrap="NO").replace("~A  DEPTH", "~O\n 1 2 3\n~A  DEPTH") + " 101.5  NaN  2.5\n 102.0  bad  2.6\n\n 102.5  7\n"
    (tmp_path / "w.las").write_text(extra)
    rows = files.las_table(files.read_las(spark, str(tmp_path / "w.las")), ["GR", "RHOB"]).orderBy("depth").collect()
    assert [(r.depth, r.GR, r.RHOB) for r in rows[3:]] == [(101.5, None, 2.5), (102.0, None, 2.6), (102.5, 7.0, None)] and len(rows) == 6


def test_las_logs_share_a_file(spark, tmp_path):
    """Several logs in a file, also where a block that is read ends inside a header or a section."""
    second = LAS.format(wrap="NO").replace("Anna 7", "Berta 8").replace("45.5", "46.5") + " 101.5  7  8\n" * 40
    (tmp_path / "w.las").write_text(LAS.format(wrap="NO") + second + LAS.format(wrap="NO").replace("Anna 7", "Cleo 9"))
    wide = spark.conf.get("spark.sql.files.maxPartitionBytes")
    seen = []
    for size in (wide, "100", "37"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = files.las_table(files.read_las(spark, str(tmp_path / "w.las")), ["GR", "RHOB"]).collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", wide)
        seen.append(sorted((r.well_name, r.depth, str(r.GR), r.RHOB or 0.0) for r in rows))
    assert seen[0] == seen[1] == seen[2]
    assert [w for w, *_ in seen[0]] == ["Anna 7"] * 3 + ["Berta 8"] * 43 + ["Cleo 9"] * 3
    assert ("Berta 8", 100.0, "46.5", 2.35) in seen[0] and ("Cleo 9", 100.0, "45.5", 2.35) in seen[0]


def test_many_files_have_their_own_encodings(spark, tmp_path):
    for name, code in (("a.csv", "utf-8"), ("b.csv", "iso-8859-1")):
        (tmp_path / name).write_bytes(f"id,place\n1,été {name}\n".encode(code))
    df = files.read_many_csv(spark, str(tmp_path / "*.csv"), "formation")
    assert sorted(r.place for r in df.collect()) == ["été a.csv", "été b.csv"]


def test_sinks(spark, tmp_path, formation):
    for fmt, codec in (("csv", "gzip"), ("parquet", "snappy"), ("json", None)):
        path = files.write_table(formation, str(tmp_path / fmt), fmt, codec)
        assert spark.read.option("header", True).format(fmt).load(path).count() == 200
    with pytest.raises(ValueError):
        files.write_table(formation, str(tmp_path / "z"), "xlsx")


# ---- streams --------------------------------------------------------------------------


def test_stream_batches_resume_from_the_checkpoint(spark, tmp_path):
    schema = "id long, ts timestamp, a int"
    seen = []

    def run():
        source = live.open_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, files_per_trigger=1)
        live.each_batch(source, lambda b, i: seen.append(sorted(r.id for r in b.collect())), str(tmp_path / "c")).awaitTermination()

    spark.sql("SELECT 1L AS id, timestamp'2024-01-01' AS ts, 1 AS a").coalesce(1).write.parquet(str(tmp_path / "in"))
    run()
    spark.sql("SELECT 2L AS id, timestamp'2024-01-01' AS ts, 1 AS a").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert [s for s in seen if s] == [[1], [2]]


# ---- catalogue ----------------------------------------------------------------------------


def test_catalogue_is_consistent():
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 150


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_scan_reads_only_what_the_query_needs(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    plan = ordered.rolling_features(df.select("user_id", "ts", "event_id", "value"), Series("user_id", ("ts", "event_id")), ["value"], [5])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "props" not in text.split("ReadSchema")[1].splitlines()[0]
