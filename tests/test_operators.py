import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strataflow.functions import drilling as D
from strataflow.functions import rules
from strataflow.operators import clean, domain, features, metrics, ordered, profile, quality, scale, select, significance, split
from strataflow.plans import preparation
from strataflow.series import Series


@pytest.fixture(scope="module")
def outliers(spark):
    return spark.createDataFrame(
        [(0, 10.0, 100), (1, 20.0, 120), (2, 30.0, 110), (3, 100.0, 115), (4, 25.0, None), (5, None, 125), (6, 22.0, 130)],
        "id int, WOB double, RPM int",
    )


@pytest.fixture(scope="module")
def hourly(spark):
    pdf = pd.DataFrame(
        {
            "Timestamp": pd.date_range("2024-01-01", periods=10, freq="h"),
            "WOB": [20, 22, 25, 23, 21, 24, 26, 22, 20, 25],
            "RPM": [100, 110, 120, 115, 105, 125, 130, 118, 108, 122],
            "ROP": [5, 7, 10, 8, 6, 12, 15, 9, 5, 11],
        }
    )
    return spark.createDataFrame(pdf)


ALONG = Series((), "Timestamp")


def test_outliers_found_removed_and_capped(outliers):
    assert [r.id for r in clean.find_outliers(outliers, ["WOB"]).collect()] == [3]
    left = clean.remove_iqr_outliers(outliers, ["WOB"])
    assert left.agg(F.max("WOB")).first()[0] < 100 and left.count() == 5
    capped = clean.cap_at_percentiles(outliers, ["WOB"]).toPandas()
    assert len(capped) == 7 and capped.WOB.max() == pytest.approx(np.nanpercentile([10, 20, 30, 100, 25, 22], 95))


def test_missing_features_are_named(outliers):
    with pytest.raises(ValueError, match="Missing features"):
        clean.require_columns(outliers, ["WOB", "DifferentFeature"])


def test_lags_ratios_and_calendar(hourly):
    lags = ordered.lag_features(hourly, ALONG, ["WOB"], [1, 2]).orderBy("Timestamp").toPandas()
    assert lags.WOB_lag_2.tolist()[0] == 20 and len(lags) == 8
    ratio = features.ratio_features(hourly, [("WOB", "RPM")]).orderBy("Timestamp").first()["WOB_RPM_ratio"]
    assert ratio == pytest.approx(0.2)
    cal = ordered.calendar_features(hourly, "Timestamp").orderBy("Timestamp").collect()
    assert [r.hour for r in cal] == list(range(10)) and cal[0].day_of_week == 0 and cal[0].quarter == 1


def test_bad_timestamps_are_tolerated(spark):
    df = spark.createDataFrame([("invalid", 1), ("2024-13-45", 2), ("2024-02-03 04:05:06", 3)], "t string, v int")
    assert [r.hour for r in ordered.calendar_features(df, "t").orderBy("v").collect()] == [None, None, 4]
    assert clean.parse_timestamps(df, "t").where("t IS NOT NULL").count() == 1


def test_timestamp_layout_fits_the_whole_column(spark):
    df = spark.createDataFrame([("05/01/2024",), ("13/01/2024",)], "t string")
    days = [r.d for r in clean.parse_timestamps(df, "t").select(F.dayofmonth("t").alias("d")).collect()]
    assert sorted(days) == [5, 13]


def test_zero_divisors_give_no_infinities(spark):
    df = spark.createDataFrame([(0.0, 100.0, 5.0), (10.0, 0.0, 8.0), (20.0, 120.0, 0.0)], "WOB double, RPM double, ROP double")
    out = features.simple_efficiency(df, "WOB", "ROP", "RPM").toPandas()
    values = out[["drilling_efficiency", "mechanical_specific_energy", "rop_per_rpm"]].to_numpy()
    assert np.isfinite(values).all() and (values >= 0).all()


def test_units_ranges_and_changes(spark):
    df = spark.createDataFrame([(10.0,), (0.0,)], "x double")
    assert df.select(D.convert_units("x", "bar", "psi")).first()[0] == pytest.approx(145.038)
    with pytest.raises(ValueError):
        D.convert_units("x", "bar", "m")
    valid, message = D.range_check("wob", "x")
    assert [r[0] for r in df.select(valid).collect()] == [True, False]
    assert df.select(D.percentage_change("x", F.lit(5.0))).collect()[1][0] == math.inf


def test_edge_tables(spark):
    empty = spark.createDataFrame([], "a double, b string")
    assert clean.basic_clean(empty).count() == 0
    assert profile.missing_summary(empty).count() == 2
    assert profile.numeric_summary(empty).first()["count"] == 0
    gone = spark.createDataFrame([(1.0, None), (2.0, None), (3.0, None)], "a double, b double")
    assert clean.constant_columns(gone) == ["b"] or clean.constant_columns(gone) == []
    assert scale.scale(gone, "standard", ["a"]).agg(F.avg("a")).first()[0] == pytest.approx(0)


def test_scaling_matches_numpy(outliers):
    full = outliers.dropna()
    x = full.toPandas().WOB.to_numpy()
    for method, want in [
        ("standard", (x - x.mean()) / x.std()),
        ("minmax", (x - x.min()) / (x.max() - x.min())),
        ("robust", (x - np.median(x)) / (np.percentile(x, 75) - np.percentile(x, 25))),
    ]:
        got = scale.scale(full, method, ["WOB"]).orderBy("id").toPandas().WOB.to_numpy()
        assert np.allclose(got, want)


def test_regression_metrics_match_numpy(spark):
    y, p = np.array([10.0, 15, 20, 25, 30]), np.array([12.0, 14, 22, 24, 32])
    df = spark.createDataFrame(pd.DataFrame({"y": y, "p": p}))
    got = metrics.regression_metrics(df, "y", "p").first().asDict()
    e = y - p
    assert got["rmse"] == pytest.approx(np.sqrt((e**2).mean()))
    assert got["r2"] == pytest.approx(1 - (e**2).sum() / ((y - y.mean()) ** 2).sum())
    assert got["median_ae"] == pytest.approx(np.median(np.abs(e)))
    assert got["residual_std"] == pytest.approx(e.std())


def test_classification_metrics(spark):
    rows = list(zip([0, 1, 0, 1, 0], [0, 1, 1, 1, 0], [0.1, 0.9, 0.6, 0.8, 0.2]))
    df = spark.createDataFrame(rows, "y int, p int, s double")
    got = metrics.kick_metrics(df, "y", "p").first()
    assert (got.true_positives, got.false_positives, got.false_negatives, got.true_negatives) == (2, 1, 0, 2)
    assert got.kick_precision == pytest.approx(2 / 3) and got.weighted_cost == 1
    assert metrics.roc_auc(df, "y", "s").first()[0] == pytest.approx(1.0)
    assert metrics.pr_auc(df, "y", "s").first()[0] == pytest.approx(1.0)


def test_paired_tests_against_known_values(spark):
    # differences 1..10 with one negative: signed-rank sum of the negative side is 2
    d = [1, -2, 3, 4, 5, 6, 7, 8, 9, 10]
    df = spark.createDataFrame([(0.0, 100.0 + v, 100.0) for v in d], "y double, a double, b double")
    got = significance.paired_error_tests(df, "y", "a", "b").first()
    assert got.wilcoxon_statistic == 2.0 and got.significant_difference
    x = np.array(d, float)
    assert got.ttest_statistic == pytest.approx(x.mean() / (x.std(ddof=1) / np.sqrt(10)))
    # two-sided quantiles of Student's t from printed tables
    assert significance.student_p(2.262, 9) == pytest.approx(0.05, abs=1e-4)
    assert significance.student_p(2.042, 30) == pytest.approx(0.05, abs=1e-4)
    assert significance.kolmogorov_p(1.358 / math.sqrt(50), 100, 100) == pytest.approx(0.05, abs=1e-3)


def test_quality_scores(spark):
    df = spark.createDataFrame([(float(i), 100.0 + i, 1.2) for i in range(20)], "Depth double, FormationPressure double, MudWeight double")
    report, score = quality.quality_checks(df, "formation")
    assert score == 100.0 and all(r[1] == "passed" for r in report)
    assert quality.is_valid_dataset(df)
    assert not quality.is_valid_dataset(df.drop("MudWeight"))
    rules_ = [quality.Rule("deep", "Depth > 5", "error"), quality.Rule("mean", "avg(Depth) > 5", aggregate=True)]
    outcome = {r[0]: r[1] for r in quality.quality_checks(df, "formation", rules_)[0]}
    assert outcome["deep"] == "issue" and outcome["mean"] == "passed"


def test_correlated_copy_is_dropped(hourly):
    df = hourly.drop("Timestamp").withColumn("WOB_copy", F.col("WOB"))
    assert "WOB_copy" in select.correlated_columns(df) and "WOB" not in select.correlated_columns(df)
    assert len(select.select_features(df, "ROP", "correlation", 2)) == 2


def test_mutual_information_finds_the_shape(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=2000)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "noise": rng.normal(size=2000), "y": x**2}))
    got = select.mutual_information(df, "y", ["x", "noise"])
    assert got["x"] > 0.8 and got["noise"] < 0.1


def test_alert_rules(spark):
    df = spark.createDataFrame(
        [(0, 0.1), (0, 0.4), (1, 0.9), (1, 0.65), (1, 0.2), (1, None)], "p int, q double"
    )
    assert [r[0] for r in df.select(rules.alert_level("p", "q")).collect()] == ["LOW", "MEDIUM", "CRITICAL", "HIGH", "MEDIUM", "HIGH"]
    log = spark.createDataFrame(
        [("kick_detection", 0.95, None, 0.9), ("formation_pressure", None, 6000.0, 0.9), ("kick_detection", 0.95, None, 0.3), ("kick_detection", 0.1, None, None)],
        "model_type string, kick_probability double, prediction double, confidence double",
    )
    got = [(r.alert_type, r.severity) for r in domain.raise_alerts(log).collect()]
    assert got == [("KICK_DETECTION", "CRITICAL"), ("HIGH_PRESSURE", "HIGH"), ("LOW_CONFIDENCE", "MEDIUM")]


def test_input_validation_messages(spark):
    df = spark.createDataFrame([("100", 1.2), ("abc", 1.2), (None, 1.2), ("-5", 1.2), ("20000", 1.2), ("5", 9.0)], "Depth string, MudWeight double")
    got = [r.problem for r in domain.validate_inputs(df, "formation_pressure").collect()]
    assert got[0] is None and got[1].startswith("Type invalide") and got[2].startswith("Champ obligatoire")
    assert got[3].startswith("Valeur négative") and got[4].startswith("Profondeur") and got[5].startswith("Densité")
    assert domain.validate_inputs(df.drop("Depth"), "formation_pressure").first()["problem"].endswith("Depth")


def test_formation_and_kick_responses(spark):
    req = spark.createDataFrame([(5000.0, 25.0, 2000.0, 3500.0)], "well_depth double, rop double, standpipe_pressure double, p double")
    out = domain.formation_responses(req, "p").first()
    assert out.pressure_gradient == pytest.approx(0.7) and out.pressure_category == "High" and len(out.recommendations) == 3
    assert out.recommendations[0] == "Increase mud weight to 182.5 ppg for adequate overbalance"
    kick = spark.createDataFrame([(1, 9.0, 300.0, 320.0), (0, 1.0, 300.0, 302.0)], "k int, raw double, i double, o double")
    a, b = domain.kick_responses(kick, "k", "raw", "i", "o").collect()
    assert a.risk_level == "Critical" and len(a.emergency) == 8 and len(a.monitoring) == 3 and a.flow_balance == 20
    assert b.risk_level == "Low" and b.emergency is None and len(b.monitoring) == 1


def test_splits_add_up(hourly):
    got = split.time_split(hourly, ALONG).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 7, "val": 1, "test": 2}


def channels(spark, n=240, wells=2):
    rng = np.random.default_rng(2)
    names = ["BTBR", "WBoPress", "HLoad", "WoBit", "RoPen", "DPPress", "FRate", "SMSpeed", "FIn", "FOut", "ActiveGL", "MRFlow"]
    pdf = pd.DataFrame({c: rng.normal(100, 10, n) for c in names})
    pdf["well_id"] = [f"w{i % wells}" for i in range(n)]
    pdf["seq"] = np.arange(n)
    pdf["WellDepth"] = 2000.0 + np.arange(n) * 1.5
    pdf["FPress"] = 0.01 * pdf.WellDepth + 0.05 * pdf.WBoPress + rng.normal(0, 1, n)
    return pdf, spark.createDataFrame(pdf)


def test_formation_preparation_matches_pandas(spark):
    pdf, df = channels(spark, wells=1)
    got, fitted = preparation.prepare_formation(df, Series("well_id", "seq"))
    out = got.orderBy("seq").toPandas()
    from strataflow.channels import FORMATION_CHANNELS

    values = [*FORMATION_CHANNELS, "FPress"]
    work = pdf[["seq", *values]].copy()
    keep = np.ones(len(work), bool)
    for c in values:
        q1, q3 = work[c].quantile([0.25, 0.75])
        keep &= ((work[c] >= q1 - 1.5 * (q3 - q1)) & (work[c] <= q3 + 1.5 * (q3 - q1))).to_numpy()
    work = work[keep]
    for c in ["WellDepth", "BTBR", "WBoPress", "RoPen"]:
        work[f"{c}_derivative"] = work[c].diff()
        work[f"{c}_second_derivative"] = work[c].diff().diff()
    work = work.dropna()
    for c in ["WellDepth", "BTBR", "WBoPress", "RoPen"]:
        for n in (5, 10):
            work[f"{c}_rolling_std_{n}"] = work[c].rolling(n).std()
    work = work.dropna()
    assert out.seq.tolist() == work.seq.tolist()
    assert np.allclose(out.FPress, work.FPress)
    # the middle of a smoothed column is the centred quadratic fit
    raw = work.WBoPress_rolling_std_5.to_numpy()
    want = [np.polyval(np.polyfit(np.arange(7), raw[i - 3: i + 4], 2), 3) for i in range(3, len(raw) - 3)]
    assert np.allclose(out.WBoPress_rolling_std_5.to_numpy()[3:-3], want)
    replay = fitted.apply(df, ["well_id", "seq"])
    assert replay.count() == len(pdf)


def test_kick_preparation_and_feature_sets_have_no_gaps(spark):
    _, df = channels(spark)
    along = Series("well_id", "seq")
    names = ["FRate", "SMSpeed", "FIn", "FOut", "ActiveGL"]
    got, fitted = preparation.prepare_kick(df.withColumn("FIn", F.when(F.col("seq") % 40 != 7, F.col("FIn"))), along, names)
    out = got.toPandas()
    assert len(out) and not out.isna().any().any()
    assert abs(out["FRate_lag_1"].mean()) < 1e-9 and out["FRate_lag_1"].std(ddof=0) == pytest.approx(1)
    for task in ("formation", "kick"):
        full = preparation.drilling_features(df, along, task).toPandas()
        assert len(full) and not full.isna().any().any()
