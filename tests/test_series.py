"""Long series cut into chunks must give what one keyed window gives."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strataflow.functions import rolling as R
from strataflow.operators import clean, domain, metrics, ordered, profile, significance, split
from strataflow.series import Series, accumulate, number_rows


def rows(df, order):
    out = df.toPandas().sort_values(order).reset_index(drop=True)
    return out[sorted(out.columns)]


@pytest.fixture(scope="module")
def wells(spark):
    """One well holds most rows; depths repeat a lot; a key is missing."""
    rng = np.random.default_rng(3)
    n = 600
    pdf = pd.DataFrame(
        {
            "well": np.where(np.arange(n) % 10 < 7, "hot", np.where(np.arange(n) % 10 < 9, "cold", None)),
            "depth": np.where(np.arange(n) % 3 == 0, 50.0, rng.integers(0, 40, n).astype(float)),
            "id": rng.permutation(n),
            "x": rng.normal(10, 3, n),
        }
    )
    pdf.loc[rng.random(n) < 0.1, "x"] = None
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x"))).repartition(5)
    return df.cache()


BIG = Series("well", ("depth", "id"))
SMALL = Series("well", ("depth", "id"), rows_per_task=60)


def same(a, b, order="id"):
    pd.testing.assert_frame_equal(rows(a, order), rows(b, order), check_exact=False, rtol=1e-9, atol=1e-9)


def test_small_series_is_cut(wells):
    assert not BIG.measure(wells).chunked
    layout = SMALL.measure(wells)
    assert layout.chunked and layout.repeated and layout.second


def test_row_numbers(wells):
    same(number_rows(wells, BIG, "_p", "_n"), number_rows(wells, SMALL, "_p", "_n"))


@pytest.fixture
def new_york(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    yield spark
    spark.conf.set("spark.sql.session.timeZone", old)


ORDERS = {
    "spring": "timestamp_ntz'2024-03-10 00:00:00' + make_dt_interval(0, 0, CAST(id AS INT) * 15)",
    "autumn": "timestamp_ntz'2024-11-03 00:00:00' + make_dt_interval(0, 0, CAST(id AS INT) * 15, 0.000001)",
    "zoned": "timestamp_micros(1730606400000000 + id * 900000000)",
    "string": "concat('well/2024-', lpad(CAST(id * 7919 % 100003 AS STRING), 6, '0'), CASE WHEN id % 3 = 0 THEN 'é' ELSE '' END)",
    "number": "CASE WHEN id % 50 = 0 THEN double('NaN') WHEN id % 51 = 0 THEN double('Infinity') WHEN id % 7 = 0 THEN NULL ELSE id % 20 END",
    "long": "9007199254740992 + id DIV 3",
    "decimal": "CAST(id DIV 4 AS DECIMAL(30, 10)) / 1000000000",
}


@pytest.mark.parametrize("kind", list(ORDERS))
def test_both_sides_of_the_cut_agree(new_york, kind):
    """Clock changes, strings, NaN, infinity, NULL, values that a double cannot tell apart."""
    df = new_york.range(240).selectExpr("id", "CAST(NULL AS STRING) AS well", f"{ORDERS[kind]} AS at", "sin(id) AS x").repartition(4)
    told = []
    for limit in (2_000_000, 20):
        layout = Series("well", ("at", "id"), rows_per_task=limit).measure(df)
        assert layout.chunked == (limit == 20)
        frame = ordered.lag_features(df, layout, ["x"], [1, 3])
        told.append(accumulate(number_rows(frame, layout, "_p"), layout, {"s": F.col("x")}).drop("at"))
    same(*told)


def test_row_numbers_without_key(wells):
    a = number_rows(wells, Series((), ("depth", "id")), "_p", "_n")
    b = number_rows(wells, Series((), ("depth", "id"), rows_per_task=60), "_p", "_n")
    same(a, b)
    assert sorted(r["_p"] for r in b.select("_p").collect()) == list(range(600))


def test_running_sums_and_last_values(wells):
    args = {"sums": {"s": F.col("x")}, "lasts": {"l": F.col("x")}}
    same(accumulate(wells, BIG, **args), accumulate(wells, SMALL, **args))


@pytest.mark.parametrize(
    "run",
    [
        lambda d, s: ordered.lag_features(d, s, ["x"], [1, 3], drop=False),
        lambda d, s: ordered.rolling_features(d, s, ["x"], [5, 20], drop=False),
        lambda d, s: ordered.temporal_features(d, s, ["x"]),
        lambda d, s: ordered.anomaly_features(d, s, ["x"]),
        lambda d, s: ordered.short_history_features(d, s, "x"),
        lambda d, s: ordered.cumulative_change(d, s, "x", "step", "total"),
        lambda d, s: ordered.gradient(d, s, "x", "id"),
        lambda d, s: ordered.smooth(d, s, ["x"]),
        lambda d, s: ordered.latest_rows(d, s, 7),
        lambda d, s: clean.forward_fill(d, s, ["x"]),
        lambda d, s: split.time_split(d, s),
        lambda d, s: split.expanding_folds(d, s, 4),
        lambda d, s: split.batches(d, s, 25),
        lambda d, s: domain.pressure_anomalies(d, s, "x", 1.0),
        lambda d, s: ordered.pit_volume_label(d, s, "x"),
    ],
    ids=lambda f: "",
)
def test_chunks_equal_one_window(wells, run):
    same(run(wells, BIG), run(wells, SMALL))


def test_kick_patterns_in_chunks(wells):
    a, b = domain.kick_patterns(wells, BIG, "x"), domain.kick_patterns(wells, SMALL, "x")
    same(a, b, "well")


def test_partitioning_does_not_matter(wells):
    a = ordered.rolling_features(wells.repartition(1), BIG, ["x"], [5], drop=False)
    b = ordered.rolling_features(wells.repartition(13, "x"), SMALL, ["x"], [5], drop=False)
    same(a, b)


def test_rank_based_operators_in_chunks(wells):
    d = wells.dropna()
    for cut in (1 << 21, 40):
        got = profile.spearman(d, "depth", "x", rows_per_task=cut).first()["correlation"]
        p = d.toPandas()
        assert got == pytest.approx(p.depth.rank().corr(p.x.rank()), abs=1e-9)
    scored = d.withColumn("y", (F.col("depth") > 20).cast("int"))
    assert metrics.roc_auc(scored, "y", "x", 40).first()[0] == pytest.approx(metrics.roc_auc(scored, "y", "x").first()[0])
    assert metrics.pr_auc(scored, "y", "x", 40).first()[0] == pytest.approx(metrics.pr_auc(scored, "y", "x").first()[0])
    a, b = d.where("id % 2 = 0"), d.where("id % 2 = 1")
    assert significance.drift(a, b, "x", rows_per_task=40).first() == significance.drift(a, b, "x").first()


def test_random_split_is_exact_in_chunks(wells):
    for cut in (None, 50):
        got = split.random_split(wells, ["id"], 0.2, ["well"], rows_per_task=cut)
        counts = {r["well"]: r["n"] for r in got.where("split = 'test'").groupBy("well").agg(F.count("*").alias("n")).collect()}
        assert counts == {"hot": 84, "cold": 24, None: 12}


def test_smoothing_weights_are_the_published_ones():
    assert np.allclose(R.smoothing_weights(7, 2)[3] * 21, [-2, 3, 6, 7, 6, 3, -2])
    assert np.allclose(R.smoothing_weights(7, 2)[0] * 42, [32, 15, 3, -4, -6, -3, 5])
    with pytest.raises(ValueError):
        R.smoothing_weights(6, 2)


def test_one_shuffle_for_the_temporal_bundle(wells):
    plan = ordered.temporal_features(wells, BIG, ["x"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_latest_rows_are_cut_before_the_shuffle(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 > 0, F.lit(1)).otherwise(F.col("id") % 50).alias("well"))
    out = ordered.latest_rows(df, Series("well", "id"), 4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.rindex("Exchange") < plan.rindex("WindowGroupLimit")
    rows = [(r.well, r.id) for r in out.collect()]
    wells = {w for w, _ in rows}
    assert all(sorted(i for w, i in rows if w == k) == sorted(i for i in range(5000) if (1 if i % 3 else i % 50) == k)[-4:] for k in wells) and len(wells) == 50
    assert sorted(r.id for r in ordered.latest_rows(df, Series((), "id"), 3).collect()) == [4997, 4998, 4999]
