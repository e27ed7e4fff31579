"""Long plans run their windows once."""

from pyspark.sql import functions as F

from strataflow.functions import rolling as R
from strataflow.plans import preparation
from strataflow.series import Series, over_series

_CHANNELS = ["FRate", "SMSpeed", "FIn", "FOut", "ActiveGL", "HLoad", "WBoPress", "MRFlow"]


def _samples(spark, n=240):
    cells = [(F.hash(F.col("id"), F.lit(i)) % 100).cast("double").alias(c) for i, c in enumerate(_CHANNELS)]
    return spark.range(n).select((F.col("id") % 2).alias("well"), "id", *cells)


def test_windows_are_not_computed_again_for_the_result(spark, capsys):
    df, series = _samples(spark), Series("well", "id")
    for out in (preparation.drilling_features(df, series, "kick"), preparation.prepare_kick(df, series, _CHANNELS[:6])[0]):
        capsys.readouterr()
        out.explain()
        assert "Window" not in capsys.readouterr().out
        assert out.count() > 0


def test_running_median_is_the_percentile_of_full_windows(spark):
    rows = [(i, None if i == 9 else float("nan") if i == 20 else float("inf") if i == 22 else float((i * 37) % 11) - 5) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, v double")
    for n in (1, 4, 5):
        want = lambda f: {"p": f.whole("v", n, F.percentile("v", F.lit(0.5)).over(f.last(n))), "m": R.middle(f, "v", n)}  # noqa: E731, B023
        got = over_series(df, Series((), "id"), want, back=n - 1).collect()
        assert all(str(r.p) == str(r.m) for r in got) and any(r.m is not None for r in got)
    assert "percentile" not in str(over_series(df, Series((), "id"), lambda f: {"m": R.middle(f, "v", 5)}, back=4)._jdf.queryExecution())
