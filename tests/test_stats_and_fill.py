import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strataflow.operators import donors, impute
from strataflow.quantiles import quantiles
from strataflow.stats import most_frequent


@pytest.mark.parametrize("listed", [200_000, 3])
def test_quantiles_equal_numpy(spark, listed):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"a": rng.normal(0, 1, 5000), "b": np.where(rng.random(5000) < 0.4, 7.0, rng.random(5000) * 10)})
    pdf.loc[:500, "a"] = None
    df = spark.createDataFrame(pdf).withColumn("a", F.when(~F.isnan("a"), F.col("a")))
    df = df.withColumn("c", F.lit(None).cast("double")).withColumn("d", (F.col("b") > 5).cast("int"))
    ps = [0.0, 0.05, 0.25, 0.5, 0.77, 0.9999, 1.0]
    got = quantiles(df, ["a", "b", "c", "d"], ps, listed)
    assert np.allclose(got["a"], np.nanpercentile(pdf.a, [100 * p for p in ps]), atol=1e-12)
    assert np.allclose(got["b"], np.percentile(pdf.b, [100 * p for p in ps]), atol=1e-12)
    assert got["c"] == [None] * len(ps)
    assert np.allclose(got["d"], np.percentile((pdf.b > 5).astype(int), [100 * p for p in ps]))


@pytest.mark.parametrize("listed", [200_000, 3])
@pytest.mark.parametrize("size", [7, 4000])
def test_quantiles_of_nan_and_infinity(spark, listed, size):
    """The rule of the built-in percentile at every size: NaN is largest, infinities are values."""
    rng = np.random.default_rng(size)
    x = rng.normal(size=size).tolist()
    x[:5] = [float("nan"), float("inf"), float("-inf"), float("inf"), None]
    x += [float("nan")] * (size // 10) + [0.5] * (size // 2)
    df = spark.createDataFrame([(v, 0.0) for v in x], "x double, y double").repartition(3)
    ps = [0.0, 0.01, 0.3, 0.5, 0.8, 0.93, 0.97, 1.0]
    want = df.select(F.percentile("x", F.array(*[F.lit(p) for p in ps]))).first()[0]
    got = quantiles(df, ["x", "y"], ps, listed)
    assert np.allclose(got["x"], want, equal_nan=True) and got["y"] == [0.0] * len(ps)


def test_quantiles_read_the_table_twice(spark):
    """A sketch and a count, whatever the number of columns; nothing is counted or listed in between."""
    df = spark.range(300_000).select(*[(F.hash("id", F.lit(i)) % 100_003).cast("double").alias(f"c{i}") for i in range(6)])
    seen = spark.sparkContext.accumulator(0)
    counted = df.rdd.map(lambda row: (seen.add(1), row)[1]).toDF(df.schema)
    got = quantiles(counted, df.columns, [0.25, 0.5, 0.75])
    assert seen.value == 2 * 300_000
    for c in df.columns:
        assert np.allclose(got[c], np.percentile(df.select(c).toPandas()[c], [25, 50, 75]))


def test_most_frequent_takes_the_smallest_of_ties(spark):
    df = spark.createDataFrame([(3.0,), (1.0,), (3.0,), (1.0,), (2.0,), (None,)], "x double")
    assert most_frequent(df, ["x"]) == {"x": 1.0}


def brute_knn(x: np.ndarray, k: int) -> np.ndarray:
    out = x.copy()
    width = x.shape[1]
    for r in range(len(x)):
        for t in np.flatnonzero(np.isnan(x[r])):
            shared = ~np.isnan(x) & ~np.isnan(x[r])
            n = shared.sum(axis=1)
            ok = (n > 0) & ~np.isnan(x[:, t])
            if not ok.any():
                out[r, t] = np.nanmean(x[:, t])
                continue
            d = np.where(shared, x - x[r], 0.0)
            dist = np.where(ok, (d**2).sum(axis=1) * width / np.maximum(n, 1), np.inf)
            best = np.lexsort((x[:, t], dist))[:k]
            out[r, t] = x[best[dist[best] < np.inf], t].mean()
    return out


@pytest.mark.parametrize("cells,block", [(1, 20_000), (60, 20_000), (60, 15)])
def test_knn_equals_brute_force(spark, monkeypatch, cells, block):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (160, 3))
    x[100:] = x[:60]  # copies of whole rows
    x[rng.random(x.shape) < 0.2] = np.nan
    monkeypatch.setattr(impute, "ROWS_PER_CELL", max(1, 160 // cells))
    monkeypatch.setattr(impute, "BLOCK_ROWS", block)
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(id=range(160))
    df = spark.createDataFrame(pdf)
    df = df.select("id", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in "abc"])
    got = impute.impute_knn(df, ["a", "b", "c"]).orderBy("id").toPandas()[["a", "b", "c"]].to_numpy()
    assert np.allclose(got, brute_knn(x, 5))


def test_simple_fills(spark):
    df = spark.createDataFrame(
        [(10.0, 100, "a"), (20.0, 120, None), (None, 110, "a"), (100.0, None, "b")], "WOB double, RPM int, kind string"
    )
    median = impute.impute_numeric(df, "median").collect()
    assert median[2]["WOB"] == 20.0 and median[3]["RPM"] == 110.0
    assert impute.impute_numeric(df, "mean").collect()[2]["WOB"] == pytest.approx(130 / 3)
    assert impute.impute_categorical(df).collect()[1]["kind"] == "a"
    with pytest.raises(ValueError):
        impute.impute_numeric(df, "guess")


def test_fill_with_means_cleans_infinities(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),), (float("nan"),), (3.0,)], "x double")
    assert [r.x for r in impute.fill_with_means(df).collect()] == [1.0, 2.0, 2.0, 3.0]


def test_knn_in_many_columns_goes_down_several_levels(spark, monkeypatch):
    rng = np.random.default_rng(11)
    base = rng.normal(0, 1, (900, 2))
    x = np.hstack([base @ rng.normal(0, 1, (2, 9)) + rng.normal(0, 0.02, (900, 9)), np.zeros((900, 1))])
    x[500:640] = x[500]  # a hot group of copies
    x[rng.random(x.shape) < 0.03] = np.nan
    monkeypatch.setattr(impute, "ROWS_PER_CELL", 40)
    monkeypatch.setattr(impute, "BLOCK_ROWS", 7)
    for name, value in {"SAMPLE": 150, "LEAST": 8, "DEALT": 60}.items():
        monkeypatch.setattr(donors, name, value)
    names = [f"c{i}" for i in range(x.shape[1])]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(id=range(len(x))))
    df = df.select("id", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in names])
    fit = impute.fit_knn(df, names)
    assert len(fit.tree.levels) >= 3
    assert fit.tree.members.agg(F.sum("n")).first()[0] == 900
    got = fit.apply(df).orderBy("id").toPandas()[names].to_numpy()
    assert np.allclose(got, brute_knn(x, 5))


def test_receivers_meet_few_donors_however_many_there_are(spark, monkeypatch):
    monkeypatch.setattr(impute, "ROWS_PER_CELL", 50)
    visits = []
    for n in (1_000, 8_000):
        rng = np.random.default_rng(3)
        t = rng.random((n, 2))
        x = t @ np.ones((2, 15)) + t[:, :1] * np.arange(15) + rng.normal(0, 1e-3, (n, 15))
        asked = spark.createDataFrame([(i, [float(v) if j else None for j, v in enumerate(x[i * 7])], 0) for i in range(20)], "rid long, x array<double>, t int")
        names = [f"c{i}" for i in range(15)]
        tree = donors.DonorTree(spark.createDataFrame(pd.DataFrame(x, columns=names)), names, 50)
        seen = []
        plain = donors.DonorTree._searched

        def watched(self, boxes, k, rows, plain=plain, seen=seen):
            seen.append(boxes.count())
            return plain(self, boxes, k, rows)

        monkeypatch.setattr(donors.DonorTree, "_searched", watched)
        tree.nearest(asked, 5, 20_000)
        monkeypatch.setattr(donors.DonorTree, "_searched", plain)
        visits.append(sum(seen) / 20)
    assert visits[1] <= 2 * visits[0] + 2 and visits[1] < 20


def test_knn_leaves_nonfinite_values_and_tables_without_donors(spark):
    rows = [(1, 1.0, 10.0), (2, None, 10.5), (3, float("nan"), 11.0), (4, float("inf"), None), (5, 3.0, None), (6, None, None)]
    got = {r.id: (r.a, r.b) for r in impute.impute_knn(spark.createDataFrame(rows, "id int, a double, b double"), ["a", "b"], k=1).collect()}
    assert got[2] == (1.0, 10.5) and np.isnan(got[3][0]) and got[5] == (3.0, 10.0)
    assert got[4] == (float("inf"), pytest.approx(10.5)) and got[6] == (2.0, pytest.approx(10.5))
    empty = spark.createDataFrame([], "id int, a double")
    assert impute.impute_knn(empty, ["a"]).collect() == []
    assert impute.impute_knn(spark.createDataFrame([(1, None)], "id int, a double"), ["a"]).first().a is None


def test_narrowing_takes_one_sketch_however_many_brackets(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=6000), 2)
    ps, calls, real = [i / 60 for i in range(61)], [], F.percentile_approx
    monkeypatch.setattr(F, "percentile_approx", lambda *a: calls.append(a) or real(*a))
    got = quantiles(spark.createDataFrame([(float(v),) for v in x], "a double"), ["a"], ps, 3)
    assert np.allclose(got["a"], np.percentile(x, [100 * p for p in ps]), atol=1e-12)
    assert len(calls) < 10
