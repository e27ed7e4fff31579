"""A large one-class search reads all rows in few rounds and ends where the plain search does."""

import numpy as np

from strataflow.models import anomaly


def test_a_large_search_begins_near_its_end(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [tuple(map(float, x)) for x in rng.normal(size=(4000, 2))]
    df = spark.createDataFrame(rows, "a double, b double")
    whole, real = [], anomaly._tree_sums

    def counted(data, features, part):
        whole.append(data.count() == len(rows))
        return real(data, features, part)

    monkeypatch.setattr(anomaly, "_tree_sums", counted)
    plain = anomaly.fit_one_class(df, ["a", "b"], dimensions=16)
    before = sum(whole)
    whole.clear()
    monkeypatch.setattr(anomaly, "LARGE", 2000, raising=False)
    monkeypatch.setattr(anomaly, "START", 1500, raising=False)
    model = anomaly.fit_one_class(df, ["a", "b"], dimensions=16)
    assert 2 < sum(whole) < before - 2
    assert np.allclose(model.weights, plain.weights, atol=2e-3)
    told = [m.transform(df).agg({"prediction": "sum"}).first()[0] for m in (plain, model)]
    assert abs(told[0] - told[1]) <= 4
