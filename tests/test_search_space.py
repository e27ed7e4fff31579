"""The random search query tries draws from the whole published range."""

from catalog import modelling
from strataflow.models import evaluate, supervised


def test_draws_are_used_as_drawn(spark, monkeypatch):
    seen = {}

    def search(df, features, target, kind, maps_of, *rest):
        estimator = supervised._regressor(kind, target, df, {})
        seen["draws"] = [{p.name: v for p, v in m.items()} for m in maps_of(estimator)]
        return None, df

    monkeypatch.setattr(modelling, "priced", lambda spark, sf: spark.range(1))
    monkeypatch.setattr(evaluate, "_search", search)
    modelling.h19_random(spark, "")
    assert seen["draws"] == evaluate.sample_parameters("random_forest", 10)
    assert max(d["numTrees"] for d in seen["draws"]) > 200 and max(d["maxDepth"] for d in seen["draws"]) > 6
