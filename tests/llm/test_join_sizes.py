"""Tables that an explode makes larger than they look are not sent to the driver."""

import random

import pytest
from pyspark.sql import functions as F

from strataflow.llm import graph, simhash


@pytest.fixture
def plans(monkeypatch, capsys):
    """The plans of all tables that the operators write, as they are planned before any of them runs."""
    found = []

    def noting(module):
        write = module.materialise

        def noted(df):
            capsys.readouterr()
            df.explain()
            found.append(capsys.readouterr().out)
            return write(df)

        monkeypatch.setattr(module, "materialise", noted)

    noting(simhash)
    noting(graph)
    return found


def _joined(plans, *columns):
    return [p for p in plans if any(j in p for j in ("HashJoin", "SortMergeJoin")) and all(c in p for c in columns)]


def _near(rng, middle):
    return middle ^ (1 << rng.randrange(62))


def test_keys_of_prints_meet_in_a_shuffle(spark, plans):
    rng = random.Random(3)
    middles = [rng.getrandbits(62) for _ in range(40)]
    prints = sorted({*middles, *(_near(rng, m) for m in middles)})
    got = simhash.linked(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()
    assert len(got) == len(prints)
    keyed = _joined(plans, "c0#", "c1#", "c2#")
    assert keyed and all("BroadcastExchange" not in p for p in keyed)
    assert all("BroadcastExchange" not in p for p in _joined(plans, "byte#"))
    assert _joined(plans, "byte#")


def test_near_duplicates_of_documents_meet_in_a_shuffle(spark, plans):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(i, f"{text} tail{i % 3}", "en") for i in range(6)] + [(9, "something else altogether", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert 9 in {r.doc_id for r in simhash.keep_one(docs).collect()}
    keyed = _joined(plans, "c0#", "c1#", "c2#")
    assert keyed and all("BroadcastExchange" not in p for p in keyed)


def test_rounds_of_many_links_meet_in_a_shuffle(spark, plans, monkeypatch):
    links = spark.range(1, 60).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    few = {r.node: r.component for r in graph.components(links).collect()}
    assert any("BroadcastExchange" in p for p in _joined(plans))
    plans.clear()
    monkeypatch.setattr(graph, "BROADCAST", 0, raising=False)
    assert {r.node: r.component for r in graph.components(links).collect()} == few == {i: 0 for i in range(60)}
    assert _joined(plans) and not any("BroadcastExchange" in p for p in _joined(plans))
