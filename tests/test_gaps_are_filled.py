"""Kick preparation fills gaps from the nearest donors: rows with gaps stay until then."""

import numpy as np
import pytest

from strataflow.operators import clean
from strataflow.plans import preparation
from strataflow.series import Series


def _samples(spark):
    rows = []
    for i in range(60):
        rate, flow = i + 0.01 * i * i, float((i * 7) % 11)
        rows.append(("w", i, None if i == 45 else rate, None if i == 30 else flow, float((i * 5) % 13)))
    return rows, spark.createDataFrame(rows, "well_id string, seq long, FRate double, FIn double, FOut double")


def test_rows_with_gaps_stay_and_are_filled(spark):
    rows, df = _samples(spark)
    got, fitted = preparation.prepare_kick(df, Series("well_id", "seq"), ["FRate", "FIn", "FOut"])
    out = {r.seq: r for r in got.collect()}
    whole, _ = preparation.prepare_kick(df.fillna(5.0), Series("well_id", "seq"), ["FRate", "FIn", "FOut"])
    assert sorted(out) == sorted(r.seq for r in whole.collect())
    mean, width = fitted.scaling["FIn"]
    # FRate alone tells distances here: 29, 31, 28, 32 and 27 are nearest
    assert out[30].FIn * width + mean == pytest.approx(np.mean([rows[i][3] for i in (29, 31, 28, 32, 27)]))
    assert all(v is not None for r in out.values() for v in r)


def test_a_gap_is_an_outlier_unless_gaps_are_kept(spark):
    df = spark.createDataFrame([(float(i), None if i == 3 else 1.0 * i) for i in range(8)] + [(900.0, None)], "a double, b double")
    assert clean.remove_iqr_outliers(df, ["a", "b"]).count() == 7
    kept = clean.remove_iqr_outliers(df, ["a", "b"], keep_gaps=True)
    assert kept.count() == 8 and kept.where("b IS NULL").count() == 1
