"""Stream operators in event-time order: no cut into batches and no order of arrival may change what comes out."""

import datetime
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strataflow.streaming import live, ordered


def run(spark, tmp_path, parts, schema, work, name):
    """The rows that ``work`` gives for a stream of one file per part."""
    root = tmp_path / name
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(root / "in"))
    read = spark.read.parquet(str(root / "in")).schema
    source = live.open_stream(spark, str(root / "in"), read, files_per_trigger=1)
    live.to_parquet(work(source), str(root / "out"), str(root / "ckpt")).awaitTermination()
    return spark.read.parquet(str(root / "out")).toPandas()


@pytest.mark.parametrize(("window", "slot"), [(10, "1 minute"), (60, "30 minutes")])
def test_features_equal_batch_features(spark, tmp_path, window, slot, monkeypatch):
    """Disorder within the delay, several files, windows over 50 rows, chunks of few rows."""
    rng = np.random.default_rng(0)
    n = 240
    pdf = pd.DataFrame(
        {
            "id": np.arange(n), "well": np.where(np.arange(n) % 3 == 0, "a", "b"),
            "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), unit="min"), "x": rng.normal(0, 1, n),
        }
    )
    places = np.argsort(np.arange(n) + rng.uniform(0, 8, n))  # each row at most a few places late
    parts = [pdf.iloc[p] for p in np.array_split(places, 4)]
    schema = "id long, well string, ts timestamp, x double"
    got = run(spark, tmp_path, parts, schema, lambda s: ordered.ordered_features(s, "well", "ts", "id", "x", window=window, lags=(1, 55), slot=slot), "f")
    got = got.sort_values("id").reset_index(drop=True)
    assert len(got) > 190 and got.id.is_unique
    want = pdf.sort_values(["well", "ts"])
    by = want.groupby("well").x
    want = want.assign(m=by.transform(lambda v: v.rolling(window).mean()), s=by.transform(lambda v: v.rolling(window).std()), far=by.shift(55))
    want = want.set_index("id").loc[got.id]
    assert np.allclose(got.x_mean, want.m, equal_nan=True)
    assert np.allclose(got.x_std, want.s, equal_nan=True)
    assert np.allclose(got.x_lag_55, want.far, equal_nan=True)


def test_late_rows_and_idle_keys(spark, tmp_path):
    at = lambda minutes: pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=minutes)
    rows = lambda *x: pd.DataFrame([(i, k, at(m), float(i)) for i, k, m in x], columns=["id", "well", "ts", "x"])
    # b is silent for a day and comes back; the row 9 is far behind the watermark; one row has no time
    parts = [rows((1, "b", 0), (2, "a", 1)), rows((3, "a", 1000)), rows((4, "a", 2000)), rows((5, "b", 2001), (6, "a", 2002), (9, "a", 3)), rows((7, "c", 4000))]
    parts[1] = pd.concat([parts[1], pd.DataFrame({"id": [8], "well": ["a"], "ts": pd.to_datetime([None]), "x": [8.0]})])
    schema = "id long, well string, ts timestamp, x double"
    for idle, lag in ((None, 1.0), ("12 hours", None)):
        got = run(spark, tmp_path, parts, schema, lambda s, idle=idle: ordered.ordered_features(s, "well", "ts", "id", "x", window=2, lags=(1,), idle=idle), f"i{idle}".replace(" ", ""))
        told = {r.id: (None if pd.isna(r.x_lag_1) else r.x_lag_1) for r in got.itertuples()}
        assert told[5] == lag and 9 not in told and 8 not in told and set(told) >= {1, 2, 3, 4, 5, 6}
        assert told[6] == 4.0


def plain_repeats(rows, lifetime):
    out, last = [], {}
    for sec, key in sorted(set(rows)):
        if key not in last or sec - last[key] > lifetime:
            out.append((sec, key))
        last[key] = sec
    return out


def test_repeats_do_not_depend_on_batches(spark, tmp_path):
    """Chains within the lifetime, a renewed lifetime, equal times, a null input: every order of three files gives the same."""
    rows = [(200, 5), (400, 5), (650, 5), (650, 5), (951, 5), (1600, 5), (0, 6), (300, 6), (601, 6), (10, None), (20, None)]
    start = pd.Timestamp("2024-01-01")
    frame = lambda part: pd.DataFrame([(start + pd.Timedelta(seconds=s), k) for s, k in part], columns=["ts", "a"]).astype({"a": "Int64"})
    want = [(s, k) for s, k in plain_repeats([(s, -1 if k is None else k) for s, k in rows], 300)]
    cuts = [rows[0::3], rows[1::3], rows[2::3]]
    orders = [[rows], *([cuts[i] for i in order] for order in itertools.islice(itertools.permutations(range(3)), 0, 6, 2))]
    for i, parts in enumerate(orders):
        # a last row moves the watermark past everything
        files = [frame(p) for p in parts] + [frame([(90_000, 0)])]
        got = run(spark, tmp_path, files, "ts timestamp, a long", lambda s: ordered.drop_repeats(s, "ts", ["a"], delay="1 hour"), f"r{i}")
        told = sorted((int((r.ts - start).total_seconds()), -1 if pd.isna(r.a) else int(r.a)) for r in got.itertuples())
        assert told == sorted(want)


def test_slots_hold_few_rows_at_once():
    """Rows of many chunks come out slot by slot, merged over the batches that brought them."""

    class Value:
        def __init__(self): self.v = None
        def exists(self): return self.v is not None
        def get(self): return self.v
        def update(self, v): self.v = v
        def clear(self): self.v = None

    class Map(dict):
        def updateValue(self, k, v): self[k] = v
        def getValue(self, k): return self[k]
        def removeKey(self, k): del self[k]

    class Handle:
        def __init__(self): self.timers = []
        def getValueState(self, *_): return Value()
        def getMapState(self, *_): return Map()
        def registerTimer(self, at): self.timers.append(at)

    row = ordered._Features._ROW
    slots = ordered._Slots(Handle(), 1000, lambda r: r["at"], lambda r: r.tobytes(), lambda b: np.frombuffer(b, row))
    rng = np.random.default_rng(1)
    times = rng.permutation(50_000) * 100
    for part in np.array_split(times, 5):
        own = np.zeros(len(part), dtype=row)
        own["at"] = part
        slots.add(own)
    seen, most = [], 0
    for rows in slots.passed(2000):  # milliseconds: slots before 2,000,000 us
        seen += sorted(rows["at"].tolist())
        most = max(most, len(rows))
    assert seen == sorted(t for t in times.tolist() if t < 2_000_000)
    assert most <= 6 * ordered.CHUNK and not slots.empty()
    assert sum(len(rows) for rows in slots.passed(10**9)) == 50_000 - len(seen) and slots.empty()


def test_a_closed_stream_leaves_no_row_behind(spark, tmp_path):
    rows = [(1, "a", "2024-01-01 10:00:00", 1.0), (2, "a", "2024-01-02 10:00:00", 3.0), (3, "a", "2024-01-02 23:59:59.999999", 6.0), (4, "b", "2024-01-02 11:00:00", 2.0), (5, "a", None, 9.0)]
    schema = "id long, well string, ts string, x double"
    spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp")).repartition(3).write.parquet(str(tmp_path / "in"))
    source = live.open_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    source = live.closed(source, "ts", datetime.datetime(2024, 1, 5), str(tmp_path / "end"), well="b")
    out = ordered.ordered_features(source, "well", "ts", "id", "x", window=2, lags=(1,), delay="0 seconds", slot="1 day")
    live.to_parquet(out, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    got = {r["id"]: (r["well"], r["x"], r["x_lag_1"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {k: v[:2] for k, v in got.items()} == {1: ("a", 1.0), 2: ("a", 3.0), 3: ("a", 6.0), 4: ("b", 2.0)}
    assert (got[2][2], got[3][2]) == (1.0, 3.0)
