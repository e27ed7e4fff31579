"""Keyed operators in event-time order on a stream, with state in the state store.

Rows wait in map state, in chunks, until the watermark has passed their slot of event time; an event-time timer per key
then releases the passed slots in order. What comes out therefore depends on the rows and their times alone, not on
files, batches or order of arrival, as long as rows are not later than the delay; later ones are dropped by the
watermark. A task holds one slot of one key, and a chunk of each batch that reaches into it, at a time.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_in_rocksdb(stream: DataFrame) -> None:
    """Timers and map state need the RocksDB store; a session that names another store is set to it."""
    conf = stream.sparkSession.conf
    if "RocksDB" not in conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def micros(span: str) -> int:
    return int(pd.Timedelta(span).value // 1000)


#: Waiting rows of a key that are read and written at once.
CHUNK = 4096


class _Slots:
    """Waiting rows of the current key: chunks of rows that follow each other in time, and an index of their first slots."""

    def __init__(self, handle: StatefulProcessorHandle, width: int, times: Callable, pack: Callable, unpack: Callable):
        self.handle, self.width, self.times, self.pack, self.unpack = handle, width, times, pack, unpack
        self.index = handle.getValueState("index", "bytes binary")
        self.rows = handle.getMapState("rows", "chunk long", "bytes binary")

    def _chunks(self) -> list[tuple[int, int]]:
        """(first slot, number) of each chunk."""
        return [tuple(x) for x in pickle.loads(bytes(self.index.get()[0]))] if self.index.exists() else []  # noqa: S301

    def _store(self, chunks: list[tuple[int, int]], rows: np.ndarray) -> None:
        rows = rows[np.argsort(self.times(rows), kind="stable")]
        for at in range(0, len(rows), CHUNK):
            part, number = rows[at : at + CHUNK], max((n for _, n in chunks), default=-1) + 1
            chunks.append((int(self.times(part[:1])[0]) // self.width, number))
            self.rows.updateValue((number,), (self.pack(part),))
        if chunks:
            self.index.update((pickle.dumps(sorted(chunks)),))
            self.handle.registerTimer(self._end(min(chunks)[0]))
        elif self.index.exists():
            self.index.clear()

    def _end(self, slot: int) -> int:
        """The millisecond at which no earlier row can come any more."""
        return -(-(slot + 1) * self.width // 1000)

    def add(self, rows: np.ndarray) -> None:
        self._store(self._chunks(), rows)

    def passed(self, watermark: int) -> Iterator[np.ndarray]:
        """The rows of the passed slots, later slots later; a timer is set for the next slot that waits."""
        chunks, pool = self._chunks(), None
        done = watermark * 1000 // self.width  # slots before this one have passed
        while chunks and chunks[0][0] < done:
            _, number = chunks.pop(0)
            more = self.unpack(bytes(self.rows.getValue((number,))[0]))
            self.rows.removeKey((number,))
            pool = more if pool is None else np.concatenate([pool, more])
            # rows before the next chunk's first slot are whole
            slots, limit = self.times(pool) // self.width, min(done, chunks[0][0] if chunks else done)
            if (slots < limit).any():
                yield pool[slots < limit]
                pool = pool[slots >= limit]
        self._store(chunks, pool if pool is not None else np.zeros(0))

    def empty(self) -> bool:
        return not self.index.exists()


def _timed(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """Adds _time, with the watermark, and _us; rows without a time have no place in the order and are left out."""
    timed = stream.withColumn("_time", F.col(time).cast("timestamp")).where(F.col("_time").isNotNull())
    return timed.withColumn("_us", F.unix_micros("_time")).withWatermark("_time", delay)


# ---- lags and rolling features ------------------------------------------------------------


def features(values: np.ndarray, start: int, window: int, lags: Sequence[int]) -> dict[str, np.ndarray]:
    """Features of ``values[start:]`` with everything before as history."""
    longest = max(window, 5, *[k + 1 for k in lags])
    padded = np.concatenate([np.full(longest, np.nan), values])

    def view(n: int) -> np.ndarray:
        """The last n values of every emitted row, NaN before the series begins."""
        return np.lib.stride_tricks.sliding_window_view(padded, n)[longest - n + 1 + start:]

    def back(k: int) -> np.ndarray:
        return padded[longest + start - k: len(padded) - k]

    part = view(window)
    return {
        **{f"lag_{k}": back(k) for k in lags},
        "rate": back(0) - back(1),
        "mean": part.mean(axis=1),
        "std": part.std(axis=1, ddof=1),
        "low": part.min(axis=1),
        "high": part.max(axis=1),
        "trend": view(5) @ (np.arange(5) - 2.0) / 10,
    }


class _Features(StatefulProcessor):
    _ROW = np.dtype([("at", "<i8"), ("id", "<i8"), ("v", "<f8")])

    def __init__(self, row_id: str, key: str, value: str, window: int, lags: Sequence[int], slot: int, idle: int | None):
        self.row_id, self.key, self.value = row_id, key, value
        self.window, self.lags, self.slot, self.idle = window, list(lags), slot, idle
        self.reach = max(window, 5, *[k + 1 for k in lags])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = _Slots(handle, self.slot, lambda rows: rows["at"], lambda rows: rows.tobytes(), lambda kept: np.frombuffer(kept, self._ROW))
        self.history = handle.getValueState("history", "last long, bytes binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        for pdf in rows:
            own = np.zeros(len(pdf), dtype=self._ROW)
            # by place: the frames come with other names
            own["at"], own["id"], own["v"] = pdf.iloc[:, 3], pdf.iloc[:, 0], pdf.iloc[:, 4].astype(float)
            self.slots.add(own)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        watermark = timerValues.getCurrentWatermarkInMs()
        last, held = None, np.zeros(0)
        if self.history.exists():
            last, kept = self.history.get()
            held = np.frombuffer(bytes(kept), "<f8")
        seen = last
        for rows in self.slots.passed(watermark):
            own = np.sort(rows, order=["at", "id"])
            values = np.concatenate([held, own["v"]])
            found = features(values, len(held), self.window, self.lags)
            yield pd.DataFrame(
                {
                    self.row_id: own["id"], self.key: pd.Series([key[0]] * len(own), dtype=object), "at_micros": own["at"], self.value: own["v"],
                    **{f"{self.value}_{n}": column for n, column in found.items()},
                }
            )
            held, last = values[-self.reach:], int(own["at"][-1])
        if last is None:
            return
        if self.idle is not None and self.slots.empty() and (last + self.idle) // 1000 <= watermark:
            self.history.clear()
            return
        if last != seen:
            self.history.update((last, held.astype("<f8").tobytes()))
        if self.idle is not None and self.slots.empty():
            self.handle.registerTimer((last + self.idle) // 1000 + 1)


def ordered_features(
    stream: DataFrame, key: str, time: str, row_id: str, value: str, window: int = 20, lags: Sequence[int] = (1, 2, 3),
    delay: str = "10 minutes", slot: str = "10 minutes", idle: str | None = None,
) -> DataFrame:
    """Lag and rolling features per key, in order of time and row id; windows and lags of any length.

    A row comes out once the watermark (the latest time less ``delay``) has passed its ``slot``. The state of a key is its
    waiting rows and as many last values as the windows reach back. With ``idle``, a key that had no row for so long
    is forgotten, and starts anew if it returns; without, every key keeps its last values.
    """
    keep_state_in_rocksdb(stream)
    names = [f"lag_{k}" for k in lags] + ["rate", "mean", "std", "low", "high", "trend"]
    doubles = [T.StructField(n, T.DoubleType()) for n in (value, *[f"{value}_{n}" for n in names])]
    out = T.StructType([T.StructField(row_id, T.LongType()), stream.schema[key], T.StructField("at_micros", T.LongType()), *doubles])
    rows = _timed(stream, time, delay).select(F.col(row_id).cast("long").alias(row_id), key, "_time", "_us", F.col(value).cast("double").alias(value))
    work = _Features(row_id, key, value, window, lags, micros(slot), micros(idle) if idle else None)
    return rows.groupBy(key).transformWithStateInPandas(work, out, "append", "EventTime")


# ---- repeats ------------------------------------------------------------------------------


def _objects(rows: list[tuple]) -> np.ndarray:
    out = np.empty(len(rows), dtype=object)
    out[:] = rows
    return out


class _Repeats(StatefulProcessor):
    def __init__(self, names: Sequence[str], lifetime: int, slot: int):
        self.names, self.lifetime, self.slot = list(names), lifetime, slot

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = _Slots(handle, self.slot, lambda rows: np.array([x[0] for x in rows], dtype=np.int64), lambda rows: pickle.dumps(list(rows)), lambda kept: _objects(pickle.loads(kept)))  # noqa: S301
        self.last = handle.getValueState("last", "at long")

    def _first(self, rows: list[tuple]) -> list[tuple]:
        """One row of each time: the smallest by its text."""
        best: dict[int, tuple] = {}
        for row in rows:
            if row[0] not in best or row[1] < best[row[0]][1]:
                best[row[0]] = row
        return sorted(best.values(), key=lambda x: x[0])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        for pdf in rows:
            rows_ = pdf.itertuples(index=False, name=None)  # by place: the frames come with other names
            own = self._first([(row[-1], row[-3], row[:-3]) for row in rows_])
            self.slots.add(_objects(own))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        watermark = timerValues.getCurrentWatermarkInMs()
        last = self.last.get()[0] if self.last.exists() else None
        seen = last
        for rows in self.slots.passed(watermark):
            kept = []
            for at, _, row in self._first(list(rows)):
                if last is None or at - last > self.lifetime:
                    kept.append(row)
                last = at
            if kept:
                yield pd.DataFrame(kept, columns=self.names)
        if last is None:
            return
        # nothing that still comes can lie within the lifetime: the input is forgotten
        if self.slots.empty() and (last + self.lifetime) // 1000 < watermark:
            self.last.clear()
            return
        if last != seen:
            self.last.update((last,))
        if self.slots.empty():
            self.handle.registerTimer((last + self.lifetime) // 1000 + 1)


def drop_repeats(stream: DataFrame, time: str, columns: Sequence[str], lifetime: str = "300 seconds", delay: str = "300 seconds", slot: str = "10 seconds") -> DataFrame:
    """Rows that no equal one (in ``columns``, nulls equal) came before by at most the lifetime; a repeat renews the lifetime.

    So of a chain of equal inputs, each within the lifetime of the one before, only the first stays, however long the chain
    is. Of equal inputs at one time one stays, the smallest by its other columns. A row comes out once the watermark
    (the latest time less ``delay``) has passed its ``slot``. Rows later than the delay, and rows without a time, are dropped.
    """
    keep_state_in_rocksdb(stream)
    names = stream.columns
    rows = _timed(stream.withColumn("_order", F.to_json(F.struct(*names))), time, delay)
    work = _Repeats(names, micros(lifetime), micros(slot))
    return rows.groupBy(*columns).transformWithStateInPandas(work, stream.schema, "append", "EventTime")
