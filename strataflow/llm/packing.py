"""Pack token sequences into rows of fixed capacity with a configuration linear program.

A configuration is a multiset of lengths that fits one row. The covering program over the length
histogram (at most ``capacity`` lengths, whatever the number of documents) is solved by multiplicative
weights: a length whose covered share lags behind gains weight, one ahead of the others loses some, and
a knapsack over the weights prices the next configurations. Every priced round covers a share of what
is left, in whole rows and within a share of each length, so rounds grow with the logarithm of the
counts. The last few pieces are placed by best fit. Only the histogram and the configurations reach the
driver; pieces find their row and place by their number among the pieces of the same length.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataflow.session import materialise

from .tokens import END_ID, encoder

CAPACITY = 1024
#: Share of the tokens left that one pricing covers, and of each length's pieces that it may use.
COVER, USE = 0.125, 0.25
#: How fast a length's weight follows its lag; how much more a token of a long piece is worth at first.
RATE, LONG = 0.1, 3.0
#: Rows worth less than this share of the first at the same prices wait for the next pricing.
CLOSE = 0.97
#: Best fit places the last pieces: this share of all, and no more than so many per length.
LAST, LAST_PER_LENGTH = 0.05, 4
#: Pieces of one length are numbered in so many groups, since one length may hold most of them.
SALTS = 512

_PIECE = "doc_id long, no_id boolean, row long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str, capacity: int, end_id: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(path).encode, np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, null, row, text in zip(batch["doc_id"], batch["no_id"], batch["row"], batch["text"], strict=True):
                raw = memoryview((encode(text) if text else b"") + end)
                n, at, piece = len(raw) // 4, 0, 0
                size = n if n <= capacity else n % capacity or capacity
                while at < n:
                    rows.append((doc_id, null, row, piece, at, size, zlib.crc32(raw[4 * at : 4 * (at + size)])))
                    at, piece, size = at + size, piece + 1, capacity
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _PIECE.split(", ")])

    return cut


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Ids of whole texts (null: empty) and ``end_id``; longer ones cut to full pieces, the first may be shorter."""
    flat = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"),
        F.xxhash64("text").alias("row"), F.col("text").cast("string").alias("text"),
    )
    return flat.mapInPandas(_cut(path, capacity, end_id), _PIECE)


# ---- the program over the histogram ---------------------------------------------


def knapsack(worth: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Per room the worth of the most valuable content: unbounded knapsack by dynamic programming."""
    best = np.zeros(capacity + 1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        k = upto[room]
        best[room] = max(best[room - 1], (worth[:k] + best[room - lengths[:k]]).max()) if k else best[room - 1]
    return best


def configuration(best: np.ndarray, worth: np.ndarray, lengths: np.ndarray, capacity: int, able: np.ndarray) -> tuple[dict[int, int], float]:
    """A row read from the knapsack's table, with at most ``able`` pieces of each length, long ones first; and its worth.

    Where lengths are used up, the table promises more than there is: the last pieces then give way to two that fill the row.
    """
    row: list[int] = []
    room, free = capacity, able.copy()
    usable = np.where(able > 0, worth, -np.inf)
    while room:
        k = int(np.searchsorted(lengths, room, side="right"))
        if not k:
            break
        gains = usable[:k] + best[room - lengths[:k]]
        j = k - 1 - int(gains[::-1].argmax())
        if gains[j] == -np.inf:
            break
        row.append(j)
        free[j] -= 1
        if not free[j]:
            usable[j] = -np.inf
        room -= int(lengths[j])
    index = np.full(capacity + 1, -1)
    for gone in range(1, min(3, len(row)) + 1) if room else ():
        j = row[-gone]
        free[j] += 1
        room += int(lengths[j])
        index[:] = -1
        index[lengths[free > 0]] = np.flatnonzero(free > 0)
        if index[room] >= 0:
            row = [*row[:-gone], int(index[room])]
            break
        longer = np.arange(room - 1, room // 2, -1)
        pairs = longer[(index[longer] >= 0) & (index[room - longer] >= 0)]
        if len(pairs):
            row = [*row[:-gone], int(index[pairs[0]]), int(index[room - pairs[0]])]
            break
    counts: dict[int, int] = {}
    for j in row:
        counts[j] = counts.get(j, 0) + 1
    return counts, float(worth[row].sum())


def covered(lengths: np.ndarray, wanted: np.ndarray, capacity: int) -> tuple[dict[tuple[tuple[int, int], ...], int], np.ndarray]:
    """Configurations (length index, count) with their numbers of rows, and the pieces that best fit is to place."""
    used: dict[tuple[tuple[int, int], ...], int] = {}
    left = wanted.copy()
    weight = lengths * (1.0 + LONG * lengths / capacity)
    last = min(LAST * float(wanted.sum()), LAST_PER_LENGTH * len(lengths))
    while left.sum() > last:
        worth = np.where(left > 0, weight, 0.0)
        best = knapsack(worth, lengths, capacity)
        able, before = np.maximum(np.ceil(left * USE).astype(np.int64), np.minimum(left, capacity // lengths)), left.copy()
        due = COVER * float((left * lengths).sum())
        first = 0.0
        while due > 0 and left.sum() > last:
            counts, value = configuration(best, worth, lengths, capacity, able)
            if not counts or value < CLOSE * first:
                break
            first = first or value
            at, held = np.fromiter(counts, dtype=np.int64), np.fromiter(counts.values(), dtype=np.int64)
            times = int((able[at] // held).min())
            able[at] -= times * held
            left[at] -= times * held
            due -= times * float((held * lengths[at]).sum())
            key = tuple(sorted(counts.items()))
            used[key] = used.get(key, 0) + times
        share = 1.0 - left / before.clip(1)  # of what this round found
        mean = 1.0 - float((left * lengths).sum()) / float((before * lengths).sum())
        weight = weight * np.exp(np.where(before > 0, RATE * (mean - share), 0.0))
    return used, left


def best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[list[int]]:
    """Rows of length indices: longest first, each into the fullest row that has room."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    rows: list[list[int]] = []
    open_rooms = 0  # bit r: some row has room r
    for j in range(len(lengths) - 1, -1, -1):
        size = int(lengths[j])
        for _ in range(int(left[j])):
            able = open_rooms >> size
            if able:
                room = size + (able & -able).bit_length() - 1
                at = rooms[room].pop()
                if not rooms[room]:
                    open_rooms ^= 1 << room
            else:
                room, at = capacity, len(rows)
                rows.append([])
            rows[at].append(j)
            if room > size:
                rooms[room - size].append(at)
                open_rooms |= 1 << room - size
    return rows


@dataclass
class Plan:
    """Slots in order of length: each stands for ``times`` pieces in rows ``first_row``, ``first_row`` + 1, ..."""

    length: np.ndarray
    number: np.ndarray
    first_row: np.ndarray
    offset: np.ndarray
    rows: int


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Rows for every piece of a length histogram. Its work grows with the capacity and the logarithm of the counts."""
    lengths = np.array(sorted(k for k, n in histogram.items() if n > 0), dtype=np.int64)
    wanted = np.array([histogram[int(k)] for k in lengths], dtype=np.int64)
    used, left = covered(lengths, wanted, capacity)
    singles: dict[tuple[int, ...], int] = {}
    for row in best_fit(lengths, left, capacity):
        singles[tuple(row)] = singles.get(tuple(row), 0) + 1
    slots, at = [], 0
    for order, times in [*(([j for j, n in c for _ in range(n)], t) for c, t in used.items()), *((list(r), t) for r, t in singles.items())]:
        offset = 0
        for j in order:
            slots.append((int(lengths[j]), at, offset, times))
            offset += int(lengths[j])
        at += times
    slots.sort()
    table = np.array(slots, dtype=np.int64).reshape(-1, 4)
    number = np.zeros(len(table), dtype=np.int64)
    for size in np.unique(table[:, 0]):
        own = table[:, 0] == size
        ends = np.cumsum(table[own, 3])
        number[own] = ends - table[own, 3]
    return Plan(table[:, 0], number, table[:, 1], table[:, 2], at)


def _place(plan: Plan) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    ceiling = int(plan.number.max()) + 1 if len(plan.number) else 1
    keys = plan.length * ceiling + plan.number

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            wanted = batch["length"].to_numpy() * ceiling + np.minimum(batch["number"].to_numpy(), ceiling - 1)
            slot = np.searchsorted(keys, wanted, side="right") - 1
            out = batch.drop(columns="number")
            out["sequence_id"] = plan.first_row[slot] + batch["number"].to_numpy() - plan.number[slot]
            out["offset"] = plan.offset[slot]
            yield out

    return place


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts are empty documents of one id. Repeated rows are documents of their own. An empty
    table gives no rows. The driver holds ``capacity`` counts and the configurations.
    """
    salt = F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(SALTS)).cast("int")
    cut = materialise(pieces(docs, path, capacity, end_id).withColumn("salt", salt))
    counts = cut.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).collect()  # at most capacity x SALTS numbers
    histogram: dict[int, int] = {}
    bases = []
    for size, group, n in sorted((r["length"], r["salt"], r["n"]) for r in counts):
        bases.append((size, group, histogram.get(size, 0)))
        histogram[size] = histogram.get(size, 0) + n
    plan = solve(histogram, capacity)
    spark = docs.sparkSession
    base = spark.createDataFrame(bases, "length long, salt int, base long")
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "row", "start", "piece")
    numbered = cut.withColumn("_n", F.row_number().over(inside)).join(F.broadcast(base), ["length", "salt"])
    ready = numbered.select("doc_id", "no_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("_n") - 1).alias("number"))
    schema = "doc_id long, no_id boolean, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    out = ready.mapInPandas(_place(plan), schema)
    return out.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
