"""Exact quantiles of many columns by one sketch pass and one counting pass.

The first read takes a mergeable sketch of every column. It encloses each wanted rank in a bracket of two of the column's
values. The second read counts what lies below, at and between the brackets' ends, and lists the values inside, of
which there are few: the sum over all brackets is bounded. Only a table so large that its brackets would hold more is
narrowed first, by a sketch of the values inside each bracket; each such read cuts them to about a hundredth.

One rule holds at every size: nulls are left out, NaN is larger than any number, infinities are values like others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The sketch's ranks are off by at most one in so many rows.
ACCURACY = 10_000
#: Values that are listed at once, over all columns and brackets.
LISTED = 200_000
#: Points of a sketch that narrows a bracket.
GRID = 256
#: Below so many values narrowing is not worth a read.
FEW = 1000

Bracket = tuple[str, float, float]


def quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], listed: int = LISTED) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of every column; None for a column without values."""
    columns, probabilities = list(columns), [float(p) for p in probabilities]
    if not columns:
        return {}
    names = [f"q{i}" for i in range(len(columns))]
    data = df.select(*[F.col(c).cast("double").alias(q) for c, q in zip(columns, names)])
    slack = 2.0 / ACCURACY + len(columns) / max(listed, FEW)
    edges = sorted({min(1.0, max(0.0, p + s)) for p in probabilities for s in (-slack, slack)})
    wanted = []
    for q in names:
        real = F.when(~F.isnan(q), F.col(q))
        wanted += [F.count(real), F.count(F.when(F.isnan(q), True)), F.percentile_approx(real, edges, ACCURACY)]
    told = data.agg(*[w.alias(f"a{i}") for i, w in enumerate(wanted)]).first()
    n, nan, sketch = ({q: told[3 * i + k] for i, q in enumerate(names)} for k in range(3))

    def ranks(q: str, p: float) -> tuple[float, int, int]:
        at = p * (n[q] + nan[q] - 1)
        return at, math.floor(at), math.ceil(at)

    open_: dict[tuple[str, int], Bracket] = {}
    everything = sum(n.values()) <= max(listed, FEW)
    for q in names:
        for p in probabilities if n[q] else []:
            for k in ranks(q, p)[1:]:
                if k < n[q]:
                    a, b = (sketch[q][edges.index(min(1.0, max(0.0, p + s)))] for s in (-slack, slack))
                    # both ends of the distribution are open, where the sketch may miss the last value;
                    # NaN shift the ranks, so a column with some is narrowed by another read
                    low, high = everything or nan[q] or p <= slack, everything or nan[q] or p >= 1 - slack
                    old = open_.get((q, k))
                    new = (q, -math.inf if low else a, math.inf if high else b)
                    open_[q, k] = new if old is None else (q, max(new[1], old[1]), min(new[2], old[2]))
    inside = {b: (1.0 if nan[b[0]] else 2 * slack + 2.0 / ACCURACY) * n[b[0]] + 1 for b in open_.values()} if not everything else {}
    found: dict[tuple[str, int], float] = {}
    while sum(inside.values()) > max(listed, FEW):
        open_, inside = _narrowed(data, open_, found)
    if open_:
        found |= _listed(data, open_)

    def value(q: str, p: float) -> float | None:
        if n[q] + nan[q] == 0:
            return None
        at, low, high = ranks(q, p)
        a, b = (found[q, k] if k < n[q] else math.nan for k in (low, high))
        if a == b or low == high:
            return a
        return a + (b - a) * (at - low) if math.isfinite(a) and math.isfinite(b) else (high - at) * a + (at - low) * b

    return {c: [value(q, p) for p in probabilities] for c, q in zip(columns, names)}


def _narrowed(data: DataFrame, open_: dict[tuple[str, int], Bracket], found: dict) -> tuple[dict, dict]:
    """Smaller brackets, and how many values can lie between their ends; ranks that fall on an end are found.

    A value is looked at once, in the place between the ends where it lies, however many brackets there are.
    """
    names, ends, shown, rows = _places(data, open_, repeated=True)
    inner = F.percentile_approx("v", [i / GRID for i in range(GRID + 1)], ACCURACY)
    # a row per place: twice as many as there are brackets, and some
    told = {(q, at): (n, grid) for q, at, n, grid in rows.groupBy("q", "place").agg(F.sum("n"), inner).collect()}
    left, inside = {}, {}
    for q, k in open_:
        below, e = 0, ends[q]
        for at in range(2 * len(e) + 1):
            n, grid = told.get((names.index(q), at), (0, None))
            if k < below + n:
                break
            below += n
        if at % 2:
            found[q, k] = float(e[at // 2])
            continue
        if not shown[q][at]:
            raise ArithmeticError("a sketch bracket missed its quantile")
        lo, hi, r = float(e[at // 2 - 1]), float(e[at // 2]), k - below
        i = math.floor((r / n - 2.0 / ACCURACY) * GRID) - 1
        j = math.ceil(((r + 1) / n + 2.0 / ACCURACY) * GRID) + 1
        new = (q, lo if i <= 0 else grid[i], hi if j >= GRID else grid[j])
        left[q, k], inside[new] = new, n * ((j - i) / GRID + 2.0 / ACCURACY)
        if new == (q, lo, hi) and n <= FEW:  # nothing more to gain
            inside[new] = 0
    return left, inside


def _places(data: DataFrame, open_: dict[tuple[str, int], Bracket], repeated: bool = False) -> tuple[list[str], dict, dict, DataFrame]:
    """Columns, the brackets' ends, the places inside a bracket, and (q, place, v, n): how often a value inside a bracket occurs, and how many lie at other places.

    Places are 2 i before end i and 2 i + 1 at end i. ``repeated`` gives values inside once each time they occur.
    """
    names = data.columns
    ends = {q: np.array(sorted({x for c, lo, hi in open_.values() if c == q for x in (lo, hi)})) for q in names}
    # even places between a bracket's ends are listed
    shown = {q: np.zeros(2 * len(e) + 1, dtype=bool) for q, e in ends.items()}
    for q, lo, hi in set(open_.values()):
        i, j = np.searchsorted(ends[q], [lo, hi])
        shown[q][2 * i + 2 : 2 * j + 1 : 2] = True
    chosen = [i for i, q in enumerate(names) if len(ends[q])]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[np.ndarray, ...]] = []
            for i in chosen:
                x = batch.column(i).drop_null().to_numpy(zero_copy_only=False)
                x = x[~np.isnan(x)]
                e, show = ends[names[i]], shown[names[i]]
                left = np.searchsorted(e, x, "left")
                at = 2 * left + (np.searchsorted(e, x, "right") > left)
                counts = np.bincount(at[~show[at]], minlength=len(show))
                held = np.flatnonzero(counts)
                rows.append((np.full(len(held), i), held, np.zeros(len(held)), counts[held]))
                if repeated:
                    v, spot = x[show[at]], at[show[at]]
                    rows.append((np.full(len(v), i), spot, v, np.ones(len(v), dtype=np.int64)))
                    continue
                v, first, number = np.unique(x[show[at]], return_index=True, return_counts=True)
                rows.append((np.full(len(v), i), at[show[at]][first], v, number))
            columns = [np.concatenate(c) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.float64(), pa.int64()))], ["q", "place", "v", "n"])

    return names, ends, shown, data.mapInArrow(place, "q int, place int, v double, n long")


def _listed(data: DataFrame, open_: dict[tuple[str, int], Bracket]) -> dict[tuple[str, int], float]:
    """The value at each rank: counts of the places between and at the brackets' ends, and the values inside them."""
    names, ends, shown, rows = _places(data, open_)
    told = rows.groupBy("q", "place", "v").agg(F.sum("n").alias("n")).toPandas()
    out = {}
    for i, q in enumerate(names):
        if not len(ends[q]):
            continue
        own = told[told.q == i].sort_values(["place", "v"])
        at, n = own.place.to_numpy(), own.n.to_numpy()
        values = np.where(at % 2 == 1, ends[q][np.minimum(at // 2, len(ends[q]) - 1)], own.v.to_numpy())
        reach = np.cumsum(n)
        for c, k in open_:
            if c == q:
                spot = int(np.searchsorted(reach, k, side="right"))
                if at[spot] % 2 == 0 and not shown[q][at[spot]]:
                    raise ArithmeticError("a sketch bracket missed its quantile")
                out[c, k] = float(values[spot])
    return out


def quantile(df: DataFrame, column: str, p: float, listed: int = LISTED) -> float | None:
    return quantiles(df, [column], [p], listed)[column][0]
