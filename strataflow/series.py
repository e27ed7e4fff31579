"""Ordered series over distributed data.

A telemetry series is a set of key columns (the well) and order columns (time or
depth, made unique by an id).  Short series are handled by one ordinary keyed
window.  When one series is longer than ``rows_per_task`` the rows are numbered
through range buckets and cut into chunks of fixed length; each chunk carries
copies of the few neighbouring rows its windows look at, so a well holding a third
of the data is spread over many tasks and results stay exact.

All choices are made from aggregates of the data and turned into literals, and the
rows of a cut series are stored in the shared checkpoint folder before they are read
twice, so a lost task is recomputed to the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import materialise

ROWS_PER_TASK = 1 << 21
MAX_BUCKETS = 8192

_BEFORE = Window.unboundedPreceding


@dataclass(frozen=True)
class Series:
    """Key and order columns; the order columns together must be unique per key."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    rows_per_task: int = ROWS_PER_TASK

    def __init__(self, keys: Sequence[str] | str, order: Sequence[str] | str, rows_per_task: int = ROWS_PER_TASK):
        object.__setattr__(self, "keys", (keys,) if isinstance(keys, str) else tuple(keys))
        object.__setattr__(self, "order", (order,) if isinstance(order, str) else tuple(order))
        object.__setattr__(self, "rows_per_task", rows_per_task)
        if not self.order:
            raise ValueError("an ordered series needs at least one order column")

    def measure(self, df: DataFrame) -> "Layout":
        """Look at the sizes once and decide whether long series must be cut."""
        total = df.count()
        if total <= self.rows_per_task:
            return Layout(self)
        if self.keys:
            longest = df.groupBy(*self.keys).count().agg(F.max("count")).first()[0]
            if longest <= self.rows_per_task:
                return Layout(self)
        buckets = min(MAX_BUCKETS, max(2, -(-4 * total // self.rows_per_task)))
        skip = tuple(_shared_bytes(df, c) for c in self.order[:2])
        first, repeated = _range_bounds(df, self.order[0], buckets, skip[0])
        second: list[float] = []
        if repeated and len(self.order) > 1:
            second, _ = _range_bounds(df, self.order[1], buckets, skip[1])
        return Layout(self, True, tuple(first), tuple(repeated), tuple(second), skip)


@dataclass(frozen=True)
class Layout:
    """A measured series: plain keyed windows, or range buckets and chunks."""

    series: Series
    chunked: bool = False
    bounds: tuple[float, ...] = ()
    repeated: tuple[float, ...] = ()
    second: tuple[float, ...] = ()
    skip: tuple[int, ...] = (0, 0)
    chunk_rows: int = field(default=0)

    @property
    def keys(self) -> tuple[str, ...]:
        return self.series.keys

    @property
    def order(self) -> tuple[str, ...]:
        return self.series.order

    def measure(self, df: DataFrame) -> "Layout":
        return self

    def by(self, *keys: str) -> "Layout":
        return replace(self, series=Series(keys, self.order, self.series.rows_per_task))


SeriesLike = Series | Layout


def _shared_bytes(df: DataFrame, name: str) -> int:
    """How many first bytes all values of a string column share; they tell nothing about the order."""
    if not isinstance(df.schema[name].dataType, T.StringType):
        return 0
    ends = df.agg(F.min(name).alias("a"), F.max(name).alias("b")).first()
    if ends["a"] is None:
        return 0
    a, b = (x.encode("utf-8", "surrogatepass") for x in ends)
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def _as_number(df: DataFrame, name: str, skip: int = 0) -> Column:
    """A number that never falls where the column's order rises; equal numbers may stand for different values."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        # by the clock's own fields: no zone, whose changes would fold or skip hours
        seconds = F.unix_date(c.cast("date")).cast("long") * 86_400 + F.hour(c) * 3600 + F.minute(c) * 60
        return seconds.cast("double") * 1e6 + F.extract(F.lit("SECOND"), c).cast("double") * 1e6
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    if isinstance(kind, T.StringType):
        # strings are ordered by their bytes: the six that follow the shared ones, as one number
        six = F.substring(F.concat(F.substring(c.cast("binary"), skip + 1, 6), F.lit(bytes(6))), 1, 6)
        return F.conv(F.hex(six), 16, 10).cast("double")
    raise ValueError(f"order column {name} must be a number, a string, a date or a timestamp to cut long series")


def _exact(df: DataFrame, name: str, value: float) -> bool:
    """Whether the number stands for one value of the column alone."""
    kind = df.schema[name].dataType
    return not isinstance(kind, (T.StringType, T.DecimalType)) and (not isinstance(kind, T.LongType) or abs(value) < 2**53)


def _range_bounds(df: DataFrame, name: str, buckets: int, skip: int = 0) -> tuple[list[float], list[float]]:
    """Approximate quantiles as cut points, and the values that fill a whole bucket."""
    probabilities = [i / buckets for i in range(1, buckets)]
    found = df.select(_as_number(df, name, skip).alias("v")).approxQuantile("v", probabilities, 1 / (4 * buckets))
    bounds = sorted({v for v in found if abs(v) != float("inf")})
    return bounds, sorted({v for v in bounds if found.count(v) > 1 and _exact(df, name, v)})


def _bucket(df: DataFrame, name: str, bounds: Sequence[float], out: str, skip: int = 0) -> DataFrame:
    number = f"{out}_number"
    splits = [float("-inf"), *bounds, float("inf")]
    cut = Bucketizer(splits=splits, inputCol=number, outputCol=out, handleInvalid="keep")
    placed = cut.transform(df.withColumn(number, _as_number(df, name, skip)))
    return placed.withColumn(out, F.when(F.col(number).isNull(), F.lit(-1.0)).otherwise(F.col(out))).drop(number)


def _bucketed(df: DataFrame, layout: Layout) -> DataFrame:
    df = df.withColumn("_series", F.struct(*layout.keys) if layout.keys else F.lit(0))
    df = _bucket(df, layout.order[0], layout.bounds, "_bucket", layout.skip[0])
    if not layout.second:
        return df.withColumn("_part", F.lit(0.0))
    df = _bucket(df, layout.order[1], layout.second, "_part", layout.skip[1])
    crowded = _as_number(df, layout.order[0]).isin(*layout.repeated) | F.col(layout.order[0]).isNull()
    return df.withColumn("_part", F.when(crowded, F.col("_part")).otherwise(F.lit(float(MAX_BUCKETS + 2))))


def accumulate(
    df: DataFrame,
    series: SeriesLike,
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    stored: bool = False,
) -> DataFrame:
    """Add running totals and last-known values along each series.

    ``sums`` are inclusive running sums, ``lasts`` carry the latest non-NULL value
    forward.  Long series use totals per range bucket plus a running value inside
    the bucket, so no task sees a whole series.  ``stored`` says that ``df`` is a plain
    table read, which need not be written again.
    """
    sums, lasts = dict(sums or {}), dict(lasts or {})
    layout = series.measure(df)
    if not layout.chunked:
        run = Window.partitionBy(*layout.keys).orderBy(*layout.order).rowsBetween(_BEFORE, 0)
        added = {n: F.sum(c).over(run) for n, c in sums.items()}
        added |= {n: F.last(c, ignorenulls=True).over(run) for n, c in lasts.items()}
        return df.withColumns(added)

    place = ["_series", "_bucket", "_part"]
    inside = {f"_in_{i}": c for i, c in enumerate([*sums.values(), *lasts.values()])}
    # the rows are read for the totals and again for the running values; stored once, a
    # chain of such steps stays linear instead of doubling with every step
    rows = _bucketed((df if stored else materialise(df)).withColumns(inside), layout)
    in_sum = list(inside)[: len(sums)]
    in_last = list(inside)[len(sums):]
    position = F.struct(*layout.order)
    totals = rows.groupBy(*place).agg(
        *[F.sum(c).alias(f"{c}_t") for c in in_sum],
        *[F.max_by(c, F.when(F.col(c).isNotNull(), position)).alias(f"{c}_t") for c in in_last],
    )
    # at most MAX_BUCKETS rows (times the same for crowded values) per series here
    earlier = Window.partitionBy("_series").orderBy("_bucket", "_part").rowsBetween(_BEFORE, -1)
    starts = totals.select(
        *place,
        *[F.sum(f"{c}_t").over(earlier).alias(f"{c}_s") for c in in_sum],
        *[F.last(f"{c}_t", ignorenulls=True).over(earlier).alias(f"{c}_s") for c in in_last],
    )
    run = Window.partitionBy(*place).orderBy(*layout.order).rowsBetween(_BEFORE, 0)
    joined = rows.join(starts, place, "left")
    added = {}
    for name, c in zip(sums, in_sum):
        here, start = F.sum(c).over(run), F.col(f"{c}_s")
        added[name] = F.when(here.isNull(), start).otherwise(here + F.coalesce(start, F.lit(0)))
    for name, c in zip(lasts, in_last):
        added[name] = F.coalesce(F.last(c, ignorenulls=True).over(run), F.col(f"{c}_s"))
    keep = [c for c in df.columns if c not in added]
    return joined.select(*keep, *[c.alias(n) for n, c in added.items()])


def number_rows(df: DataFrame, series: SeriesLike, name: str = "_row", length: str | None = None) -> DataFrame:
    """Zero-based row number inside each series, and optionally the series length."""
    layout = series.measure(df)
    if not layout.chunked:
        keyed = Window.partitionBy(*layout.keys)
        added = {name: F.row_number().over(keyed.orderBy(*layout.order)).cast("long") - 1}
        if length:
            added[length] = F.count(F.lit(1)).over(keyed)
        return df.withColumns(added)
    df = materialise(df)
    numbered = accumulate(df, layout, {name: F.lit(1).cast("long")}, stored=True).withColumn(name, F.col(name) - 1)
    if not length:
        return numbered
    if not layout.keys:
        return numbered.withColumn(length, F.lit(df.count()).cast("long"))
    same = F.struct(*layout.keys)
    sizes = df.groupBy(same.alias("_series")).agg(F.count(F.lit(1)).alias(length))
    return numbered.withColumn("_series", same).join(sizes, "_series").drop("_series")


@dataclass(frozen=True)
class Frame:
    """Rows ready for windows: ``window`` is ordered, ``row`` numbers the series."""

    df: DataFrame
    window: WindowSpec
    row: str
    chunked: bool

    def last(self, n: int) -> WindowSpec:
        return self.window.rowsBetween(-(n - 1), 0)

    def whole(self, column: str, n: int, value: Column) -> Column:
        """``value`` where the last ``n`` rows are all present, else NULL."""
        return F.when(F.count(column).over(self.last(n)) >= n, value)

    def close(self, df: DataFrame) -> DataFrame:
        if self.chunked:
            df = df.where("_own").drop("_series", "_chunk", "_own")
        return df.drop(self.row)


def open_frame(df: DataFrame, series: SeriesLike, back: int = 0, ahead: int = 0) -> Frame:
    """Prepare windows that look at most ``back`` rows behind and ``ahead`` rows on."""
    layout = series.measure(df)
    if not layout.chunked:
        window = Window.partitionBy(*layout.keys).orderBy(*layout.order)
        numbered = df.withColumn("_row", F.row_number().over(window).cast("long") - 1)
        return Frame(numbered, window, "_row", False)
    size = layout.chunk_rows or max(1, layout.series.rows_per_task // 2)
    size = max(size, back + 1, ahead + 1)
    rows = number_rows(df, layout, "_row").withColumn(
        "_series", F.struct(*layout.keys) if layout.keys else F.lit(0)
    )
    home = F.floor(F.col("_row") / F.lit(size))
    offset = F.col("_row") - home * size
    copies = F.array_compact(
        F.array(
            home,
            F.when(offset >= size - back, home + 1),
            F.when((offset < ahead) & (home > 0), home - 1),
        )
    )
    rows = rows.select("*", home.alias("_home"), F.explode(copies).alias("_chunk"))
    rows = rows.withColumn("_own", F.col("_home") == F.col("_chunk")).drop("_home")
    window = Window.partitionBy("_series", "_chunk").orderBy("_row")
    return Frame(rows, window, "_row", True)


def over_series(
    df: DataFrame,
    series: SeriesLike,
    columns: Callable[[Frame], Mapping[str, Column]],
    back: int = 0,
    ahead: int = 0,
) -> DataFrame:
    """Add window columns in one pass: one shuffle, one sort, one projection."""
    frame = open_frame(df, series, back, ahead)
    return frame.close(frame.df.withColumns(dict(columns(frame))))


def join_per_series(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join two per-series reports; a NULL key matches a NULL key."""
    same = F.struct(*keys) if keys else F.lit(0)
    a = left.withColumn("_same", same)
    b = right.withColumn("_same", same).drop(*keys)
    return a.join(b, "_same", how).drop("_same")
