"""Lag, rolling, derivative and smoothing features along a series."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..channels import EPSILON
from ..functions import rolling as R
from ..series import Frame, SeriesLike, accumulate, number_rows, over_series
from ..session import materialise
from ..quantiles import quantile
from .clean import forward_fill


#: Tasks of a costly function for each core: enough to even out series of different lengths.
TASKS_PER_CORE = 4


def _complete(df: DataFrame, drop: bool, subset: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(subset=list(subset) if subset else None) if drop else df


def lag_features(
    df: DataFrame, series: SeriesLike, columns: Sequence[str], lags: Sequence[int] = (1, 2, 3, 4, 5), drop: bool = True
) -> DataFrame:
    """``<column>_lag_<k>``; rows with any missing column are dropped."""
    out = over_series(
        df, series, lambda f: {f"{c}_lag_{k}": R.shifted(f, c, k) for c in columns for k in lags}, back=max(lags)
    )
    return _complete(out, drop)


def rolling_features(
    df: DataFrame, series: SeriesLike, columns: Sequence[str], windows: Sequence[int] = (5, 10, 20), drop: bool = True
) -> DataFrame:
    """Mean, std, min and max of full windows."""
    kinds = {"mean": R.mean, "std": R.std, "min": R.low, "max": R.high}
    out = over_series(
        df,
        series,
        lambda f: {f"{c}_rolling_{k}_{n}": fn(f, c, n) for c in columns for n in windows for k, fn in kinds.items()},
        back=max(windows) - 1,
    )
    return _complete(out, drop)


def rolling_apply(df: DataFrame, series: SeriesLike, columns: Sequence[str], window: int, function: Callable[[pd.Series], float], name: str) -> DataFrame:
    """``<column>_<name>_<window>``: a function of the user's own over the last ``window`` values; null in shorter windows.

    One pass serves all columns. On a long series the function sees the same windows, carried by its chunks.
    The function is slow beside its rows' bytes, so series are dealt to as many tasks as there are cores to run them.
    """
    series = series.measure(df)
    if series.keys and not series.chunked and not df.isStreaming:
        df = df.repartition(TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism, *series.keys)
    return over_series(df, series, lambda f: {f"{c}_{name}_{window}": R.custom(f, c, window, function) for c in columns}, back=window - 1)


def derivative_features(df: DataFrame, series: SeriesLike, columns: Sequence[str], drop: bool = True) -> DataFrame:
    def build(f: Frame) -> dict[str, Column]:
        out = {}
        for c in columns:
            out[f"{c}_derivative"] = R.difference(f, c)
            out[f"{c}_second_derivative"] = R.second_difference(f, c)
        return out

    return _complete(over_series(df, series, build, back=2), drop)


def _temporal(f: Frame, c: str) -> dict[str, Column]:
    out = {f"{c}_Rate": R.difference(f, c), f"{c}_Acceleration": R.second_difference(f, c)}
    for n in (5, 10, 20):
        out[f"{c}_MA_{n}"] = R.mean(f, c, n)
        out[f"{c}_STD_{n}"] = R.std(f, c, n)
        out[f"{c}_MIN_{n}"] = R.low(f, c, n)
        out[f"{c}_MAX_{n}"] = R.high(f, c, n)
    out[f"{c}_Trend_5"] = R.slope(f, c, 5)
    out[f"{c}_Volatility"] = R.volatility(f, c, 10)
    return out


def temporal_features(df: DataFrame, series: SeriesLike, columns: Sequence[str]) -> DataFrame:
    """Rate, acceleration, moving statistics, trend and volatility in one window pass."""
    present = [c for c in columns if c in df.columns]
    return over_series(df, series, lambda f: {k: v for c in present for k, v in _temporal(f, c).items()}, back=19)


def trend(df: DataFrame, series: SeriesLike, column: str, n: int, name: str | None = None) -> DataFrame:
    return over_series(df, series, lambda f: {name or f"{column}_Trend": R.slope(f, column, n)}, back=n - 1)


def short_history_features(df: DataFrame, series: SeriesLike, column: str) -> DataFrame:
    """Moving averages that start with the first row, and relative change."""
    return over_series(
        df,
        series,
        lambda f: {
            f"{column}_MA3": R.partial_mean(f, column, 3),
            f"{column}_MA5": R.partial_mean(f, column, 5),
            f"{column}_Std3": R.partial_std(f, column, 3),
            f"{column}_Change": R.difference(f, column),
            f"{column}_ROC": R.percent_change(f, column),
            f"{column}_Lag1": R.shifted(f, column, 1),
        },
        back=4,
    )


def anomaly_features(df: DataFrame, series: SeriesLike, columns: Sequence[str]) -> DataFrame:
    """Rolling z-score (50), distance from the rolling median (20), rate anomaly (20)."""
    names = {c: f"{c}__step" for c in columns}

    def build(f: Frame) -> dict[str, Column]:
        out = {}
        for c, step in names.items():
            out[f"{c}_ZScore"] = F.try_divide(F.col(c) - R.mean(f, c, 50), R.std(f, c, 50) + F.lit(EPSILON))
            out[f"{c}_Median_Distance"] = F.abs(F.col(c) - R.middle(f, c, 20))
            out[f"{c}_Rate_Anomaly"] = F.try_divide(F.abs(F.col(step)), R.std(f, step, 20) + F.lit(EPSILON))
        return out

    layout = series.measure(df)
    stepped = over_series(df, layout, lambda f: {s: R.difference(f, c) for c, s in names.items()}, back=1)
    return over_series(stepped, layout, build, back=49).drop(*names.values())


def deviation_features(df: DataFrame, series: SeriesLike, column: str, n: int = 10) -> DataFrame:
    return over_series(
        df,
        series,
        lambda f: {f"{column}_MA": R.mean(f, column, n), f"{column}_Deviation": F.col(column) - R.mean(f, column, n)},
        back=n - 1,
    )


def variation(df: DataFrame, series: SeriesLike, column: str, n: int = 5) -> DataFrame:
    return over_series(df, series, lambda f: {f"{column}_Variation": R.std(f, column, n)}, back=n - 1)


def cumulative_change(df: DataFrame, series: SeriesLike, column: str, change: str, total: str) -> DataFrame:
    """Step from the previous row, and the running sum of the steps."""
    layout = series.measure(df)
    stepped = over_series(df, layout, lambda f: {change: R.difference(f, column)}, back=1)
    summed = accumulate(stepped, layout, sums={total: F.col(change)})
    return summed.withColumn(total, F.when(F.col(change).isNotNull(), F.col(total)))


def gradient(df: DataFrame, series: SeriesLike, y: str, x: str, name: str = "gradient") -> DataFrame:
    return over_series(df, series, lambda f: {name: R.gradient(f, y, x)}, back=1, ahead=1)


def steps(df: DataFrame, series: SeriesLike, column: str, name: str) -> DataFrame:
    """First differences; the first row of each series has none and is dropped."""
    return over_series(df, series, lambda f: {name: R.difference(f, column)}, back=1).where(F.col(name).isNotNull())


def smooth(df: DataFrame, series: SeriesLike, columns: Sequence[str], size: int = 7, degree: int = 2) -> DataFrame:
    """Fill forward, then smooth every column that has more than ``size`` values in its series."""
    layout = series.measure(df)
    names = {c: f"{c}__filled" for c in columns}
    enough = {c: f"{c}__count" for c in columns}
    work = df.withColumns({n: F.col(c) for c, n in names.items()})
    work = forward_fill(work, layout, list(names.values()))
    work = _series_counts(work, layout, {"_length": F.lit(1), **{enough[c]: F.col(c) for c in columns}})

    seen = over_series(
        work, layout, lambda f: R.smoothing_window(f, list(names.values()), "_length", size, degree),
        back=size - 1, ahead=size - 1,
    )
    smoothed = {
        c: F.when(F.col(enough[c]) > size, R.weighted_sum(n, size)).otherwise(F.col(c)) for c, n in names.items()
    }
    return seen.select(*[smoothed.get(c, F.col(c)).alias(c) for c in df.columns])


def _series_counts(df: DataFrame, layout, counted: dict[str, Column]) -> DataFrame:
    """Non-NULL counts per series, attached to every row."""
    if not layout.chunked:
        keyed = Window.partitionBy(*layout.keys)
        return df.withColumns({n: F.count(c).over(keyed) for n, c in counted.items()})
    if not layout.keys:
        df = materialise(df)
        got = df.agg(*[F.count(c).alias(n) for n, c in counted.items()]).first()
        return df.withColumns({n: F.lit(got[n]).cast("long") for n in counted})
    df = materialise(df)
    same = F.struct(*layout.keys)
    sizes = df.groupBy(same.alias("_series")).agg(*[F.count(c).alias(n) for n, c in counted.items()])
    return df.withColumn("_series", same).join(sizes, "_series").drop("_series")


def kick_features(df: DataFrame, series: SeriesLike) -> DataFrame:
    """Flow balance, pit-volume rate, pressure, return-flow and hook-load indicators."""
    from .features import flow_balance

    have = set(df.columns)

    def build(f: Frame) -> dict[str, Column]:
        out = {}
        if "ActiveGL" in have:
            out["ActiveGL_Rate"] = R.difference(f, "ActiveGL")
            out["ActiveGL_Acceleration"] = R.second_difference(f, "ActiveGL")
        if "WBoPress" in have:
            out["SPP_Variation"] = R.std(f, "WBoPress", 5)
            out["SPP_Trend"] = R.slope(f, "WBoPress", 10)
        if "MRFlow" in have:
            out["MRFlow_MA"] = R.mean(f, "MRFlow", 10)
            out["MRFlow_Deviation"] = F.col("MRFlow") - R.mean(f, "MRFlow", 10)
        if "HLoad" in have:
            out["HLoad_Variation"] = R.std(f, "HLoad", 5)
            out["HLoad_Trend"] = R.slope(f, "HLoad", 10)
        return out

    return over_series(flow_balance(df), series, build, back=9)


def calendar_features(df: DataFrame, column: str) -> DataFrame:
    """Hour, weekday (Monday is 0), month and quarter; unreadable timestamps give NULL."""
    moment = F.col(column)
    if dict(df.dtypes)[column] == "string":
        moment = F.coalesce(F.try_to_timestamp(moment), moment.try_cast("timestamp"))
    return df.withColumns(
        {"hour": F.hour(moment), "day_of_week": F.weekday(moment), "month": F.month(moment), "quarter": F.quarter(moment)}
    )


#: Rows of a series that each task keeps before the shuffle; for more, whole series are numbered.
LATEST = 1000


def latest_rows(df: DataFrame, series: SeriesLike, n: int) -> DataFrame:
    """The last n rows of each series: every task passes on n rows of a series at most, however long it is."""
    newest = [F.desc(c) for c in series.order]
    if not series.keys:
        return df.orderBy(*newest).limit(n)
    if n > LATEST:
        return number_rows(df, series, "_at", "_of").where(F.col("_at") >= F.col("_of") - n).drop("_at", "_of")
    place = F.row_number().over(Window.partitionBy(*series.keys).orderBy(*newest))
    return df.withColumn("_at", place).where(F.col("_at") <= n).drop("_at")


def pit_volume_label(df: DataFrame, series: SeriesLike, column: str, share: float = 0.99, label: str = "Kick") -> DataFrame:
    """1 where the absolute step exceeds its percentile over all rows."""
    stepped = over_series(df, series, lambda f: {"_step": F.abs(R.difference(f, column))}, back=1)
    limit = quantile(stepped, "_step", share)
    limit_column = F.lit(limit) if limit is not None else F.lit(None).cast("double")
    return stepped.withColumn(label, F.coalesce((F.col("_step") > limit_column).cast("int"), F.lit(0))).drop("_step")


def level_label(df: DataFrame, column: str, share: float = 0.95, label: str = "Kick") -> DataFrame:
    limit = quantile(df, column, share)
    return df.withColumn(label, F.coalesce((F.col(column) > F.lit(limit)).cast("int"), F.lit(0)))
