"""Cleaning and filtering: names, types, timestamps, duplicates, outliers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..channels import drop_nonfinite, numeric_columns, text_columns
from ..series import SeriesLike, accumulate
from ..quantiles import quantiles
from ..stats import gather, literal_table, moments

# fixed values: accepted timestamp layouts, tried in this order
TIMESTAMP_LAYOUTS = [
    "yyyy-MM-dd HH:mm:ss",
    "dd/MM/yyyy HH:mm:ss",
    "MM/dd/yyyy HH:mm:ss",
    "yyyy-MM-dd",
    "dd/MM/yyyy",
    "MM/dd/yyyy",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
]


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.dropna(how="all")


def tidy_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().replace(" ", "_") for c in df.columns])


def coerce_numeric_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Turn a text column into doubles when every non-NULL value parses."""
    columns = list(columns if columns is not None else text_columns(df))
    bad = gather(df, {c: F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()) for c in columns})
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns if bad[c] == 0})


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def parse_timestamps(df: DataFrame, column: str, layouts: Sequence[str] = TIMESTAMP_LAYOUTS) -> DataFrame:
    """Use the first layout that reads the whole column, else the first that reads each value."""
    if not isinstance(df.schema[column].dataType, T.StringType):
        return df
    parsed = [F.try_to_timestamp(F.col(column), F.lit(p)) for p in layouts]
    misses = gather(
        df, {str(i): F.count_if(F.col(column).isNotNull() & p.isNull()) for i, p in enumerate(parsed)}
    )
    for i, p in enumerate(parsed):
        if misses[str(i)] == 0:
            return df.withColumn(column, p)
    return df.withColumn(column, F.coalesce(*parsed, F.col(column).try_cast("timestamp")))


def constant_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    columns = list(columns if columns is not None else numeric_columns(df))
    ends = moments(df, columns, {"min": F.min, "max": F.max})
    return [c for c in columns if ends[c]["min"] == ends[c]["max"]]


def drop_constant_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.drop(*constant_columns(df, columns))


def basic_clean(df: DataFrame) -> DataFrame:
    """Empty rows out, names tidied, numeric text coerced, duplicates out."""
    return drop_duplicate_rows(coerce_numeric_text(tidy_names(drop_empty_rows(df))))


def iqr_bounds(df: DataFrame, columns: Sequence[str], factor: float = 1.5) -> dict[str, tuple[float, float]]:
    found = quantiles(df, columns, [0.25, 0.75])
    bounds = {}
    for c, (q1, q3) in found.items():
        if q1 is not None:
            spread = q3 - q1
            bounds[c] = (q1 - factor * spread, q3 + factor * spread)
    return bounds


def _all_of(conditions: list[Column]) -> Column:
    kept = F.lit(True)
    for condition in conditions:
        kept = kept & condition
    return kept


def remove_iqr_outliers(
    df: DataFrame, columns: Sequence[str] | None = None, factor: float = 1.5, keep_gaps: bool = False
) -> DataFrame:
    """Keep rows inside the bounds of every column; a NULL counts as outside, or as inside with ``keep_gaps``.

    A column with no values at all has no bounds and removes every row, as a
    comparison with missing bounds is never true.
    """
    columns = list(columns if columns is not None else numeric_columns(df))
    bounds = iqr_bounds(df, columns, factor)
    tests = [F.col(c).between(*bounds[c]) if c in bounds else F.lit(False) for c in columns]
    if keep_gaps:
        tests = [F.col(c).isNull() | t for c, t in zip(columns, tests)]
    return df.where(_all_of(tests))


def remove_zscore_outliers(df: DataFrame, columns: Sequence[str] | None = None, factor: float = 3.0) -> DataFrame:
    columns = list(columns if columns is not None else numeric_columns(df))
    got = moments(df, columns, {"mean": F.avg, "std": F.stddev_pop})
    tests = []
    for c in columns:
        mean, std = got[c]["mean"], got[c]["std"]
        if mean is None:
            tests.append(F.lit(False))
        else:
            tests.append(F.abs(F.try_divide(F.col(c) - F.lit(mean), F.lit(std))) <= factor)
    return df.where(_all_of(tests))


def remove_sigma_outliers_stepwise(df: DataFrame, columns: Sequence[str] | None = None, sigmas: float = 3.0) -> DataFrame:
    """Complete rows only, then mean ± sigmas·std column by column on what is left."""
    columns = list(columns if columns is not None else numeric_columns(df))
    left = df.dropna()
    for c in columns:
        got = moments(left, [c], {"mean": F.avg, "std": F.stddev_samp})[c]
        if got["std"] is None:
            return left.where(F.lit(False))
        low, high = got["mean"] - sigmas * got["std"], got["mean"] + sigmas * got["std"]
        left = left.where(F.col(c).between(low, high))
    return left


def outlier_report(df: DataFrame, columns: Sequence[str] | None = None, factor: float = 1.5) -> DataFrame:
    """Per column: number and share of values beyond the IQR bounds, and the bounds."""
    columns = list(columns if columns is not None else numeric_columns(df))
    bounds = iqr_bounds(df, columns, factor)
    wanted = {"\0rows": F.count(F.lit(1))}
    for c, (low, high) in bounds.items():
        wanted[c] = F.count_if((F.col(c) < low) | (F.col(c) > high))
    got = gather(df, wanted)
    rows = [
        (c, int(got[c]), 100.0 * got[c] / got["\0rows"], float(low), float(high)) for c, (low, high) in bounds.items()
    ]
    return literal_table(df.sparkSession, rows, "column string, outliers long, percentage double, lower double, upper double")


def clip_to_bounds(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    clipped = {
        c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c).cast("double"), F.lit(float(lo))), F.lit(float(hi))))
        for c, (lo, hi) in bounds.items()
    }
    return df.withColumns(clipped)


def winsorise_iqr(df: DataFrame, columns: Sequence[str] | None = None, factor: float = 1.5) -> DataFrame:
    columns = list(columns if columns is not None else numeric_columns(df))
    return clip_to_bounds(df, iqr_bounds(df, columns, factor))


def cap_at_percentiles(df: DataFrame, columns: Sequence[str], low: float = 0.05, high: float = 0.95) -> DataFrame:
    found = quantiles(df, columns, [low, high])
    return clip_to_bounds(df, {c: (a, b) for c, (a, b) in found.items() if a is not None})


def find_outliers(df: DataFrame, columns: Sequence[str], factor: float = 1.5) -> DataFrame:
    """Rows with at least one listed column beyond its IQR bounds."""
    outside = F.lit(False)
    for c, (low, high) in iqr_bounds(df, columns, factor).items():
        outside = outside | F.coalesce(~F.col(c).between(low, high), F.lit(False))
    return df.where(outside)


def clean_rows(df: DataFrame, factor: float = 1.5, remove_outliers: bool = True, method: str = "iqr") -> DataFrame:
    """Duplicates, then outliers, then constant columns."""
    cleaned = drop_duplicate_rows(df)
    if remove_outliers:
        if method == "iqr":
            cleaned = remove_iqr_outliers(cleaned, factor=factor)
        elif method == "zscore":
            cleaned = remove_zscore_outliers(cleaned, factor=factor)
        else:
            raise ValueError(f"unknown outlier method {method}")
    return drop_constant_columns(cleaned)


def forward_fill(df: DataFrame, series: SeriesLike, columns: Sequence[str]) -> DataFrame:
    filled = accumulate(df, series, lasts={c: F.col(c) for c in columns})
    return filled.select(*df.columns)


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Project the wanted features, naming every one that is absent."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"Missing features: {absent}")
    return df.select(*columns)


def fill_defaults(df: DataFrame, defaults: Mapping[str, float]) -> DataFrame:
    filled = {
        c: F.coalesce(F.col(c).cast("double"), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()
    }
    return df.withColumns(filled)


def zero_fill(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns if columns is not None else numeric_columns(df))
    return drop_nonfinite(df, columns).fillna(0, subset=columns)
