"""Column profiles, correlations, ranks and histograms as small report tables."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..channels import numeric_columns, text_columns
from ..series import ROWS_PER_TASK, Series, accumulate
from ..quantiles import quantiles
from ..stats import gather, literal_table, moments
from .clean import outlier_report


def corrected_skewness(c: Column | str) -> Column:
    """Sample skewness; NULL below three values."""
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def corrected_kurtosis(c: Column | str) -> Column:
    """Sample excess kurtosis; NULL below four values."""
    n = F.count(c).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


_SUMMARY = {
    "count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max,
    "skewness": corrected_skewness, "kurtosis": corrected_kurtosis,
}
_SUMMARY_SCHEMA = (
    "column string, count long, mean double, std double, min double, max double, "
    "median double, q25 double, q75 double, skewness double, kurtosis double"
)


def _number(x: object) -> float | None:
    return None if x is None else float(x)


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None, corrected: bool = True) -> DataFrame:
    """Count, moments, quartiles, skewness and kurtosis of every numeric column."""
    columns = list(columns if columns is not None else numeric_columns(df))
    kinds = dict(_SUMMARY) if corrected else {**_SUMMARY, "skewness": F.skewness, "kurtosis": F.kurtosis}
    got = moments(df, columns, kinds)
    cuts = quantiles(df, columns, [0.5, 0.25, 0.75])
    rows = [
        (c, int(g["count"]), _number(g["mean"]), _number(g["std"]), _number(g["min"]), _number(g["max"]),
         *[_number(q) for q in cuts[c]], _number(g["skewness"]), _number(g["kurtosis"]))
        for c, g in got.items()
    ]
    return literal_table(df.sparkSession, rows, _SUMMARY_SCHEMA)


def missing_summary(df: DataFrame) -> DataFrame:
    got = gather(df, {"\0n": F.count(F.lit(1)), **{c: F.count_if(F.col(c).isNull()) for c in df.columns}})
    rows = [(c, int(got[c]), 100.0 * got[c] / got["\0n"] if got["\0n"] else None, bool(got[c])) for c in df.columns]
    return literal_table(df.sparkSession, rows, "column string, missing long, percentage double, has_gaps boolean")


def duplicate_summary(df: DataFrame) -> DataFrame:
    per_row = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    total = F.coalesce(F.sum("_n"), F.lit(0))
    return per_row.agg(
        (total - F.count(F.lit(1))).alias("duplicate_rows"),
        F.count(F.lit(1)).alias("unique_rows"),
        F.try_divide((total - F.count(F.lit(1))) * F.lit(100.0), total).alias("duplicate_percentage"),
    )


def categorical_top(df: DataFrame, columns: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """The k most frequent values of each text column with their rank; ties by value."""
    columns = list(columns if columns is not None else text_columns(df))
    parts = []
    for c in columns:
        counted = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("count"))
        parts.append(
            counted.orderBy(F.desc("count"), F.asc("value")).limit(k).select(F.lit(c).alias("column"), "value", "count")
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def unique_counts(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Distinct non-NULL values per column, exact through one grouped shuffle."""
    columns = list(columns if columns is not None else df.columns)
    if approximate:
        got = gather(df, {c: F.approx_count_distinct(c) for c in columns})
        return literal_table(df.sparkSession, [(c, int(got[c])) for c in columns], "column string, unique_values long")
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    values = df.select(cells.alias("x")).select("x.*").groupBy("column", "value").agg(F.lit(1).alias("one"))
    return values.groupBy("column").agg(F.count("value").alias("unique_values"))


def categorical_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns if columns is not None else text_columns(df))
    top = categorical_top(df, columns, 1).withColumnsRenamed({"value": "most_frequent", "count": "most_frequent_count"})
    return unique_counts(df, columns).join(top, "column", "left")


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> list[tuple[str, str, float | None]]:
    """Pearson correlation of every column pair, pairwise complete, in one aggregation."""
    columns = list(columns if columns is not None else numeric_columns(df))
    pairs = list(combinations(columns, 2))
    got = gather(df, {f"{a}\0{b}": F.corr(F.col(a).cast("double"), F.col(b).cast("double")) for a, b in pairs})
    return [(a, b, _number(got[f"{a}\0{b}"])) for a, b in pairs]


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns if columns is not None else numeric_columns(df))
    rows = [(c, c, 1.0) for c in columns]
    for a, b, v in correlations(df, columns):
        rows += [(a, b, v), (b, a, v)]
    return literal_table(df.sparkSession, rows, "column1 string, column2 string, correlation double")


def top_correlations(df: DataFrame, columns: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    found = [t for t in correlations(df, columns) if t[2] is not None and t[2] == t[2]]
    found.sort(key=lambda t: -abs(t[2]))
    return literal_table(df.sparkSession, found[:k], "column1 string, column2 string, correlation double")


def average_ranks(counted: DataFrame, value: str, count: str, rank: str = "rank", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Average rank of each distinct value, from a table of values and counts."""
    ranked = accumulate(counted, Series((), value, rows_per_task), sums={"_upto": F.col(count)})
    return ranked.withColumn(rank, F.col("_upto") - F.col(count) + (F.col(count) + 1) / F.lit(2.0)).drop("_upto")


def spearman(df: DataFrame, a: str, b: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Rank correlation of two columns over the rows where both are known.

    Rows are counted by value pair first, so copies of a frequent pair meet as one row.
    """
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    pairs = both.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    ranked = pairs
    for c in ("a", "b"):
        counted = both.groupBy(F.col({"a": a, "b": b}[c]).alias(c)).agg(F.count(F.lit(1)).alias("m"))
        ranked = ranked.join(average_ranks(counted, c, "m", f"r{c}", rows_per_task).drop("m"), c)
    n, x, y = F.col("n").cast("double"), F.col("ra"), F.col("rb")
    middle = (F.sum(n) + 1) / 2
    sums = ranked.agg(
        F.sum(n).alias("n"), middle.alias("m"),
        F.sum(n * x * y).alias("xy"), F.sum(n * x * x).alias("xx"), F.sum(n * y * y).alias("yy"),
    )
    cov = F.col("xy") - F.col("n") * F.col("m") * F.col("m")
    vx = F.col("xx") - F.col("n") * F.col("m") * F.col("m")
    vy = F.col("yy") - F.col("n") * F.col("m") * F.col("m")
    return sums.select(F.lit(a).alias("column1"), F.lit(b).alias("column2"), F.try_divide(cov, F.sqrt(vx * vy)).alias("correlation"))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins between the smallest and largest value; the last bin is closed."""
    ends = gather(df, {"lo": F.min(column), "hi": F.max(column)})
    if ends["lo"] is None:
        return literal_table(df.sparkSession, [], "bin int, lower double, upper double, count long")
    lo, hi = float(ends["lo"]), float(ends["hi"])
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    place = F.least(F.floor((F.col(column) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counted = df.where(F.col(column).isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(counted, "bin", "left").select(
        "bin",
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lower"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("count"),
    )


def overview(df: DataFrame, depth: str, pressure: str) -> DataFrame:
    """Row count, mean depth and pressure, and share of filled cells."""
    filled = None
    for c in df.columns:
        part = F.count(c)
        filled = part if filled is None else filled + part
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(depth).alias("mean_depth"),
        F.avg(pressure).alias("mean_pressure"),
        (filled / (F.count(F.lit(1)) * len(df.columns))).alias("completeness"),
    )


def descriptive_statistics(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Summary with population skewness and kurtosis, and the share beyond the IQR bounds."""
    columns = list(columns if columns is not None else numeric_columns(df))
    share = outlier_report(df, columns).select("column", "outliers", F.col("percentage").alias("outlier_percentage"))
    return numeric_summary(df, columns, corrected=False).join(share, "column", "left")


def profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row per column: type, missing values, distinct values and an example."""
    kinds = dict(df.dtypes)
    got = gather(
        df,
        {
            "\0n": F.count(F.lit(1)),
            **{f"m\0{c}": F.count_if(F.col(c).isNull()) for c in df.columns},
            **{f"e\0{c}": F.min(F.col(c).cast("string")) for c in df.columns},
        },
    )
    rows = [
        (c, kinds[c], int(got[f"m\0{c}"]), 100.0 * got[f"m\0{c}"] / got["\0n"] if got["\0n"] else None, got[f"e\0{c}"])
        for c in df.columns
    ]
    base = literal_table(
        df.sparkSession, rows, "column string, type string, missing long, missing_percentage double, example string"
    )
    return base.join(unique_counts(df, approximate=approximate), "column", "left")
