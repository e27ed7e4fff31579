"""Ordered and random splits, folds, samples, batches and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..series import Series, SeriesLike, number_rows


def time_split(df: DataFrame, series: SeriesLike, train: float = 0.7, val: float = 0.15, name: str = "split") -> DataFrame:
    """Label rows train, val or test by their position in the series."""
    n, at = F.col("_of"), F.col("_at")
    first, second = F.floor(n * F.lit(train)), F.floor(n * F.lit(train + val))
    label = F.when(at < first, "train").when(at < second, "val").otherwise("test")
    return number_rows(df, series, "_at", "_of").withColumn(name, label).drop("_at", "_of")


def holdout_split(df: DataFrame, series: SeriesLike, share: float = 0.2, name: str = "split") -> DataFrame:
    """The last ``share`` of each series is the validation part."""
    label = F.when(F.col("_at") < F.floor(F.col("_of") * F.lit(1 - share)), "train").otherwise("val")
    return number_rows(df, series, "_at", "_of").withColumn(name, label).drop("_at", "_of")


def expanding_folds(df: DataFrame, series: SeriesLike, k: int = 5) -> DataFrame:
    """Test fold of every row: k equal tail blocks, 0 for rows that are only ever trained on.

    Fold i tests block i and trains on all rows of lower block number.
    """
    size = F.floor(F.col("_of") / F.lit(k + 1))
    head = F.col("_of") - size * k
    block = F.when(F.col("_at") < head, F.lit(0)).otherwise(F.floor(F.try_divide(F.col("_at") - head, size)) + 1)
    return number_rows(df, series, "_at", "_of").withColumn("fold", block.cast("int")).drop("_at", "_of")


def fold_parts(folded: DataFrame, i: int) -> tuple[DataFrame, DataFrame]:
    return folded.where(F.col("fold") < i), folded.where(F.col("fold") == i)


def hash_number(*keys: str):
    """A number drawn from the MD5 of the key; the same in any engine with MD5."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def random_split(
    df: DataFrame, keys: Sequence[str], share: float = 0.2, strata: Sequence[str] = (), name: str = "split",
    rows_per_task: int | None = None,
) -> DataFrame:
    """Reproducible split; exactly ``floor(n·share)`` rows (of each stratum) are the test part."""
    extra = {} if rows_per_task is None else {"rows_per_task": rows_per_task}
    shuffled = df.withColumn("_hash", hash_number(*keys))
    series = Series(tuple(strata), ("_hash", *keys), **extra)
    label = F.when(F.col("_at") < F.floor(F.col("_of") * F.lit(share)), "test").otherwise("train")
    return number_rows(shuffled, series, "_at", "_of").withColumn(name, label).drop("_at", "_of", "_hash")


def random_sample(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """At most n rows, the same ones every time."""
    return df.withColumn("_hash", hash_number(*keys)).orderBy("_hash", *keys).limit(n).drop("_hash")


def top_k(df: DataFrame, column: str, k: int, *ties: str, ascending: bool = False) -> DataFrame:
    order = F.asc(column) if ascending else F.desc(column)
    return df.orderBy(order, *[F.asc(t) for t in ties]).limit(k)


def batches(df: DataFrame, series: SeriesLike, size: int = 100, name: str = "batch") -> DataFrame:
    """Number consecutive groups of ``size`` rows."""
    return number_rows(df, series, "_at").withColumn(name, F.floor(F.col("_at") / F.lit(size))).drop("_at")
