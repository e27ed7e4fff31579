"""Missing-value imputation with fitted values that can be replayed."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..channels import drop_nonfinite, numeric_columns, text_columns
from ..quantiles import quantiles
from ..session import materialise
from ..stats import gather, moments, most_frequent
from .donors import DonorTree


@dataclass(frozen=True)
class FittedFill:
    """One replacement value per column."""

    values: dict[str, object]

    def apply(self, df: DataFrame) -> DataFrame:
        filled = {}
        for c, v in self.values.items():
            if c in df.columns and v is not None:
                base = F.col(c) if isinstance(v, str) else F.col(c).cast("double")
                filled[c] = F.coalesce(base, F.lit(v))
        return df.withColumns(filled) if filled else df


def columns_with_gaps(df: DataFrame, columns: Sequence[str]) -> list[str]:
    gaps = gather(df, {c: F.count_if(F.col(c).isNull()) for c in columns})
    return [c for c in columns if gaps[c]]


def fit_fill(df: DataFrame, strategy: str = "median", columns: Sequence[str] | None = None) -> FittedFill:
    """Mean, median or most frequent value of every numeric column that has gaps."""
    chosen = columns_with_gaps(df, list(columns if columns is not None else numeric_columns(df)))
    if strategy == "mean":
        values = {c: v["mean"] for c, v in moments(df, chosen, {"mean": F.avg}).items()}
    elif strategy == "median":
        values = {c: v[0] for c, v in quantiles(df, chosen, [0.5]).items()}
    elif strategy == "most_frequent":
        values = {c: None if v is None else float(v) for c, v in most_frequent(df, chosen).items()}
    else:
        raise ValueError(f"unknown imputation strategy {strategy}")
    return FittedFill(values)


def impute_numeric(df: DataFrame, strategy: str = "median", columns: Sequence[str] | None = None) -> DataFrame:
    return fit_fill(df, strategy, columns).apply(df)


def impute_categorical(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    chosen = columns_with_gaps(df, list(columns if columns is not None else text_columns(df)))
    return FittedFill(most_frequent(df, chosen)).apply(df)


def fill_with_means(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NaN and infinities become NULL, then the column mean."""
    columns = list(columns if columns is not None else numeric_columns(df))
    clean = drop_nonfinite(df, columns)
    return FittedFill({c: v["mean"] for c, v in moments(clean, columns, {"mean": F.avg}).items()}).apply(clean)


def fill_from_training(train: DataFrame, *others: DataFrame, columns: Sequence[str]) -> list[DataFrame]:
    """Fill every split with the means of the training split."""
    fitted = FittedFill({c: v["mean"] for c, v in moments(train, columns, {"mean": F.avg}).items()})
    return [fitted.apply(part) for part in (train, *others)]


#: Different donors in a box of the tree, and receivers that meet a box in one group.
ROWS_PER_CELL = 2_000
BLOCK_ROWS = 20_000


@dataclass(frozen=True)
class KnnFill:
    """Donors in a tree of boxes; ``apply`` fills gaps of new rows."""

    tree: DonorTree | None
    columns: tuple[str, ...]
    k: int
    means: dict[str, float]

    def apply(self, df: DataFrame) -> DataFrame:
        """Complete rows pass unshuffled; NaN and infinities are no neighbours and stay as they are."""
        columns = list(self.columns)
        if not columns or self.tree is None:
            return df
        gap = F.lit(False)
        for c in columns:
            gap = gap | F.col(c).isNull()
        rows = df.withColumns({c: F.col(c).cast("double") for c in columns})
        # equal receivers get equal answers, so each different row with gaps is solved once
        own = rows.where(gap).select(*columns).distinct()
        solved = materialise(own.withColumn("_rid", F.monotonically_increasing_id()))
        finite = drop_nonfinite(solved, columns)
        asked = finite.select(
            F.col("_rid").alias("rid"), F.array(*columns).alias("x"),
            F.explode(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(t)) for t, c in enumerate(columns)]))).alias("t"),
        )
        found = self.tree.nearest(materialise(asked), self.k, BLOCK_ROWS)
        ranked = Window.partitionBy("rid", "t").orderBy("dist", "value")
        upto = F.sum("copies").over(ranked.rowsBetween(Window.unboundedPreceding, 0))
        used = F.greatest(F.lit(0), F.least(F.col("copies"), F.lit(self.k) - (F.col("upto") - F.col("copies"))))
        fills = (
            found.withColumn("upto", upto).withColumn("used", used).where("used > 0")
            .groupBy("rid", "t").agg((F.sum(F.col("value") * F.col("used")) / F.sum("used")).alias("fill"))
            .groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("t", "fill"))).alias("fills"))
        )
        whole = [f"_of_{i}" for i in range(len(columns))]
        told = solved.join(fills, F.col("_rid") == F.col("rid"), "left").select(*[F.col(c).alias(w) for c, w in zip(columns, whole)], F.col("fills").alias("_fills"))
        same = F.lit(True)
        for c, w in zip(columns, whole):
            same = same & F.col(c).eqNullSafe(F.col(w))
        joined = rows.where(gap).join(told, same, "left")
        final = {}
        for t, c in enumerate(columns):
            final[c] = F.coalesce(F.col(c), F.try_element_at("_fills", F.lit(t)), F.lit(self.means[c]).cast("double"))
        return rows.where(~gap).unionByName(joined.withColumns(final).select(*df.columns))


def fit_knn(df: DataFrame, columns: Sequence[str] | None = None, k: int = 5) -> KnnFill:
    """The donors of ``df`` in a tree; without columns, or without columns that have gaps, nothing is filled."""
    columns = list(columns if columns is not None else columns_with_gaps(df, numeric_columns(df)))
    if not columns:
        return KnnFill(None, (), k, {})
    donors = drop_nonfinite(df.select(*[F.col(c).cast("double").alias(c) for c in columns]), columns)
    means = {c: v["mean"] for c, v in moments(donors, columns, {"mean": F.avg}).items()}
    return KnnFill(DonorTree(donors, columns, ROWS_PER_CELL), tuple(columns), k, means)


def impute_knn(df: DataFrame, columns: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """Mean of the k nearest rows under the gap-aware Euclidean distance."""
    return fit_knn(df, columns, k).apply(df)
