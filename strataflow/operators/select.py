"""Feature selection from one-pass statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..channels import DOMAIN_WEIGHTS, numeric_columns
from ..quantiles import quantiles
from ..stats import gather, literal_table, moments
from .impute import fill_with_means
from .profile import correlations


def _scores(df: DataFrame, rows: list[tuple[str, float]]) -> DataFrame:
    return literal_table(df.sparkSession, rows, "feature string, score double")


def _features(df: DataFrame, target: str, columns: Sequence[str] | None) -> list[str]:
    return list(columns if columns is not None else numeric_columns(df, [target]))


def target_correlations(df: DataFrame, target: str, columns: Sequence[str] | None = None) -> dict[str, float | None]:
    names = _features(df, target, columns)
    got = gather(df, {c: F.corr(F.col(c).cast("double"), F.col(target).cast("double")) for c in names})
    return {c: None if v is None or v != v else float(v) for c, v in got.items()}


def correlated_columns(df: DataFrame, threshold: float = 0.95, columns: Sequence[str] | None = None) -> list[str]:
    """Columns whose absolute correlation with an earlier column exceeds the threshold."""
    names = list(columns if columns is not None else numeric_columns(df))
    high = {b for a, b, v in correlations(df, names) if v is not None and abs(v) > threshold}
    return [c for c in names if c in high]


def low_variance_columns(df: DataFrame, threshold: float = 0.01, columns: Sequence[str] | None = None) -> list[str]:
    names = list(columns if columns is not None else numeric_columns(df))
    got = moments(df, names, {"v": F.var_samp})
    return [c for c in names if got[c]["v"] is not None and got[c]["v"] < threshold]


def high_variance_columns(df: DataFrame, threshold: float = 0.01, columns: Sequence[str] | None = None) -> list[str]:
    """Columns whose population variance exceeds the threshold once gaps hold the mean."""
    names = list(columns if columns is not None else numeric_columns(df))
    got = moments(fill_with_means(df, names), names, {"v": F.var_pop})
    return [c for c in names if got[c]["v"] is not None and got[c]["v"] > threshold]


def _top(scores: dict[str, float | None], k: int) -> list[tuple[str, float]]:
    known = [(c, float(s)) for c, s in scores.items() if s is not None]
    return sorted(known, key=lambda t: (-t[1], t[0]))[:k]


def top_by_correlation(df: DataFrame, target: str, k: int = 50, columns: Sequence[str] | None = None) -> DataFrame:
    got = target_correlations(df, target, columns)
    return _scores(df, _top({c: None if v is None else abs(v) for c, v in got.items()}, k))


def mutual_information(
    df: DataFrame, target: str, columns: Sequence[str] | None = None, bins: int = 10
) -> dict[str, float]:
    """Mutual information with the target, both cut at their quantiles.

    Cells are counted on the executors; at most ``bins²`` counts per feature return.
    """
    names = _features(df, target, columns)
    filled = fill_with_means(df.select(*names, target), [*names, target])
    cuts = quantiles(filled, [*names, target], [i / bins for i in range(1, bins)])

    def place(c: str):
        total = F.lit(0)
        for cut in sorted(set(cuts[c])):
            total = total + (F.col(c) > F.lit(cut)).cast("int")
        return total

    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), place(c).alias("bx")) for c in names]))
    counted = (
        filled.select(place(target).alias("by"), cells.alias("x")).groupBy("x.feature", "x.bx", "by")
        .agg(F.count(F.lit(1)).alias("n")).toPandas()
    )
    scores = {}
    for c in names:
        part = counted[counted.feature == c]
        total = part.n.sum()
        px, py = part.groupby("bx").n.sum(), part.groupby("by").n.sum()
        scores[c] = float(
            sum(n / total * math.log(n * total / (px[bx] * py[by])) for bx, by, n in zip(part.bx, part.by, part.n))
        )
    return scores


def top_by_mutual_information(df: DataFrame, target: str, k: int = 20, columns: Sequence[str] | None = None, bins: int = 10) -> DataFrame:
    return _scores(df, _top(mutual_information(df, target, columns, bins), k))


def variance_then_correlation(
    df: DataFrame, target: str, k: int = 50, threshold: float = 0.01, columns: Sequence[str] | None = None
) -> list[str]:
    kept = high_variance_columns(df, threshold, _features(df, target, columns))
    if len(kept) <= k:
        return kept
    got = target_correlations(df, target, kept)
    return [c for c, _ in _top({c: None if v is None else abs(v) for c, v in got.items()}, k)]


def f_scores(df: DataFrame, target: str, k: int = 20, columns: Sequence[str] | None = None) -> DataFrame:
    """Univariate regression F: r²(n-2)/(1-r²) over the rows where both are known."""
    names = _features(df, target, columns)
    got = gather(
        df,
        {f"{kind}\0{c}": e for c in names for kind, e in (
            ("r", F.corr(F.col(c).cast("double"), F.col(target).cast("double"))),
            ("n", F.count_if(F.col(c).isNotNull() & F.col(target).isNotNull())),
        )},
    )
    scores: dict[str, float | None] = {}
    for c in names:
        r, n = got[f"r\0{c}"], got[f"n\0{c}"]
        scores[c] = None if r is None or r != r else (math.inf if r * r >= 1 else r * r * (n - 2) / (1 - r * r))
    return _scores(df, _top(scores, k))


def domain_importance(df: DataFrame, target: str, columns: Sequence[str] | None = None) -> DataFrame:
    """0.6 of the domain weight plus 0.4 of the absolute correlation."""
    got = target_correlations(df, target, columns)
    rows = [(c, 0.6 * DOMAIN_WEIGHTS.get(c, 0.5) + 0.4 * abs(v or 0.0)) for c, v in got.items()]
    return _scores(df, sorted(rows, key=lambda t: (-t[1], t[0])))


def select_features(df: DataFrame, target: str, method: str = "correlation", k: int = 50) -> list[str]:
    if method == "correlation":
        return [r[0] for r in top_by_correlation(df, target, k).collect()]
    if method == "mutual_info":
        return [r[0] for r in top_by_mutual_information(df, target, k).collect()]
    if method == "variance":
        return variance_then_correlation(df, target, k)
    raise ValueError(f"unknown selection method {method}")


def forest_selection(df: DataFrame, target: str, columns: Sequence[str], n: int, trees: int = 10, seed: int = 42) -> DataFrame:
    """Top features by random-forest importance."""
    from pyspark.ml.regression import RandomForestRegressor

    from ..models.common import assemble

    model = RandomForestRegressor(labelCol=target, featuresCol="features", numTrees=trees, seed=seed).fit(
        assemble(df, columns)
    )
    return _scores(df, _top(dict(zip(columns, map(float, model.featureImportances.toArray()))), n))
