"""Column scaling with fitted centre and width."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..channels import EPSILON, numeric_columns
from ..quantiles import quantiles
from ..stats import gather, moments


@dataclass(frozen=True)
class FittedScale:
    """x becomes (x - centre) / width; a zero width counts as one."""

    parameters: dict[str, tuple[float, float]]

    def apply(self, df: DataFrame) -> DataFrame:
        scaled = {
            c: (F.col(c).cast("double") - F.lit(float(centre))) / F.lit(float(width) or 1.0)
            for c, (centre, width) in self.parameters.items()
            if c in df.columns
        }
        return df.withColumns(scaled)


def fit_scale(df: DataFrame, method: str = "standard", columns: Sequence[str] | None = None) -> FittedScale:
    """``standard`` uses the population deviation, ``minmax`` maps to 0..1, ``robust`` uses median and IQR."""
    columns = list(columns if columns is not None else numeric_columns(df))
    if method == "standard":
        got = moments(df, columns, {"centre": F.avg, "width": F.stddev_pop})
        fitted = {c: (v["centre"], v["width"]) for c, v in got.items()}
    elif method == "minmax":
        got = moments(df, columns, {"low": F.min, "high": F.max})
        fitted = {c: (v["low"], None if v["low"] is None else v["high"] - v["low"]) for c, v in got.items()}
    elif method == "robust":
        got = quantiles(df, columns, [0.25, 0.5, 0.75])
        fitted = {c: (v[1], None if v[1] is None else v[2] - v[0]) for c, v in got.items()}
    else:
        raise ValueError(f"unknown scaling method {method}")
    return FittedScale({c: p for c, p in fitted.items() if p[0] is not None})


def scale(df: DataFrame, method: str = "standard", columns: Sequence[str] | None = None) -> DataFrame:
    return fit_scale(df, method, columns).apply(df)


def log1p_positive(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``log1p`` on the columns whose values are all above zero."""
    columns = list(columns if columns is not None else numeric_columns(df))
    got = gather(df, {c: F.min(F.coalesce((F.col(c) > 0).cast("int"), F.lit(0))) for c in columns})
    return df.withColumns({c: F.log1p(F.col(c)) for c in columns if got[c] == 1})


def unit_range(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Scores mapped to 0..1 with the guarded range, ``{score column: output column}``."""
    got = moments(df, list(columns), {"low": F.min, "high": F.max})
    return df.withColumns(
        {
            out: (F.col(c) - F.lit(got[c]["low"])) / F.lit(got[c]["high"] - got[c]["low"] + EPSILON)
            for c, out in columns.items()
            if got[c]["low"] is not None
        }
    )
