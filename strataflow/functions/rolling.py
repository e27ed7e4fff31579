"""Window expressions over a :class:`~strataflow.series.Frame`."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..channels import EPSILON
from ..series import Frame


def shifted(frame: Frame, c: str, n: int) -> Column:
    return F.lag(c, n).over(frame.window) if n >= 0 else F.lead(c, -n).over(frame.window)


def difference(frame: Frame, c: str) -> Column:
    return F.col(c) - shifted(frame, c, 1)


def second_difference(frame: Frame, c: str) -> Column:
    """Difference of differences, in that order, so rounding equals two passes of diff."""
    return (F.col(c) - shifted(frame, c, 1)) - (shifted(frame, c, 1) - shifted(frame, c, 2))


def percent_change(frame: Frame, c: str) -> Column:
    return F.try_divide(F.col(c) - shifted(frame, c, 1), shifted(frame, c, 1))


def mean(frame: Frame, c: str, n: int) -> Column:
    return frame.whole(c, n, F.avg(c).over(frame.last(n)))


def std(frame: Frame, c: str, n: int) -> Column:
    return frame.whole(c, n, F.stddev_samp(c).over(frame.last(n)))


def low(frame: Frame, c: str, n: int) -> Column:
    return frame.whole(c, n, F.min(c).over(frame.last(n)))


def high(frame: Frame, c: str, n: int) -> Column:
    return frame.whole(c, n, F.max(c).over(frame.last(n)))


def middle(frame: Frame, c: str, n: int) -> Column:
    # a full window holds n values and no NULL: sorting them costs far less than a percentile aggregate for every row
    ranked = F.sort_array(F.collect_list(F.col(c).cast("double")).over(frame.last(n)))
    return frame.whole(c, n, F.lit(0.5) * ranked[(n - 1) // 2] + F.lit(0.5) * ranked[n // 2])


def slope(frame: Frame, c: str, n: int) -> Column:
    """Least-squares slope over the last n rows."""
    return frame.whole(c, n, F.regr_slope(F.col(c), F.col(frame.row).cast("double")).over(frame.last(n)))


def custom(frame: Frame, c: str, n: int, function: Callable[[pd.Series], float]) -> Column:
    """``function`` of the values of each full window; a function of the user's own, run by Arrow batches.

    The plain form for what no built-in function expresses: each window is handed to Python.
    """

    def apply(values: pd.Series) -> float:
        return float(function(values))

    return frame.whole(c, n, F.pandas_udf(apply, "double")(F.col(c).cast("double")).over(frame.last(n)))


def partial_mean(frame: Frame, c: str, n: int) -> Column:
    return F.avg(c).over(frame.last(n))


def partial_std(frame: Frame, c: str, n: int) -> Column:
    return F.stddev_samp(c).over(frame.last(n))


def volatility(frame: Frame, c: str, n: int = 10) -> Column:
    return F.try_divide(std(frame, c, n), mean(frame, c, n) + F.lit(EPSILON))


def gradient(frame: Frame, y: str, x: str) -> Column:
    """dy/dx on uneven spacing: central inside, one-sided at the ends of the series."""
    before_x, after_x = shifted(frame, x, 1), shifted(frame, x, -1)
    before_y, after_y = shifted(frame, y, 1), shifted(frame, y, -1)
    hs, hd = F.col(x) - before_x, after_x - F.col(x)
    inner = F.try_divide(
        hs * hs * after_y + (hd * hd - hs * hs) * F.col(y) - hd * hd * before_y, hs * hd * (hs + hd)
    )
    position = F.col(frame.row)
    has_next = F.lead(F.lit(1), 1).over(frame.window).isNotNull()
    return (
        F.when((position == 0) & has_next, F.try_divide(after_y - F.col(y), hd))
        .when((position > 0) & ~has_next, F.try_divide(F.col(y) - before_y, hs))
        .when(position > 0, inner)
    )


@lru_cache(maxsize=None)
def smoothing_weights(size: int, degree: int) -> np.ndarray:
    """Row i holds the weights that evaluate the window's polynomial fit at its i-th point."""
    if size % 2 == 0 or degree >= size:
        raise ValueError("the smoothing window must be odd and longer than the polynomial degree")
    x = np.arange(size) - size // 2
    basis = np.vander(x, degree + 1, increasing=True).astype(float)
    return basis @ np.linalg.pinv(basis)


def smoothing_window(frame: Frame, columns: list[str], length: str, size: int, degree: int) -> dict[str, Column]:
    """The rows of the polynomial fit of each row, and the weights of the row's place in it.

    Inside the series the fit is centred; near both ends it is the first or last full
    window.  One collected window serves all columns.
    """
    reach = size - 1
    around = F.collect_list(F.struct(*columns)).over(frame.window.rowsBetween(-reach, reach))
    position = F.col(frame.row)
    start = F.greatest(F.lit(0), F.least(position - size // 2, F.col(length) - size))
    first = F.greatest(F.lit(0), position - reach)
    rows = F.array(*[F.array(*[F.lit(float(w)) for w in row]) for row in smoothing_weights(size, degree)])
    return {"_around": around, "_skip": (start - first).cast("int"), "_weights": F.element_at(rows, (position - start + 1).cast("int"))}


def weighted_sum(column: str, size: int) -> Column:
    return F.expr(" + ".join(f"_around[_skip + {i}].`{column}` * _weights[{i}]" for i in range(size)))
