"""Paired tests of two models' errors and two-sample drift."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..series import ROWS_PER_TASK, Series, accumulate
from ..stats import gather, literal_table
from .profile import average_ranks


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return h


def student_p(t: float, dof: float) -> float:
    """Two-sided p value of Student's t."""
    x = dof / (dof + t * t)
    if x >= 1.0:
        return 1.0
    a, b = dof / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def kolmogorov_p(distance: float, n1: int, n2: int) -> float:
    """Asymptotic two-sided p value of the two-sample statistic."""
    if not n1 or not n2:
        return 1.0
    z = distance * math.sqrt(n1 * n2 / (n1 + n2))
    if z < 0.2:
        return 1.0
    total = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * z * z) for k in range(1, 101))
    return min(1.0, max(0.0, total))


def paired_error_tests(
    df: DataFrame, label: str, first: str, second: str, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Paired t and Wilcoxon signed-rank tests on absolute errors.

    Differences are counted by size before ranking, zeros are left out of the ranks,
    and the signed-rank p value uses the normal approximation with tie correction.
    """
    e1, e2 = F.abs(F.col(label) - F.col(first)), F.abs(F.col(label) - F.col(second))
    d = df.select(e1.alias("e1"), e2.alias("e2"), (e1 - e2).alias("d")).where(F.col("d").isNotNull())
    got = gather(d, {"n": F.count("d"), "m": F.avg("d"), "s": F.stddev_samp("d"), "m1": F.avg("e1"), "m2": F.avg("e2")})
    sizes = d.where("d <> 0").groupBy(F.abs("d").alias("size")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") > 0).alias("up")
    )
    ranked = average_ranks(sizes, "size", "n", "rank", rows_per_task)
    n = F.col("n").cast("double")
    w = gather(
        ranked,
        {
            "count": F.sum("n"), "up": F.sum(F.col("rank") * F.col("up")), "down": F.sum(F.col("rank") * (F.col("n") - F.col("up"))),
            "ties": F.sum(n * n * n - n),
        },
    )
    t_stat = t_p = w_stat = w_p = None
    if got["n"] and got["n"] > 1 and got["s"]:
        t_stat = got["m"] / (got["s"] / math.sqrt(got["n"]))
        t_p = student_p(t_stat, got["n"] - 1)
    if w["count"]:
        c = float(w["count"])
        w_stat = float(min(w["up"], w["down"]))
        spread = math.sqrt((c * (c + 1) * (2 * c + 1) - w["ties"] / 2) / 24)
        w_p = math.erfc(abs(w_stat - c * (c + 1) / 4) / spread / math.sqrt(2)) if spread else None
    row = (w_stat, w_p, t_stat, t_p, got["m1"], got["m2"], bool(w_p is not None and w_p < 0.05))
    return literal_table(
        df.sparkSession, [row],
        "wilcoxon_statistic double, wilcoxon_p_value double, ttest_statistic double, ttest_p_value double, "
        "model1_mean_error double, model2_mean_error double, significant_difference boolean",
    )


def drift(reference: DataFrame, current: DataFrame, column: str, threshold: float = 0.1, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic from counts per value."""
    tagged = reference.select(F.col(column).alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        current.select(F.col(column).alias("x"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    counted = tagged.where(F.col("x").isNotNull()).groupBy("x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    totals = gather(counted, {"a": F.coalesce(F.sum("a"), F.lit(0)), "b": F.coalesce(F.sum("b"), F.lit(0))})
    run = accumulate(counted, Series((), "x", rows_per_task), sums={"fa": F.col("a"), "fb": F.col("b")})
    gap = F.abs(F.try_divide(F.col("fa"), F.lit(float(totals["a"]))) - F.try_divide(F.col("fb"), F.lit(float(totals["b"]))))
    distance = gather(run, {"d": F.max(gap)})["d"]
    p = None if distance is None else kolmogorov_p(distance, totals["a"], totals["b"])
    row = (distance, p, bool(distance is not None and distance > threshold), float(threshold))
    return literal_table(
        reference.sparkSession, [row], "ks_statistic double, p_value double, drift_detected boolean, threshold double"
    )
