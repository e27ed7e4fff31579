"""Evaluation metrics as aggregates over label and prediction columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..channels import EPSILON
from ..series import ROWS_PER_TASK, Series, accumulate, over_series
from ..quantiles import quantile
from ..stats import gather, literal_table

# fixed values: costs and directions
MISSED_KICK_WEIGHT = 5
COSTS = {"false_positive": 10_000, "false_negative": 1_000_000, "true_positive": 50_000}
LOWER_IS_BETTER = ("mse", "rmse", "mae", "mape")


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 when there is nothing to divide by."""
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def mse(y: Column, p: Column) -> Column:
    return F.avg((y - p) * (y - p))


def r2(y: Column, p: Column) -> Column:
    n = F.count(F.when(p.isNotNull(), y))
    return F.lit(1.0) - F.try_divide(F.sum((y - p) * (y - p)), F.var_pop(F.when(p.isNotNull(), y)) * n)


def mape(y: Column, p: Column) -> Column:
    """Over rows whose label is not zero."""
    return F.avg(F.when(y != 0, F.abs(F.try_divide(y - p, y)))) * 100


def regression_columns(y: Column, p: Column) -> dict[str, Column]:
    """Every regression metric except the median, which needs its own pass."""
    e = y - p
    half = (F.abs(y) + F.abs(p)) / 2
    return {
        "mse": mse(y, p),
        "rmse": F.sqrt(mse(y, p)),
        "mae": F.avg(F.abs(e)),
        "r2": r2(y, p),
        "mape": mape(y, p),
        "smape": F.coalesce(F.avg(F.when(half != 0, F.try_divide(F.abs(e), half))), F.lit(0.0)) * 100,
        "max_error": F.max(F.abs(e)),
        "residual_mean": F.avg(e),
        "residual_std": F.stddev_pop(e),
        "residual_skew": F.skewness(e),
    }


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    middle = quantile(df.select(F.abs(y - p).alias("_ae")), "_ae", 0.5)
    wanted = {**regression_columns(y, p), "median_ae": F.max(F.lit(middle).cast("double"))}
    return df.agg(*[c.alias(n) for n, c in wanted.items()])


def within_tolerance(label: str, prediction: str, percent: float) -> Column:
    """Share (0..100) of rows within a relative tolerance."""
    y = F.col(label)
    error = F.abs(F.try_divide(y - F.col(prediction), F.greatest(y, F.lit(EPSILON)))) * 100
    return F.avg((error <= percent).cast("double")) * 100


def tolerance_metrics(df: DataFrame, label: str, prediction: str, percents: Sequence[float] = (5, 10, 20)) -> DataFrame:
    return df.agg(*[within_tolerance(label, prediction, p).alias(f"within_{p:g}_pct") for p in percents])


def efficiency_score(df: DataFrame, label: str, prediction: str, target: float = 20.0) -> DataFrame:
    error = F.abs(F.col(label) - F.col(prediction)) / F.lit(target)
    return df.agg(F.avg(F.lit(1.0) / (F.lit(1.0) + error)).alias("efficiency_score"))


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("rows"))


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support per class; the counts table has classes² rows."""
    cells = confusion(df, label, prediction)
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(F.col("label").alias("class"), F.col("rows").alias("actual"), F.lit(0).cast("long").alias("predicted"),
                         F.when(F.col("label") == F.col("prediction"), F.col("rows")).otherwise(0).cast("long").alias("hits")),
                F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("actual"), F.col("rows").alias("predicted"),
                         F.lit(0).cast("long").alias("hits")),
            )
        ).alias("s")
    ).select("s.*")
    by = sides.groupBy("class").agg(F.sum("hits").alias("tp"), F.sum("predicted").alias("predicted"), F.sum("actual").alias("support"))
    precision, recall = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    return by.select(
        "class", precision.alias("precision"), recall.alias("recall"),
        ratio(2 * precision * recall, precision + recall).alias("f1"), "support", "tp",
    )


def classification_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Accuracy with macro and support-weighted precision, recall and F1."""
    report = classification_report(df, label, prediction)
    wanted = [ratio(F.sum("tp"), F.sum("support")).alias("accuracy")]
    for m in ("precision", "recall", "f1"):
        wanted.append(F.avg(m).alias(f"{m}_macro"))
        wanted.append(ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"{m}_weighted"))
    return report.agg(*wanted)


def kick_columns(label: Column, prediction: Column) -> dict[str, Column]:
    tp = F.count_if((label == 1) & (prediction == 1))
    tn = F.count_if((label == 0) & (prediction == 0))
    fp = F.count_if((label == 0) & (prediction == 1))
    fn = F.count_if((label == 1) & (prediction == 0))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {
        "true_positives": tp, "true_negatives": tn, "false_positives": fp, "false_negatives": fn,
        "accuracy": ratio(tp + tn, tp + tn + fp + fn),
        "detection_rate": recall,
        "false_alarm_rate": ratio(fp, fp + tn),
        "specificity": ratio(tn, tn + fp),
        "false_negative_rate": ratio(fn, fn + tp),
        "kick_precision": precision,
        "kick_f1": ratio(2 * precision * recall, precision + recall),
        "weighted_cost": fp + MISSED_KICK_WEIGHT * fn,
    }


def kick_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.agg(*[c.alias(n) for n, c in kick_columns(F.col(label), F.col(prediction)).items()])


# ---- score curves ---------------------------------------------------------------


def _score_counts(df: DataFrame, label: str, score: str, rows_per_task: int) -> DataFrame:
    """Cumulative positives and negatives from the highest score down."""
    counted = (
        df.groupBy((-F.col(score)).alias("_down"))
        .agg(F.sum((F.col(label) == 1).cast("long")).alias("_p"), F.sum((F.col(label) == 0).cast("long")).alias("_n"))
    )
    return accumulate(counted, Series((), "_down", rows_per_task), sums={"tp": F.col("_p"), "fp": F.col("_n")})


def _label_totals(df: DataFrame, label: str) -> dict:
    return gather(df, {"p": F.count_if(F.col(label) == 1), "n": F.count_if(F.col(label) == 0)})


def roc_curve(df: DataFrame, label: str, score: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """One point per distinct score: threshold, false and true positive rate."""
    totals = _label_totals(df, label)
    return _score_counts(df, label, score, rows_per_task).select(
        (-F.col("_down")).alias("threshold"),
        ratio(F.col("fp"), F.lit(totals["n"])).alias("fpr"),
        ratio(F.col("tp"), F.lit(totals["p"])).alias("tpr"),
    )


def pr_curve(df: DataFrame, label: str, score: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    totals = _label_totals(df, label)
    return _score_counts(df, label, score, rows_per_task).select(
        (-F.col("_down")).alias("threshold"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.lit(totals["p"])).alias("recall"),
    )


def _trapezoid(curve: DataFrame, x: str, y: str, first: tuple[float, float], name: str, rows_per_task: int) -> DataFrame:
    """Area under a curve whose points are ordered by falling threshold."""
    ordered = curve.withColumn("_down", -F.col("threshold"))
    series = Series((), "_down", rows_per_task)

    def build(f):
        before_x = F.coalesce(F.lag(x, 1).over(f.window), F.lit(first[0]))
        before_y = F.coalesce(F.lag(y, 1).over(f.window), F.lit(first[1]))
        return {"_area": (F.col(x) - before_x) * (F.col(y) + before_y) / 2}

    return over_series(ordered, series, build, back=1).agg(F.sum("_area").alias(name))


def roc_auc(df: DataFrame, label: str, score: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    return _trapezoid(roc_curve(df, label, score, rows_per_task), "fpr", "tpr", (0.0, 0.0), "auc_roc", rows_per_task)


def pr_auc(df: DataFrame, label: str, score: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    return _trapezoid(pr_curve(df, label, score, rows_per_task), "recall", "precision", (0.0, 1.0), "pr_auc", rows_per_task)


# ---- domain metrics -------------------------------------------------------------


def pressure_error(df: DataFrame, label: str, prediction: str) -> DataFrame:
    y, p = F.col(label), F.col(prediction)
    spread = F.max(y) - F.min(y)
    rmse = F.sqrt(mse(y, p))
    return df.agg(
        rmse.alias("rmse_psi"),
        F.coalesce(F.try_divide(rmse, spread), F.lit(float("inf"))).alias("normalized_rmse"),
        spread.alias("pressure_range_psi"),
        F.max(F.abs(y - p)).alias("max_prediction_error_psi"),
    )


def optimisation_score(df: DataFrame, pairs: Mapping[str, tuple[str, str]], weights: Mapping[str, float] | None = None) -> DataFrame:
    """Weighted mean of max(0, 100 - MAPE) over ``{parameter: (actual, predicted)}``."""
    weights = dict(weights or {})
    total = sum(weights.get(n, 1.0) for n in pairs)
    if not total:
        return df.agg(F.max(F.lit(0.0)).alias("optimisation_score"))
    score = None
    for n, (actual, predicted) in pairs.items():
        part = F.greatest(F.lit(0.0), F.lit(100.0) - mape(F.col(actual), F.col(predicted))) * F.lit(weights.get(n, 1.0))
        score = part if score is None else score + part
    return df.agg((score / F.lit(float(total))).alias("optimisation_score"))


def business_cost(df: DataFrame, label: str, predictions: Mapping[str, str]) -> DataFrame:
    """Cost of each model's alarms and misses, and savings against detecting nothing."""
    y = F.col(label)
    wanted = {"n": F.count(F.lit(1)), "kicks": F.count_if(y == 1)}
    for m, c in predictions.items():
        wanted[f"{m}\0tp"] = F.count_if((y == 1) & (F.col(c) == 1))
        wanted[f"{m}\0fp"] = F.count_if((y == 0) & (F.col(c) == 1))
        wanted[f"{m}\0fn"] = F.count_if((y == 1) & (F.col(c) == 0))
    got = gather(df, wanted)
    rows = []
    for m in predictions:
        tp, fp, fn = (got[f"{m}\0{k}"] for k in ("tp", "fp", "fn"))
        cost = fp * COSTS["false_positive"] + fn * COSTS["false_negative"] + tp * COSTS["true_positive"]
        base = got["kicks"] * COSTS["false_negative"]
        rows.append((m, cost, cost / got["n"] if got["n"] else None, base - cost, 100.0 * (base - cost) / base if base else 0.0, tp, fp, fn))
    rows.sort(key=lambda t: -t[3])
    return literal_table(
        df.sparkSession, rows,
        "model string, total_cost long, cost_per_sample double, savings long, savings_percentage double, "
        "true_positives long, false_positives long, false_negatives long",
    )


# ---- comparing models -----------------------------------------------------------


def long_predictions(df: DataFrame, predictions: Mapping[str, str], keep: Sequence[str]) -> DataFrame:
    """One row per model and sample: ``model``, ``prediction`` and the kept columns."""
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("prediction")) for m, c in predictions.items()]))
    return df.select(*keep, cells.alias("m")).select(*keep, "m.*")


def compare_regressors(df: DataFrame, label: str, predictions: Mapping[str, str]) -> DataFrame:
    y, p = F.col(label).cast("double"), F.col("prediction")
    relative = F.abs(F.try_divide(y - p, y + F.lit(EPSILON)))
    return (
        long_predictions(df, predictions, [label]).groupBy("model")
        .agg(
            r2(y, p).alias("r2"), F.sqrt(mse(y, p)).alias("rmse"), F.avg(F.abs(y - p)).alias("mae"),
            (F.avg(relative) * 100).alias("mape"),
            (F.avg((relative < 0.05).cast("double")) * 100).alias("accuracy_5pct"),
            (F.avg((relative < 0.10).cast("double")) * 100).alias("accuracy_10pct"),
        )
        .orderBy(F.desc("r2"))
    )


def compare_detectors(df: DataFrame, label: str, predictions: Mapping[str, str], scores: Mapping[str, str] | None = None) -> DataFrame:
    """Detection rate and quality per model, best recall first."""
    scores = dict(scores or {})
    cells = [
        F.struct(
            F.lit(m).alias("model"), F.col(c).cast("int").alias("prediction"),
            (F.col(scores[m]).cast("double") if m in scores else F.lit(None).cast("double")).alias("score"),
        )
        for m, c in predictions.items()
    ]
    long = df.select(label, F.explode(F.array(*cells)).alias("m")).select(label, "m.*")
    k = kick_columns(F.col(label), F.col("prediction"))
    return (
        long.groupBy("model")
        .agg(
            F.avg("prediction").alias("anomaly_rate"), k["accuracy"].alias("accuracy"), k["kick_precision"].alias("precision"),
            k["detection_rate"].alias("recall"), k["kick_f1"].alias("f1"),
            F.avg("score").alias("mean_score"), F.max("score").alias("max_score"),
        )
        .orderBy(F.desc("recall"))
    )


def improvement(baseline: DataFrame, new: DataFrame) -> DataFrame:
    """Change of every shared metric in percent; both inputs are (metric, value) tables."""
    both = baseline.select("metric", F.col("value").alias("baseline")).join(new.select("metric", F.col("value").alias("new")), "metric")
    fall = F.try_divide(F.col("baseline") - F.col("new"), F.col("baseline"))
    rise = F.try_divide(F.col("new") - F.col("baseline"), F.abs(F.col("baseline")))
    better = F.when(F.col("metric").isin(*LOWER_IS_BETTER), fall).otherwise(rise) * 100
    return both.withColumn("improvement_pct", F.when(F.col("baseline") != 0, better))


def metric_table(long: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Wide model × metric table from (model, metric, value) rows."""
    return long.groupBy("model").pivot("metric", list(metrics)).agg(F.first("value"))


def melt(wide: DataFrame, metrics: Sequence[str], key: str = "model") -> DataFrame:
    return wide.unpivot(key, list(metrics), "metric", "value")


def best_model(table: DataFrame, metric: str) -> DataFrame:
    """Model with the highest value; ties go to the first name."""
    top = table.agg(F.max(metric).alias("value")).first()["value"]
    return table.where(F.col(metric) == F.lit(top)).agg(F.min("model").alias("model"), F.max(metric).alias("value"))


def residuals(df: DataFrame, label: str, prediction: str, *keep: str) -> DataFrame:
    return df.select(
        *keep, F.col(label).alias("actual"), F.col(prediction).alias("predicted"),
        (F.col(label) - F.col(prediction)).alias("residual"),
    )


def validate_pressure_model(df: DataFrame, label: str, prediction: str, depth: str | None = None) -> DataFrame:
    """Domain checks of a pressure model as (check, outcome, value) rows."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    relative = F.abs(F.try_divide(y - p, y))
    wanted = {
        "pmin": F.min(p), "pmax": F.max(p), "ymin": F.min(y), "ymax": F.max(y), "negative": F.count_if(p < 0),
        "in5": F.avg(F.coalesce((relative < 0.05).cast("double"), F.lit(0.0))) * 100,
        "in10": F.avg(F.coalesce((relative < 0.10).cast("double"), F.lit(0.0))) * 100,
    }
    if depth:
        g = F.try_divide(p, F.col(depth))
        wanted["odd"] = F.count_if((g > 1.5) | (g < 0.3))
    got = gather(df, wanted)
    wide = got["pmin"] < got["ymin"] * 0.5 or got["pmax"] > got["ymax"] * 1.5
    rows = [
        ("prediction_range", "warning" if wide else "passed", float(got["pmax"] - got["pmin"])),
        ("negative_predictions", "failed" if got["negative"] else "passed", float(got["negative"])),
        ("accuracy_within_5pct", "info", float(got["in5"])),
        ("accuracy_within_10pct", "failed" if got["in10"] < 70 else "passed", float(got["in10"])),
    ]
    if depth:
        rows.append(("pressure_gradient", "warning" if got["odd"] else "passed", float(got["odd"])))
    passed = not any(o == "failed" for _, o, _ in rows)
    rows.append(("overall", "passed" if passed else "failed", float(passed)))
    return literal_table(df.sparkSession, rows, "check string, outcome string, value double")


def validate_kick_model(df: DataFrame, label: str, prediction: str) -> DataFrame:
    k = kick_columns(F.col(label), F.col(prediction))
    got = gather(df, {"precision": k["kick_precision"], "recall": k["detection_rate"]})
    rows = [
        ("recall", "failed" if got["recall"] < 0.8 else "passed", got["recall"]),
        ("precision", "warning" if got["precision"] < 0.3 else "passed", got["precision"]),
        ("overall", "failed" if got["recall"] < 0.8 else "passed", float(got["recall"] >= 0.8)),
    ]
    return literal_table(df.sparkSession, rows, "check string, outcome string, value double")


def entropy_uncertainty(probability: Column | str) -> Column:
    """Binary entropy in bits of a kick probability; its maximum is one."""
    p = F.col(probability) if isinstance(probability, str) else probability
    q = F.lit(1.0) - p
    return -(p * F.log2(p + F.lit(EPSILON)) + q * F.log2(q + F.lit(EPSILON)))
