"""Pressure trends, anomalies, kick patterns, alerts and responses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..channels import NORMAL_GRADIENT, PSI_TO_MUD_WEIGHT
from ..functions import rolling as R
from ..functions import rules
from ..series import Series, SeriesLike, join_per_series, number_rows, over_series
from ..quantiles import quantile
from ..stats import gather, moments
from . import ordered


def pressure_trends(df: DataFrame, series: SeriesLike, pressure: str, depth: str) -> DataFrame:
    """Per series: gradient statistics and counts above 1.2 and below 0.8 of normal."""
    g = F.col("_gradient")
    return (
        ordered.gradient(df, series, pressure, depth, "_gradient")
        .groupBy(*series.keys)
        .agg(
            F.avg(g).alias("mean_gradient"),
            F.stddev_pop(g).alias("std_gradient"),
            F.min(g).alias("min_gradient"),
            F.max(g).alias("max_gradient"),
            F.count_if(g > F.lit(NORMAL_GRADIENT * 1.2)).alias("overpressure_zones"),
            F.count_if(g < F.lit(NORMAL_GRADIENT * 0.8)).alias("underpressure_zones"),
        )
    )


def _anomaly_scores(df: DataFrame, series: SeriesLike, column: str) -> DataFrame:
    stepped = over_series(df, series, lambda f: {"_step": R.difference(f, column)}, back=1)
    got = moments(stepped, [column, "_step"], {"m": F.avg, "s": F.stddev_pop})

    def z(c: str) -> Column:
        return F.abs(F.try_divide(F.col(c) - F.lit(got[c]["m"]), F.lit(got[c]["s"]).cast("double")))

    return stepped.withColumns({"z_score": z(column), "step_z_score": z("_step")}).drop("_step")


def pressure_anomalies(df: DataFrame, series: SeriesLike, column: str, threshold: float = 2.0) -> DataFrame:
    """Rows whose value, or step from the previous row, is beyond ``threshold`` deviations."""
    scored = _anomaly_scores(df, series, column)
    return scored.where((F.col("z_score") > threshold) | (F.col("step_z_score") > threshold))


def pressure_anomaly_summary(df: DataFrame, series: SeriesLike, column: str, threshold: float = 2.0) -> DataFrame:
    return _anomaly_scores(df, series, column).agg(
        F.count_if(F.col("z_score") > threshold).alias("anomaly_count"),
        F.count_if(F.col("step_z_score") > threshold).alias("rapid_change_count"),
        F.max("z_score").alias("max_z_score"),
    )


def anomaly_mask(df: DataFrame, column: str, threshold: float = 3.0, name: str = "is_anomaly") -> DataFrame:
    got = moments(df, [column], {"m": F.avg, "s": F.stddev_pop})[column]
    z = F.abs(F.try_divide(F.col(column) - F.lit(got["m"]), F.lit(got["s"]).cast("double")))
    return df.withColumn(name, F.coalesce(z > threshold, F.lit(False)))


def overbalance_metrics(
    df: DataFrame, series: SeriesLike, predicted: str, actual: str, mud_weight: str | None = None
) -> DataFrame:
    """Prediction error, overbalance shares and stability of the predicted series."""
    stepped = over_series(df, series, lambda f: {"_step": R.difference(f, predicted)}, back=1)
    got = moments(stepped, ["_step"], {"m": F.avg, "s": F.stddev_pop})["_step"]
    error = F.col(predicted) - F.col(actual)
    wanted = [
        F.avg(F.abs(error)).alias("mean_absolute_error"),
        F.max(F.abs(error)).alias("max_error"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
    ]
    if mud_weight:
        over = F.col(mud_weight) - F.col(predicted) * F.lit(PSI_TO_MUD_WEIGHT)
        wanted += [
            F.avg(over).alias("mean_overbalance"),
            F.avg(((over > 0.5) & (over < 2.0)).cast("double")).alias("overbalance_efficiency"),
            F.avg((over < 0.5).cast("double")).alias("underbalanced_risk"),
            F.avg((over > 3.0).cast("double")).alias("excessive_overbalance"),
        ]
    if got["s"] is not None:
        steady = F.abs(F.col("_step") - F.lit(got["m"])) < F.lit(got["s"])
        wanted += [
            F.lit(1.0 / (1.0 + got["s"])).alias("pressure_stability"),
            F.avg(steady.cast("double")).alias("gradient_consistency"),
        ]
    return stepped.agg(*wanted)


def series_recommendations(
    df: DataFrame, series: SeriesLike, pressure: str, depth: str, mud_weight: float | str = 10.0
) -> DataFrame:
    """Advice rows (type, priority, reason, action, values) per series."""
    layout = series.measure(df)
    work = ordered.gradient(df, layout, pressure, depth, "_gradient")
    work = number_rows(work, layout, "_at", "_of")
    mud = F.col(mud_weight) if isinstance(mud_weight, str) else F.lit(float(mud_weight))
    recent = F.when(F.col("_at") >= F.col("_of") - 10, F.col("_gradient"))
    is_last = F.col("_at") == F.col("_of") - 1
    facts = work.groupBy(*layout.keys).agg(
        F.max(F.when(is_last, F.col(pressure) * F.lit(PSI_TO_MUD_WEIGHT))).alias("_last"),
        F.max(F.when(is_last, mud)).alias("_mud"),
        F.avg("_gradient").alias("_mean"),
        F.max(pressure).alias("_peak"),
        F.count("_gradient").alias("_n"),
        F.stddev_pop(recent).alias("_recent"),
        F.stddev_pop("_gradient").alias("_spread"),
    )
    conditions = [
        F.col("_last") > F.col("_mud") - 0.5,
        F.col("_mean") > 0.5,
        F.col("_peak") > 5000,
        (F.col("_n") > 10) & (F.col("_recent") > F.col("_spread") * 1.5),
    ]
    advice = []
    for condition, (kind, priority, reason, action) in zip(conditions, rules.SERIES_ADVICE):
        target = F.col("_last") + 1.0 if kind == "mud_weight" else F.lit(None).cast("double")
        row = F.struct(
            F.lit(kind).alias("type"), F.lit(priority).alias("priority"), F.lit(reason).alias("reason"),
            F.lit(action).alias("action"), target.alias("recommended_value"),
        )
        advice.append(F.when(condition, row))
    return facts.select(*layout.keys, F.explode(F.array_compact(F.array(*advice))).alias("a")).select(*layout.keys, "a.*")


def kick_patterns(df: DataFrame, series: SeriesLike, score: str, threshold: float | None = None) -> DataFrame:
    """Event count and rate, gaps between events and run lengths, per series."""
    if threshold is None:
        threshold = quantile(df, score, 0.95)
    layout = series.measure(df)
    keys = list(layout.keys)
    numbered = number_rows(df, layout, "_at")
    totals = df.groupBy(*keys).agg(
        F.count_if(F.col(score) > threshold).alias("total_events"),
        (F.count_if(F.col(score) > threshold) / F.count(F.lit(1))).alias("event_rate"),
        F.max(score).alias("max_score"),
    )
    events = numbered.where(F.col(score) > threshold).select(*keys, "_at")
    along = Series(keys, "_at", layout.series.rows_per_task)
    along = along.measure(events) if layout.chunked else type(layout)(along)
    ranked = number_rows(events, along, "_rank")
    spaced = over_series(ranked, along, lambda f: {"_gap": F.col("_at") - R.shifted(f, "_at", 1)}, back=1)
    runs = spaced.groupBy(*keys, (F.col("_at") - F.col("_rank")).alias("_run")).agg(
        F.count(F.lit(1)).alias("_length"),
        F.count("_gap").alias("_gaps"),
        F.sum("_gap").alias("_sum"),
        F.sum(F.col("_gap").cast("double") * F.col("_gap")).alias("_squares"),
        F.min("_gap").alias("_low"),
        F.max("_gap").alias("_high"),
    )
    mean = F.try_divide(F.sum("_sum"), F.sum("_gaps"))
    variance = F.try_divide(F.sum("_squares"), F.sum("_gaps")) - mean * mean
    patterns = runs.groupBy(*keys).agg(
        mean.alias("mean_interval"),
        F.when(mean.isNotNull(), F.sqrt(F.greatest(variance, F.lit(0.0)))).alias("std_interval"),
        F.min("_low").alias("min_interval"),
        F.max("_high").alias("max_interval"),
        F.avg("_length").alias("mean_duration"),
        F.max("_length").alias("max_duration"),
        F.count(F.lit(1)).alias("total_durations"),
    )
    return join_per_series(totals, patterns, keys).withColumn("threshold_used", F.lit(threshold))


# ---- alerts ---------------------------------------------------------------------


def raise_alerts(
    df: DataFrame,
    model_type: str = "model_type",
    kick_probability: str = "kick_probability",
    pressure: str = "prediction",
    confidence: str = "confidence",
) -> DataFrame:
    """Keep the predictions that raise an alert, with its type and severity."""
    kind = rules.alert_type(model_type, kick_probability, pressure, confidence)
    tagged = df.withColumn("alert_type", kind).where(F.col("alert_type").isNotNull())
    return tagged.withColumn("severity", rules.alert_severity("alert_type", kick_probability))


def recent_alerts(alerts: DataFrame, order: Sequence[str], limit: int = 50) -> DataFrame:
    """The latest ``limit`` alerts."""
    return alerts.orderBy(*[F.desc(c) for c in order]).limit(limit)


def alert_statistics(alerts: DataFrame, kind: str = "alert_type") -> DataFrame:
    """Count and share of every alert type."""
    counted = alerts.groupBy(kind).agg(F.count(F.lit(1)).alias("alerts"))
    # one row per alert type: a handful of rows in the window
    total = F.sum("alerts").over(Window.partitionBy())
    return counted.withColumn("rate", F.col("alerts") / F.greatest(total, F.lit(1)))


# ---- validation and responses ---------------------------------------------------


def validate_inputs(df: DataFrame, task: str, name: str = "problem") -> DataFrame:
    """Add the first failed check of every row, NULL for valid rows."""
    kinds = dict(df.dtypes)
    fractional = [c for c, t in kinds.items() if t in ("double", "float")]
    checks = [rules.input_problem(kinds, task)]
    if fractional:
        checks.append(rules.finite_problem(fractional))
    return df.withColumn(name, F.coalesce(*checks))


def split_valid(df: DataFrame, task: str) -> tuple[DataFrame, DataFrame]:
    checked = validate_inputs(df, task)
    return checked.where("problem IS NULL").drop("problem"), checked.where("problem IS NOT NULL")


def formation_responses(
    df: DataFrame, pressure: str, depth: str = "well_depth", rop: str = "rop", standpipe: str = "standpipe_pressure"
) -> DataFrame:
    return df.withColumns(
        {
            "pressure_gradient": F.try_divide(F.col(pressure), F.col(depth)),
            "mud_weight_recommendation": rules.recommended_mud_weight(pressure),
            "pressure_category": rules.pressure_category(pressure, depth),
            "recommendations": rules.formation_advice(pressure, depth, rop, standpipe),
        }
    )


def kick_responses(df: DataFrame, prediction: str, raw_score: str, flow_in: str, flow_out: str) -> DataFrame:
    scored = df.withColumns(
        {"anomaly_score": rules.kick_score(raw_score), "flow_balance": F.col(flow_out) - F.col(flow_in)}
    )
    return scored.withColumns(
        {
            "kick_detected": F.col(prediction) == 1,
            "risk_level": rules.risk_level("anomaly_score"),
            "confidence_level": rules.confidence_level("anomaly_score", prediction),
            "monitoring": rules.monitoring_advice("anomaly_score", "flow_balance"),
            "emergency": rules.emergency_actions(prediction),
        }
    )


def _recent(log: DataFrame, time: str, days: int) -> DataFrame:
    """Rows of the last ``days`` days before the newest entry of the log."""
    newest = gather(log, {"t": F.max(F.unix_micros(F.col(time).cast("timestamp")))})["t"]
    if newest is None:
        return log.where(F.lit(False))
    return log.where(F.unix_micros(F.col(time).cast("timestamp")) > newest - days * 86_400_000_000)


def pressure_analytics(log: DataFrame, time: str, pressure: str, category: str, days: int = 7) -> DataFrame:
    """Counts, mean and range of logged predictions per pressure category."""
    return _recent(log, time, days).groupBy(category).agg(
        F.count(F.lit(1)).alias("predictions"),
        F.avg(pressure).alias("average_pressure"),
        F.min(pressure).alias("min_pressure"),
        F.max(pressure).alias("max_pressure"),
    )


def kick_analytics(log: DataFrame, time: str, prediction: str, label: str, score: str, days: int = 7) -> DataFrame:
    """Kicks found, false-positive rate, mean score and risk distribution."""
    scored = _recent(log, time, days).withColumn("_risk", rules.risk_level(score))
    fp = F.count_if((F.col(prediction) == 1) & (F.col(label) == 0))
    negatives = F.count_if(F.col(label) == 0)
    return scored.agg(
        F.count(F.lit(1)).alias("total_analyses"),
        F.count_if(F.col(prediction) == 1).alias("kicks_detected"),
        F.coalesce(F.try_divide(fp.cast("double"), negatives), F.lit(0.0)).alias("false_positive_rate"),
        F.avg(score).alias("average_anomaly_score"),
        *[F.count_if(F.col("_risk") == k).alias(f"risk_{k.lower()}") for k in ("Low", "Medium", "High", "Critical")],
    )


def bulk_predict(df: DataFrame, task: str, model, prediction: str = "prediction") -> DataFrame:
    """Score the valid rows and return every row with a status; one bad row fails alone."""
    valid, rejected = split_valid(df, task)
    scored = model.transform(valid).select(*df.columns, prediction).withColumn("problem", F.lit(None).cast("string"))
    failed = rejected.select(*df.columns, F.lit(None).cast("double").alias(prediction), "problem")
    both = scored.unionByName(failed)
    return both.withColumn("status", F.when(F.col("problem").isNull(), "success").otherwise("error"))


def bulk_totals(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "success").alias("successes"),
        F.count_if(F.col("status") == "error").alias("errors"),
    )


def append_prediction_log(results: DataFrame, path: str, batch: int | None = None) -> None:
    """Add results to a log. With a batch number they are that batch's folder, so writing the batch again replaces it."""
    if batch is None:
        results.write.mode("append").parquet(path)
    else:
        results.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def service_statistics(log: DataFrame, kind: str = "model_type", latency: str = "latency_ms", status: str = "status") -> DataFrame:
    return log.groupBy(kind).agg(
        F.count(F.lit(1)).alias("predictions"),
        F.avg(latency).alias("mean_latency_ms"),
        F.avg((F.col(status) == "error").cast("double")).alias("error_rate"),
    )
