"""Structured Streaming: batches, scoring, live KPIs, quality. Operators in event-time order are in ``ordered``."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import rules
from ..operators.domain import append_prediction_log, raise_alerts, validate_inputs
from ..operators.metrics import kick_columns


def open_stream(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_trigger: int | None = None, **options: str
) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def closed(stream: DataFrame, time: str, end: datetime, path: str, **cells: object) -> DataFrame:
    """The stream with one more row, kept under ``path``, of nulls but for its time ``end`` and the given cells.

    A stream that reads a whole table in one batch leaves the rows of its last slots waiting for a later row that never
    comes. A row far enough behind them lets the watermark pass; it waits itself and never comes out.
    Give it a key that is not null: keyed Python state mixes up the keys of a batch that holds a null one.
    """
    spark = stream.sparkSession
    last = spark.range(1).select(*[F.lit(end if f.name == time else cells.get(f.name)).cast(f.dataType).alias(f.name) for f in stream.schema])
    last.write.parquet(path)
    return stream.unionByName(open_stream(spark, path, last.schema))


def each_batch(
    stream: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None,
    output_mode: str = "append",
) -> StreamingQuery:
    """Hand every micro-batch to ``callback``; offsets and recovery live in the checkpoint."""
    writer = stream.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint).foreachBatch(callback)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()


def to_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def log_predictions(scored: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """A stream of results to a log in which every row stands once.

    A batch that is run again after a failure has the number and the rows it had before, and replaces its own folder.
    """
    return each_batch(scored, lambda batch, number: append_prediction_log(batch, path, number), checkpoint, interval)


def score_stream(stream: DataFrame, model, task: str, prediction: str = "prediction", **extra: str) -> DataFrame:
    """Valid requests only, scored by a stateless model."""
    checked = validate_inputs(stream, task).where("problem IS NULL").drop("problem")
    return model.transform(checked, output=prediction, **extra)


def alert_stream(scored: DataFrame, model_type: str, prediction: str, probability: str | None, confidence: str | None) -> DataFrame:
    """Alerts of a scored stream with their level."""
    none = F.lit(None).cast("double")
    tagged = scored.withColumns(
        {
            "model_type": F.lit(model_type),
            "_probability": F.col(probability) if probability else none,
            "_confidence": F.col(confidence) if confidence else none,
        }
    )
    alerts = raise_alerts(tagged, "model_type", "_probability", prediction, "_confidence")
    return alerts.withColumn("level", rules.alert_level(prediction, "_probability")).drop("_probability", "_confidence")


# ---- windows and quality ------------------------------------------------------------


def live_kpis(
    stream: DataFrame, key: str, time: str, value: str, width: str = "5 minutes", slide: str | None = None, delay: str = "10 minutes"
) -> DataFrame:
    """Count, mean, deviation and range per key and time window; late rows are bounded by the delay."""
    timed = stream.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", delay)
    window = F.window("_time", width, slide) if slide else F.window("_time", width)
    grouped = timed.groupBy(key, window).agg(
        F.count(value).alias("samples"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("low"), F.max(value).alias("high"),
    )
    return grouped.select(
        key, F.unix_micros("window.start").alias("window_start"), "samples", "mean", "std", "low", "high"
    )


def running_quality(stream: DataFrame, label: str, prediction: str) -> DataFrame:
    """Detection quality over everything seen so far."""
    wanted = kick_columns(F.col(label), F.col(prediction))
    return stream.agg(
        wanted["accuracy"].alias("accuracy"), wanted["kick_precision"].alias("precision"),
        wanted["detection_rate"].alias("recall"), wanted["kick_f1"].alias("f1"),
    )
