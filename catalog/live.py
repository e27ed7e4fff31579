"""Streaming queries: the events table read as a stream until it is used up."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from strataflow.models.pressure import LinearModel
from strataflow.operators.domain import append_prediction_log, service_statistics
from strataflow.session import materialise
from strataflow.streaming import live, ordered

from .base import query, r, rounded, table, workdir


def stream(spark, sf):
    schema = table(spark, sf, "events").schema
    # a pattern, so that the table may be one file or a folder of files
    return live.open_stream(spark, f"{sf}/events.parque[t]", schema)


def finish(spark, df, mode: str = "append"):
    """Run a stream to its end and return what it wrote; in complete mode only the latest result counts."""
    root = workdir(spark)

    def keep(batch, number):
        batch.write.mode("append" if mode == "append" else "overwrite").parquet(f"{root}/out")

    live.each_batch(df, keep, f"{root}/ckpt", output_mode=mode).awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query("l01_stream_batches", sql="SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY event_type")
def l01(spark, sf):
    root = workdir(spark)

    def callback(batch, number):
        batch.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id")).write.mode("append").parquet(f"{root}/out")

    live.each_batch(stream(spark, sf), callback, f"{root}/ckpt").awaitTermination()
    seen = spark.read.parquet(f"{root}/out")
    return seen.groupBy("event_type").agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"))


@query("l02_stream_scoring", sql=f"""
WITH q AS (SELECT event_id, value AS FlowRateIn, value * 1.5 AS FlowRateOut, value * 2 AS StandpipePressure FROM events),
s AS (SELECT *, 20 * FlowRateIn + 3 * StandpipePressure AS prediction FROM q WHERE FlowRateIn <= 1000 AND StandpipePressure <= 500)
SELECT event_id, {r('prediction')} AS prediction, 'HIGH_PRESSURE' AS alert_type, 'HIGH' AS severity FROM s WHERE prediction > 5000""")
def l02(spark, sf):
    requests = stream(spark, sf).select(
        "event_id", F.col("value").alias("FlowRateIn"), (F.col("value") * 1.5).alias("FlowRateOut"), (F.col("value") * 2).alias("StandpipePressure")
    )
    model = LinearModel("pls", ["FlowRateIn", "StandpipePressure"], "p", 0.0, [20.0, 3.0])
    scored = live.score_stream(requests, model, "kick_detection")
    alerts = live.alert_stream(scored, "formation_pressure", "prediction", None, None)
    return rounded(finish(spark, alerts.select("event_id", "prediction", "alert_type", "severity")))


@query("j15_prediction_log", sql=f"""
SELECT event_type AS model_type, count(*) AS predictions, {r('avg(value)')} AS mean_latency_ms, {r("avg((value > 60)::INT)")} AS error_rate FROM events GROUP BY event_type""")
def j15_log(spark, sf):
    """The log of a stream, of which a batch is written twice, as after a failure."""
    root = workdir(spark)
    status = F.when(F.col("value") > 60, "error").otherwise("success").alias("status")
    results = stream(spark, sf).select(F.col("event_type").alias("model_type"), "value", status)
    live.log_predictions(results, f"{root}/log", f"{root}/ckpt").awaitTermination()
    again = spark.read.parquet(f"{root}/log/batch=0")
    append_prediction_log(again.select("*").transform(materialise), f"{root}/log", 0)
    return rounded(service_statistics(spark.read.parquet(f"{root}/log"), latency="value"))


_W = "PARTITION BY user_id ORDER BY ts, event_id"
_F20 = f"({_W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
_F5 = f"({_W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"


@query("l03_stream_ordered_features", sql=f"""
WITH x AS (SELECT *, row_number() OVER ({_W}) AS rn FROM events),
f AS (SELECT event_id, user_id, ts, {", ".join(f"lag(value, {k}) OVER ({_W}) AS value_lag_{k}" for k in (1, 2, 3))},
  {r(f'value - lag(value) OVER ({_W})')} AS value_rate,
  {", ".join(f"round(CASE WHEN count(*) OVER {_F20} = 20 THEN {fn}(value) OVER {_F20} END, 6) + 0.0 AS value_{n}" for n, fn in (('mean', 'avg'), ('std', 'stddev_samp'), ('low', 'min'), ('high', 'max')))},
  round(CASE WHEN count(*) OVER {_F5} = 5 THEN regr_slope(value, rn) OVER {_F5} END, 6) + 0.0 AS value_trend FROM x)
SELECT * EXCLUDE (ts) FROM f WHERE ts IS NOT NULL""")
def l03(spark, sf):
    events = stream(spark, sf)
    last, user = table(spark, sf, "events").agg(F.max("ts"), F.max("user_id")).first()
    if last is not None:
        # a day's rows come out once the next day begins, those of the last day at the closing row
        events = live.closed(events, "ts", last + timedelta(days=2), f"{workdir(spark)}/end", user_id=user)
    out = ordered.ordered_features(events, "user_id", "ts", "event_id", "value", delay="0 seconds", slot="1 day")
    done = finish(spark, out).drop("at_micros", "value")
    return rounded(done.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c, t in done.dtypes if t == "double"}))


@query("l04_live_kpis", sql=f"""
SELECT user_id, epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS window_start, count(value) AS samples, {r('avg(value)')} AS mean,
  {r('stddev_samp(value)')} AS std, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2""")
def l04(spark, sf):
    kpis = live.live_kpis(stream(spark, sf), "user_id", "ts", "value", "1 day")
    return rounded(finish(spark, kpis, "complete"), only=["mean", "std"])


@query("l05_running_quality", sql=f"""
WITH p AS (SELECT (event_type = 'error')::INT AS y, (value > 60)::INT AS p FROM events),
c AS (SELECT count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (p = 1) AS pp, count(*) FILTER (y = 1) AS ap, avg((y = p)::INT) AS acc FROM p)
SELECT {r('acc')} AS accuracy, {r('tp / pp')} AS precision, {r('tp / ap')} AS recall, {r('2.0 * tp / (pp + ap)')} AS f1 FROM c""")
def l05(spark, sf):
    s = stream(spark, sf).select((F.col("event_type") == "error").cast("int").alias("y"), (F.col("value") > 60).cast("int").alias("p"))
    return rounded(finish(spark, live.running_quality(s, "y", "p"), "complete"))


@query("l06_repeat_suppression", sql="""
WITH k AS (SELECT user_id // 50 AS user_group, event_type, ts FROM events),
o AS (SELECT *, lag(ts) OVER (PARTITION BY user_group, event_type ORDER BY ts) AS before FROM (SELECT DISTINCT * FROM k))
SELECT user_group, event_type, epoch_us(ts) AS at_micros FROM o WHERE (before IS NULL OR ts - before > INTERVAL 6 HOUR)
  AND time_bucket(INTERVAL 6 HOUR, ts) < (SELECT time_bucket(INTERVAL 6 HOUR, max(ts)) FROM events)""")
def l06(spark, sf):
    inputs = stream(spark, sf).select(F.expr("user_id DIV 50").alias("user_group"), "event_type", "ts")
    # groups of users, so that chains of repeats within the lifetime are common
    kept = ordered.drop_repeats(inputs, "ts", ["user_group", "event_type"], "6 hours", delay="0 seconds", slot="6 hours")
    return finish(spark, kept.select("user_group", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_micros")))
