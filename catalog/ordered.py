"""Series queries: lags, rolling windows, slopes, gradients, smoothing, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataflow.operators import domain, ordered
from strataflow.series import Series

from .base import EVENTS_SQL, WELL, each, query, r, rounded, tele

_W = "PARTITION BY user_id ORDER BY ts, event_id"


def full(n: int, expression: str, column: str = "value") -> str:
    frame = f"({_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({column}) OVER {frame} >= {n} THEN {expression} OVER {frame} END"


_KINDS = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}


@query("d00_rolling_outliers", sql=f"""
WITH f AS (SELECT event_id, user_id, ts, value,
    {full(10, 'avg(value)')} AS value_MA_10, {full(10, 'stddev_samp(value)')} AS value_STD_10,
    {full(5, 'regr_slope(value, rn)')} AS value_Trend_5,
    value - lag(value) OVER ({_W}) AS step
  FROM (SELECT *, row_number() OVER ({_W}) AS rn FROM events)),
s AS (SELECT avg(value) AS m, stddev_pop(value) AS d, avg(step) AS ms, stddev_pop(step) AS ds FROM f)
SELECT event_id, user_id, {r('value_MA_10')} AS value_MA_10, {r('value_STD_10')} AS value_STD_10,
  {r('value_Trend_5')} AS value_Trend_5, {r('abs((value - m) / d)')} AS z_score,
  {r('abs((step - ms) / ds)')} AS step_z_score
FROM f, s WHERE abs((value - m) / d) > 2 OR abs((step - ms) / ds) > 2""")
def d00(spark, sf):
    featured = ordered.temporal_features(tele(spark, sf, "event_id", "user_id", "ts", "value"), WELL, ["value"])
    flagged = domain.pressure_anomalies(featured, WELL, "value", threshold=2.0)
    return rounded(
        flagged.select("event_id", "user_id", "value_MA_10", "value_STD_10", "value_Trend_5", "z_score", "step_z_score")
    )


@query("d01_lags", sql=f"""
WITH x AS (SELECT event_id, value, {each(f'lag(value, {{c}}) OVER ({_W}) AS value_lag_{{c}}', ['1', '2', '3', '5'])} FROM events)
SELECT * FROM x WHERE value_lag_5 IS NOT NULL""")
def d01(spark, sf):
    out = ordered.lag_features(tele(spark, sf, "event_id", "user_id", "ts", "value"), WELL, ["value"], [1, 2, 3, 5])
    return out.drop("user_id", "ts")


@query("d02_rolling", sql=f"""
{EVENTS_SQL.replace('tele AS', 'WITH tele AS', 1)}, x AS (SELECT event_id, {", ".join(f"{r(full(n, f'{fn}({c})', c))} AS {c}_rolling_{k}_{n}" for c in ('value', 'k') for n in (5, 10, 20) for k, fn in _KINDS.items())}
FROM tele) SELECT * FROM x WHERE value_rolling_mean_20 IS NOT NULL""")
def d02(spark, sf):
    df = tele(spark, sf, "event_id", "user_id", "ts", "value", "k")
    return rounded(ordered.rolling_features(df, WELL, ["value", "k"]).drop("user_id", "ts", "value", "k"))


@query("d03_derivatives", sql=f"""
WITH x AS (SELECT event_id, value - lag(value) OVER ({_W}) AS value_derivative,
  (value - lag(value) OVER ({_W})) - (lag(value) OVER ({_W}) - lag(value, 2) OVER ({_W})) AS value_second_derivative FROM events)
SELECT * FROM x WHERE value_second_derivative IS NOT NULL""")
def d03(spark, sf):
    df = tele(spark, sf, "event_id", "user_id", "ts", "value")
    return ordered.derivative_features(df, WELL, ["value"]).drop("user_id", "ts", "value")


@query("d04_temporal_bundle", sql=f"""
SELECT event_id, {r(f'value - lag(value) OVER ({_W})')} AS value_Rate,
  {r(f'(value - lag(value) OVER ({_W})) - (lag(value) OVER ({_W}) - lag(value, 2) OVER ({_W}))')} AS value_Acceleration,
  {", ".join(f"{r(full(n, f'{fn}(value)'))} AS value_{k}_{n}" for n in (5, 10, 20) for k, fn in (('MA', 'avg'), ('STD', 'stddev_samp'), ('MIN', 'min'), ('MAX', 'max')))},
  {r(full(5, 'regr_slope(value, rn)'))} AS value_Trend_5,
  {r(f"({full(10, 'stddev_samp(value)')}) / ({full(10, 'avg(value)')} + 1e-8)")} AS value_Volatility
FROM (SELECT *, row_number() OVER ({_W}) AS rn FROM events)""")
def d04(spark, sf):
    df = tele(spark, sf, "event_id", "user_id", "ts", "value")
    return rounded(ordered.temporal_features(df, WELL, ["value"]).drop("user_id", "ts", "value"))


@query("d05_trend", sql=f"""
SELECT event_id, {r(full(10, 'regr_slope(value, rn)'))} AS value_Trend
FROM (SELECT *, row_number() OVER ({_W}) AS rn FROM events)""")
def d05(spark, sf):
    df = tele(spark, sf, "event_id", "user_id", "ts", "value")
    return rounded(ordered.trend(df, WELL, "value", 10).select("event_id", "value_Trend"))


@query("m03_user_window", sql=f"""
WITH w AS (SELECT event_id, value, count(value) OVER f AS n, list(value) OVER f AS held FROM events
           WINDOW f AS ({_W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT event_id, CASE WHEN n = 5 THEN {r("list_avg(list_transform(held, lambda x: abs(x - list_median(held))))")} END AS value_spread_5 FROM w""")
def m03(spark, sf):
    df = tele(spark, sf, "event_id", "user_id", "ts", "value")
    spread = ordered.rolling_apply(df, WELL, ["value"], 5, lambda v: (v - v.median()).abs().mean(), "spread")
    return rounded(spread.select("event_id", "value_spread_5"))


_FRAME = f"({_W} ROWS BETWEEN {{n}} PRECEDING AND CURRENT ROW)"


@query("d06_d07_short_history", sql=f"""
SELECT event_id, {r(f"avg(value) OVER {_FRAME.format(n=2)}")} AS value_MA3, {r(f"avg(value) OVER {_FRAME.format(n=4)}")} AS value_MA5,
  {r(f"stddev_samp(value) OVER {_FRAME.format(n=2)}")} AS value_Std3, {r(f"value - lag(value) OVER ({_W})")} AS value_Change,
  {r(f"(value - lag(value) OVER ({_W})) / lag(value) OVER ({_W})")} AS value_ROC, lag(value) OVER ({_W}) AS value_Lag1
FROM events""")
def d06(spark, sf):
    df = tele(spark, sf, "event_id", "user_id", "ts", "value")
    out = ordered.short_history_features(df, WELL, "value").drop("user_id", "ts", "value")
    return rounded(out, only=[c for c in out.columns if c not in ("event_id", "value_Lag1")])


@query("d08_anomaly_features", sql=f"""
WITH x AS (SELECT *, value - lag(value) OVER ({_W}) AS step FROM events)
SELECT event_id,
  {r(f"(value - ({full(50, 'avg(value)')})) / (({full(50, 'stddev_samp(value)')}) + 1e-8)")} AS value_ZScore,
  {r(f"abs(value - ({full(20, 'quantile_cont(value, 0.5)')}))")} AS value_Median_Distance,
  {r(f"abs(step) / (({full(20, 'stddev_samp(step)', 'step')}) + 1e-8)")} AS value_Rate_Anomaly
FROM x""")
def d08(spark, sf):
    df = tele(spark, sf, "event_id", "user_id", "ts", "value")
    return rounded(ordered.anomaly_features(df, WELL, ["value"]).drop("user_id", "ts", "value"))


@query("d09_deviation", sql=f"""
SELECT event_id, {r(full(10, 'avg(value)'))} AS value_MA, {r(f"value - ({full(10, 'avg(value)')})")} AS value_Deviation FROM events""")
def d09(spark, sf):
    df = tele(spark, sf, "event_id", "user_id", "ts", "value")
    return rounded(ordered.deviation_features(df, WELL, "value").drop("user_id", "ts", "value"))


@query("d10_variation", sql=f"SELECT event_id, {r(full(5, 'stddev_samp(value)'))} AS value_Variation FROM events")
def d10(spark, sf):
    df = tele(spark, sf, "event_id", "user_id", "ts", "value")
    return rounded(ordered.variation(df, WELL, "value").select("event_id", "value_Variation"))


@query("d11_cumulative_change", sql=f"""
WITH x AS (SELECT *, value - lag(value) OVER ({_W}) AS step FROM events)
SELECT event_id, {r('step')} AS step, {r(f'CASE WHEN step IS NOT NULL THEN sum(step) OVER ({_W} ROWS UNBOUNDED PRECEDING) END')} AS total FROM x""")
def d11(spark, sf):
    df = tele(spark, sf, "event_id", "user_id", "ts", "value")
    return rounded(ordered.cumulative_change(df, WELL, "value", "step", "total").select("event_id", "step", "total"))


GRADIENT_SQL = f"""
x AS (SELECT event_id, user_id, CAST(event_id AS DOUBLE) AS depth, value FROM events),
n AS (SELECT *, depth - lag(depth) OVER g AS hs, lead(depth) OVER g - depth AS hd,
        lag(value) OVER g AS before, lead(value) OVER g AS after FROM x
      WINDOW g AS (PARTITION BY user_id ORDER BY depth)),
grad AS (SELECT event_id, user_id, depth, value,
  CASE WHEN hs IS NULL THEN (after - value) / hd WHEN hd IS NULL THEN (value - before) / hs
    ELSE (hs * hs * after + (hd * hd - hs * hs) * value - hd * hd * before) / (hs * hd * (hs + hd)) END AS gradient FROM n)"""


@query("d12_gradient", sql=f"WITH {GRADIENT_SQL} SELECT event_id, gradient FROM grad")
def d12(spark, sf):
    df = tele(spark, sf, "event_id", "user_id", "value").withColumn("depth", F.col("event_id").cast("double"))
    return ordered.gradient(df, Series("user_id", "depth"), "value", "depth").select("event_id", "gradient")


@query("d13_steps", sql=f"""
WITH x AS (SELECT event_id, value - lag(value) OVER ({_W}) AS step FROM events) SELECT * FROM x WHERE step IS NOT NULL""")
def d13(spark, sf):
    return ordered.steps(tele(spark, sf, "event_id", "user_id", "ts", "value"), WELL, "value", "step").select("event_id", "step")


def _dot(weights, first):
    terms = []
    for i, w in enumerate(weights):
        k = first + i
        value = "v" if k == 0 else (f"lead(v, {k}) OVER g" if k > 0 else f"lag(v, {-k}) OVER g")
        terms.append(f"{float(w)} * {value}")
    return "(" + " + ".join(terms) + ")"


_EDGES = [([32, 15, 3, -4, -6, -3, 5], 42), ([5, 4, 3, 2, 1, 0, -1], 14), ([1, 3, 4, 4, 3, 1, -2], 14)]
_SMOOTH = " ".join(
    f"WHEN rn = {i} THEN {_dot(w, -i)} / {d} WHEN n - 1 - rn = {i} THEN {_dot(w[::-1], i - 6)} / {d}"
    for i, (w, d) in enumerate(_EDGES)
)


@query("d14_smoothing", sql=f"""
WITH f AS (SELECT event_id, user_id, ts, last_value(CASE WHEN event_type = 'error' THEN NULL ELSE value END IGNORE NULLS)
    OVER ({_W} ROWS UNBOUNDED PRECEDING) AS v, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS raw,
    row_number() OVER ({_W}) - 1 AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events),
c AS (SELECT *, count(raw) OVER (PARTITION BY user_id) AS known FROM f)
SELECT event_id, {r(f"CASE WHEN known <= 7 THEN raw {_SMOOTH} ELSE {_dot([-2, 3, 6, 7, 6, 3, -2], -3)} / 21 END")} AS value
FROM c WINDOW g AS ({_W})""")
def d14(spark, sf):
    df = tele(spark, sf, "event_id", "user_id", "ts", "event_type", "value")
    df = df.withColumn("value", F.when(F.col("event_type") != "error", F.col("value"))).drop("event_type")
    return rounded(ordered.smooth(df, WELL, ["value"]).select("event_id", "value"))


@query("d15_kick_bundle", sql=f"""
WITH {EVENTS_SQL}, x AS (SELECT *, row_number() OVER ({_W}) AS rn FROM tele)
SELECT event_id, value - k AS Flow_Balance, value / (k + 1e-8) AS Flow_Balance_Ratio,
  {r(f'value - lag(value) OVER ({_W})')} AS ActiveGL_Rate,
  {r(f'(value - lag(value) OVER ({_W})) - (lag(value) OVER ({_W}) - lag(value, 2) OVER ({_W}))')} AS ActiveGL_Acceleration,
  {r(full(5, 'stddev_samp(value)'))} AS SPP_Variation, {r(full(10, 'regr_slope(value, rn)'))} AS SPP_Trend,
  {r(full(10, 'avg(k)', 'k'))} AS MRFlow_MA, {r(f"k - ({full(10, 'avg(k)', 'k')})")} AS MRFlow_Deviation,
  {r(full(5, 'stddev_samp(k)', 'k'))} AS HLoad_Variation, {r(full(10, 'regr_slope(k, rn)', 'k'))} AS HLoad_Trend
FROM x""")
def d15(spark, sf):
    df = tele(spark, sf)
    roles = {"FIn": "k", "FOut": "value", "ActiveGL": "value", "WBoPress": "value", "MRFlow": "k", "HLoad": "k"}
    df = df.select("event_id", "user_id", "ts", *[F.col(c).alias(n) for n, c in roles.items()])
    out = ordered.kick_features(df, WELL).drop("user_id", "ts", *roles)
    return rounded(out, only=[c for c in out.columns if c not in ("event_id", "Flow_Balance", "Flow_Balance_Ratio")])


@query("d16_calendar", sql="""
SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE hour(ts) END AS hour,
  CASE WHEN event_type = 'error' THEN NULL ELSE isodow(ts) - 1 END AS day_of_week,
  CASE WHEN event_type = 'error' THEN NULL ELSE month(ts) END AS month,
  CASE WHEN event_type = 'error' THEN NULL ELSE quarter(ts) END AS quarter FROM events""")
def d16(spark, sf):
    stamp = F.when(F.col("event_type") == "error", F.lit("not a time")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    df = tele(spark, sf, "event_id", "event_type", "ts").select("event_id", stamp.alias("stamp"))
    return ordered.calendar_features(df, "stamp").drop("stamp")


@query("d17_latest_rows", sql=f"""
SELECT event_id, user_id, value FROM
 (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 10""")
def d17(spark, sf):
    return ordered.latest_rows(tele(spark, sf, "event_id", "user_id", "ts", "value"), WELL, 10).drop("ts")


@query("d18_pit_volume_label", sql=f"""
WITH x AS (SELECT event_id, abs(value - lag(value) OVER ({_W})) AS step FROM events),
q AS (SELECT quantile_cont(step, 0.99) AS t FROM x)
SELECT event_id, CASE WHEN step > t THEN 1 ELSE 0 END AS Kick FROM x, q""")
def d18(spark, sf):
    df = tele(spark, sf, "event_id", "user_id", "ts", "value")
    return ordered.pit_volume_label(df, WELL, "value").select("event_id", "Kick")


@query("d18_level_label", sql="""
WITH q AS (SELECT quantile_cont(value, 0.95) AS t FROM events)
SELECT event_id, CASE WHEN value > t THEN 1 ELSE 0 END AS Kick FROM events, q""")
def d18_level(spark, sf):
    return ordered.level_label(tele(spark, sf, "event_id", "value"), "value").select("event_id", "Kick")
