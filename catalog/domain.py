"""Pressure trend, kick pattern, alert and response queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataflow.functions import rules
from strataflow.operators import domain
from strataflow.series import Series

from .base import EVENTS_SQL, WELL, query, r, rounded, table, tele
from .ordered import GRADIENT_SQL

_W = "PARTITION BY user_id ORDER BY ts, event_id"
_DEPTH = Series("user_id", "depth")


def _depth(spark, sf):
    return tele(spark, sf, "event_id", "user_id", "value").withColumn("depth", F.col("event_id").cast("double"))


@query("j01_pressure_trends", sql=f"""
WITH {GRADIENT_SQL} SELECT user_id, {r('avg(gradient)')} AS mean_gradient, {r('stddev_pop(gradient)')} AS std_gradient,
  {r('min(gradient)', 5)} AS min_gradient, {r('max(gradient)', 5)} AS max_gradient,
  count(*) FILTER (gradient > 0.433 * 1.2) AS overpressure_zones, count(*) FILTER (gradient < 0.433 * 0.8) AS underpressure_zones
FROM grad GROUP BY user_id""")
def j01(spark, sf):
    out = domain.pressure_trends(_depth(spark, sf), _DEPTH, "value", "depth")
    return rounded(rounded(out, 5, ["min_gradient", "max_gradient"]), 6, ["mean_gradient", "std_gradient"])


@query("j02_anomaly_summary", sql=f"""
WITH f AS (SELECT value, value - lag(value) OVER ({_W}) AS step FROM events),
s AS (SELECT avg(value) AS m, stddev_pop(value) AS d, avg(step) AS ms, stddev_pop(step) AS ds FROM f)
SELECT count(*) FILTER (abs((value - m) / d) > 2) AS anomaly_count, count(*) FILTER (abs((step - ms) / ds) > 2) AS rapid_change_count,
  {r('max(abs((value - m) / d))')} AS max_z_score FROM f, s""")
def j02(spark, sf):
    df = tele(spark, sf, "event_id", "user_id", "ts", "value")
    return rounded(domain.pressure_anomaly_summary(df, WELL, "value"))


@query("j03_anomaly_mask", sql="""
WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS d FROM events)
SELECT event_id, abs((value - m) / d) > 3 AS is_anomaly FROM events, s""")
def j03(spark, sf):
    return domain.anomaly_mask(tele(spark, sf, "event_id", "value"), "value").select("event_id", "is_anomaly")


@query("j04_overbalance", sql=f"""
WITH {EVENTS_SQL}, f AS (SELECT value AS p, k AS a, k / 20.0 - value * 0.052 AS ob, value - lag(value) OVER ({_W}) AS g FROM tele),
s AS (SELECT avg(g) AS m, stddev_pop(g) AS d FROM f)
SELECT {r('avg(abs(p - a))')} AS mean_absolute_error, {r('max(abs(p - a))')} AS max_error, {r('sqrt(avg((p - a) * (p - a)))')} AS rmse,
 {r('avg(ob)')} AS mean_overbalance, {r('avg((ob > 0.5 AND ob < 2)::INT)')} AS overbalance_efficiency, {r('avg((ob < 0.5)::INT)')} AS underbalanced_risk,
 {r('avg((ob > 3)::INT)')} AS excessive_overbalance, {r('1 / (1 + any_value(d))')} AS pressure_stability, {r('avg((abs(g - m) < d)::INT)')} AS gradient_consistency
FROM f, s""")
def j04(spark, sf):
    df = tele(spark, sf).withColumn("mud", F.col("k") / F.lit(20.0))
    return rounded(domain.overbalance_metrics(df, WELL, "value", "k", "mud"))


@query("j05_recommendations", sql=f"""
WITH {GRADIENT_SQL.replace("value FROM events", "value * 40 AS value FROM events")},
p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY depth DESC) AS back FROM grad),
f AS (SELECT user_id, max(value * 0.052) FILTER (back = 1) AS last, avg(gradient) AS mean, max(value) AS peak, count(gradient) AS n,
  stddev_pop(gradient) FILTER (back <= 10) AS recent, stddev_pop(gradient) AS spread FROM p GROUP BY user_id)
SELECT user_id, 'mud_weight' AS type, 'HIGH' AS priority, {r('last + 1.0')} AS recommended_value FROM f WHERE last > 100.0 - 0.5
UNION ALL SELECT user_id, 'drilling_parameters', 'MEDIUM', NULL FROM f WHERE mean > 0.5
UNION ALL SELECT user_id, 'circulation', 'MEDIUM', NULL FROM f WHERE peak > 5000
UNION ALL SELECT user_id, 'alert', 'HIGH', NULL FROM f WHERE n > 10 AND recent > spread * 1.5""")
def j05(spark, sf):
    df = _depth(spark, sf).withColumn("value", F.col("value") * 40)
    out = domain.series_recommendations(df, _DEPTH, "value", "depth", mud_weight=100.0)
    return rounded(out.select("user_id", "type", "priority", "recommended_value"))


@query("j06_kick_patterns", sql=f"""
WITH q AS (SELECT quantile_cont(value, 0.95) AS t FROM events),
n AS (SELECT user_id, value, row_number() OVER ({_W}) - 1 AS pos FROM events),
tot AS (SELECT user_id, count(*) FILTER (value > t) AS total_events, count(*) FILTER (value > t) / count(*) AS event_rate, max(value) AS max_score FROM n, q GROUP BY user_id),
e AS (SELECT user_id, pos, pos - lag(pos) OVER (PARTITION BY user_id ORDER BY pos) AS gap, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS run FROM n, q WHERE value > t),
g AS (SELECT user_id, avg(gap) AS mean_interval, stddev_pop(gap) AS std_interval, min(gap) AS min_interval, max(gap) AS max_interval FROM e GROUP BY user_id),
l AS (SELECT user_id, avg(len) AS mean_duration, max(len) AS max_duration, count(*) AS total_durations FROM (SELECT user_id, run, count(*) AS len FROM e GROUP BY ALL) GROUP BY user_id)
SELECT tot.user_id, total_events, {r('event_rate')} AS event_rate, max_score, {r('mean_interval')} AS mean_interval, {r('std_interval')} AS std_interval,
  min_interval, max_interval, {r('mean_duration')} AS mean_duration, max_duration, total_durations, {r('t')} AS threshold_used
FROM tot LEFT JOIN g ON tot.user_id = g.user_id LEFT JOIN l ON tot.user_id = l.user_id, q""")
def j06(spark, sf):
    out = domain.kick_patterns(tele(spark, sf, "event_id", "user_id", "ts", "value"), WELL, "value")
    return rounded(out, 6, ["event_rate", "mean_interval", "std_interval", "mean_duration", "threshold_used"])


_LOG = """
log AS (SELECT event_id, ts, event_type, value, (value > 100)::INT AS pred, CASE WHEN event_type = 'view' THEN NULL ELSE least(value / 150, 1) END AS prob,
  CASE WHEN event_type IN ('click', 'view') THEN 'kick_detection' ELSE 'formation_pressure' END AS model_type,
  value * 60 AS prediction, 0.5 + value / 300 AS confidence FROM events)"""


def log(spark, sf):
    """A prediction log drawn from the events."""
    e = tele(spark, sf, "event_id", "ts", "event_type", "value")
    v = F.col("value")
    return e.withColumns({
        "pred": (v > 100).cast("int"),
        "prob": F.when(F.col("event_type") != "view", F.least(v / F.lit(150), F.lit(1.0))),
        "model_type": F.when(F.col("event_type").isin("click", "view"), "kick_detection").otherwise("formation_pressure"),
        "prediction": v * 60,
        "confidence": F.lit(0.5) + v / F.lit(300),
    })


_LEVEL = """CASE WHEN pred = 0 THEN CASE WHEN prob > 0.3 THEN 'MEDIUM' ELSE 'LOW' END WHEN prob IS NULL OR prob = 0 THEN 'HIGH'
  WHEN prob >= 0.8 THEN 'CRITICAL' WHEN prob >= 0.6 THEN 'HIGH' ELSE 'MEDIUM' END"""


@query("j07_alert_level", sql=f"WITH {_LOG} SELECT event_id, {_LEVEL} AS level FROM log")
def j07(spark, sf):
    return log(spark, sf).select("event_id", rules.alert_level("pred", "prob").alias("level"))


_ALERTS = f"""{_LOG}, typed AS (SELECT *, CASE WHEN confidence <> 0 AND confidence < 0.6 THEN 'LOW_CONFIDENCE'
    WHEN model_type = 'kick_detection' AND prob >= 0.7 THEN 'KICK_DETECTION'
    WHEN model_type = 'formation_pressure' AND prediction > 5000 THEN 'HIGH_PRESSURE' END AS alert_type FROM log),
alerts AS (SELECT *, CASE WHEN alert_type = 'LOW_CONFIDENCE' THEN 'MEDIUM' WHEN alert_type = 'KICK_DETECTION' AND prob >= 0.9 THEN 'CRITICAL' ELSE 'HIGH' END AS severity
  FROM typed WHERE alert_type IS NOT NULL)"""


@query("j08_alert_rules", sql=f"WITH {_ALERTS} SELECT event_id, alert_type, severity FROM alerts")
def j08(spark, sf):
    return domain.raise_alerts(log(spark, sf), kick_probability="prob").select("event_id", "alert_type", "severity")


@query("j09_alert_statistics", sql=f"""
WITH {_ALERTS} SELECT alert_type, count(*) AS alerts, {r('count(*) / sum(count(*)) OVER ()')} AS rate FROM alerts GROUP BY alert_type""")
def j09(spark, sf):
    return rounded(domain.alert_statistics(domain.raise_alerts(log(spark, sf), kick_probability="prob")))


@query("j09_recent_alerts", sql=f"WITH {_ALERTS} SELECT event_id, alert_type FROM alerts ORDER BY ts DESC, event_id DESC LIMIT 50")
def j09_recent(spark, sf):
    alerts = domain.raise_alerts(log(spark, sf), kick_probability="prob")
    return domain.recent_alerts(alerts, ["ts", "event_id"]).select("event_id", "alert_type")


@query("j10_input_validation", sql="""
SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'Champ obligatoire manquant: Depth' WHEN c_acctbal < 0 THEN 'Valeur négative non autorisée pour Depth'
  WHEN c_acctbal * 1.5 > 10000 THEN 'Profondeur trop importante (max 10000m)'
  WHEN c_nationkey / 5.0 < 0.8 OR c_nationkey / 5.0 > 3.0 THEN 'Densité de boue hors limites (0.8-3.0)' END AS problem FROM customer""")
def j10(spark, sf):
    return domain.validate_inputs(_requests(spark, sf), "formation_pressure").select("c_custkey", "problem")


def _requests(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(
        "c_custkey",
        F.when(F.col("c_nationkey") != 3, F.col("c_acctbal") * 1.5).alias("Depth"),
        (F.col("c_nationkey") / F.lit(5.0)).alias("MudWeight"),
    )


@query("j10_request_limits", sql="""
SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice > 50000 THEN 'Valeur invalide pour well_depth' WHEN l_quantity - 5 < 0 THEN 'Valeur négative non autorisée pour rop'
  WHEN l_quantity * 11 > 520 THEN NULL END AS problem FROM lineitem""")
def j10_request(spark, sf):
    li = table(spark, sf, "lineitem")
    req = li.select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("well_depth"), F.col("l_quantity").alias("wob"),
        (F.col("l_quantity") - 5).alias("rop"), F.col("l_tax").alias("torque"), F.col("l_tax").alias("standpipe_pressure"),
        F.col("l_discount").alias("hook_load"),
    )
    problem = rules.request_problem(req.columns)
    return req.select("l_orderkey", "l_linenumber", problem.alias("problem"))


_RESPONSE = """
p AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 10 AS pressure, l_quantity * 200 AS depth, l_quantity AS rop, l_extendedprice / 20 AS spp FROM lineitem),
g AS (SELECT *, pressure / depth AS gr, pressure * 0.052::DOUBLE + 0.5::DOUBLE AS mw FROM p)"""


@query("j11_formation_response", sql=f"""
WITH {_RESPONSE} SELECT l_orderkey, l_linenumber, gr AS pressure_gradient, mw AS mud_weight_recommendation,
 CASE WHEN gr / 0.433 > 1.2 THEN 'High' WHEN gr / 0.433 < 0.8 THEN 'Low' ELSE 'Normal' END AS pressure_category,
 (mw > spp * 0.052::DOUBLE / 100 + 0.5)::INT + 1 + (gr > 0.5 AND rop > 20)::INT AS advice_count,
 CASE WHEN gr > 0.6 THEN 'High pressure zone detected - consider reducing ROP and increasing circulation rate'
      WHEN gr < 0.3 THEN 'Low pressure zone - monitor for lost circulation' ELSE 'Normal pressure gradient - continue current operations' END AS gradient_advice
FROM g""")
def j11(spark, sf):
    li = table(spark, sf, "lineitem")
    df = li.select(
        "l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 10).alias("pressure"), (F.col("l_quantity") * 200).alias("well_depth"),
        F.col("l_quantity").alias("rop"), (F.col("l_extendedprice") / 20).alias("standpipe_pressure"),
    )
    out = domain.formation_responses(df, "pressure")
    gradient = F.filter("recommendations", lambda a: a.isin(rules.ADVICE_HIGH, rules.ADVICE_LOW, rules.ADVICE_NORMAL))
    return out.select(
        "l_orderkey", "l_linenumber", "pressure_gradient", "mud_weight_recommendation", "pressure_category",
        F.size("recommendations").alias("advice_count"), F.element_at(gradient, 1).alias("gradient_advice"),
    )


@query("j12_kick_response", sql=f"""
WITH {EVENTS_SQL}, s AS (SELECT event_id, (value > 60)::INT AS pred, least(greatest(value / 10.0, 0), 1) AS score, k - 50 AS balance FROM (SELECT event_id, value / 10 AS value, k FROM tele) t),
p AS (SELECT *, (score > 0.6)::INT AS kick FROM s),
l AS (SELECT *, CASE WHEN score > 0.8 THEN 'Critical' WHEN score > 0.6 THEN 'High' WHEN score > 0.4 THEN 'Medium' ELSE 'Low' END AS risk_level,
  CASE WHEN score > 0.8 THEN 'High' WHEN score > 0.6 THEN CASE WHEN kick = 1 THEN 'High' ELSE 'Medium' END WHEN score > 0.4 THEN 'Medium' ELSE 'Low' END AS confidence_level,
  concat_ws('; ', CASE WHEN abs(balance) > 10 THEN 'Monitor flow rates closely - significant imbalance detected' END,
    CASE WHEN score > 0.5 THEN 'Increase monitoring frequency - elevated anomaly score' END,
    CASE WHEN score > 0.6 THEN 'Consider stopping drilling operations for assessment' END) AS watch FROM p)
SELECT event_id, kick = 1 AS kick_detected, score AS anomaly_score, balance AS flow_balance, risk_level, confidence_level,
  CASE WHEN watch = '' THEN 'Continue normal drilling operations with standard monitoring' ELSE watch END AS monitoring,
  CASE WHEN kick = 1 THEN 8 ELSE 0 END AS emergency_steps FROM l""")
def j12(spark, sf):
    df = tele(spark, sf, "event_id", "value", "k").withColumns({"raw": F.col("value") / 10, "flow_in": F.lit(50.0)})
    df = df.withColumn("kick", (rules.kick_score("raw") > 0.6).cast("int"))
    out = domain.kick_responses(df, "kick", "raw", "flow_in", "k")
    return out.select(
        "event_id", "kick_detected", "anomaly_score", "flow_balance", "risk_level", "confidence_level",
        F.concat_ws("; ", "monitoring").alias("monitoring"),
        F.when(F.col("emergency").isNotNull(), F.size("emergency")).otherwise(0).alias("emergency_steps"),
    )


@query("j13_pressure_analytics", sql=f"""
WITH {_LOG} SELECT event_type, count(*) AS predictions, {r('avg(prediction)', 4)} AS average_pressure, min(prediction) AS min_pressure, max(prediction) AS max_pressure
FROM log WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY event_type""")
def j13(spark, sf):
    return rounded(domain.pressure_analytics(log(spark, sf), "ts", "prediction", "event_type"), 4, ["average_pressure"])


@query("j13_kick_analytics", sql=f"""
WITH {_LOG}, x AS (SELECT *, least(value / 150, 1) AS score, (event_type = 'error')::INT AS label FROM log WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY)
SELECT count(*) AS total_analyses, count(*) FILTER (pred = 1) AS kicks_detected,
 {r('count(*) FILTER (pred = 1 AND label = 0) / count(*) FILTER (label = 0)')} AS false_positive_rate, {r('avg(score)')} AS average_anomaly_score,
 count(*) FILTER (score <= 0.4) AS risk_low, count(*) FILTER (score > 0.4 AND score <= 0.6) AS risk_medium,
 count(*) FILTER (score > 0.6 AND score <= 0.8) AS risk_high, count(*) FILTER (score > 0.8) AS risk_critical FROM x""")
def j13_kick(spark, sf):
    df = log(spark, sf).withColumns({
        "score": F.least(F.col("value") / F.lit(150), F.lit(1.0)), "label": (F.col("event_type") == "error").cast("int"),
    })
    return rounded(domain.kick_analytics(df, "ts", "pred", "label", "score"))


@query("j15_service_statistics", sql=f"""
WITH {_LOG} SELECT model_type, count(*) AS predictions, {r('avg(value)')} AS mean_latency_ms, {r("avg((event_type = 'error')::INT)")} AS error_rate FROM log GROUP BY model_type""")
def j15(spark, sf):
    df = log(spark, sf).withColumn("status", F.when(F.col("event_type") == "error", "error").otherwise("success"))
    return rounded(domain.service_statistics(df, latency="value"))
