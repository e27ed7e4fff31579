"""Metric, comparison and significance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataflow.models import ensemble
from strataflow.operators import metrics, significance
from strataflow.quantiles import quantile

from .base import EVENTS_SQL, query, r, rounded, table, tele

_SQL = """
pred AS (SELECT *, l_quantity * 2000 AS p1, y * (1.0::DOUBLE - l_discount) AS p2,
   CASE WHEN y > 80000 THEN 1 ELSE 0 END AS label, CASE WHEN l_quantity > 35 THEN 1 ELSE 0 END AS k1,
   CASE WHEN y * (1.0::DOUBLE - l_discount) > 75000 THEN 1 ELSE 0 END AS k2
 FROM (SELECT l_orderkey, l_quantity, l_discount, l_extendedprice AS y FROM lineitem))"""


def pred(spark, sf):
    """Prices with two stand-in predictions and alarms."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_discount", F.col("l_extendedprice").alias("y"))
    p2 = F.col("y") * (F.lit(1.0) - F.col("l_discount"))
    return li.withColumns({
        "p1": F.col("l_quantity") * 2000, "p2": p2, "label": (F.col("y") > 80000).cast("int"),
        "k1": (F.col("l_quantity") > 35).cast("int"), "k2": (p2 > 75000).cast("int"),
    })


@query("i01_regression_metrics", sql=f"""
WITH {_SQL}, s AS (SELECT var_pop(y) * count(*) AS sst FROM pred)
SELECT {r('avg((y - p1) * (y - p1))', 2)} AS mse, {r('sqrt(avg((y - p1) * (y - p1)))', 4)} AS rmse, {r('avg(abs(y - p1))', 4)} AS mae,
 {r('1 - sum((y - p1) * (y - p1)) / any_value(sst)', 4)} AS r2, {r('avg(abs((y - p1) / y)) * 100', 4)} AS mape,
 {r('avg(abs(y - p1) / ((abs(y) + abs(p1)) / 2)) * 100', 4)} AS smape, {r('max(abs(y - p1))', 4)} AS max_error,
 {r('avg(y - p1)', 4)} AS residual_mean, {r('stddev_pop(y - p1)', 4)} AS residual_std,
 {r('skewness(y - p1) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0))', 4)} AS residual_skew,
 {r('quantile_cont(abs(y - p1), 0.5)', 4)} AS median_ae FROM pred, s""")
def i01(spark, sf):
    out = metrics.regression_metrics(pred(spark, sf), "y", "p1")
    return rounded(rounded(out, 2, ["mse"]), 4, [c for c in out.columns if c != "mse"])


@query("i02_tolerance", sql=f"""
WITH {_SQL} SELECT {", ".join(f"{r(f'avg(CAST(abs((y - p2) / greatest(y, 1e-8)) * 100 <= {p} AS INT)) * 100')} AS within_{p}_pct" for p in (5, 10, 20))} FROM pred""")
def i02(spark, sf):
    return rounded(metrics.tolerance_metrics(pred(spark, sf), "y", "p2"))


@query("i03_efficiency_score", sql=f"WITH {_SQL} SELECT {r('avg(1 / (1 + abs(y - p1) / 20.0))')} AS efficiency_score FROM pred")
def i03(spark, sf):
    return rounded(metrics.efficiency_score(pred(spark, sf), "y", "p1"))


_CLASS = f"""
{_SQL}, c AS (SELECT "class", (SELECT count(*) FROM pred WHERE label = "class" AND k1 = "class") AS tp,
  (SELECT count(*) FROM pred WHERE k1 = "class") AS predicted, (SELECT count(*) FROM pred WHERE label = "class") AS support
  FROM (SELECT DISTINCT label AS "class" FROM pred)),
rep AS (SELECT "class", tp / predicted AS precision, tp / support AS recall, support, tp FROM c),
f AS (SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM rep)"""


@query("i04_class_report", sql=f"""
WITH {_CLASS} SELECT "class", {r('precision')} AS precision, {r('recall')} AS recall, {r('f1')} AS f1, support, tp FROM f""")
def i04(spark, sf):
    return rounded(metrics.classification_report(pred(spark, sf), "label", "k1"))


@query("i04_classification_metrics", sql=f"""
WITH {_CLASS} SELECT {r('sum(tp) / sum(support)')} AS accuracy,
 {", ".join(f"{r(f'avg({m})')} AS {m}_macro, {r(f'sum({m} * support) / sum(support)')} AS {m}_weighted" for m in ('precision', 'recall', 'f1'))} FROM f""")
def i04_all(spark, sf):
    return rounded(metrics.classification_metrics(pred(spark, sf), "label", "k1"))


@query("i05_confusion", sql=f'WITH {_SQL} SELECT label, k1 AS prediction, count(*) AS "rows" FROM pred GROUP BY ALL')
def i05(spark, sf):
    return metrics.confusion(pred(spark, sf), "label", "k1")


_CONF = """conf AS (SELECT count(*) FILTER (label = 1 AND k1 = 1) AS tp, count(*) FILTER (label = 0 AND k1 = 0) AS tn,
  count(*) FILTER (label = 0 AND k1 = 1) AS fp, count(*) FILTER (label = 1 AND k1 = 0) AS fn FROM pred)"""


@query("i06_kick_metrics", sql=f"""
WITH {_SQL}, {_CONF} SELECT tp AS true_positives, tn AS true_negatives, fp AS false_positives, fn AS false_negatives,
 {r('(tp + tn) / (tp + tn + fp + fn)')} AS accuracy, {r('tp / (tp + fn)')} AS detection_rate, {r('fp / (fp + tn)')} AS false_alarm_rate,
 {r('tn / (tn + fp)')} AS specificity, {r('fn / (fn + tp)')} AS false_negative_rate, {r('tp / (tp + fp)')} AS kick_precision,
 {r('2.0 * tp / (2 * tp + fp + fn)')} AS kick_f1, fp + 5 * fn AS weighted_cost FROM conf""")
def i06(spark, sf):
    return rounded(metrics.kick_metrics(pred(spark, sf), "label", "k1"))


_CURVE = """
j AS (SELECT l.quality AS label, d.n_chars AS score FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
g AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM j GROUP BY score),
c AS (SELECT score AS threshold, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS tps, sum(n) OVER () AS fps FROM g
      WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
curve AS (SELECT threshold, fp / fps AS fpr, tp / tps AS tpr, tp / (tp + fp) AS precision, tp / tps AS recall FROM c)"""


def scored_documents(spark, sf):
    """Document length as a stand-in score of the quality label."""
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    return lab.join(d, "doc_id").select(F.col("quality").alias("label"), F.col("n_chars").alias("score"))


@query("i07_roc_curve", sql=f"WITH {_CURVE} SELECT threshold, {r('fpr')} AS fpr, {r('tpr')} AS tpr FROM curve")
def i07(spark, sf):
    return rounded(metrics.roc_curve(scored_documents(spark, sf), "label", "score"))


@query("i07_pr_curve", sql=f"WITH {_CURVE} SELECT threshold, {r('precision')} AS precision, {r('recall')} AS recall FROM curve")
def i07_pr(spark, sf):
    return rounded(metrics.pr_curve(scored_documents(spark, sf), "label", "score"))


@query("i07_roc_auc", sql=f"""
WITH {_CURVE} SELECT {r('sum(a)')} AS auc_roc FROM (SELECT (fpr - coalesce(lag(fpr) OVER w, 0)) * (tpr + coalesce(lag(tpr) OVER w, 0)) / 2 AS a
 FROM curve WINDOW w AS (ORDER BY threshold DESC))""")
def i07_auc(spark, sf):
    return rounded(metrics.roc_auc(scored_documents(spark, sf), "label", "score"))


@query("i07_pr_auc", sql=f"""
WITH {_CURVE} SELECT {r('sum(a)')} AS pr_auc FROM (SELECT (recall - coalesce(lag(recall) OVER w, 0)) * (precision + coalesce(lag(precision) OVER w, 1)) / 2 AS a
 FROM curve WINDOW w AS (ORDER BY threshold DESC))""")
def i07_pr_auc(spark, sf):
    return rounded(metrics.pr_auc(scored_documents(spark, sf), "label", "score"))


@query("i08_pressure_error", sql=f"""
WITH {_SQL} SELECT {r('sqrt(avg((y - p1) * (y - p1)))', 4)} AS rmse_psi, {r('sqrt(avg((y - p1) * (y - p1))) / (max(y) - min(y))', 4)} AS normalized_rmse,
 {r('max(y) - min(y)', 4)} AS pressure_range_psi, {r('max(abs(y - p1))', 4)} AS max_prediction_error_psi FROM pred""")
def i08(spark, sf):
    return rounded(metrics.pressure_error(pred(spark, sf), "y", "p1"), 4)


@query("i09_paired_tests", sql=f"""
WITH {_SQL}, d AS (SELECT abs(y - p1) AS e1, abs(y - p2) AS e2, abs(y - p1) - abs(y - p2) AS d FROM pred),
k AS (SELECT d, row_number() OVER (ORDER BY abs(d)) AS rk, abs(d) AS size FROM d WHERE d <> 0),
a AS (SELECT d, min(rk) OVER (PARTITION BY size) + (count(*) OVER (PARTITION BY size) - 1) / 2.0 AS rk FROM k)
SELECT (SELECT {r('least(sum(rk) FILTER (d > 0), sum(rk) FILTER (d < 0))', 1)} FROM a) AS wilcoxon_statistic,
  {r('avg(d) / (stddev_samp(d) / sqrt(count(*)))', 4)} AS ttest_statistic, {r('avg(e1)', 4)} AS model1_mean_error, {r('avg(e2)', 4)} AS model2_mean_error FROM d""")
def i09(spark, sf):
    out = significance.paired_error_tests(pred(spark, sf), "y", "p1", "p2")
    out = out.select("wilcoxon_statistic", "ttest_statistic", "model1_mean_error", "model2_mean_error")
    return rounded(rounded(out, 1, ["wilcoxon_statistic"]), 4, out.columns[1:])


@query("i10_drift", sql=f"""
WITH t AS (SELECT value AS x, (event_type = 'click')::INT AS a, (event_type = 'purchase')::INT AS b FROM events WHERE event_type IN ('click', 'purchase')),
g AS (SELECT x, sum(a) AS a, sum(b) AS b FROM t GROUP BY x),
c AS (SELECT sum(a) OVER w / sum(a) OVER () AS fa, sum(b) OVER w / sum(b) OVER () AS fb FROM g WINDOW w AS (ORDER BY x ROWS UNBOUNDED PRECEDING))
SELECT {r('max(abs(fa - fb))')} AS ks_statistic, max(abs(fa - fb)) > 0.1 AS drift_detected FROM c""")
def i10(spark, sf):
    e = tele(spark, sf, "event_type", "value")
    out = significance.drift(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), "value")
    return rounded(out.select("ks_statistic", "drift_detected"))


_METRICS = ["rmse", "mae", "r2"]
_LONG = """m AS (SELECT 'rmse' AS metric, sqrt(avg((y - p1) * (y - p1))) AS baseline, sqrt(avg((y - p2) * (y - p2))) AS "new" FROM pred
 UNION ALL SELECT 'mae', avg(abs(y - p1)), avg(abs(y - p2)) FROM pred
 UNION ALL SELECT 'r2', 1 - avg((y - p1) * (y - p1)) / var_pop(y), 1 - avg((y - p2) * (y - p2)) / var_pop(y) FROM pred)"""


def _long(spark, sf):
    wide = metrics.compare_regressors(pred(spark, sf), "y", {"p1": "p1", "p2": "p2"}).select("model", *_METRICS)
    return metrics.melt(wide, _METRICS)


@query("i11_improvement", sql=f"""
WITH {_SQL}, {_LONG} SELECT metric, {r('baseline', 4)} AS baseline, {r('"new"', 4)} AS "new",
 {r("CASE WHEN metric IN ('rmse', 'mae') THEN (baseline - new) / baseline ELSE (new - baseline) / abs(baseline) END * 100", 4)} AS improvement_pct FROM m""")
def i11(spark, sf):
    long = _long(spark, sf)
    return rounded(metrics.improvement(long.where("model = 'p1'"), long.where("model = 'p2'")), 4)


@query("i12_optimisation_score", sql=f"""
WITH {_SQL} SELECT {r('(2 * greatest(0, 100 - avg(abs((y - p2) / y)) * 100) + 1 * greatest(0, 100 - avg(abs((l_quantity - 25) / l_quantity)) * 100)) / 3')} AS optimisation_score FROM pred""")
def i12(spark, sf):
    df = pred(spark, sf).withColumn("guess", F.lit(25.0))
    return rounded(metrics.optimisation_score(df, {"pressure": ("y", "p2"), "rate": ("l_quantity", "guess")}, {"pressure": 2.0}))


_COST = """SELECT '{m}' AS model, fp * 10000 + fn * 1000000 + tp * 50000 AS total_cost, round((fp * 10000 + fn * 1000000 + tp * 50000) / n, 4) + 0.0 AS cost_per_sample,
  (tp + fn) * 1000000 - (fp * 10000 + fn * 1000000 + tp * 50000) AS savings,
  round(100.0 * ((tp + fn) * 1000000 - (fp * 10000 + fn * 1000000 + tp * 50000)) / ((tp + fn) * 1000000), 4) + 0.0 AS savings_percentage,
  tp AS true_positives, fp AS false_positives, fn AS false_negatives
 FROM (SELECT count(*) FILTER (label = 1 AND {m} = 1) AS tp, count(*) FILTER (label = 0 AND {m} = 1) AS fp, count(*) FILTER (label = 1 AND {m} = 0) AS fn, count(*) AS n FROM pred)"""


@query("i13_business_cost", sql=f"WITH {_SQL} {_COST.format(m='k1')} UNION ALL {_COST.format(m='k2')}")
def i13(spark, sf):
    return rounded(metrics.business_cost(pred(spark, sf), "label", {"k1": "k1", "k2": "k2"}), 4)


@query("i14_metric_table", sql=f"""
WITH {_SQL}, {_LONG} SELECT 'p1' AS model, {", ".join(f"{r(f'''max(baseline) FILTER (metric = '{m}')''', 4)} AS {m}" for m in _METRICS)} FROM m
UNION ALL SELECT 'p2', {", ".join(f"{r(f'''max(new) FILTER (metric = '{m}')''', 4)} AS {m}" for m in _METRICS)} FROM m""")
def i14(spark, sf):
    return rounded(metrics.metric_table(_long(spark, sf), _METRICS), 4)


@query("i15_best_model", sql=f"""
WITH {_SQL}, {_LONG} SELECT CASE WHEN baseline >= new THEN 'p1' ELSE 'p2' END AS model, {r('greatest(baseline, new)', 4)} AS value FROM m WHERE metric = 'r2'""")
def i15(spark, sf):
    wide = metrics.metric_table(_long(spark, sf), _METRICS)
    return rounded(metrics.best_model(wide, "r2"), 4)


@query("i16_residuals", sql=f"WITH {_SQL} SELECT l_orderkey, y AS actual, p1 AS predicted, y - p1 AS residual FROM pred")
def i16(spark, sf):
    return metrics.residuals(pred(spark, sf), "y", "p1", "l_orderkey")


_CMP = """SELECT '{m}' AS model, round(1 - avg((y - {m}) * (y - {m})) / var_pop(y), 4) + 0.0 AS r2, round(sqrt(avg((y - {m}) * (y - {m}))), 4) + 0.0 AS rmse,
  round(avg(abs(y - {m})), 4) + 0.0 AS mae, round(avg(abs((y - {m}) / (y + 1e-8))) * 100, 4) + 0.0 AS mape,
  round(avg((abs((y - {m}) / (y + 1e-8)) < 0.05)::INT) * 100, 4) + 0.0 AS accuracy_5pct, round(avg((abs((y - {m}) / (y + 1e-8)) < 0.1)::INT) * 100, 4) + 0.0 AS accuracy_10pct FROM pred"""


@query("h23_compare_regressors", sql=f"WITH {_SQL} {_CMP.format(m='p1')} UNION ALL {_CMP.format(m='p2')}")
def h23(spark, sf):
    return rounded(metrics.compare_regressors(pred(spark, sf), "y", {"p1": "p1", "p2": "p2"}), 4)


_DET = """SELECT '{m}' AS model, round(avg({m}), 6) + 0.0 AS anomaly_rate, round(avg((label = {m})::INT), 6) + 0.0 AS accuracy,
  round(count(*) FILTER (label = 1 AND {m} = 1) / count(*) FILTER ({m} = 1), 6) + 0.0 AS precision,
  round(count(*) FILTER (label = 1 AND {m} = 1) / count(*) FILTER (label = 1), 6) + 0.0 AS recall,
  round(2.0 * count(*) FILTER (label = 1 AND {m} = 1) / (count(*) FILTER ({m} = 1) + count(*) FILTER (label = 1)), 6) + 0.0 AS f1,
  round({s}, 4) + 0.0 AS mean_score, round({x}, 4) + 0.0 AS max_score FROM pred"""


@query("h23_compare_detectors", sql=f"""
WITH {_SQL} {_DET.format(m='k1', s='CAST(NULL AS DOUBLE)', x='CAST(NULL AS DOUBLE)')} UNION ALL {_DET.format(m='k2', s='avg(p2)', x='max(p2)')}""")
def h23_detectors(spark, sf):
    out = metrics.compare_detectors(pred(spark, sf), "label", {"k1": "k1", "k2": "k2"}, {"k2": "p2"})
    return rounded(rounded(out, 4, ["mean_score", "max_score"]), 6, ["anomaly_rate", "accuracy", "precision", "recall", "f1"])


@query("h24_validate_pressure_model", sql=f"""
WITH {_SQL}, s AS (SELECT min(p2) AS a, max(p2) AS b, min(y) AS c, max(y) AS d, count(*) FILTER (p2 < 0) AS neg,
  avg((abs((y - p2) / y) < 0.05)::INT) * 100 AS in5, avg((abs((y - p2) / y) < 0.1)::INT) * 100 AS in10,
  count(*) FILTER (p2 / l_quantity > 1.5 OR p2 / l_quantity < 0.3) AS odd FROM pred)
SELECT 'prediction_range' AS "check", CASE WHEN a < c * 0.5 OR b > d * 1.5 THEN 'warning' ELSE 'passed' END AS outcome, {r('b - a', 4)} AS value FROM s
UNION ALL SELECT 'negative_predictions', CASE WHEN neg > 0 THEN 'failed' ELSE 'passed' END, neg FROM s
UNION ALL SELECT 'accuracy_within_5pct', 'info', {r('in5', 4)} FROM s
UNION ALL SELECT 'accuracy_within_10pct', CASE WHEN in10 < 70 THEN 'failed' ELSE 'passed' END, {r('in10', 4)} FROM s
UNION ALL SELECT 'pressure_gradient', CASE WHEN odd > 0 THEN 'warning' ELSE 'passed' END, odd FROM s
UNION ALL SELECT 'overall', CASE WHEN in10 < 70 OR neg > 0 THEN 'failed' ELSE 'passed' END, (in10 >= 70 AND neg = 0)::INT FROM s""")
def h24(spark, sf):
    return rounded(metrics.validate_pressure_model(pred(spark, sf), "y", "p2", "l_quantity"), 4)


@query("h24_validate_kick_model", sql=f"""
WITH {_SQL}, {_CONF}, v AS (SELECT tp / (tp + fn) AS rec, tp / (tp + fp) AS pre FROM conf)
SELECT 'recall' AS "check", CASE WHEN rec < 0.8 THEN 'failed' ELSE 'passed' END AS outcome, {r('rec')} AS value FROM v
UNION ALL SELECT 'precision', CASE WHEN pre < 0.3 THEN 'warning' ELSE 'passed' END, {r('pre')} FROM v
UNION ALL SELECT 'overall', CASE WHEN rec < 0.8 THEN 'failed' ELSE 'passed' END, (rec >= 0.8)::INT FROM v""")
def h24_kick(spark, sf):
    return rounded(metrics.validate_kick_model(pred(spark, sf), "label", "k1"))


@query("h26_entropy_uncertainty", sql=f"""
WITH m AS (SELECT max(value) AS hi FROM events), p AS (SELECT event_id, value / hi AS p FROM events, m)
SELECT event_id, {r('-(p * log2(p + 1e-8) + (1 - p) * log2(1 - p + 1e-8))')} AS uncertainty FROM p""")
def h26(spark, sf):
    from strataflow.stats import gather

    e = tele(spark, sf, "event_id", "value")
    hi = gather(e, {"m": F.max("value")})["m"]
    return rounded(e.select("event_id", metrics.entropy_uncertainty(F.col("value") / F.lit(hi)).alias("uncertainty")))


# ---- ensembles from prediction columns -------------------------------------------------


@query("h08_regression_ensemble", sql=f"""
WITH {_SQL}, w AS (SELECT 1 / (avg(abs(y - p1)) + 1e-8) AS a, 1 / (avg(abs(y - p2)) + 1e-8) AS b FROM pred)
SELECT l_orderkey, {r('(p1 * a + p2 * b) / (a + b)', 4)} AS prediction FROM pred, w""")
def h08(spark, sf):
    df = pred(spark, sf)
    weights = ensemble.inverse_error_weights(df, "y", {"p1": "p1", "p2": "p2"})
    return rounded(ensemble.weighted_mean(df, {"p1": "p1", "p2": "p2"}, weights).select("l_orderkey", "prediction"), 4)


@query("h09_contributions", sql=f"""
WITH {_SQL} SELECT l_orderkey, 'p1' AS model, p1 AS prediction, 0.25 AS weight FROM pred UNION ALL SELECT l_orderkey, 'p2', p2, 0.75 FROM pred""")
def h09(spark, sf):
    return ensemble.contributions(pred(spark, sf), {"p1": "p1", "p2": "p2"}, {"p1": 0.25, "p2": 0.75}, ["l_orderkey"])


@query("h16_kick_vote", sql=f"WITH {_SQL} SELECT l_orderkey, CASE WHEN (k1 + k2) / 2.0 > 0.5 THEN 1 ELSE 0 END AS prediction FROM pred")
def h16(spark, sf):
    return ensemble.vote(pred(spark, sf), {"k1": "k1", "k2": "k2"}).select("l_orderkey", "prediction")


@query("h17_ensemble_score", sql=f"""
WITH {_SQL}, s AS (SELECT min(p1) AS a, max(p1) - min(p1) + 1e-8 AS b, min(p2) AS c, max(p2) - min(p2) + 1e-8 AS d FROM pred)
SELECT l_orderkey, {r('((p1 - a) / b + (p2 - c) / d) / 2')} AS score FROM pred, s""")
def h17(spark, sf):
    return rounded(ensemble.mean_score(pred(spark, sf), {"p1": "p1", "p2": "p2"}).select("l_orderkey", "score"))


@query("h18_threshold_search", sql=f"""
WITH {_SQL}, q AS (SELECT i, 50 + 49.9 * i / 99 AS pct FROM range(100) t(i)),
t AS (SELECT unnest(quantile_cont(p2, {[round((50 + 49.9 * i / 99) / 100, 12) for i in range(100)]})) AS t FROM pred),
m AS (SELECT t, (SELECT count(*) FILTER (label = 1 AND p2 > t) FROM pred) AS tp, (SELECT count(*) FILTER (p2 > t) FROM pred) AS pp,
  (SELECT count(*) FILTER (label = 1) FROM pred) AS ap FROM (SELECT DISTINCT t FROM t))
SELECT {r('t', 4)} AS threshold, {r('coalesce(tp / nullif(pp, 0), 0)')} AS precision, {r('tp / ap')} AS recall, {r('2.0 * tp / (pp + ap)')} AS f1
FROM m ORDER BY 2.0 * tp / (pp + ap) DESC, t LIMIT 1""")
def h18(spark, sf):
    out = ensemble.best_threshold(pred(spark, sf), "label", "p2", "f1")
    return rounded(rounded(out, 4, ["threshold"]), 6, ["precision", "recall", "f1"])
