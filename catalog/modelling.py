"""Model queries: each fits on the given tables and returns predictions or reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataflow.models import anomaly, ensemble, evaluate, pressure, supervised
from strataflow.operators import domain, metrics
from strataflow.operators.ordered import level_label

from .base import EVENTS_SQL, WELL, line, query, r, rounded, table, tele, workdir

_X = ["l_quantity", "l_discount", "l_tax", "p_retailprice"]
_Y = "l_extendedprice"


def priced(spark, sf):
    """Order lines with their part's list price."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax", _Y)
    parts = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    return li.join(parts, li.l_partkey == parts.p_partkey).drop("p_partkey", "l_partkey")


def flagged(spark, sf):
    """Order lines labelled as a kick where the price is above its 95 % quantile."""
    return level_label(line(spark, sf, "l_orderkey", "l_quantity", "l_discount", "l_tax", _Y), _Y)


_K = ["l_quantity", "l_discount", "l_tax", _Y]


@query("h01_pcr")
def h01(spark, sf):
    df = priced(spark, sf)
    return pressure.fit_pcr(df, _X, _Y, 3).transform(df).select("l_orderkey", "l_linenumber", _Y, "prediction")


_PCR_FULL = """
WITH d AS (SELECT l_extendedprice AS y, l_quantity AS a, l_tax AS b FROM lineitem),
m AS (SELECT avg(y) AS my, avg(a) AS ma, avg(b) AS mb, covar_pop(y, a) AS ya, covar_pop(y, b) AS yb, covar_pop(a, b) AS ab, var_pop(a) AS aa, var_pop(b) AS bb FROM d),
c AS (SELECT *, (ya * bb - yb * ab) / (aa * bb - ab * ab) AS ca, (yb * aa - ya * ab) / (aa * bb - ab * ab) AS cb FROM m)
SELECT l_orderkey, l_linenumber, round(my + ca * (l_quantity - ma) + cb * (l_tax - mb), 3) + 0.0 AS prediction FROM lineitem, c"""


@query("h01_pcr_all_components", sql=_PCR_FULL)
def h01_full(spark, sf):
    """With every component kept the regression equals least squares on the inputs."""
    df = line(spark, sf, "l_orderkey", "l_linenumber", "l_quantity", "l_tax", _Y)
    out = pressure.fit_pcr(df, ["l_quantity", "l_tax"], _Y, 2).transform(df)
    return rounded(out.select("l_orderkey", "l_linenumber", "prediction"), 3)


@query("h02_pcr_coefficients", sql="""
WITH d AS (SELECT l_extendedprice AS y, l_quantity AS a, l_tax AS b FROM lineitem),
m AS (SELECT covar_pop(y, a) AS ya, covar_pop(y, b) AS yb, covar_pop(a, b) AS ab, var_pop(a) AS aa, var_pop(b) AS bb FROM d)
SELECT 'l_quantity' AS feature, round((ya * bb - yb * ab) / (aa * bb - ab * ab), 3) + 0.0 AS coefficient FROM m
UNION ALL SELECT 'l_tax', round((yb * aa - ya * ab) / (aa * bb - ab * ab), 3) + 0.0 FROM m""")
def h02(spark, sf):
    df = line(spark, sf, "l_quantity", "l_tax", _Y)
    return rounded(pressure.fit_pcr(df, ["l_quantity", "l_tax"], _Y, 2).coefficient_table(spark), 3)


@query("h02_pcr_loadings")
def h02_loadings(spark, sf):
    return pressure.fit_pcr(priced(spark, sf), _X, _Y, 3).loading_table(spark)


@query("h02_explained_variance", sql="""
WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem)
SELECT 'PC1' AS component, round((1 + abs(r)) / 2, 6) + 0.0 AS explained, round((1 + abs(r)) / 2, 6) + 0.0 AS cumulative FROM c
UNION ALL SELECT 'PC2', round((1 - abs(r)) / 2, 6) + 0.0, 1.0 FROM c""")
def h02_variance(spark, sf):
    return rounded(pressure.explained_variance(line(spark, sf, "l_quantity", _Y), ["l_quantity", _Y], 2))


@query("h03_ols", sql=f"""
WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem)
SELECT l_orderkey, l_linenumber, {r('i + s * l_quantity', 3)} AS prediction FROM lineitem, f""")
def h03(spark, sf):
    df = line(spark, sf, "l_orderkey", "l_linenumber", "l_quantity", _Y)
    out = supervised.fit_regressor(df, ["l_quantity"], _Y, "linear").transform(df)
    return rounded(out.select("l_orderkey", "l_linenumber", "prediction"), 3)


@query("h03_ridge", sql=f"""
WITH f AS (SELECT covar_pop(l_extendedprice, l_quantity) * count(*) / (var_pop(l_quantity) * count(*) + 1.0) AS s, avg(l_extendedprice) AS my, avg(l_quantity) AS mx FROM lineitem)
SELECT l_orderkey, l_linenumber, {r('my + s * (l_quantity - mx)', 2)} AS prediction FROM lineitem, f""")
def h03_ridge(spark, sf):
    df = line(spark, sf, "l_orderkey", "l_linenumber", "l_quantity", _Y)
    out = supervised.fit_regressor(df, ["l_quantity"], _Y, "ridge").transform(df)
    return rounded(out.select("l_orderkey", "l_linenumber", "prediction"), 2)


@query("h03_lasso", sql=f"""
WITH f AS (SELECT sign(covar_pop(l_extendedprice, l_quantity)) * greatest(abs(covar_pop(l_extendedprice, l_quantity)) - 1.0, 0) / var_pop(l_quantity) AS s,
  avg(l_extendedprice) AS my, avg(l_quantity) AS mx FROM lineitem)
SELECT l_orderkey, l_linenumber, {r('my + s * (l_quantity - mx)', 2)} AS prediction FROM lineitem, f""")
def h03_lasso(spark, sf):
    df = line(spark, sf, "l_orderkey", "l_linenumber", "l_quantity", _Y)
    out = supervised.fit_regressor(df, ["l_quantity"], _Y, "lasso").transform(df)
    return rounded(out.select("l_orderkey", "l_linenumber", "prediction"), 2)


def _regression(kind, **params):
    def run(spark, sf):
        df = priced(spark, sf)
        return supervised.fit_regressor(df, _X, _Y, kind, **params).transform(df).select("l_orderkey", "l_linenumber", _Y, "prediction")

    return run


def _classification(kind, **params):
    def run(spark, sf):
        df = flagged(spark, sf)
        model = supervised.fit_classifier(df, _K, "Kick", kind, **params)
        return metrics.kick_metrics(model.transform(df), "Kick", "prediction")

    return run


query("h04_tree_regressor")(_regression("decision_tree"))
query("h04_tree_classifier")(_classification("decision_tree"))
query("h05_forest_regressor")(_regression("random_forest", numTrees=20, maxDepth=6))
query("h05_forest_classifier")(_classification("random_forest", numTrees=20, maxDepth=6))
query("h06_boosted_regressor")(_regression("gradient_boosting", maxIter=10, maxDepth=4))
query("h06_boosted_classifier")(_classification("gradient_boosting", maxIter=10, maxDepth=4))
query("h14_logistic")(_classification("logistic"))
query("h15_linear_svc")(_classification("svc"))


@query("h07_pls")
def h07(spark, sf):
    df = priced(spark, sf)
    return pressure.fit_pls(df, _X, _Y, 2).transform(df).select("l_orderkey", "l_linenumber", _Y, "prediction")


@query("h07_pls_all_components", sql=_PCR_FULL)
def h07_full(spark, sf):
    """With every component kept the regression equals least squares on the inputs."""
    df = line(spark, sf, "l_orderkey", "l_linenumber", "l_quantity", "l_tax", _Y)
    out = pressure.fit_pls(df, ["l_quantity", "l_tax"], _Y, 2).transform(df)
    return rounded(out.select("l_orderkey", "l_linenumber", "prediction"), 3)


@query("h08_fitted_ensemble")
def h08(spark, sf):
    df = priced(spark, sf)
    members = {
        "pcr": lambda t: pressure.fit_pcr(t, _X, _Y, 3), "pls": lambda t: pressure.fit_pls(t, _X, _Y, 2),
        "tree": lambda t: supervised.fit_regressor(t, _X, _Y, "decision_tree"),
    }
    fitted = ensemble.fit_weighted(df, members, _Y, ["l_orderkey", "l_linenumber"])
    return fitted.transform(df).select("l_orderkey", "l_linenumber", *members, "prediction")


_FOLDED = """
WITH d AS (SELECT l_extendedprice::DOUBLE AS y, l_quantity::DOUBLE AS a, l_tax::DOUBLE AS b,
  (('0x' || substr(md5(l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey), 1, 13))::BIGINT % 5) AS fold FROM lineitem),
f AS (SELECT g.i AS fold, regr_slope(y, a) AS sa, regr_intercept(y, a) AS ia, regr_slope(y, b) AS sb, regr_intercept(y, b) AS ib
  FROM d JOIN range(5) g(i) ON d.fold <> g.i GROUP BY g.i),
e AS (SELECT d.fold, y, ia + sa * a AS quantity, ib + sb * b AS tax FROM d JOIN f USING (fold))"""


def _folded(spark, sf):
    """Two one-input regressions, whose fits have a closed form in each fold."""
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_tax", _Y)])
    fitters = {"quantity": lambda t: pressure.fit_pls(t, ["l_quantity"], _Y, 1), "tax": lambda t: pressure.fit_pls(t, ["l_tax"], _Y, 1)}
    return df, fitters, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("h08_out_of_fold_weights", sql=f"""{_FOLDED},
w AS (SELECT 1 / (avg(abs(y - quantity)) + 1e-8) AS q, 1 / (avg(abs(y - tax)) + 1e-8) AS t FROM e)
SELECT 'quantity' AS model, {r('q / (q + t)', 6)} AS weight FROM w UNION ALL SELECT 'tax', {r('t / (q + t)', 6)} FROM w""")
def h08_weights(spark, sf):
    df, fitters, keys = _folded(spark, sf)
    weights = ensemble.fit_weighted(df, fitters, _Y, keys).weights
    cells = [F.struct(F.lit(m).alias("model"), F.lit(round(w, 6)).alias("weight")) for m, w in weights.items()]
    return spark.range(1).select(F.inline(F.array(*cells)))


@query("h20_compare_by_folds", sql=f"""{_FOLDED},
s AS (SELECT fold, sqrt(avg((y - quantity) * (y - quantity))) AS quantity, sqrt(avg((y - tax) * (y - tax))) AS tax FROM e GROUP BY fold),
u AS (UNPIVOT s ON quantity, tax INTO NAME model VALUE v)
SELECT model, {r('avg(v)', 4)} AS mean_score, {r('stddev_pop(v)', 4)} AS std_score, {r('min(v)', 4)} AS min_score, {r('max(v)', 4)} AS max_score FROM u GROUP BY model""")
def h20_folds(spark, sf):
    df, fitters, keys = _folded(spark, sf)
    return rounded(evaluate.compare_by_folds(df, fitters, _Y, keys), 4)


@query("h20_compare_classifiers")
def h20_classifiers(spark, sf):
    df = flagged(spark, sf).withColumn("_row", F.concat_ws("|", "l_orderkey", *_K))
    fitters = {
        "logistic": lambda t: supervised.fit_classifier(t, _K[:3], "Kick", "logistic"),
        "decision_tree": lambda t: supervised.fit_classifier(t, _K[:3], "Kick", "decision_tree"),
        "pca": lambda t: anomaly.fit_pca_detector(t, _K, "Kick"),
    }
    return evaluate.compare_by_folds(df, fitters, "Kick", ["_row"], metric="f1")


@query("h19_search_pcr", sql=f"""{_FOLDED},
s AS (SELECT fold, sqrt(avg((y - quantity) * (y - quantity))) AS quantity, sqrt(avg((y - tax) * (y - tax))) AS tax FROM e GROUP BY fold)
SELECT 0 AS trial, 'feature=l_quantity' AS parameters, 2 AS folds, {r('avg(quantity)', 4)} AS rmse FROM s WHERE fold < 2
UNION ALL SELECT 1, 'feature=l_tax', 1, {r('avg(tax)', 4)} FROM s WHERE fold < 1""")
def h19_trials(spark, sf):
    df, _, keys = _folded(spark, sf)
    fitter = lambda t, feature: pressure.fit_pcr(t, [feature], _Y, 1)
    return rounded(evaluate.search_trials(df, fitter, [{"feature": "l_quantity"}, {"feature": "l_tax"}], _Y, keys)[1], 4)


_SPE = """
WITH n AS (SELECT * FROM lineitem WHERE l_extendedprice <= (SELECT quantile_cont(l_extendedprice, 0.95) FROM lineitem)),
s AS (SELECT avg(l_quantity) AS ma, stddev_pop(l_quantity) AS sa, avg(l_extendedprice) AS mb, stddev_pop(l_extendedprice) AS sb,
  sign(corr(l_quantity, l_extendedprice)) AS g FROM n),
e AS (SELECT ((l_quantity - ma) / sa - g * (l_extendedprice - mb) / sb) * ((l_quantity - ma) / sa - g * (l_extendedprice - mb) / sb) / 2 AS spe FROM n, s),
t AS (SELECT quantile_cont(spe, 0.99) AS t FROM e),
z AS (SELECT l_orderkey, l_linenumber, (l_quantity - ma) / sa AS a, (l_extendedprice - mb) / sb AS b, g FROM lineitem, s)"""


def _two_inputs(spark, sf):
    """Two inputs and one component, where the reconstruction has a closed form."""
    full = level_label(line(spark, sf, "l_orderkey", "l_linenumber", "l_quantity", _Y), _Y)
    return full, anomaly.fit_pca_detector(full, ["l_quantity", _Y], "Kick", variance=0.4, percentile=99.0)


@query("h10_pca_detector_error", sql=f"""{_SPE}
SELECT l_orderkey, l_linenumber, round((a - g * b) * (a - g * b) / 2, 4) + 0.0 AS spe, ((a - g * b) * (a - g * b) / 2 > t)::INT AS prediction FROM z, t""")
def h10_spe(spark, sf):
    full, model = _two_inputs(spark, sf)
    return rounded(model.transform(full).select("l_orderkey", "l_linenumber", "spe", "prediction"), 4)


@query("h10_pca_detector")
def h10(spark, sf):
    df = flagged(spark, sf)
    return anomaly.fit_pca_detector(df, _K, "Kick").transform(df).select("l_orderkey", "Kick", "spe", "prediction")


@query("h11_pca_contributions", sql=f"""{_SPE}
SELECT l_orderkey, l_linenumber, round((a - g * b) * (a - g * b) / 4, 4) + 0.0 AS l_quantity_contribution,
  round((a - g * b) * (a - g * b) / 4, 4) + 0.0 AS l_extendedprice_contribution FROM z""")
def h11(spark, sf):
    full, model = _two_inputs(spark, sf)
    return rounded(model.contributions(full, ["l_orderkey", "l_linenumber"]), 4)


@query("h12_isolation_forest")
def h12(spark, sf):
    df = flagged(spark, sf)
    return anomaly.fit_isolation_forest(df, _K).transform(df).select("l_orderkey", "Kick", "score", "prediction")


@query("h13_one_class")
def h13(spark, sf):
    df = flagged(spark, sf)
    return anomaly.fit_one_class(df, _K).transform(df).select("l_orderkey", "Kick", "score", "prediction")


@query("h16_fitted_kick_ensemble")
def h16(spark, sf):
    df = flagged(spark, sf)
    pca = anomaly.fit_pca_detector(df, _K, "Kick")
    forest = anomaly.fit_isolation_forest(df, _K)
    scored = forest.transform(pca.transform(df, "pca", "pca_score"), "forest", "forest_score")
    voted = ensemble.vote(scored, {"pca": "pca", "forest": "forest"})
    return ensemble.mean_score(voted, {"pca": "pca_score", "forest": "forest_score"}).select("l_orderkey", "Kick", "prediction", "score")


@query("h19_grid_search")
def h19(spark, sf):
    grid = {"maxDepth": [3, 5], "minInstancesPerNode": [1, 20]}
    return evaluate.grid_search(priced(spark, sf), _X, _Y, "decision_tree", grid)[1]


@query("h19_random_search")
def h19_random(spark, sf):
    return evaluate.random_search(priced(spark, sf), _X, _Y, "random_forest")[1]


@query("h20_cross_validation")
def h20(spark, sf):
    return evaluate.cross_validate(priced(spark, sf), _X, _Y, ["linear", "decision_tree"], ["l_orderkey", "l_linenumber"])


@query("h20_time_series_scores", sql=f"""
WITH {EVENTS_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p, count(*) OVER (PARTITION BY user_id) AS n FROM tele),
d AS (SELECT k, value, CASE WHEN p < n - 5 * (n // 6) THEN 0 ELSE (p - (n - 5 * (n // 6))) // (n // 6) + 1 END AS fold FROM x),
f AS (SELECT g.i AS fold, regr_slope(value, k) AS s, regr_intercept(value, k) AS b FROM d JOIN range(1, 6) g(i) ON d.fold < g.i GROUP BY g.i),
e AS (SELECT d.fold, value, value - (b + s * k) AS e FROM d JOIN f ON d.fold = f.fold)
SELECT fold::INT AS fold, {r('1 - avg(e * e) / var_pop(value)', 5)} AS r2, {r('sqrt(avg(e * e))', 5)} AS rmse FROM e GROUP BY fold""")
def h20_time(spark, sf):
    df = tele(spark, sf, "event_id", "user_id", "ts", "value", "k")
    return rounded(evaluate.time_series_scores(df, WELL, "value", lambda t: pressure.fit_pls(t, ["k"], "value", 1), 5), 5)


@query("h21_permutation_importance")
def h21(spark, sf):
    df = priced(spark, sf)
    model = supervised.fit_regressor(df, _X, _Y, "decision_tree")
    return evaluate.permutation_importance(df, model, _Y, ["l_orderkey", "l_linenumber", _Y])


@query("h22_model_importance")
def h22(spark, sf):
    return supervised.fit_regressor(priced(spark, sf), _X, _Y, "decision_tree").importance_table(spark, 3)


@query("h25_save_and_load", sql=_PCR_FULL)
def h25(spark, sf):
    df = line(spark, sf, "l_orderkey", "l_linenumber", "l_quantity", "l_tax", _Y)
    path = f"{workdir(spark)}/pressure-model"
    pressure.fit_pcr(df, ["l_quantity", "l_tax"], _Y, 2).save(path, spark, source="lineitem")
    out = pressure.LinearModel.load(path, spark).transform(df)
    return rounded(out.select("l_orderkey", "l_linenumber", "prediction"), 3)


@query("h26_noise_confidence")
def h26(spark, sf):
    df = priced(spark, sf)
    model = pressure.fit_pcr(df, _X, _Y, 3)
    return evaluate.noise_confidence(df, model).select("l_orderkey", "l_linenumber", "confidence")


@query("h27_robustness")
def h27(spark, sf):
    df = priced(spark, sf)
    return evaluate.robustness(df, pressure.fit_pcr(df, _X, _Y, 3), _Y)


@query("h28_fit_evaluate", sql=f"""
WITH {EVENTS_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p, count(*) OVER (PARTITION BY user_id) AS n FROM tele),
d AS (SELECT CASE WHEN p < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'val' END AS split, k, value FROM x),
f AS (SELECT regr_slope(value, k) AS s, regr_intercept(value, k) AS i FROM d WHERE split = 'train'),
e AS (SELECT split, value, value - (i + s * k) AS e FROM d, f),
m AS (SELECT split, 1 - avg(e * e) / var_pop(value) AS r2, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae FROM e GROUP BY split)
SELECT split || '_r2' AS metric, {r('r2', 5)} AS value FROM m UNION ALL SELECT split || '_rmse', {r('rmse', 5)} FROM m UNION ALL SELECT split || '_mae', {r('mae', 5)} FROM m""")
def h28(spark, sf):
    df = tele(spark, sf, "event_id", "user_id", "ts", "value", "k")
    return rounded(evaluate.fit_evaluate(df, WELL, "value", lambda t: supervised.fit_regressor(t, ["k"], "value", "linear"))[1], 5)


@query("j14_bulk_predict", sql="""
WITH x AS (SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN NULL ELSE c_acctbal * 1.5 END AS Depth, c_nationkey / 5.0 AS MudWeight FROM customer),
s AS (SELECT *, coalesce(Depth >= 0 AND Depth <= 10000 AND MudWeight >= 0.8 AND MudWeight <= 3.0, false) AS ok FROM x)
SELECT count(*) AS total, count(*) FILTER (ok) AS successes, count(*) FILTER (NOT ok) AS errors FROM s""")
def j14(spark, sf):
    c = table(spark, sf, "customer")
    df = c.select(
        "c_custkey", F.when(F.col("c_nationkey") != 3, F.col("c_acctbal") * 1.5).alias("Depth"),
        (F.col("c_nationkey") / F.lit(5.0)).alias("MudWeight"),
    )
    model = pressure.fit_pcr(df.withColumn("p", F.col("Depth") * 0.4), ["Depth", "MudWeight"], "p", 2)
    return domain.bulk_totals(domain.bulk_predict(df, "formation_pressure", model))


@query("m04_user_model", sql=f"""
WITH g AS (SELECT l_returnflag, avg(l_extendedprice) AS p FROM lineitem GROUP BY l_returnflag)
SELECT {r('sqrt(avg((l_extendedprice - p) ** 2))', 3)} AS rmse, {r('avg(abs(l_extendedprice - p))', 3)} AS mae FROM lineitem JOIN g USING (l_returnflag)""")
def m04(spark, sf):
    """A model of the user's own, the mean of each group, offered by name like the built ones."""

    class GroupMean:
        def __init__(self, means, group):
            self.means, self.group = means, group

        def transform(self, df):
            return df.join(F.broadcast(self.means), self.group)  # a row per group

    def fit(df, features, target):
        return GroupMean(df.groupBy(*features).agg(F.avg(target).alias("prediction")), list(features))

    if "group_mean" not in evaluate.registry()["formation_pressure"]:
        evaluate.register("formation_pressure", "group_mean", fit)
    df = line(spark, sf, "l_extendedprice", "l_returnflag")
    model = evaluate.fit("formation_pressure", "group_mean", df, ["l_returnflag"], "l_extendedprice")
    return rounded(evaluate.evaluate(model.transform(df), "l_extendedprice").select("rmse", "mae"), 3)
