"""Cleaning, filtering, imputation and scaling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataflow.operators import clean, impute, scale
from strataflow.series import Series

from .base import (
    EVENTS_SQL, GAPS_SQL, NUMBERS, each, gaps, line, query, r, rounded, table, tele,
)


@query("b01_drop_empty_rows", sql=f"""
WITH {GAPS_SQL}, e AS (SELECT qty, CASE WHEN qty IS NULL THEN NULL ELSE flag END AS flag FROM gaps)
SELECT qty, flag FROM e WHERE NOT (qty IS NULL AND flag IS NULL)""")
def b01(spark, sf):
    df = gaps(spark, sf).select("qty", F.when(F.col("qty").isNotNull(), F.col("flag")).alias("flag"))
    return clean.drop_empty_rows(df)


@query("b02_tidy_names", sql="SELECT o_orderkey AS Order_Key, o_totalprice AS Total_Price FROM orders")
def b02(spark, sf):
    df = table(spark, sf, "orders").select(F.col("o_orderkey").alias(" Order Key"), F.col("o_totalprice").alias("Total Price "))
    return clean.tidy_names(df)


@query("b03_coerce_numeric_text", sql="""
SELECT c_custkey, c_acctbal AS balance_text, c_mktsegment AS segment_text FROM customer""")
def b03(spark, sf):
    df = table(spark, sf, "customer").select(
        "c_custkey", F.col("c_acctbal").cast("string").alias("balance_text"), F.col("c_mktsegment").alias("segment_text")
    )
    return clean.coerce_numeric_text(df)


@query("b04_drop_duplicates", sql="SELECT DISTINCT l_quantity, l_discount, l_tax, l_returnflag FROM lineitem")
def b04(spark, sf):
    return clean.drop_duplicate_rows(line(spark, sf, "l_quantity", "l_discount", "l_tax", "l_returnflag"))


@query("b05_parse_timestamps", sql="SELECT o_orderkey, epoch_us(o_orderdate) AS micros FROM orders")
def b05(spark, sf):
    text = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy HH:mm:ss").alias("stamp"))
    parsed = clean.parse_timestamps(text, "stamp")
    return parsed.select("o_orderkey", F.unix_micros("stamp").alias("micros"))


@query("b06_drop_constant_columns", sql="SELECT l_quantity, l_tax FROM lineitem")
def b06(spark, sf):
    df = line(spark, sf, "l_quantity", "l_tax").withColumns({"unit": F.lit(1.0), "none": F.lit(None).cast("double")})
    return clean.drop_constant_columns(df, ["l_quantity", "l_tax", "unit"]).drop("none")


@query("b07_iqr_filter", sql="""
WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT event_id, value FROM events, b
WHERE value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1)""")
def b07(spark, sf):
    return clean.remove_iqr_outliers(tele(spark, sf, "event_id", "value"), ["value"])


@query("b08_zscore_filter", sql="""
WITH s AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS d FROM customer)
SELECT c_custkey, c_acctbal FROM customer, s WHERE abs((c_acctbal - m) / d) <= 1.5""")
def b08(spark, sf):
    return clean.remove_zscore_outliers(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], 1.5)


@query("b09_stepwise_sigma_filter", sql=f"""
WITH {EVENTS_SQL}, s1 AS (SELECT avg(value) AS m, stddev_samp(value) AS d FROM tele),
f1 AS (SELECT event_id, value, k FROM tele, s1 WHERE value BETWEEN m - 3 * d AND m + 3 * d),
s2 AS (SELECT avg(k) AS m, stddev_samp(k) AS d FROM f1)
SELECT event_id, value, k FROM f1, s2 WHERE k BETWEEN m - 3 * d AND m + 3 * d""")
def b09(spark, sf):
    return clean.remove_sigma_outliers_stepwise(tele(spark, sf, "event_id", "value", "k"), ["value", "k"])


@query("b10_winsorise", sql=f"""
WITH {EVENTS_SQL}, q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM tele)
SELECT event_id, {r('least(greatest(value, a - 1.5 * (b - a)), b + 1.5 * (b - a))')} AS value FROM tele, q""")
def b10(spark, sf):
    return rounded(clean.winsorise_iqr(tele(spark, sf, "event_id", "value"), ["value"]))


_REPORT = "SELECT '{c}' AS \"column\", quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM tele"


@query("b10_outlier_report", sql=f"""
WITH {EVENTS_SQL}, q AS ({each(_REPORT, ['value', 'k'], ' UNION ALL ')}),
w AS (SELECT "column", a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi FROM q),
v AS (SELECT 'value' AS "column", value AS x FROM tele UNION ALL SELECT 'k', k FROM tele)
SELECT w."column", count(*) FILTER (x < lo OR x > hi) AS outliers,
  {r('100.0 * count(*) FILTER (x < lo OR x > hi) / count(*)')} AS percentage,
  {r('any_value(lo)')} AS lower, {r('any_value(hi)')} AS upper
FROM v JOIN w ON v."column" = w."column" GROUP BY w."column" """)
def b10_report(spark, sf):
    return rounded(clean.outlier_report(tele(spark, sf, "value", "k")))


@query("b11_find_outliers", sql="""
WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT event_id FROM events, b WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""")
def b11(spark, sf):
    return clean.find_outliers(tele(spark, sf, "event_id", "value"), ["value"]).select("event_id")


@query("b11_cap_percentiles", sql=f"""
WITH b AS (SELECT quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM events)
SELECT event_id, {r('least(greatest(value, lo), hi)')} AS value FROM events, b""")
def b11_cap(spark, sf):
    return rounded(clean.cap_at_percentiles(tele(spark, sf, "event_id", "value"), ["value"]))


@query("b12_fill_infinite_with_mean", sql=f"""
WITH x AS (SELECT l_orderkey, CASE WHEN l_discount = 0 THEN NULL ELSE l_tax / l_discount END AS ratio FROM lineitem)
SELECT l_orderkey, {r('coalesce(ratio, (SELECT avg(ratio) FROM x))')} AS ratio FROM x""")
def b12(spark, sf):
    li = line(spark, sf, "l_orderkey", "l_tax", "l_discount")
    ratio = F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.col("l_tax"), F.col("l_discount")))
    return rounded(impute.fill_with_means(li.select("l_orderkey", ratio.alias("ratio")), ["ratio"]))


@query("b13_zero_fill", sql="""
SELECT l_orderkey, CASE WHEN l_discount = 0 THEN 0.0 ELSE l_tax / l_discount END AS ratio,
  CASE WHEN l_linenumber = 1 THEN 0.0 ELSE l_quantity END AS qty FROM lineitem""")
def b13(spark, sf):
    li = line(spark, sf, "l_orderkey", "l_tax", "l_discount", "l_quantity", "l_linenumber")
    ratio = F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.col("l_tax"), F.col("l_discount")))
    df = li.select("l_orderkey", ratio.alias("ratio"), F.when(F.col("l_linenumber") != 1, F.col("l_quantity")).alias("qty"))
    return clean.zero_fill(df, ["ratio", "qty"])


_FILL = {"mean": "avg({c})", "median": "quantile_cont({c}, 0.5)"}
for _kind, _agg in _FILL.items():
    @query(f"b14_impute_{_kind}", sql=f"""
    WITH {GAPS_SQL}
    SELECT l_orderkey, {r(f"coalesce(qty, (SELECT {_agg.format(c='qty')} FROM gaps))")} AS qty,
      {r(f"coalesce(price, (SELECT {_agg.format(c='price')} FROM gaps))")} AS price FROM gaps""")
    def b14(spark, sf, kind=_kind):
        return rounded(impute.impute_numeric(gaps(spark, sf).drop("flag"), kind, ["qty", "price"]))


@query("b14_impute_most_frequent", sql=f"""
WITH {GAPS_SQL}, m AS (SELECT qty FROM gaps WHERE qty IS NOT NULL GROUP BY qty ORDER BY count(*) DESC, qty LIMIT 1)
SELECT l_orderkey, coalesce(qty, (SELECT qty FROM m)) AS qty FROM gaps""")
def b14_mode(spark, sf):
    return impute.impute_numeric(gaps(spark, sf).select("l_orderkey", "qty"), "most_frequent", ["qty"])


@query("b15_impute_categorical", sql=f"""
WITH {GAPS_SQL}, m AS (SELECT flag FROM gaps WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1)
SELECT l_orderkey, coalesce(flag, (SELECT flag FROM m)) AS flag FROM gaps""")
def b15(spark, sf):
    return impute.impute_categorical(gaps(spark, sf).select("l_orderkey", "flag"))


@query("b16_knn_impute", sql=f"""
WITH p AS (SELECT s_suppkey, CASE WHEN s_nationkey < 5 THEN NULL ELSE s_acctbal END AS a,
             CASE WHEN s_nationkey > 20 THEN NULL ELSE CAST(s_suppkey AS DOUBLE) END AS b FROM supplier),
pairs AS (
  SELECT x.s_suppkey, y.a AS da, y.b AS db, x.a AS xa, x.b AS xb,
    row_number() OVER (PARTITION BY x.s_suppkey ORDER BY
      CASE WHEN x.a IS NULL THEN (x.b - y.b) * (x.b - y.b) * 2 ELSE (x.a - y.a) * (x.a - y.a) * 2 END,
      CASE WHEN x.a IS NULL THEN y.a ELSE y.b END) AS rn
  FROM p x JOIN p y ON (x.a IS NULL AND y.a IS NOT NULL AND y.b IS NOT NULL)
                    OR (x.b IS NULL AND y.b IS NOT NULL AND y.a IS NOT NULL)),
best AS (SELECT s_suppkey, avg(da) AS fa, avg(db) AS fb FROM pairs WHERE rn <= 5 GROUP BY s_suppkey)
SELECT p.s_suppkey, {r('coalesce(p.a, fa)')} AS a, {r('coalesce(p.b, fb)')} AS b
FROM p LEFT JOIN best ON p.s_suppkey = best.s_suppkey""")
def b16(spark, sf):
    s = table(spark, sf, "supplier")
    df = s.select(
        "s_suppkey",
        F.when(F.col("s_nationkey") >= 5, F.col("s_acctbal")).alias("a"),
        F.when(F.col("s_nationkey") <= 20, F.col("s_suppkey").cast("double")).alias("b"),
    )
    return rounded(impute.impute_knn(df, ["a", "b"]))


@query("b17_forward_fill", sql=f"""
WITH {EVENTS_SQL}, g AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value FROM tele)
SELECT event_id, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM g""")
def b17(spark, sf):
    df = tele(spark, sf, "event_id", "user_id", "ts", "event_type", "value")
    df = df.withColumn("value", F.when(F.col("event_type") != "error", F.col("value"))).drop("event_type")
    return clean.forward_fill(df, Series("user_id", ("ts", "event_id")), ["value"]).select("event_id", "value")


@query("b18_fill_from_training", sql=f"""
WITH g AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_totalprice END AS price FROM orders)
SELECT o_orderkey, {r("coalesce(price, (SELECT avg(price) FROM g WHERE o_orderstatus = 'F'))")} AS price
FROM g WHERE o_orderstatus <> 'F'""")
def b18(spark, sf):
    df = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderstatus", F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_totalprice")).alias("price")
    )
    train, rest = df.where("o_orderstatus = 'F'"), df.where("o_orderstatus <> 'F'")
    return rounded(impute.fill_from_training(train, rest, columns=["price"])[1].select("o_orderkey", "price"))


@query("b19_require_columns", sql="SELECT l_tax, l_quantity FROM lineitem")
def b19(spark, sf):
    return clean.require_columns(table(spark, sf, "lineitem"), ["l_tax", "l_quantity"])


@query("b20_fill_defaults", sql="""
SELECT p_partkey, CASE WHEN p_size > 40 THEN 1000.0 ELSE CAST(p_size AS DOUBLE) END AS Depth,
  1.2::DOUBLE AS MudWeight, 25.0::DOUBLE AS Temperature, 0.15::DOUBLE AS Porosity, 100.0::DOUBLE AS Permeability FROM part""")
def b20(spark, sf):
    from strataflow.channels import PRESSURE_DEFAULTS

    df = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") <= 40, F.col("p_size")).alias("Depth"))
    return clean.fill_defaults(df, PRESSURE_DEFAULTS)


@query("c01_standard_scale", sql=f"""
WITH s AS (SELECT {each('avg({c}) AS m_{c}, stddev_pop({c}) AS d_{c}', NUMBERS)} FROM lineitem)
SELECT {each('round(({c} - m_{c}) / d_{c}, 6) + 0.0 AS {c}', NUMBERS)} FROM lineitem, s""")
def c01(spark, sf):
    return rounded(scale.scale(line(spark, sf, *NUMBERS), "standard"))


@query("c02_minmax_scale", sql=f"""
WITH s AS (SELECT {each('min({c}) AS m_{c}, max({c}) - min({c}) AS d_{c}', NUMBERS)} FROM lineitem)
SELECT {each('round(({c} - m_{c}) / d_{c}, 6) + 0.0 AS {c}', NUMBERS)}, 0.0 AS unit FROM lineitem, s""")
def c02(spark, sf):
    return rounded(scale.scale(line(spark, sf, *NUMBERS).withColumn("unit", F.lit(3.0)), "minmax"))


@query("c03_robust_scale", sql=f"""
WITH s AS (SELECT {each('quantile_cont({c}, 0.5) AS m_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS d_{c}', NUMBERS)} FROM lineitem)
SELECT {each('round(({c} - m_{c}) / d_{c}, 6) + 0.0 AS {c}', NUMBERS)} FROM lineitem, s""")
def c03(spark, sf):
    return rounded(scale.scale(line(spark, sf, *NUMBERS), "robust"))


@query("c04_log1p_positive", sql=f"""
SELECT {r('ln(1 + l_quantity)')} AS l_quantity, l_discount FROM lineitem""")
def c04(spark, sf):
    return rounded(scale.log1p_positive(line(spark, sf, "l_quantity", "l_discount")), only=["l_quantity"])


@query("c05_unit_range", sql=f"""
WITH s AS (SELECT min(value) AS lo, max(value) AS hi FROM events)
SELECT event_id, {r('(value - lo) / (hi - lo + 1e-8)')} AS score FROM events, s""")
def c05(spark, sf):
    return rounded(scale.unit_range(tele(spark, sf, "event_id", "value"), {"value": "score"}).select("event_id", "score"))
