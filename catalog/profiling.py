"""Profile, quality, correlation, selection and split queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from strataflow.operators import profile, quality, select, split
from strataflow.stats import literal_table

from .base import (
    EVENTS_SQL, GAPS_SQL, NUMBERS, WELL, drill, CHANNELS_SQL, each, gaps, line, query, r, rounded, table, tele,
)

_SUMMARY = """SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) + 0.0 AS mean, round(stddev_samp({c}), 6) + 0.0 AS std,
  round(min({c}), 6) + 0.0 AS min, round(max({c}), 6) + 0.0 AS max, round(quantile_cont({c}, 0.5), 6) + 0.0 AS median,
  round(quantile_cont({c}, 0.25), 6) + 0.0 AS q25, round(quantile_cont({c}, 0.75), 6) + 0.0 AS q75,
  round(skewness({c}), 6) + 0.0 AS skewness, round(kurtosis({c}), 6) + 0.0 AS kurtosis FROM lineitem"""


@query("f01_numeric_summary", sql=each(_SUMMARY, NUMBERS, " UNION ALL "))
def f01(spark, sf):
    return rounded(profile.numeric_summary(line(spark, sf, *NUMBERS)))


@query("f02_missing_summary", sql=f"""
WITH {GAPS_SQL}
{each('''SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS missing,
  round(100.0 * count(*) FILTER ({c} IS NULL) / count(*), 6) + 0.0 AS percentage, count(*) FILTER ({c} IS NULL) > 0 AS has_gaps FROM gaps''',
  ['l_orderkey', 'qty', 'price', 'flag'], ' UNION ALL ')}""")
def f02(spark, sf):
    return rounded(profile.missing_summary(gaps(spark, sf)))


@query("f03_duplicate_summary", sql=f"""
WITH g AS (SELECT count(*) AS n FROM lineitem GROUP BY l_quantity, l_discount, l_tax)
SELECT CAST(sum(n) - count(*) AS BIGINT) AS duplicate_rows, count(*) AS unique_rows,
  {r('(sum(n) - count(*)) * 100.0 / sum(n)')} AS duplicate_percentage FROM g""")
def f03(spark, sf):
    return rounded(profile.duplicate_summary(line(spark, sf, "l_quantity", "l_discount", "l_tax")))


@query("f04_categorical_top", sql="""
(SELECT 'o_orderpriority' AS "column", o_orderpriority AS value, count(*) AS count FROM orders GROUP BY ALL ORDER BY count DESC, value LIMIT 5)
UNION ALL
(SELECT 'o_orderstatus', o_orderstatus, count(*) AS count FROM orders GROUP BY ALL ORDER BY count DESC, 2 LIMIT 5)""")
def f04(spark, sf):
    return profile.categorical_top(table(spark, sf, "orders"), ["o_orderpriority", "o_orderstatus"])


@query("f04_categorical_summary", sql="""
WITH c AS (SELECT 'o_orderpriority' AS "column", o_orderpriority AS v, count(*) AS n FROM orders GROUP BY ALL
           UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM orders GROUP BY ALL)
SELECT "column", count(*) AS unique_values, arg_min(v, (-n, v)) AS most_frequent, max(n) AS most_frequent_count FROM c GROUP BY "column" """)
def f04_summary(spark, sf):
    return profile.categorical_summary(table(spark, sf, "orders"), ["o_orderpriority", "o_orderstatus"])


_PAIRS = list(combinations(NUMBERS, 2))


@query("f06_top_correlations", sql=f"""
WITH c AS ({' UNION ALL '.join(f"SELECT '{a}' AS column1, '{b}' AS column2, corr({a}, {b}) AS c FROM lineitem" for a, b in _PAIRS)})
SELECT column1, column2, {r('c')} AS correlation FROM c ORDER BY abs(c) DESC LIMIT 3""")
def f06(spark, sf):
    return rounded(profile.top_correlations(line(spark, sf, *NUMBERS), k=3))


_QUALITY = """
WITH x AS (SELECT l_extendedprice AS Depth, l_quantity AS FormationPressure, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_tax END AS MudWeight FROM lineitem),
d AS (SELECT count(*) AS n FROM x GROUP BY Depth, FormationPressure, MudWeight),
s AS (SELECT 100.0 * count(*) FILTER (MudWeight IS NULL) / (count(*) * 3) AS missing,
  (SELECT sum(n) - count(*) FROM d) AS dup, count(*) AS n, count(*) FILTER (Depth > 15000) AS deep,
  bool_and(FormationPressure >= 1) AS rule1, max(Depth) < 1000 AS rule2 FROM x),
o AS (SELECT *, CASE WHEN missing < 1 THEN 'passed' WHEN missing < 15 THEN 'warning' ELSE 'issue' END AS om,
  CASE WHEN dup = 0 THEN 'passed' WHEN 100.0 * dup / n < 1 THEN 'warning' ELSE 'issue' END AS od,
  CASE WHEN deep = 0 THEN 'passed' ELSE 'warning' END AS op, CASE WHEN rule1 THEN 'passed' ELSE 'issue' END AS o1,
  CASE WHEN rule2 THEN 'passed' ELSE 'warning' END AS o2 FROM s),
rep AS (SELECT 'missing' AS "check", om AS outcome, missing AS value, '' AS message FROM o
  UNION ALL SELECT 'duplicates', od, 100.0 * dup / n, '' FROM o
  UNION ALL SELECT 'types', 'passed', 0, '' FROM o UNION ALL SELECT 'required_columns', 'passed', 0, '' FROM o
  UNION ALL SELECT 'physical_range', op, deep, CASE WHEN deep > 0 THEN 'Depth_large' ELSE '' END FROM o
  UNION ALL SELECT 'positive', o1, NULL, 'pressure present' FROM o UNION ALL SELECT 'shallow', o2, NULL, 'well is shallow' FROM o),
c AS (SELECT sum(CASE WHEN outcome = 'passed' THEN 1.0 WHEN "check" = 'missing' AND value < 5 THEN 0.5
   WHEN "check" = 'duplicates' AND outcome = 'warning' THEN 0.5 ELSE 0 END) / 7 * 100
   - 10 * count(*) FILTER (outcome = 'issue') - 3 * count(*) FILTER (outcome = 'warning') AS score FROM rep)
SELECT "check", outcome, round(value, 6) + 0.0 AS value, message FROM rep
UNION ALL SELECT 'score', 'score', round(greatest(0, least(100, score)), 6) + 0.0, '' FROM c"""


@query("f07_f11_quality_report", sql=_QUALITY)
def f07(spark, sf):
    rules = [
        quality.Rule("positive", "FormationPressure >= 1", "error", "pressure present"),
        quality.Rule("shallow", "max(Depth) < 1000", "warning", "well is shallow", aggregate=True),
    ]
    return rounded(quality.quality_report(_formation(spark, sf), "formation", rules))


def _formation(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("Depth"), F.col("l_quantity").alias("FormationPressure"),
        F.when(F.col("l_linenumber") != 1, F.col("l_tax")).alias("MudWeight"),
    )


@query("f08_simple_quality", sql="""
WITH x AS (SELECT l_extendedprice AS Depth, l_quantity AS FormationPressure, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_tax END AS MudWeight FROM lineitem),
d AS (SELECT count(*) AS n FROM x GROUP BY Depth, FormationPressure, MudWeight),
s AS (SELECT count(*) AS n, 100.0 * count(*) FILTER (MudWeight IS NULL) / (count(*) * 3) AS m,
  (SELECT sum(n) - count(*) FROM d) AS dup, count(*) FILTER (Depth > 15000) AS deep FROM x),
c AS (SELECT n, (m > 10)::INT + (dup > 0 AND 100.0 * dup / n > 5)::INT AS issues,
  (m > 5 AND m <= 10)::INT + (dup > 0 AND 100.0 * dup / n <= 5)::INT + (deep > 0)::INT AS warnings FROM s)
SELECT n AS "rows", issues, warnings, 100 - 15 * issues - 5 * warnings AS score,
  100 - 15 * issues - 5 * warnings >= 70 AND issues = 0 AND n > 10 AS valid FROM c""")
def f08(spark, sf):
    df = _formation(spark, sf)
    q = quality.simple_quality(df, quality.detect_data_type(df))
    valid = q["score"] >= 70 and q["issues"] == 0 and q["rows"] > 10
    return literal_table(
        spark, [(q["rows"], q["issues"], q["warnings"], q["score"], valid)],
        "rows long, issues int, warnings int, score int, valid boolean",
    )


@query("f09_correlation_matrix", sql=" UNION ALL ".join(
    f"SELECT '{a}' AS column1, '{b}' AS column2, {r(f'corr({a}, {b})')} AS correlation FROM lineitem" if a != b
    else f"SELECT '{a}' AS column1, '{a}' AS column2, 1.0 AS correlation" for a in NUMBERS for b in NUMBERS))
def f09(spark, sf):
    return rounded(profile.correlation_matrix(line(spark, sf, *NUMBERS)))


_RANK = """(SELECT {c}, min(rk) + (count(*) - 1) / 2.0 AS r FROM (SELECT {c}, row_number() OVER (ORDER BY {c}) AS rk FROM {t}) GROUP BY {c})"""


@query("f10_spearman", sql=f"""
SELECT 'l_quantity' AS column1, 'l_extendedprice' AS column2, {r('corr(a.r, b.r)')} AS correlation FROM lineitem
JOIN {_RANK.format(c='l_quantity', t='lineitem')} a USING (l_quantity) JOIN {_RANK.format(c='l_extendedprice', t='lineitem')} b USING (l_extendedprice)""")
def f10(spark, sf):
    return rounded(profile.spearman(line(spark, sf, "l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice"))


@query("f12_histogram", sql=f"""
WITH m AS (SELECT min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / 30 AS w FROM events),
h AS (SELECT least(floor((value - lo) / w), 29)::INT AS bin, count(*) AS n FROM events, m GROUP BY 1)
SELECT b.bin, {r('lo + b.bin * w')} AS lower, {r('lo + (b.bin + 1) * w')} AS upper, coalesce(n, 0) AS count
FROM (SELECT CAST(range AS INT) AS bin FROM range(30)) b CROSS JOIN m LEFT JOIN h ON b.bin = h.bin""")
def f12(spark, sf):
    return rounded(profile.histogram(tele(spark, sf, "value"), "value", 30))


@query("f13_overview", sql=f"""
WITH {GAPS_SQL} SELECT count(*) AS "rows", {r('avg(price)')} AS mean_depth, {r('avg(qty)')} AS mean_pressure,
 {r('(count(l_orderkey) + count(qty) + count(price) + count(flag)) / (count(*) * 4)')} AS completeness FROM gaps""")
def f13(spark, sf):
    return rounded(profile.overview(gaps(spark, sf), "price", "qty"))


@query("f14_descriptive", sql=f"""
WITH {EVENTS_SQL}, q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM tele)
SELECT 'value' AS "column", count(value) AS count, {r('avg(value)')} AS mean, {r('stddev_samp(value)')} AS std, {r('min(value)')} AS min,
  {r('max(value)')} AS max, {r('quantile_cont(value, 0.5)')} AS median, {r('any_value(a)')} AS q25, {r('any_value(b)')} AS q75,
  {r('(skewness(value) * (count(value) - 2) / sqrt(count(value) * (count(value) - 1.0)))')} AS skewness, {r('kurtosis_pop(value)')} AS kurtosis,
  count(*) FILTER (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) AS outliers,
  {r('100.0 * count(*) FILTER (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) / count(*)')} AS outlier_percentage
FROM tele, q""")
def f14(spark, sf):
    return rounded(profile.descriptive_statistics(tele(spark, sf, "value")))


@query("f15_average_ranks", sql=f"""
SELECT l_quantity, count(*) AS n, min(rk) + (count(*) - 1) / 2.0 AS "rank"
FROM (SELECT l_quantity, row_number() OVER (ORDER BY l_quantity) AS rk FROM lineitem) GROUP BY l_quantity""")
def f15(spark, sf):
    counted = line(spark, sf, "l_quantity").groupBy("l_quantity").agg(F.count(F.lit(1)).alias("n"))
    return profile.average_ranks(counted, "l_quantity", "n")


@query("f16_profile", sql=f"""
WITH {GAPS_SQL}
{each('''SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS missing, round(100.0 * count(*) FILTER ({c} IS NULL) / count(*), 6) + 0.0 AS missing_percentage,
  count(DISTINCT {c}) AS unique_values FROM gaps''', ['l_orderkey', 'qty', 'price', 'flag'], ' UNION ALL ')}""")
def f16(spark, sf):
    return rounded(profile.profile(gaps(spark, sf)).drop("type", "example"))


# ---- feature selection ------------------------------------------------------------

_CHANNELS = ["WellDepth", "WoBit", "RoPen", "BTBR", "WBoPress", "HLoad", "DPPress", "FRate"]


@query("g01_correlation_filter", sql=f"""
WITH {CHANNELS_SQL}, c AS ({' UNION ALL '.join(f"SELECT '{b}' AS feature, abs(corr({a}, {b})) AS c FROM drill" for a, b in combinations(_CHANNELS, 2))})
SELECT DISTINCT feature FROM c WHERE c > 0.9""")
def g01(spark, sf):
    names = select.correlated_columns(drill(spark, sf, *_CHANNELS), 0.9)
    return literal_table(spark, [(n,) for n in names], "feature string")


@query("g02_low_variance", sql=each("SELECT '{c}' AS feature FROM lineitem HAVING var_samp({c}) < 0.01", NUMBERS, " UNION ALL "))
def g02(spark, sf):
    return literal_table(spark, [(n,) for n in select.low_variance_columns(line(spark, sf, *NUMBERS))], "feature string")


_CORR = "SELECT '{c}' AS feature, abs(corr({c}, WellDepth)) AS s FROM drill"
_INPUTS = [c for c in _CHANNELS if c != "WellDepth"]


@query("g03_top_correlation", sql=f"""
WITH {CHANNELS_SQL}, c AS ({each(_CORR, _INPUTS, ' UNION ALL ')}) SELECT feature, {r('s')} AS score FROM c ORDER BY s DESC LIMIT 3""")
def g03(spark, sf):
    return rounded(select.top_by_correlation(drill(spark, sf, *_CHANNELS), "WellDepth", 3))


_BINS = 10


def _bin(c: str) -> str:
    cuts = ", ".join(str(i / _BINS) for i in range(1, _BINS))
    return f"(SELECT list_distinct(quantile_cont({c}, [{cuts}])) FROM lineitem)"


def _mi(c: str) -> str:
    return f"""SELECT '{c}' AS feature, sum(n / t * ln(n * t / (nx * ny))) AS s FROM (
      SELECT n, sum(n) OVER (PARTITION BY bx) AS nx, sum(n) OVER (PARTITION BY by_) AS ny, sum(n) OVER () AS t FROM (
        SELECT len(list_filter({_bin(c)}, lambda q: q < {c})) AS bx, len(list_filter({_bin('l_extendedprice')}, lambda q: q < l_extendedprice)) AS by_,
          count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2))"""


@query("g04_mutual_information", sql=f"""
WITH m AS ({' UNION ALL '.join(_mi(c) for c in ('l_quantity', 'l_discount', 'l_tax'))})
SELECT feature, {r('s')} AS score FROM m ORDER BY s DESC LIMIT 2""")
def g04(spark, sf):
    return rounded(select.top_by_mutual_information(line(spark, sf, *NUMBERS), "l_extendedprice", 2))


@query("g05_variance_then_correlation", sql=f"""
WITH {CHANNELS_SQL}, c AS ({each("SELECT '{c}' AS feature, abs(corr({c}, WellDepth)) AS s FROM drill HAVING var_pop({c}) > 0.01", _INPUTS, ' UNION ALL ')})
SELECT feature FROM c ORDER BY s DESC LIMIT 3""")
def g05(spark, sf):
    names = select.variance_then_correlation(drill(spark, sf, *_CHANNELS), "WellDepth", 3)
    return literal_table(spark, [(n,) for n in names], "feature string")


_F = "SELECT '{c}' AS feature, corr({c}, l_extendedprice) AS c, count(*) AS n FROM lineitem"


@query("g06_f_scores", sql=f"""
WITH f AS ({each(_F, ['l_quantity', 'l_discount', 'l_tax'], ' UNION ALL ')})
SELECT feature, {r('c * c * (n - 2) / (1 - c * c)', 5)} AS score FROM f""")
def g06(spark, sf):
    return rounded(select.f_scores(line(spark, sf, *NUMBERS), "l_extendedprice"), 5)


_WEIGHTS = {"WoBit": 1.0, "RoPen": 1.0, "BTBR": 1.0, "WBoPress": 0.9, "HLoad": 0.7, "DPPress": 0.8, "FRate": 0.8}


@query("g07_domain_importance", sql=f"""
WITH {CHANNELS_SQL} {' UNION ALL '.join(f"SELECT '{c}' AS feature, {r(f'0.6 * {w} + 0.4 * abs(corr({c}, WellDepth))')} AS score FROM drill" for c, w in _WEIGHTS.items())}""")
def g07(spark, sf):
    return rounded(select.domain_importance(drill(spark, sf, *_CHANNELS), "WellDepth"))


@query("g08_forest_selection")
def g08(spark, sf):
    df = line(spark, sf, *NUMBERS)
    return select.forest_selection(df, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], 2)


# ---- splits -------------------------------------------------------------------------

_W = "PARTITION BY user_id ORDER BY ts, event_id"
_POS = f"x AS (SELECT event_id, row_number() OVER ({_W}) - 1 AS p, count(*) OVER (PARTITION BY user_id) AS n FROM events)"


@query("k01_time_split", sql=f"""
WITH {_POS} SELECT event_id, CASE WHEN p < floor(n * 0.7::DOUBLE) THEN 'train' WHEN p < floor(n * 0.85::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM x""")
def k01(spark, sf):
    return split.time_split(tele(spark, sf, "event_id", "user_id", "ts"), WELL).select("event_id", "split")


@query("k02_holdout_split", sql=f"WITH {_POS} SELECT event_id, CASE WHEN p < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM x")
def k02(spark, sf):
    return split.holdout_split(tele(spark, sf, "event_id", "user_id", "ts"), WELL).select("event_id", "split")


@query("k03_expanding_folds", sql=f"""
WITH {_POS} SELECT event_id, CASE WHEN p < n - 5 * (n // 6) THEN 0 ELSE ((p - (n - 5 * (n // 6))) // (n // 6) + 1) END::INT AS fold FROM x""")
def k03(spark, sf):
    return split.expanding_folds(tele(spark, sf, "event_id", "user_id", "ts"), WELL, 5).select("event_id", "fold")


_HASH = "CAST('0x' || substr(md5(CAST({k} AS VARCHAR)), 1, 13) AS BIGINT)"


@query("k04_random_split", sql=f"""
WITH x AS (SELECT o_orderkey, row_number() OVER (ORDER BY {_HASH.format(k='o_orderkey')}, o_orderkey) - 1 AS p, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN p < floor(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM x""")
def k04(spark, sf):
    return split.random_split(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"])


@query("k04_stratified_split", sql=f"""
WITH x AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_HASH.format(k='o_orderkey')}, o_orderkey) - 1 AS p,
  count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
SELECT o_orderkey, o_orderstatus, CASE WHEN p < floor(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM x""")
def k04_stratified(spark, sf):
    return split.random_split(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], strata=["o_orderstatus"])


@query("k05_random_sample", sql=f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {_HASH.format(k='o_orderkey')}, o_orderkey LIMIT 1000")
def k05(spark, sf):
    return split.random_sample(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 1000)


@query("k06_top_k", sql="SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def k06(spark, sf):
    return split.top_k(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 20, "o_orderkey")


@query("k07_batches", sql=f"WITH {_POS} SELECT event_id, CAST(p // 25 AS BIGINT) AS batch FROM x")
def k07(spark, sf):
    return split.batches(tele(spark, sf, "event_id", "user_id", "ts"), WELL, 25).select("event_id", "batch")
