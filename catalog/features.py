"""Row-wise feature queries over the drilling channels."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataflow.functions import drilling as D
from strataflow.operators import features
from strataflow.series import Series

from .base import CHANNELS_SQL, drill, line, query, r, rounded, table, tele


def _pair(a: str, b: str, eps: str = "1e-8", minus: bool = True) -> str:
    parts = [f"{a} * {b} AS {a}_x_{b}", f"{a} / ({b} + {eps}) AS {a}_div_{b}"]
    if minus:
        parts.append(f"{a} - {b} AS {a}_minus_{b}")
    return ", ".join(parts)


@query("e01_pair_interactions", sql=f"""
WITH {CHANNELS_SQL} SELECT {_pair('WellDepth', 'BTBR')}, {_pair('WBoPress', 'HLoad')}, {_pair('WoBit', 'RoPen')} FROM drill""")
def e01(spark, sf):
    inputs = ["WellDepth", "BTBR", "WBoPress", "HLoad", "WoBit", "RoPen"]
    pairs = [("WellDepth", "BTBR"), ("WBoPress", "HLoad"), ("WoBit", "RoPen")]
    return features.pair_interactions(drill(spark, sf, *inputs), pairs).drop(*inputs)


@query("e02_group_interactions", sql=f"""
WITH {CHANNELS_SQL} SELECT {_pair('WBoPress', 'FPress')}, {_pair('WBoPress', 'DPPress')}, {_pair('FPress', 'DPPress')},
  {_pair('FRate', 'WBoPress')} FROM drill""")
def e02(spark, sf):
    inputs = ["WBoPress", "FPress", "DPPress", "FRate"]
    groups = {"pressure": ["WBoPress", "FPress", "DPPress"], "hydraulic": ["FRate", "WBoPress", "Missing"]}
    return features.group_interactions(drill(spark, sf, *inputs), groups).drop(*inputs)


@query("e03_polynomial", sql="""
SELECT l_quantity * l_quantity AS "poly_l_quantity^2", l_quantity * l_discount AS "poly_l_quantity l_discount",
  l_quantity * l_tax AS "poly_l_quantity l_tax", l_discount * l_discount AS "poly_l_discount^2",
  l_discount * l_tax AS "poly_l_discount l_tax", l_tax * l_tax AS "poly_l_tax^2" FROM lineitem""")
def e03(spark, sf):
    inputs = ["l_quantity", "l_discount", "l_tax"]
    return features.polynomial_features(line(spark, sf, *inputs), inputs).drop(*inputs)


@query("e04_powers", sql=f"""
SELECT {_pair('l_quantity', 'l_discount', '1e-6', False)}, {_pair('l_quantity', 'l_tax', '1e-6', False)},
  {_pair('l_discount', 'l_tax', '1e-6', False)}, l_quantity * l_quantity AS l_quantity_squared, sqrt(abs(l_quantity)) AS l_quantity_sqrt,
  l_discount * l_discount AS l_discount_squared, sqrt(abs(l_discount)) AS l_discount_sqrt,
  l_tax * l_tax AS l_tax_squared, sqrt(abs(l_tax)) AS l_tax_sqrt FROM lineitem""")
def e04(spark, sf):
    inputs = ["l_quantity", "l_discount", "l_tax"]
    return features.power_features(line(spark, sf, *inputs), inputs).drop(*inputs)


@query("e05_ratios", sql="""
SELECT l_tax / nullif(l_discount, 0) AS l_tax_l_discount_ratio, l_extendedprice / l_quantity AS l_extendedprice_l_quantity_ratio FROM lineitem""")
def e05(spark, sf):
    inputs = ["l_tax", "l_discount", "l_extendedprice", "l_quantity"]
    pairs = [("l_tax", "l_discount"), ("l_extendedprice", "l_quantity")]
    return features.ratio_features(line(spark, sf, *inputs), pairs).drop(*inputs)


@query("e06_efficiency", sql=f"""
WITH {CHANNELS_SQL} SELECT (WoBit + 6.283185307179586::DOUBLE * BTBR * RPM) / (RoPen + 1e-8) AS MSE, RoPen / (WoBit + 1e-8) AS WOB_Efficiency,
  BTBR / (WoBit + 1e-8) AS Torque_WOB_Ratio, (FRate * WBoPress) / 1714 AS Hydraulic_HP,
  FRate / (WellDepth * 0.1::DOUBLE + 1e-8) AS Flow_Efficiency FROM drill""")
def e06(spark, sf):
    df = drill(spark, sf, "WoBit", "RoPen", "BTBR", "FRate", "WBoPress", "WellDepth", "RPM").withColumnRenamed("RPM", "Torque")
    return features.efficiency_features(df).select("MSE", "WOB_Efficiency", "Torque_WOB_Ratio", "Hydraulic_HP", "Flow_Efficiency")


@query("e07_simple_efficiency", sql=f"""
WITH {CHANNELS_SQL} SELECT greatest(coalesce(RoPen / nullif(BTBR, 0), 0), 0) AS drilling_efficiency,
  greatest(coalesce(RPM * WoBit / nullif(RoPen, 0), 0), 0) AS mechanical_specific_energy,
  greatest(coalesce(RoPen / nullif(RPM, 0), 0), 0) AS rop_per_rpm FROM drill""")
def e07(spark, sf):
    df = features.simple_efficiency(drill(spark, sf, "BTBR", "RoPen", "RPM", "WoBit"), "BTBR", "RoPen", "RPM", "WoBit")
    return df.select("drilling_efficiency", "mechanical_specific_energy", "rop_per_rpm")


@query("e08_formation", sql=f"""
WITH {CHANNELS_SQL} SELECT FPress / (WellDepth + 1e-8) AS FPress_Gradient, WBoPress - FPress AS Overbalance,
  WBoPress / (FPress + 1e-8) AS Overbalance_Ratio, WoBit / (RoPen + 1e-8) AS Formation_Strength,
  DPPress / (FPress + 1e-8) AS DP_FP_Ratio FROM drill""")
def e08(spark, sf):
    df = drill(spark, sf, "FPress", "WellDepth", "WBoPress", "WoBit", "RoPen", "DPPress")
    return features.formation_features(df).drop("FPress", "WellDepth", "WBoPress", "WoBit", "RoPen", "DPPress")


@query("e09_depth", sql=f"""
WITH x AS (SELECT c_custkey, c_nationkey, c_acctbal AS WellDepth FROM customer),
q AS (SELECT quantile_cont(WellDepth, 0.33) AS a, quantile_cont(WellDepth, 0.66) AS b FROM x),
s AS (SELECT *, WellDepth - lag(WellDepth) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS step FROM x)
SELECT c_custkey, CASE WHEN WellDepth <= a THEN 'Shallow' WHEN WellDepth <= b THEN 'Medium' ELSE 'Deep' END AS Depth_Category,
  {r('c_custkey / (WellDepth + 1e-8)')} AS HLoad_per_Depth, {r('step')} AS Depth_Change,
  {r('CASE WHEN step IS NOT NULL THEN sum(step) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS UNBOUNDED PRECEDING) END')} AS Cumulative_Depth_Change
FROM s, q""")
def e09(spark, sf):
    df = table(spark, sf, "customer").select(
        "c_custkey", "c_nationkey", F.col("c_acctbal").alias("WellDepth"), F.col("c_custkey").alias("HLoad")
    )
    return rounded(features.depth_features(df, Series("c_nationkey", "c_custkey")).drop("c_nationkey", "WellDepth", "HLoad"))


@query("e10_physics", sql=f"""
WITH {CHANNELS_SQL} SELECT FRate * sqrt(WBoPress) AS Hydraulic_Impact, FRate / 100 AS Flow_Velocity,
  WoBit - HLoad * 0.1::DOUBLE AS Effective_WOB, WoBit / (HLoad + 1e-8) AS Weight_Transfer_Efficiency,
  BTBR / (RoPen + 1e-8) AS Specific_Torque, BTBR * RPM / 5252 AS Rotary_Power,
  WBoPress + DPPress AS Total_System_Pressure, FPress / (WBoPress + 1e-8) AS Pressure_Efficiency FROM drill""")
def e10(spark, sf):
    inputs = ["FRate", "WBoPress", "WoBit", "HLoad", "BTBR", "RoPen", "RPM", "FPress", "DPPress"]
    return features.physics_features(drill(spark, sf, *inputs)).drop(*inputs)


@query("e10_negative_pressure", sql="""
SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_custkey * sqrt(greatest(c_acctbal, 0)) END AS Hydraulic_Impact FROM customer""")
def e10_negative(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", F.col("c_custkey").alias("FRate"), F.col("c_acctbal").alias("WBoPress"))
    return features.physics_features(df).select("c_custkey", "Hydraulic_Impact")


@query("e11_specific_energy", sql=f"""
WITH {CHANNELS_SQL} SELECT {r('WoBit / 56.74501730546564 + (6.283185307179586::DOUBLE * RPM * DPPress) / (RoPen * 56.74501730546564 + 1e-8)')} AS mse FROM drill""")
def e11(spark, sf):
    df = drill(spark, sf, "WoBit", "RoPen", "DPPress", "RPM")
    return rounded(df.select(D.mechanical_specific_energy("WoBit", "RoPen", "DPPress", "RPM").alias("mse")))


@query("e12_hydraulics", sql=f"""
WITH {CHANNELS_SQL} SELECT (FRate * WBoPress) / 1714 AS hydraulic_hp, FRate / 0.5::DOUBLE AS velocity,
  FRate * (FRate / 0.5::DOUBLE) * 0.052::DOUBLE AS jet_impact FROM drill""")
def e12(spark, sf):
    return drill(spark, sf, "FRate", "WBoPress").select(
        D.hydraulic_horsepower("FRate", "WBoPress").alias("hydraulic_hp"),
        D.nozzle_velocity("FRate").alias("velocity"),
        D.jet_impact("FRate").alias("jet_impact"),
    )


@query("e13_notebook_formation", sql=f"""
WITH {CHANNELS_SQL} SELECT MudWeight * 0.052::DOUBLE AS MudWeightGradient, WellDepth * MudWeight * 0.052::DOUBLE AS HydrostaticPress,
  WoBit * 1000 / (BTBR + 1e-6) AS SpecificEnergy, RoPen / (WoBit + 1e-6) AS MechEfficiency,
  WBoPress / (WellDepth + 1e-6) AS PressureGradient, RPM / (RoPen + 1e-6) AS TorqueRatio FROM drill""")
def e13(spark, sf):
    inputs = ["WellDepth", "MudWeight", "WoBit", "BTBR", "RoPen", "WBoPress", "RPM"]
    df = drill(spark, sf, *inputs).withColumnRenamed("RPM", "Torque")
    return features.notebook_formation_features(df).drop("Torque", *inputs)


@query("e13_notebook_kick", sql=f"""
WITH {CHANNELS_SQL} SELECT FRate - WoBit AS FlowBalance, FRate / (WoBit + 1e-6) AS FlowRatio, abs(FRate - WoBit) AS FlowImbalance,
  WBoPress - FPress AS PressureDiff, RPM * HLoad AS PowerIndex FROM drill""")
def e13_kick(spark, sf):
    df = drill(spark, sf, "FRate", "WoBit", "WBoPress", "FPress", "RPM", "HLoad")
    df = df.withColumnsRenamed({"WoBit": "FIn", "FRate": "FOut", "WBoPress": "StandPipePress", "FPress": "CasingPress", "RPM": "SMSpeed"})
    return features.notebook_kick_features(df).select("FlowBalance", "FlowRatio", "FlowImbalance", "PressureDiff", "PowerIndex")


@query("e14_unit_conversion", sql="""
SELECT p_partkey, p_retailprice * 0.068948::DOUBLE AS bar, p_size * 0.3048::DOUBLE AS metres, p_size * 3.78541::DOUBLE AS litres FROM part""")
def e14(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey",
        D.convert_units("p_retailprice", "psi", "bar").alias("bar"),
        D.convert_units("p_size", "ft", "m").alias("metres"),
        D.convert_units("p_size", "gpm", "lpm").alias("litres"),
    )


@query("e15_safe_divide", sql="""
SELECT coalesce(l_tax / nullif(l_discount, 0), -1) AS ratio,
  CASE WHEN l_discount = 0 THEN CASE WHEN l_tax <> 0 THEN -999 ELSE 0 END ELSE (l_tax - l_discount) / abs(l_discount) * 100 END AS change
FROM lineitem""")
def e15(spark, sf):
    change = D.percentage_change("l_discount", "l_tax")
    return line(spark, sf, "l_tax", "l_discount").select(
        D.safe_divide("l_tax", "l_discount", -1.0).alias("ratio"),
        F.when(change == float("inf"), F.lit(-999.0)).otherwise(change).alias("change"),
    )


@query("e16_range_check", sql="""
SELECT l_orderkey, l_quantity >= 8 AND l_quantity <= 20 AS valid,
  CASE WHEN l_quantity < 8 THEN 'MudWeight below the normal range (8.0-20.0)'
       WHEN l_quantity > 20 THEN 'MudWeight above the normal range (8.0-20.0)' ELSE 'MudWeight in the normal range' END AS message,
  l_tax >= 0.02 AND l_tax <= 0.05 AS tax_valid FROM lineitem""")
def e16(spark, sf):
    valid, message = D.range_check("MudWeight", "l_quantity")
    return line(spark, sf, "l_orderkey", "l_quantity", "l_tax").select(
        "l_orderkey", valid.alias("valid"), message.alias("message"), D.in_range("l_tax", 0.02, 0.05).alias("tax_valid")
    )


@query("e17_zscore_flags", sql=f"""
WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS d FROM events)
SELECT event_id, {r('(value - m) / d')} AS value_zscore, abs((value - m) / d) > 3 AS value_is_outlier FROM events, s""")
def e17(spark, sf):
    return rounded(features.zscore_flags(tele(spark, sf, "event_id", "value"), ["value"]).drop("value"))
