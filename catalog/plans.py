"""Preparation, feature-set and batch-run queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataflow.operators import impute, scale
from strataflow.plans import preparation
from strataflow.series import Series

from .base import EVENTS_SQL, query, r, rounded, table, tele

_ALONG = Series("user_id", "event_id")


def formation(spark, sf):
    e = tele(spark, sf, "event_id", "user_id", "value", "k")
    v, k = F.col("value"), F.col("k")
    return e.select(
        "event_id", "user_id", (F.col("event_id") * 1.5 + 1000).alias("WellDepth"), (k + 1).alias("BTBR"), (v * 40).alias("WBoPress"),
        (v + k).alias("HLoad"), (k + 2).alias("WoBit"), v.alias("RoPen"), (v - k).alias("DPPress"),
        (v * 30 + F.col("event_id") * 0.01).alias("FPress"),
    )


def kick(spark, sf):
    e = tele(spark, sf, "event_id", "user_id", "event_type", "value", "k")
    v, k = F.col("value"), F.col("k")
    return e.select(
        "event_id", "user_id", k.alias("FRate"), (v - k).alias("SMSpeed"), (k * 3).alias("FIn"), (k * 3 + v / 10).alias("FOut"),
        (v + 100).alias("ActiveGL"), (v + k).alias("HLoad"), (v * 40).alias("WBoPress"), (k * 3 - 5).alias("MRFlow"),
    )


@query("b21_replay_preparation", sql=f"""
WITH g AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_totalprice END AS price FROM orders),
t AS (SELECT quantile_cont(price, 0.5) AS med FROM g WHERE o_orderstatus = 'F'),
s AS (SELECT avg(coalesce(price, med)) AS m, stddev_pop(coalesce(price, med)) AS d FROM g, t WHERE o_orderstatus = 'F')
SELECT o_orderkey, {r('(coalesce(price, med) - m) / d')} AS price FROM g, t, s WHERE o_orderstatus <> 'F'""")
def b21(spark, sf):
    df = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderstatus", F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_totalprice")).alias("price")
    )
    train = df.where("o_orderstatus = 'F'")
    fills = impute.fit_fill(train, "median", ["price"])
    scaling = scale.fit_scale(fills.apply(train), "standard", ["price"])
    fitted = preparation.Preparation("formation", ["price"], fills.values, scaling.parameters)
    return rounded(fitted.apply(df.where("o_orderstatus <> 'F'"), ["o_orderkey"]))


@query("b22_prepare_formation")
def b22(spark, sf):
    return preparation.prepare_formation(formation(spark, sf), _ALONG)[0]


@query("b23_prepare_kick")
def b23(spark, sf):
    channels = ["FRate", "SMSpeed", "FIn", "FOut", "ActiveGL", "HLoad"]
    return preparation.prepare_kick(kick(spark, sf), _ALONG, channels)[0]


_W = "PARTITION BY user_id ORDER BY event_id"


def _full(n: int, expression: str, column: str) -> str:
    frame = f"({_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({column}) OVER {frame} >= {n} THEN {expression} OVER {frame} END"


def _temporal(c: str) -> dict[str, str]:
    lag1, lag2 = f"lag({c}) OVER ({_W})", f"lag({c}, 2) OVER ({_W})"
    out = {f"{c}_Rate": f"{c} - {lag1}", f"{c}_Acceleration": f"({c} - {lag1}) - ({lag1} - {lag2})"}
    for n in (5, 10, 20):
        for k, fn in (("MA", "avg"), ("STD", "stddev_samp"), ("MIN", "min"), ("MAX", "max")):
            out[f"{c}_{k}_{n}"] = _full(n, f"{fn}({c})", c)
    out[f"{c}_Trend_5"] = _full(5, f"regr_slope({c}, rn)", c)
    out[f"{c}_Volatility"] = f"({_full(10, f'stddev_samp({c})', c)}) / (({_full(10, f'avg({c})', c)}) + 1e-8)"
    return out


def _pair(a: str, b: str) -> dict[str, str]:
    return {f"{a}_x_{b}": f"{a} * {b}", f"{a}_div_{b}": f"{a} / ({b} + 1e-8)", f"{a}_minus_{b}": f"{a} - {b}"}


def _columns(parts: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in parts.items())


_FORM_INPUTS = {
    "WellDepth": "event_id * 1.5::DOUBLE + 1000", "BTBR": "k + 1", "WBoPress": "value * 40", "HLoad": "value + k", "WoBit": "k + 2",
    "RoPen": "value", "DPPress": "value - k", "FPress": "value * 30 + event_id * 0.01::DOUBLE",
}
_FORM_ROW = {
    "MSE": "WoBit / (RoPen + 1e-8)", "WOB_Efficiency": "RoPen / (WoBit + 1e-8)", "Torque_WOB_Ratio": "BTBR / (WoBit + 1e-8)",
    "FPress_Gradient": "FPress / (WellDepth + 1e-8)", "Overbalance": "WBoPress - FPress", "Overbalance_Ratio": "WBoPress / (FPress + 1e-8)",
    "Formation_Strength": "WoBit / (RoPen + 1e-8)", "DP_FP_Ratio": "DPPress / (FPress + 1e-8)",
    "FPress_per_Depth": "FPress / (WellDepth + 1e-8)", "WBoPress_per_Depth": "WBoPress / (WellDepth + 1e-8)", "HLoad_per_Depth": "HLoad / (WellDepth + 1e-8)",
    "Effective_WOB": "WoBit - HLoad * 0.1::DOUBLE", "Weight_Transfer_Efficiency": "WoBit / (HLoad + 1e-8)", "Specific_Torque": "BTBR / (RoPen + 1e-8)",
    "Total_System_Pressure": "WBoPress + DPPress", "Pressure_Efficiency": "FPress / (WBoPress + 1e-8)",
    **_pair("WBoPress", "FPress"), **_pair("WBoPress", "DPPress"), **_pair("FPress", "DPPress"),
    **_pair("WoBit", "RoPen"), **_pair("WoBit", "BTBR"), **_pair("RoPen", "BTBR"),
}
_FORM_WINDOW = {k: v for c in ("WellDepth", "WBoPress", "RoPen", "BTBR") for k, v in _temporal(c).items()} | {
    "Depth_Change": f"WellDepth - lag(WellDepth) OVER ({_W})",
    "Cumulative_Depth_Change": f"CASE WHEN rn > 1 THEN WellDepth - first_value(WellDepth) OVER ({_W}) END",
}


@query("e18_formation_feature_set", sql=f"""
WITH {EVENTS_SQL}, x AS (SELECT event_id, user_id, {_columns(_FORM_INPUTS)}, row_number() OVER ({_W}) AS rn FROM tele),
w AS (SELECT event_id, user_id, {", ".join(_FORM_INPUTS)}, {_columns(_FORM_ROW)}, {_columns(_FORM_WINDOW)} FROM x),
q AS (SELECT quantile_cont(WellDepth, 0.33) AS q33, quantile_cont(WellDepth, 0.66) AS q66 FROM x)
SELECT event_id, user_id, {", ".join([*_FORM_INPUTS, *_FORM_ROW])},
  CASE WHEN WellDepth <= q33 THEN 'Shallow' WHEN WellDepth <= q66 THEN 'Medium' ELSE 'Deep' END AS Depth_Category,
  {", ".join(f"round(coalesce({c}, avg({c}) OVER ()), 4) + 0.0 AS {c}" for c in _FORM_WINDOW)} FROM w, q""")
def e18(spark, sf):
    return rounded(preparation.drilling_features(formation(spark, sf), _ALONG, "formation"), 4, _FORM_WINDOW)


_KICK_INPUTS = {
    "FRate": "k", "SMSpeed": "value - k", "FIn": "k * 3", "FOut": "k * 3 + value / 10", "ActiveGL": "value + 100", "HLoad": "value + k",
    "WBoPress": "value * 40", "MRFlow": "k * 3 - 5",
}


def _anomaly(c: str) -> dict[str, str]:
    return {
        f"{c}_ZScore": f"({c} - ({_full(50, f'avg({c})', c)})) / (({_full(50, f'stddev_samp({c})', c)}) + 1e-8)",
        f"{c}_Median_Distance": f"abs({c} - ({_full(20, f'quantile_cont({c}, 0.5)', c)}))",
        f"{c}_Rate_Anomaly": f"abs({c}__step) / (({_full(20, f'stddev_samp({c}__step)', f'{c}__step')}) + 1e-8)",
    }


_KICK_WINDOW = {
    "ActiveGL_Rate": f"ActiveGL - lag(ActiveGL) OVER ({_W})",
    "ActiveGL_Acceleration": f"(ActiveGL - lag(ActiveGL) OVER ({_W})) - (lag(ActiveGL) OVER ({_W}) - lag(ActiveGL, 2) OVER ({_W}))",
    "SPP_Variation": _full(5, "stddev_samp(WBoPress)", "WBoPress"), "SPP_Trend": _full(10, "regr_slope(WBoPress, rn)", "WBoPress"),
    "MRFlow_MA": _full(10, "avg(MRFlow)", "MRFlow"), "MRFlow_Deviation": f"MRFlow - ({_full(10, 'avg(MRFlow)', 'MRFlow')})",
    "HLoad_Variation": _full(5, "stddev_samp(HLoad)", "HLoad"), "HLoad_Trend": _full(10, "regr_slope(HLoad, rn)", "HLoad"),
    **{k: v for c in ("ActiveGL", "FIn", "FOut", "WBoPress", "MRFlow") for k, v in _temporal(c).items()},
    **{k: v for c in _KICK_INPUTS for k, v in _anomaly(c).items()},
    **{f"{c}_lag_{n}": f"lag({c}, {n}) OVER ({_W})" for c in ("ActiveGL", "FIn", "FOut", "MRFlow") for n in (1, 2, 3, 5)},
}


@query("e18_kick_feature_set", sql=f"""
WITH {EVENTS_SQL}, x AS (SELECT event_id, user_id, {_columns(_KICK_INPUTS)}, row_number() OVER ({_W}) AS rn FROM tele),
y AS (SELECT *, {", ".join(f"{c} - lag({c}) OVER ({_W}) AS {c}__step" for c in _KICK_INPUTS)} FROM x),
w AS (SELECT event_id, user_id, rn, {", ".join(_KICK_INPUTS)}, {_columns(_KICK_WINDOW)} FROM y)
SELECT event_id, user_id, {", ".join(_KICK_INPUTS)}, FRate * WBoPress / 1714 AS Hydraulic_HP, FOut - FIn AS Flow_Balance, FOut / (FIn + 1e-8) AS Flow_Balance_Ratio,
  {", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in _KICK_WINDOW)} FROM w WHERE rn >= 50""")
def e18_kick(spark, sf):
    return rounded(preparation.drilling_features(kick(spark, sf), _ALONG, "kick"), 6, _KICK_WINDOW)


@query("h23_batch_run")
def batch_run(spark, sf):
    df = formation(spark, sf)
    features = ["WellDepth", "BTBR", "HLoad", "WoBit"]
    return preparation.run_batch(df, ["user_id"], ["event_id"], "formation_pressure", "FPress", ["pcr", "pls", "linear"], features)[1]
