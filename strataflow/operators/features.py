"""Row-wise feature algebra; channels that are absent are skipped."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations, combinations_with_replacement
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..channels import (
    EPSILON,
    HOLE_VOLUME_FACTOR,
    HOOK_LOAD_SHARE,
    NOTEBOOK_EPSILON,
    NOZZLE_DIVISOR,
    PSI_TO_MUD_WEIGHT,
    ROTARY_DIVISOR,
    finite,
)
from ..functions.drilling import guarded_ratio, hydraulic_horsepower
from ..series import SeriesLike
from ..quantiles import quantiles
from ..stats import moments


def _has(df: DataFrame, *names: str) -> bool:
    return all(n in df.columns for n in names)


def pair_interactions(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    added = {}
    for a, b in pairs:
        if _has(df, a, b):
            added[f"{a}_x_{b}"] = F.col(a) * F.col(b)
            added[f"{a}_div_{b}"] = guarded_ratio(a, b)
            added[f"{a}_minus_{b}"] = F.col(a) - F.col(b)
    return df.withColumns(added) if added else df


def group_interactions(df: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    pairs = [p for names in groups.values() for p in combinations([n for n in names if n in df.columns], 2)]
    return pair_interactions(df, pairs)


def polynomial_features(df: DataFrame, columns: Sequence[str], degree: int = 2, limit: int | None = None) -> DataFrame:
    """Products up to ``degree`` of all columns, or of the first ``limit``, named like ``poly_a^2`` and ``poly_a b``."""
    inputs = [c for c in columns if c in df.columns][:limit]
    added: dict[str, Column] = {}
    for d in range(2, degree + 1):
        for combo in combinations_with_replacement(inputs, d):
            name = " ".join(c if combo.count(c) == 1 else f"{c}^{combo.count(c)}" for c in dict.fromkeys(combo))
            product = F.col(combo[0])
            for c in combo[1:]:
                product = product * F.col(c)
            added[f"poly_{name}"] = product
    return df.withColumns(added) if added else df


def power_features(df: DataFrame, columns: Sequence[str], squared: int | None = None, crossed: int | None = None) -> DataFrame:
    """Squares and roots of all columns, or the first ``squared``; products and ratios among all, or the first ``crossed``."""
    added: dict[str, Column] = {}
    for a, b in combinations(columns[:crossed], 2):
        added[f"{a}_x_{b}"] = F.col(a) * F.col(b)
        added[f"{a}_div_{b}"] = guarded_ratio(a, b, NOTEBOOK_EPSILON)
    for c in columns[:squared]:
        added[f"{c}_squared"] = F.col(c) * F.col(c)
        added[f"{c}_sqrt"] = F.sqrt(F.abs(F.col(c)))
    return df.withColumns(added)


def ratio_features(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    return df.withColumns({f"{a}_{b}_ratio": F.try_divide(F.col(a), F.col(b)) for a, b in pairs})


def efficiency_features(df: DataFrame) -> DataFrame:
    added: dict[str, Column] = {}
    if _has(df, "WoBit", "RoPen", "BTBR"):
        torque = F.col("Torque") if _has(df, "Torque") else F.lit(0.0)
        work = F.col("WoBit") + F.lit(2 * math.pi) * F.col("BTBR") * torque
        added["MSE"] = F.try_divide(work, F.col("RoPen") + F.lit(EPSILON))
    if _has(df, "WoBit", "RoPen"):
        added["WOB_Efficiency"] = guarded_ratio("RoPen", "WoBit")
    if _has(df, "BTBR", "WoBit"):
        added["Torque_WOB_Ratio"] = guarded_ratio("BTBR", "WoBit")
    if _has(df, "FRate", "WBoPress"):
        added["Hydraulic_HP"] = hydraulic_horsepower("FRate", "WBoPress")
    if _has(df, "FRate", "WellDepth"):
        added["Flow_Efficiency"] = guarded_ratio("FRate", F.col("WellDepth") * F.lit(HOLE_VOLUME_FACTOR))
    return df.withColumns(added) if added else df


def simple_efficiency(df: DataFrame, wob: str, rop: str, rpm: str, torque: str | None = None) -> DataFrame:
    """Efficiency, specific energy and ROP per RPM; never negative, never infinite, 0 for a zero divisor."""
    turning = F.col(torque) if torque else F.col(wob)

    def bounded(c: Column) -> Column:
        return F.greatest(F.coalesce(finite(c), F.lit(0.0)), F.lit(0.0))

    return df.withColumns(
        {
            "drilling_efficiency": bounded(F.try_divide(F.col(rop), F.col(wob))),
            "mechanical_specific_energy": bounded(F.try_divide(F.col(rpm) * turning, F.col(rop))),
            "rop_per_rpm": bounded(F.try_divide(F.col(rop), F.col(rpm))),
        }
    )


def formation_features(df: DataFrame) -> DataFrame:
    added: dict[str, Column] = {}
    if _has(df, "FPress", "WellDepth"):
        added["FPress_Gradient"] = guarded_ratio("FPress", "WellDepth")
    if _has(df, "WBoPress", "FPress"):
        added["Overbalance"] = F.col("WBoPress") - F.col("FPress")
        added["Overbalance_Ratio"] = guarded_ratio("WBoPress", "FPress")
    if _has(df, "WoBit", "RoPen"):
        added["Formation_Strength"] = guarded_ratio("WoBit", "RoPen")
    if _has(df, "DPPress", "FPress"):
        added["DP_FP_Ratio"] = guarded_ratio("DPPress", "FPress")
    return df.withColumns(added) if added else df


def flow_balance(df: DataFrame) -> DataFrame:
    if not _has(df, "FIn", "FOut"):
        return df
    return df.withColumns(
        {"Flow_Balance": F.col("FOut") - F.col("FIn"), "Flow_Balance_Ratio": guarded_ratio("FOut", "FIn")}
    )


def depth_category(df: DataFrame, column: str = "WellDepth", name: str = "Depth_Category") -> DataFrame:
    """Shallow, Medium or Deep by the 33 % and 66 % quantiles; edges belong to the lower class."""
    shallow, deep = quantiles(df, [column], [0.33, 0.66])[column]
    if shallow is None:
        return df.withColumn(name, F.lit(None).cast("string"))
    d = F.col(column)
    label = F.when(d <= shallow, "Shallow").when(d <= deep, "Medium").when(d > deep, "Deep")
    return df.withColumn(name, label)


def depth_features(df: DataFrame, series: SeriesLike, depth: str = "WellDepth") -> DataFrame:
    from .ordered import cumulative_change

    if depth not in df.columns:
        return df
    out = depth_category(df, depth)
    out = out.withColumns(
        {f"{c}_per_Depth": guarded_ratio(c, depth) for c in ("FPress", "WBoPress", "HLoad") if c in df.columns}
    )
    return cumulative_change(out, series, depth, "Depth_Change", "Cumulative_Depth_Change")


def physics_features(df: DataFrame) -> DataFrame:
    added: dict[str, Column] = {}
    if _has(df, "FRate", "WBoPress"):
        root = F.when(F.col("WBoPress") >= 0, F.sqrt("WBoPress"))
        added["Hydraulic_Impact"] = F.col("FRate") * root
        added["Flow_Velocity"] = F.col("FRate") / F.lit(NOZZLE_DIVISOR)
    if _has(df, "WoBit", "HLoad"):
        added["Effective_WOB"] = F.col("WoBit") - F.col("HLoad") * F.lit(HOOK_LOAD_SHARE)
        added["Weight_Transfer_Efficiency"] = guarded_ratio("WoBit", "HLoad")
    if _has(df, "BTBR", "RoPen"):
        added["Specific_Torque"] = guarded_ratio("BTBR", "RoPen")
        if _has(df, "RPM"):
            added["Rotary_Power"] = F.col("BTBR") * F.col("RPM") / F.lit(ROTARY_DIVISOR)
    if _has(df, "WBoPress", "FPress", "DPPress"):
        added["Total_System_Pressure"] = F.col("WBoPress") + F.col("DPPress")
        added["Pressure_Efficiency"] = guarded_ratio("FPress", "WBoPress")
    return df.withColumns(added) if added else df


def notebook_formation_features(df: DataFrame) -> DataFrame:
    e = NOTEBOOK_EPSILON
    added: dict[str, Column] = {}
    if _has(df, "WellDepth", "MudWeight"):
        added["MudWeightGradient"] = F.col("MudWeight") * F.lit(PSI_TO_MUD_WEIGHT)
        added["HydrostaticPress"] = F.col("WellDepth") * F.col("MudWeight") * F.lit(PSI_TO_MUD_WEIGHT)
    if _has(df, "WoBit", "BTBR"):
        added["SpecificEnergy"] = guarded_ratio(F.col("WoBit") * F.lit(1000), "BTBR", e)
    if _has(df, "RoPen", "WoBit"):
        added["MechEfficiency"] = guarded_ratio("RoPen", "WoBit", e)
    if _has(df, "WBoPress", "WellDepth"):
        added["PressureGradient"] = guarded_ratio("WBoPress", "WellDepth", e)
    if _has(df, "Torque", "RoPen"):
        added["TorqueRatio"] = guarded_ratio("Torque", "RoPen", e)
    return df.withColumns(added) if added else df


def notebook_kick_features(df: DataFrame) -> DataFrame:
    added: dict[str, Column] = {}
    if _has(df, "FIn", "FOut"):
        added["FlowBalance"] = F.col("FOut") - F.col("FIn")
        added["FlowRatio"] = guarded_ratio("FOut", "FIn", NOTEBOOK_EPSILON)
        added["FlowImbalance"] = F.abs(F.col("FOut") - F.col("FIn"))
    if _has(df, "StandPipePress", "CasingPress"):
        added["PressureDiff"] = F.col("StandPipePress") - F.col("CasingPress")
    if _has(df, "SMSpeed", "HLoad"):
        added["PowerIndex"] = F.col("SMSpeed") * F.col("HLoad")
    return df.withColumns(added) if added else df


def zscore_flags(df: DataFrame, columns: Sequence[str], limit: float = 3.0) -> DataFrame:
    got = moments(df, columns, {"mean": F.avg, "std": F.stddev_samp})
    added: dict[str, Column] = {}
    for c in columns:
        z = F.try_divide(F.col(c) - F.lit(got[c]["mean"]), F.lit(got[c]["std"]).cast("double"))
        added[f"{c}_zscore"] = z
        added[f"{c}_is_outlier"] = F.coalesce(F.abs(z) > limit, F.lit(False))
    return df.withColumns(added)
