"""Channel names, default values and missing-value rules for drilling telemetry."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: these have to equal the published ones for results to agree ---
EPSILON = 1e-8
NOTEBOOK_EPSILON = 1e-6
NORMAL_GRADIENT = 0.433
SEAWATER_GRADIENT = 0.445
PORE_GRADIENT = 0.465
PSI_TO_MUD_WEIGHT = 0.052
MUD_WEIGHT_MARGIN = 0.5
HYDRAULIC_DIVISOR = 1714
ROTARY_DIVISOR = 5252
NOZZLE_DIVISOR = 100
HOLE_VOLUME_FACTOR = 0.1
HOOK_LOAD_SHARE = 0.1

UNIT_FACTORS = {
    "bar_to_psi": 14.5038,
    "psi_to_bar": 0.068948,
    "ft_to_m": 0.3048,
    "m_to_ft": 3.28084,
    "gpm_to_lpm": 3.78541,
    "lpm_to_gpm": 0.264172,
}
TYPICAL_RANGES = {
    "mud_weight_ppg": (8.0, 20.0),
    "rop_ft_hr": (5.0, 200.0),
    "wob_klbs": (5.0, 80.0),
    "rpm": (50.0, 250.0),
    "flow_rate_gpm": (100.0, 800.0),
}
PARAMETER_NAMES = {
    "mudweight": "mud_weight_ppg",
    "mud_weight": "mud_weight_ppg",
    "rop": "rop_ft_hr",
    "rate_of_penetration": "rop_ft_hr",
    "wob": "wob_klbs",
    "weight_on_bit": "wob_klbs",
    "rpm": "rpm",
    "flowrate": "flow_rate_gpm",
    "flow_rate": "flow_rate_gpm",
}
FORMATION_CHANNELS = ["WellDepth", "BTBR", "WBoPress", "HLoad", "WoBit", "RoPen", "DPPress"]
FORMATION_TARGET = "FPress"
KICK_CHANNELS = [
    "FRate", "SMSpeed", "FIn", "FOut", "MRFlow", "ActiveGL", "ATVolume", "ROPenetration",
    "WOBit", "HLoad", "WBoPressure", "BTBR", "ATMPV", "ATMYP", "WellDepth",
]
PRESSURE_DEFAULTS = {
    "Depth": 1000.0, "MudWeight": 1.2, "Temperature": 25.0, "Porosity": 0.15, "Permeability": 100.0,
}
KICK_DEFAULTS = {
    "FlowRateIn": 350.0, "FlowRateOut": 350.0, "StandpipePressure": 200.0, "CasingPressure": 50.0,
    "MudWeight": 1.2, "HookLoad": 180.0, "RPM": 120.0, "Torque": 15.0, "ROP": 10.0,
}
DOMAIN_WEIGHTS = {
    "WoBit": 1.0, "RoPen": 1.0, "BTBR": 1.0, "WBoPress": 0.9, "FPress": 0.9,
    "FRate": 0.8, "FIn": 0.8, "FOut": 0.8, "MRFlow": 0.7, "ActiveGL": 0.9,
    "HLoad": 0.7, "SMSpeed": 0.6, "WellDepth": 0.9, "DPPress": 0.8,
    "MSE": 0.9, "WOB_Efficiency": 0.8, "Flow_Balance": 0.9, "Overbalance": 0.8,
}
LABEL_NAMES = ["kick", "KICK", "Kick_Flag", "IsKick"]
REQUEST_TO_CHANNEL = {
    "well_depth": "WellDepth", "wob": "WoBit", "rop": "RoPen", "torque": "BTBR",
    "standpipe_pressure": "WBoPress", "hook_load": "HLoad", "differential_pressure": "DPPress",
    "flow_in": "FIn", "flow_out": "FOut", "active_pit_volume": "ActiveGL",
    "mud_return_flow": "MRFlow", "block_speed": "SMSpeed",
}
KICK_TO_FORMATION_DIALECT = {"WOBit": "WoBit", "ROPenetration": "RoPen", "WBoPressure": "WBoPress"}
# --- end of fixed values ---


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def rename_channels(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename the columns that occur in ``names``; others stay as they are."""
    present = {old: new for old, new in names.items() if old in df.columns and new not in df.columns}
    return df.withColumnsRenamed(present)


def finite(column: Column | str) -> Column:
    """NaN and infinities become NULL, which is this library's only missing marker.

    NaN sorts above infinity, so one comparison covers both.
    """
    if isinstance(column, str):
        return F.expr(f"CASE WHEN abs(`{column}`) < double('Infinity') THEN `{column}` END")
    return F.when(F.abs(column.cast("double")) < F.lit(float("inf")), column)


def drop_nonfinite(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    fractional = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    chosen = [c for c in (columns if columns is not None else df.columns) if c in fractional]
    return df.withColumns({c: finite(c) for c in chosen}) if chosen else df
