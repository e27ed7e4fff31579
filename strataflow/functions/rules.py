"""Alert, validation and advice rules as Column expressions over rule tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..channels import MUD_WEIGHT_MARGIN, NORMAL_GRADIENT, PSI_TO_MUD_WEIGHT
from .drilling import col

# --- fixed values: limits, texts and levels that have to equal the published ones ---
KICK_ALERT_PROBABILITY = 0.7
KICK_CRITICAL_PROBABILITY = 0.9
HIGH_PRESSURE_PSI = 5000
LOW_CONFIDENCE = 0.6
ALERT_RETENTION = 1000
ALERT_TYPES = ["KICK_DETECTION", "HIGH_PRESSURE", "LOW_CONFIDENCE"]
REQUIRED_INPUTS = {
    "formation_pressure": ["Depth", "MudWeight"],
    "kick_detection": ["FlowRateIn", "FlowRateOut", "StandpipePressure"],
}
INPUT_LIMITS = {
    "formation_pressure": [
        ("Depth", None, 10000, "Profondeur trop importante (max 10000m)"),
        ("MudWeight", 0.8, 3.0, "Densité de boue hors limites (0.8-3.0)"),
    ],
    "kick_detection": [
        ("FlowRateIn", None, 1000, "Débit d'entrée trop élevé (max 1000 L/min)"),
        ("StandpipePressure", None, 500, "Pression standpipe trop élevée (max 500 bar)"),
    ],
}
MISSING_FIELD = "Champ obligatoire manquant: "
NOT_A_NUMBER = "Type invalide pour {field}, attendu: nombre"
NEGATIVE_VALUE = "Valeur négative non autorisée pour "
INVALID_VALUE = "Valeur invalide pour "
REQUEST_LIMITS = {"well_depth": 50000, "rop": 500}
REQUEST_FIELDS = ["well_depth", "wob", "rop", "torque", "standpipe_pressure", "hook_load"]
KICK_REQUEST_FIELDS = ["flow_in", "flow_out", "active_pit_volume"]
EMERGENCY_ACTIONS = [
    "1. STOP DRILLING - Cease all drilling operations immediately",
    "2. PICK UP OFF BOTTOM - Lift drill string off bottom",
    "3. CHECK FLOW - Verify mud returns and flow rates",
    "4. CLOSE BOP if necessary - Activate blowout preventers",
    "5. CIRCULATE KICK OUT - Follow proper kick circulation procedures",
    "6. MONITOR PRESSURES - Watch standpipe and annular pressures",
    "7. WEIGH UP MUD - Calculate and mix heavier mud weight",
    "8. NOTIFY SUPERVISION - Alert drilling supervisor and company representative",
]
ADVICE_HIGH = "High pressure zone detected - consider reducing ROP and increasing circulation rate"
ADVICE_LOW = "Low pressure zone - monitor for lost circulation"
ADVICE_NORMAL = "Normal pressure gradient - continue current operations"
ADVICE_ROP = "Consider reducing ROP in high-pressure formation"
WATCH_FLOW = "Monitor flow rates closely - significant imbalance detected"
WATCH_SCORE = "Increase monitoring frequency - elevated anomaly score"
WATCH_STOP = "Consider stopping drilling operations for assessment"
WATCH_NORMAL = "Continue normal drilling operations with standard monitoring"
SERIES_ADVICE = [
    ("mud_weight", "HIGH", "Formation pressure approaching mud weight - increase for safety",
     "Increase mud weight to maintain adequate overbalance"),
    ("drilling_parameters", "MEDIUM", "High pressure gradient indicates harder formation",
     "Consider increasing WOB for better penetration"),
    ("circulation", "MEDIUM", "High formation pressure detected",
     "Optimize flow rate for better hole cleaning and pressure control"),
    ("alert", "HIGH", "Rapid formation pressure changes detected",
     "Monitor closely for potential formation change or drilling issues"),
]
# --- end of fixed values ---


def alert_level(prediction: Column | str, probability: Column | str) -> Column:
    """LOW to CRITICAL from a 0/1 prediction and its (possibly missing) probability."""
    p, q = col(prediction), col(probability)
    known = q.isNotNull() & (q != 0)
    return (
        F.when((p == 0) & known & (q > 0.3), "MEDIUM")
        .when(p == 0, "LOW")
        .when(known & (q >= 0.8), "CRITICAL")
        .when(known & (q >= 0.6), "HIGH")
        .when(known, "MEDIUM")
        .otherwise("HIGH")
    )


def alert_type(model_type, kick_probability, pressure, confidence) -> Column:
    """Kind of alert a prediction raises; a low confidence overrides the others."""
    kind, q, p, c = col(model_type), col(kick_probability), col(pressure), col(confidence)
    return (
        F.when((c != 0) & (c < LOW_CONFIDENCE), "LOW_CONFIDENCE")
        .when((kind == "kick_detection") & (q >= KICK_ALERT_PROBABILITY), "KICK_DETECTION")
        .when((kind == "formation_pressure") & (p > HIGH_PRESSURE_PSI), "HIGH_PRESSURE")
    )


def alert_severity(kind: Column | str, kick_probability: Column | str) -> Column:
    k = col(kind)
    return (
        F.when(k == "LOW_CONFIDENCE", "MEDIUM")
        .when((k == "KICK_DETECTION") & (col(kick_probability) >= KICK_CRITICAL_PROBABILITY), "CRITICAL")
        .when(k.isNotNull(), "HIGH")
    )


def pressure_category(pressure: Column | str, depth: Column | str) -> Column:
    ratio = F.try_divide(F.try_divide(col(pressure), col(depth)), F.lit(NORMAL_GRADIENT))
    return F.when(ratio > 1.2, "High").when(ratio < 0.8, "Low").otherwise("Normal")


def recommended_mud_weight(pressure: Column | str) -> Column:
    return col(pressure) * F.lit(PSI_TO_MUD_WEIGHT) + F.lit(MUD_WEIGHT_MARGIN)


def formation_advice(pressure, depth, rop, standpipe_pressure) -> Column:
    """Array of advice texts for one pressure prediction."""
    needed = recommended_mud_weight(pressure)
    current = col(standpipe_pressure) * F.lit(PSI_TO_MUD_WEIGHT) / F.lit(100)
    gradient = F.try_divide(col(pressure), col(depth))
    raise_mud = F.format_string("Increase mud weight to %.1f ppg for adequate overbalance", needed)
    return F.array_compact(
        F.array(
            F.when(needed > current + MUD_WEIGHT_MARGIN, raise_mud),
            F.when(gradient > 0.6, ADVICE_HIGH).when(gradient < 0.3, ADVICE_LOW).otherwise(ADVICE_NORMAL),
            F.when((gradient > 0.5) & (col(rop) > 20), ADVICE_ROP),
        )
    )


def kick_score(raw: Column | str) -> Column:
    """Raw anomaly score mapped to 0..1 by a tenth, clipped."""
    return F.least(F.greatest(col(raw) / F.lit(10.0), F.lit(0.0)), F.lit(1.0))


def risk_level(score: Column | str) -> Column:
    s = col(score)
    return F.when(s > 0.8, "Critical").when(s > 0.6, "High").when(s > 0.4, "Medium").otherwise("Low")


def confidence_level(score: Column | str, prediction: Column | str) -> Column:
    s = col(score)
    return (
        F.when(s > 0.8, "High")
        .when(s > 0.6, F.when(col(prediction) == 1, "High").otherwise("Medium"))
        .when(s > 0.4, "Medium")
        .otherwise("Low")
    )


def monitoring_advice(score: Column | str, flow_balance: Column | str) -> Column:
    s = col(score)
    found = F.array_compact(
        F.array(
            F.when(F.abs(col(flow_balance)) > 10, WATCH_FLOW),
            F.when(s > 0.5, WATCH_SCORE),
            F.when(s > 0.6, WATCH_STOP),
        )
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(WATCH_NORMAL)))


def emergency_actions(prediction: Column | str) -> Column:
    return F.when(col(prediction) == 1, F.array(*[F.lit(a) for a in EMERGENCY_ACTIONS]))


def input_problem(columns: Mapping[str, str], task: str) -> Column:
    """First failed check of a request row, NULL when it is valid.

    ``columns`` maps each column to its Spark type name; text columns are read as
    numbers, so a text that is no number is reported as such.
    """
    if task not in REQUIRED_INPUTS:
        return F.lit(f"Type de modèle non supporté: {task}")
    checks = []
    for field in REQUIRED_INPUTS[task]:
        if field not in columns:
            return F.lit(MISSING_FIELD + field)
        value = _number(field, columns[field])
        checks += [
            F.when(F.col(field).isNull(), MISSING_FIELD + field),
            F.when(value.isNull(), NOT_A_NUMBER.format(field=field)),
            F.when(value < 0, NEGATIVE_VALUE + field),
        ]
    for field, low, high, message in INPUT_LIMITS[task]:
        value = _number(field, columns[field])
        if low is not None:
            checks.append(F.when((value < low) | (value > high), message))
        else:
            checks.append(F.when(value > high, message))
    return F.coalesce(*checks)


def _number(field: str, kind: str) -> Column:
    return F.col(field).try_cast("double") if kind == "string" else F.col(field).cast("double")


def finite_problem(columns: Sequence[str]) -> Column:
    """First column holding NaN or an infinity."""
    bad = [
        F.when(F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")), INVALID_VALUE + c)
        for c in columns
    ]
    return F.coalesce(*bad)


def request_problem(columns: Sequence[str], kick: bool = False) -> Column:
    """First failed check of an API-style request row: required, non-negative, within limits."""
    checks = []
    for field in REQUEST_FIELDS + (KICK_REQUEST_FIELDS if kick else []):
        if field not in columns:
            return F.lit(MISSING_FIELD + field)
        checks += [F.when(F.col(field).isNull(), MISSING_FIELD + field), F.when(F.col(field) < 0, NEGATIVE_VALUE + field)]
        if field in REQUEST_LIMITS:
            checks.append(F.when(F.col(field) > REQUEST_LIMITS[field], INVALID_VALUE + field))
    return F.coalesce(*checks)
