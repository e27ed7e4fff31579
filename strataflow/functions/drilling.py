"""Row-wise drilling formulas as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..channels import (
    EPSILON,
    HYDRAULIC_DIVISOR,
    PARAMETER_NAMES,
    PSI_TO_MUD_WEIGHT,
    TYPICAL_RANGES,
    UNIT_FACTORS,
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def guarded_ratio(a: Column | str, b: Column | str, eps: float = EPSILON) -> Column:
    """a / (b + eps), NULL where the guarded divisor is exactly zero."""
    return F.try_divide(col(a), col(b) + F.lit(eps))


def safe_divide(a: Column | str, b: Column | str, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(col(a), col(b)), F.lit(default))


def percentage_change(old: Column | str, new: Column | str) -> Column:
    """Change relative to the old magnitude; from zero it is infinite, or 0 if nothing changed."""
    old, new = col(old), col(new)
    from_zero = F.when(new != 0, F.lit(float("inf"))).when(new == 0, F.lit(0.0))
    return F.when(old == 0, from_zero).otherwise(F.try_divide(new - old, F.abs(old)) * 100)


def mechanical_specific_energy(wob, rop, torque, rpm, bit_diameter: float = 8.5) -> Column:
    area = math.pi * (bit_diameter / 2) ** 2
    turning = F.lit(2 * math.pi) * col(rpm) * col(torque)
    return col(wob) / F.lit(area) + F.try_divide(turning, col(rop) * F.lit(area) + F.lit(EPSILON))


def hydraulic_horsepower(flow, pressure) -> Column:
    return (col(flow) * col(pressure)) / F.lit(HYDRAULIC_DIVISOR)


def nozzle_velocity(flow, nozzle_area: float = 0.5) -> Column:
    return col(flow) / F.lit(nozzle_area)


def jet_impact(flow, nozzle_area: float = 0.5) -> Column:
    return col(flow) * nozzle_velocity(flow, nozzle_area) * F.lit(PSI_TO_MUD_WEIGHT)


def convert_units(value: Column | str, source: str, target: str) -> Column:
    forward, backward = f"{source}_to_{target}", f"{target}_to_{source}"
    if forward in UNIT_FACTORS:
        return col(value) * F.lit(UNIT_FACTORS[forward])
    if backward in UNIT_FACTORS:
        return col(value) / F.lit(UNIT_FACTORS[backward])
    raise ValueError(f"no conversion from {source} to {target}")


def range_check(parameter: str, value: Column | str) -> tuple[Column, Column]:
    """(valid, message) for a named drilling parameter; unknown names always pass."""
    known = PARAMETER_NAMES.get(parameter.lower())
    if known is None:
        return F.lit(True), F.lit(f"{parameter} is not a known parameter")
    low, high = TYPICAL_RANGES[known]
    v = col(value)
    message = (
        F.when(v < low, f"{parameter} below the normal range ({low}-{high})")
        .when(v > high, f"{parameter} above the normal range ({low}-{high})")
        .otherwise(f"{parameter} in the normal range")
    )
    return v.between(low, high), message


def in_range(value: Column | str, low: float | None = None, high: float | None = None) -> Column:
    ok = col(value).isNotNull()
    if low is not None:
        ok = ok & (col(value) >= low)
    if high is not None:
        ok = ok & (col(value) <= high)
    return ok
