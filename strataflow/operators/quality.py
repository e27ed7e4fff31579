"""Data-quality reports, scores and gates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..stats import gather, literal_table
from .profile import duplicate_summary

# fixed values: what each kind of data set needs
REQUIRED = {"formation": ["Depth", "FormationPressure", "MudWeight"], "kick": ["FlowRateIn", "FlowRateOut", "Kick"]}
NUMERIC_NAMES = {"depth", "pressure", "weight", "rate", "temperature"}
TIME_WORDS = ("time", "date")
MAX_DEPTH, MAX_PRESSURE = 15000, 20000


@dataclass(frozen=True)
class Rule:
    """A user check: a row condition that must hold everywhere, or an aggregate condition."""

    name: str
    condition: str
    severity: str = "warning"
    message: str = ""
    aggregate: bool = False


def _facts(df: DataFrame, data_type: str, rules: Sequence[Rule]) -> dict:
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    wanted = {"rows": F.count(F.lit(1))}
    missing = None
    for c in df.columns:
        part = F.count_if(F.col(c).isNull())
        missing = part if missing is None else missing + part
    wanted["missing"] = missing
    if data_type == "formation":
        for c, limit in (("Depth", MAX_DEPTH), ("FormationPressure", MAX_PRESSURE)):
            if c in numeric:
                wanted[f"{c}_negative"] = F.count_if(F.col(c) < 0)
                wanted[f"{c}_large"] = F.count_if(F.col(c) > limit)
    if data_type == "kick" and "Kick" in numeric:
        wanted["kick_rate"] = F.avg("Kick")
    for i, rule in enumerate(rules):
        condition = F.expr(rule.condition)
        wanted[f"rule{i}"] = condition if rule.aggregate else F.bool_and(F.coalesce(condition, F.lit(False)))
    got = gather(df, wanted)
    got["duplicates"] = duplicate_summary(df).first()["duplicate_rows"] or 0
    return got


def _percentages(df: DataFrame, got: dict) -> tuple[float, float]:
    cells = got["rows"] * len(df.columns)
    missing = 100.0 * (got["missing"] or 0) / cells if cells else 0.0
    duplicates = 100.0 * got["duplicates"] / got["rows"] if got["rows"] else 0.0
    return missing, duplicates


def _typed(df: DataFrame) -> list[str]:
    wrong = []
    for f in df.schema.fields:
        low = f.name.lower()
        if low in NUMERIC_NAMES:
            if not isinstance(f.dataType, T.NumericType):
                wrong.append(f.name)
        elif any(w in low for w in TIME_WORDS) and not isinstance(
            f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)
        ):
            wrong.append(f.name)
    return wrong


def quality_checks(df: DataFrame, data_type: str = "general", rules: Sequence[Rule] = ()) -> tuple[list[tuple], float]:
    """Report rows ``(check, outcome, value, message)`` and the 0..100 score."""
    got = _facts(df, data_type, rules)
    missing, duplicates = _percentages(df, got)
    report: list[tuple] = []
    performed, passed = 0, 0.0

    def note(check: str, outcome: str, value: float | None, message: str = "", credit: float | None = None) -> None:
        nonlocal passed
        report.append((check, outcome, None if value is None else float(value), message))
        passed += credit if credit is not None else float(outcome == "passed")

    performed += 1
    if missing < 1:
        note("missing", "passed", missing)
    elif missing < 5:
        note("missing", "warning", missing, credit=0.5)
    elif missing < 15:
        note("missing", "warning", missing)
    else:
        note("missing", "issue", missing)

    performed += 1
    if got["duplicates"] == 0:
        note("duplicates", "passed", 0.0)
    elif duplicates < 1:
        note("duplicates", "warning", duplicates, credit=0.5)
    else:
        note("duplicates", "issue", duplicates)

    performed += 1
    wrong = _typed(df)
    if not wrong:
        note("types", "passed", 0.0)
    for c in wrong:
        note("types", "warning", None, c)

    if data_type in REQUIRED:
        performed += 1
        absent = [c for c in REQUIRED[data_type] if c not in df.columns]
        note("required_columns", "issue" if absent else "passed", float(len(absent)), ", ".join(absent))
    if data_type == "formation":
        performed += 1
        physical = [k for k in ("Depth_negative", "Depth_large", "FormationPressure_negative", "FormationPressure_large") if got.get(k)]
        if not physical:
            note("physical_range", "passed", 0.0)
        for k in physical:
            note("physical_range", "warning", float(got[k]), k)
    if data_type == "kick" and "Kick" in df.columns:
        performed += 1
        rate = got.get("kick_rate")
        if rate is not None and 0.01 <= rate <= 0.15:
            note("kick_rate", "passed", rate)
        elif rate is not None and (rate < 0.005 or rate > 0.20):
            note("kick_rate", "warning", rate)
    for i, rule in enumerate(rules):
        performed += 1
        ok = bool(got[f"rule{i}"])
        failed = "issue" if rule.severity == "error" else "warning"
        note(rule.name, "passed" if ok else failed, None, rule.message)

    issues = sum(r[1] == "issue" for r in report)
    warnings = sum(r[1] == "warning" for r in report)
    score = 100.0 * passed / performed - 10 * issues - 3 * warnings
    return report, float(max(0.0, min(100.0, score)))


def quality_report(df: DataFrame, data_type: str = "general", rules: Sequence[Rule] = ()) -> DataFrame:
    """The checks as rows, followed by a ``score`` row."""
    report, score = quality_checks(df, data_type, rules)
    rows = [*report, ("score", "score", score, "")]
    return literal_table(df.sparkSession, rows, "check string, outcome string, value double, message string")


def simple_quality(df: DataFrame, data_type: str = "general") -> dict:
    """The second weighting: 100 less 15 per issue and 5 per warning."""
    got = _facts(df, data_type, ())
    missing, duplicates = _percentages(df, got)
    issues, warnings = 0, 0
    issues += missing > 10
    warnings += 5 < missing <= 10
    if got["duplicates"]:
        issues += duplicates > 5
        warnings += duplicates <= 5
    if data_type in REQUIRED:
        issues += any(c not in df.columns for c in REQUIRED[data_type])
    if data_type == "formation":
        issues += bool(got.get("Depth_negative"))
        warnings += bool(got.get("Depth_large"))
    if data_type == "kick" and got.get("kick_rate") is not None:
        warnings += got["kick_rate"] < 0.01 or got["kick_rate"] > 0.20
    score = max(0, min(100, 100 - 15 * issues - 5 * warnings))
    return {"rows": got["rows"], "issues": int(issues), "warnings": int(warnings), "score": int(score)}


def detect_data_type(df: DataFrame) -> str:
    if "FormationPressure" in df.columns:
        return "formation"
    return "kick" if "Kick" in df.columns else "general"


def is_valid_dataset(df: DataFrame, data_type: str = "auto") -> bool:
    kind = detect_data_type(df) if data_type == "auto" else data_type
    q = simple_quality(df, kind)
    return q["score"] >= 70 and q["issues"] == 0 and q["rows"] > 10
