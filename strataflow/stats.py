"""Whole-table statistics: one aggregation for many columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def gather(df: DataFrame, expressions: Mapping[object, Column]) -> dict:
    """Run all aggregate expressions in a single job and return them by name."""
    if not expressions:
        return {}
    names = list(expressions)
    row: Row = df.agg(*[expressions[n].alias(f"a{i}") for i, n in enumerate(names)]).first()
    return {n: row[i] for i, n in enumerate(names)}


def moments(df: DataFrame, columns: Iterable[str], kinds: Mapping[str, object]) -> dict[str, dict]:
    """``{column: {kind: value}}`` for aggregate functions taking one column."""
    columns = list(columns)
    got = gather(df, {f"{c}\0{k}": f(F.col(c)) for c in columns for k, f in kinds.items()})
    return {c: {k: got[f"{c}\0{k}"] for k in kinds} for c in columns}


def most_frequent(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Most frequent value per column; ties go to the smallest value."""
    found = {}
    for c in columns:
        top = (
            df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
            .orderBy(F.desc("_n"), F.asc(c)).limit(1).collect()
        )
        found[c] = top[0][0] if top else None
    return found


def literal_table(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A report whose size depends on the number of columns, not of rows."""
    return spark.createDataFrame(rows, schema)
