"""Registry of the queries offered to the driver, with their SQL counterparts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.series import Series
from strataflow.session import checkpoint_root

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise KeyError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    # the tables' timestamps carry no zone and the SQL side reads them as UTC
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def workdir(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder for files a query writes."""
    return f"{checkpoint_root(spark)}/run-{uuid.uuid4().hex}"


def rounded(df: DataFrame, digits: int = 6, only: Iterable[str] | None = None) -> DataFrame:
    """Round computed doubles; adding zero turns a negative zero into zero."""
    chosen = list(only) if only is not None else [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in chosen})


def r(expression: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0"


# ---- inputs: the driver's tables under drilling channel names -------------------

WELL = Series("user_id", ("ts", "event_id"))

EVENTS_SQL = """
tele AS (
  SELECT event_id, ts, user_id, event_type, value,
         CAST(regexp_extract(props, ':[ ]*([0-9]+)', 1) AS DOUBLE) AS k
  FROM events)"""


def tele(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Event samples as a two-channel series per user."""
    e = table(spark, sf, "events")
    out = e.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )
    return out.select(*columns) if columns else out


LINE_SQL = """
line AS (
  SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus
  FROM lineitem)"""


def line(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    chosen = columns or (
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus",
    )
    return table(spark, sf, "lineitem").select(*chosen)


CHANNELS_SQL = """
drill AS (
  SELECT l_extendedprice AS WellDepth, l_quantity AS WoBit, l_tax AS RoPen, l_discount AS BTBR,
         l_extendedprice * (1.0::DOUBLE - l_discount) AS WBoPress, l_extendedprice * 0.4::DOUBLE AS FPress,
         CAST(l_linenumber AS DOUBLE) AS HLoad, l_quantity * l_tax AS DPPress,
         l_quantity + l_linenumber AS FRate, l_quantity * l_linenumber AS RPM,
         l_discount * 100.0::DOUBLE AS MudWeight
  FROM lineitem)"""


def drill(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Order lines as one wide sample of drilling channels."""
    li = table(spark, sf, "lineitem")
    price, quantity, tax, discount = (F.col(f"l_{c}") for c in ("extendedprice", "quantity", "tax", "discount"))
    number = F.col("l_linenumber").cast("double")
    channels: dict[str, Column] = {
        "WellDepth": price, "WoBit": quantity, "RoPen": tax, "BTBR": discount,
        "WBoPress": price * (F.lit(1.0) - discount), "FPress": price * F.lit(0.4), "HLoad": number,
        "DPPress": quantity * tax, "FRate": quantity + number, "RPM": quantity * number,
        "MudWeight": discount * F.lit(100.0),
    }
    return li.select(*[channels[c].alias(c) for c in (columns or channels)])


GAPS_SQL = """
gaps AS (
  SELECT l_orderkey, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_quantity END AS qty,
         CASE WHEN l_linenumber = 2 THEN NULL ELSE l_extendedprice END AS price,
         CASE WHEN l_linenumber = 3 THEN NULL ELSE l_returnflag END AS flag
  FROM lineitem)"""


def gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines with missing quantities, prices and flags."""
    n = F.col("l_linenumber")
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        F.when(n != 1, F.col("l_quantity")).alias("qty"),
        F.when(n != 2, F.col("l_extendedprice")).alias("price"),
        F.when(n != 3, F.col("l_returnflag")).alias("flag"),
    )


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def each(template: str, names: Iterable[str], joiner: str = ", ") -> str:
    return joiner.join(template.format(c=c) for c in names)
