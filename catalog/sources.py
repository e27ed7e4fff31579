"""Source and sink queries: the given tables written to a format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataflow.models import evaluate, supervised
from strataflow.models.pressure import LinearModel
from strataflow.operators.clean import coerce_numeric_text
from strataflow.sources import files

from .base import EVENTS_SQL, line, query, r, rounded, table, tele, workdir


@query("a01_csv_with_encoding", sql="SELECT c_custkey, c_name || ' é' AS c_name, c_acctbal FROM customer")
def a01(spark, sf):
    path = workdir(spark)
    df = table(spark, sf, "customer").select("c_custkey", F.concat("c_name", F.lit(" é")).alias("c_name"), "c_acctbal")
    df.write.option("header", True).option("encoding", "iso-8859-1").csv(path)
    return files.read_formation_csv(spark, path).withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("a02_kick_csv", sql="""
SELECT o_orderkey, (o_orderstatus = 'F')::INT AS Kick, epoch_us(o_orderdate) AS stamp, o_totalprice AS Flow_Rate FROM orders""")
def a02(spark, sf):
    path = workdir(spark)
    table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("IsKick"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("Timestamp"), F.col("o_totalprice").alias("Flow Rate"),
    ).write.option("header", True).csv(path)
    df = files.read_kick_csv(spark, path)
    return df.select(
        F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("Kick").cast("int").alias("Kick"),
        F.unix_micros("Timestamp").alias("stamp"), "Flow_Rate",
    )


@query("a03_many_csv", sql="""
SELECT c_custkey AS id, c_acctbal AS balance, NULL::INT AS Kick, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_suppkey, s_acctbal, s_nationkey, NULL FROM supplier""")
def a03(spark, sf):
    path = workdir(spark)
    table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")
    ).write.option("header", True).csv(f"{path}/formation")
    table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("KICK")
    ).write.option("header", True).csv(f"{path}/kick")
    df = files.read_many_csv(spark, f"{path}/*/*.csv", "kick")
    return df.select(F.col("id").cast("long").alias("id"), "balance", F.col("Kick").cast("int").alias("Kick"), "segment")


@query("a05_json_envelope", sql="SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def a05(spark, sf):
    path = workdir(spark)
    # one landed document per row group of an order line: {"data": [record]}
    record = F.struct("l_orderkey", "l_linenumber", "l_quantity")
    line(spark, sf).select(F.array(record).alias("data")).write.json(path)
    df = files.read_json_records(spark, path, lines=True)
    return df.select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), "l_quantity")


@query("a06_las_logs", sql=f"""
WITH {EVENTS_SQL} SELECT 'W-' || user_id AS well_name, CAST(event_id AS DOUBLE) AS depth, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS GR, k AS RHOB FROM tele""")
def a06(spark, sf):
    path = workdir(spark)
    e = tele(spark, sf, "event_id", "user_id", "event_type", "value", "k")
    e = e.withColumn("part", F.floor(F.col("event_id") / 50_000))
    gr = F.when(F.col("event_type") == "error", F.lit("-999.25")).otherwise(F.col("value").cast("string"))
    body = e.select(
        "user_id", "part", F.lit(99).alias("rank"), "event_id",
        F.concat_ws("  ", F.col("event_id").cast("double").cast("string"), gr, F.col("k").cast("string")).alias("text"),
    )
    head = [
        "~VERSION INFORMATION", "VERS.   2.0 : CWLS LOG ASCII STANDARD", "WRAP.   NO  : ONE LINE PER DEPTH STEP", "~WELL INFORMATION",
        "NULL.   -999.25 : NULL VALUE", "WELL.   W-{well} : WELL NAME", "LOC.    FIELD 7 : LOCATION", "~CURVE INFORMATION",
        "DEPT.M  : depth", "GR.API  : gamma ray", "RHOB.K/M3 : bulk density", "~ASCII",
    ]
    lines = F.array(*[
        F.struct(F.lit(i).alias("rank"), F.regexp_replace(F.lit(t), r"\{well\}", F.col("user_id").cast("string")).alias("text"))
        for i, t in enumerate(head)
    ])
    top = e.select("user_id", "part").distinct().select("user_id", "part", F.explode(lines).alias("h")).select(
        "user_id", "part", "h.rank", F.lit(0).cast("long").alias("event_id"), "h.text"
    )
    # many logs a file: one file for each would cost more than its rows
    logs = body.unionByName(top).repartition("user_id", "part").sortWithinPartitions("user_id", "part", "rank", "event_id")
    logs.select("text").write.text(path)
    return files.las_table(files.read_las(spark, path), ["GR", "RHOB"]).select("well_name", "depth", "GR", "RHOB")


@query("a07_configured_source", sql="SELECT o_orderkey, o_totalprice FROM orders")
def a07(spark, sf):
    return files.load_configured(spark, {"type": "format", "format": "parquet", "path": f"{sf}/orders.parquet"}).select("o_orderkey", "o_totalprice")


@query("a08_sinks", sql="""
SELECT 'csv' AS format, count(*) AS "rows", round(sum(c_acctbal), 2) + 0.0 AS balance FROM customer
UNION ALL SELECT 'parquet', count(*), round(sum(c_acctbal), 2) + 0.0 FROM customer
UNION ALL SELECT 'json', count(*), round(sum(c_acctbal), 2) + 0.0 FROM customer""")
def a08(spark, sf):
    root, out = workdir(spark), None
    df = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    for fmt, codec in (("csv", "gzip"), ("parquet", "zstd"), ("json", None)):
        path = files.write_table(df, f"{root}/{fmt}", fmt, codec, ["c_mktsegment"])
        back = spark.read.option("header", True).format(fmt).load(path)
        part = back.agg(
            F.lit(fmt).alias("format"), F.count(F.lit(1)).alias("rows"),
            (F.round(F.sum(F.col("c_acctbal").cast("double")), 2) + 0.0).alias("balance"),
        ).select("format", "rows", "balance")
        out = part if out is None else out.unionByName(part)
    return out


@query("a09_score_files", sql=f"""
WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem),
p AS (SELECT l_returnflag AS source, i + s * l_quantity AS p FROM lineitem, f)
SELECT source, count(*) AS count, {r('avg(p)', 3)} AS mean, {r('stddev_pop(p)', 3)} AS std, {r('min(p)', 3)} AS min, {r('max(p)', 3)} AS max FROM p GROUP BY source""")
def a09(spark, sf):
    path = workdir(spark)
    df = line(spark, sf, "l_quantity", "l_extendedprice", "l_returnflag")
    model = supervised.fit_regressor(df, ["l_quantity"], "l_extendedprice", "linear")
    df.withColumn("source", F.col("l_returnflag")).write.option("header", True).partitionBy("source").csv(path)
    landed = coerce_numeric_text(files.read_csv(spark, path), ["l_quantity", "l_extendedprice"])
    return rounded(evaluate.score_files(model, landed, "source"), 3)


@query("a09_score_file_errors", sql=f"""
WITH p AS (SELECT l_returnflag || '.csv' AS source_file, 2 * l_quantity + 1 AS p FROM lineitem WHERE l_returnflag <> 'R')
SELECT source_file, count(*) AS count, {r('avg(p)', 3)} AS mean, {r('max(p)', 3)} AS max, CAST(NULL AS VARCHAR) AS error FROM p GROUP BY source_file
UNION ALL SELECT 'R.csv', NULL, NULL, NULL, count(*) || ' rows with values that are no numbers' FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49
UNION ALL SELECT 'other.csv', NULL, NULL, NULL, 'no column l_quantity'""")
def a09_errors(spark, sf):
    """Good files in several parts beside one with words among its numbers and one without the column."""
    path = workdir(spark)
    df = line(spark, sf, "l_quantity", "l_extendedprice", "l_returnflag")
    told = F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 49), "much").otherwise(F.col("l_quantity").cast("string"))
    for flag in ("A", "N", "R"):
        own = df.where(F.col("l_returnflag") == flag).select("l_extendedprice", told.alias("l_quantity"))
        own.write.option("header", True).csv(f"{path}/{flag}.csv")
    df.select("l_extendedprice").limit(5).coalesce(1).write.option("header", True).csv(f"{path}/other.csv")
    model = LinearModel("pls", ["l_quantity"], "p", 1.0, [2.0])
    summary, errors = evaluate.score_csv_files(spark, f"{path}/*.csv", model, ["l_quantity"], folders=True)
    none = F.lit(None).cast("string").alias("error")
    good = rounded(summary.select("source_file", "count", "mean", "max"), 3).select("*", none)
    return good.unionByName(errors, allowMissingColumns=True)
