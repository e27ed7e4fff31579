"""File, JSON, LAS and JDBC sources, and sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..channels import LABEL_NAMES
from ..operators.clean import basic_clean, parse_timestamps
from ..session import materialise
from ..stats import gather

# fixed value: utf-8 is tried first; latin-1 (iso-8859-1) reads any byte, so it ends the search
ENCODINGS = ["utf-8", "iso-8859-1"]
FORMATS = ("csv", "parquet", "json")
#: Files whose header lines are sent to every task.
FEW_FILES = 100_000


def detect_encoding(spark: SparkSession, paths: str | Sequence[str]) -> str:
    """utf-8 unless some line is not valid UTF-8."""
    lines = spark.read.text(paths)
    bad = gather(lines, {"bad": F.bool_or(~F.is_valid_utf8("value"))})["bad"]
    return ENCODINGS[1] if bad else ENCODINGS[0]


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | None = None, encoding: str | None = None) -> DataFrame:
    """Raw CSV with a header; without a schema every column is text."""
    found = encoding or detect_encoding(spark, paths)
    reader = spark.read.option("header", True).option("encoding", found)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(paths if isinstance(paths, str) else list(paths))


def read_formation_csv(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    return basic_clean(read_csv(spark, paths, schema))


def read_kick_csv(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """Label aliases become ``Kick``, a ``Timestamp`` column is parsed, then basic cleaning."""
    df = read_csv(spark, paths, schema)
    if "Kick" not in df.columns:
        alias = next((n for n in LABEL_NAMES if n in df.columns), None)
        if alias:
            df = df.withColumnRenamed(alias, "Kick")
    if "Timestamp" in df.columns:
        df = parse_timestamps(df, "Timestamp")
    return basic_clean(df)


def read_checked_csv(spark: SparkSession, pattern: str, numbers: Sequence[str], folders: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, errors): the numeric columns of all sound files with their source_file, and why the other files are not.

    One read of all files as lines; every file's own header says where a column stands, so files may order them
    differently and have others besides. A file without one of the columns, or with a value in one that is no number,
    is an error as a whole (source_file, error). Empty values are null. A record stands on one line.
    With ``folders`` a folder's part files are one file, told by the folder's name; each has a header of its own.
    Only the table of headers, one row a file, meets the lines, which are neither sorted nor shuffled for it.
    """
    lines = spark.read.text(pattern).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"),
    ).where(F.trim("value") != "")
    # numbers alone are compared: a minimum of whole lines would sort them all
    first = materialise(lines.where("start = 0").groupBy("path").agg(F.min("id").alias("first")))
    few = first.count() <= FEW_FILES
    small = F.broadcast if few else (lambda df: df)
    first = materialise(lines.select("id", "value").join(small(first), F.col("id") == F.col("first")).select("path", "first", F.col("value").alias("header")))
    widest = first.agg(F.max(F.size(F.split("header", ",")))).first()[0] or 1

    def fields(line: Column) -> Column:
        """The values of a line by place; quoted values may hold commas."""
        parsed = F.from_csv(line, ", ".join(f"f{i} string" for i in range(widest)))
        return F.array(*[F.trim(parsed[f"f{i}"]) for i in range(widest)])

    whole = F.regexp_replace("path", "/[^/]*$", "") if folders else F.col("path")
    asked = F.array(*[F.lit(c) for c in numbers])
    files = first.withColumn("whole", whole).withColumn("names", fields(F.col("header"))).withColumn("lacking", F.array_except(asked, "names"))
    absent = files.where(F.size("lacking") > 0).groupBy("whole").agg(F.array_intersect(asked, F.flatten(F.collect_set("lacking"))).alias("lacking"))
    read = files.join(absent.select("whole"), "whole", "left_anti").select("path", "whole", "first", "names")
    values = lines.join(small(read), "path").where(F.col("id") != F.col("first")).withColumn("at", fields(F.col("value")))
    told = values.select("whole", *[F.get("at", F.array_position("names", c).cast("int") - 1).alias(c) for c in numbers])
    empty = lambda c: F.col(c).isNull() | (F.col(c) == "")
    wrong = F.lit(False)
    for c in numbers:
        wrong = wrong | (~empty(c) & F.expr(f"try_cast(`{c}` AS DOUBLE)").isNull())
    name = F.element_at(F.split("whole", "/"), -1).alias("source_file")
    bad = told.where(wrong).groupBy("whole").agg(F.count(F.lit(1)).alias("n"))
    lacking = absent.select(name, F.concat(F.lit("no column "), F.array_join("lacking", ", ")).alias("error"))
    errors = lacking.union(bad.select(name, F.concat("n", F.lit(" rows with values that are no numbers")).alias("error")))
    sound = told.join(small(bad.select("whole")), "whole", "left_anti")
    return sound.select(name, *[F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c) for c in numbers]), errors


def read_many_csv(spark: SparkSession, pattern: str, data_type: str = "auto") -> DataFrame:
    """All files of a pattern with their ``source_file``; files may differ in their columns.

    Files are grouped by header line and encoding, each group is one scan, and the groups are
    united by column name. The encoding is found for each file by itself.
    """
    lines = spark.read.text(pattern).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("id"),
    )
    head = F.when(F.col("start") == 0, F.struct("id", "value"))
    first = lines.groupBy("path").agg(F.min(head)["value"].alias("header"), F.bool_or(~F.is_valid_utf8("value")).alias("other"))
    groups = first.groupBy("header", "other").agg(F.collect_list("path").alias("paths")).orderBy("header", "other").collect()
    parts = []
    for group in groups:
        by_kind: dict[str, list[str]] = {}
        for path in group["paths"]:
            kind = data_type
            if kind == "auto":
                kind = "kick" if "kick" in path.rsplit("/", 1)[-1].lower() else "formation"
            by_kind.setdefault(kind, []).append(path)
        for kind, paths in sorted(by_kind.items()):
            raw = read_csv(spark, sorted(paths), encoding=ENCODINGS[int(group["other"])]).withColumn("source_file", F.col("_metadata.file_name"))
            if kind == "kick" and "Kick" not in raw.columns:
                alias = next((n for n in LABEL_NAMES if n in raw.columns), None)
                raw = raw.withColumnRenamed(alias, "Kick") if alias else raw
            parts.append(raw)
    if not parts:
        raise FileNotFoundError(f"no files match {pattern}")
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part, allowMissingColumns=True)
    return basic_clean(united)


def read_json_records(
    spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | None = None, lines: bool = False
) -> DataFrame:
    """A JSON array of records, or records inside a ``data`` envelope.

    ``lines`` reads landed files that hold one document per line, which can be split.
    """
    reader = spark.read.option("multiLine", not lines)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.json(paths)
    if "data" in df.columns and isinstance(df.schema["data"].dataType, T.ArrayType):
        return df.select(F.explode("data").alias("r")).select("r.*")
    return df


def read_jdbc(
    spark: SparkSession, url: str, query: str, partition_column: str | None = None, lower: object = None, upper: object = None,
    partitions: int = 8, **options: str,
) -> DataFrame:
    """A pushed SQL query; with a partition column the rows are fetched by several tasks."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if partition_column is None:
        return reader.option("query", query).load()
    return (
        reader.option("dbtable", f"({query}) pushed").option("partitionColumn", partition_column)
        .option("lowerBound", lower).option("upperBound", upper).option("numPartitions", partitions).load()
    )


def read_las(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Well logs: one row per depth sample with the curves as a map.

    A file may hold several logs one after another: a ``~V`` section that follows a ``~A`` section opens the next one.
    Lines are read in parallel and ordered within the blocks they are read in; the section titles tell what a block begins
    with.  A line of a ``~A`` section is a sample, whose values are cast one by one, so text and NaN become null.
    The other lines of a log give the curve names, missing marker, well and location.
    Blank lines and comments are passed over; wrapped files (a sample spread over several lines) are rejected.
    """
    title, letter = F.col("text").startswith("~"), F.upper(F.substring("text", 2, 1))
    lines = spark.read.text(paths).select(
        F.trim("value").alias("text"), F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("id"),
    )
    lines = lines.where((F.col("text") != "") & ~F.col("text").startswith("#"))
    # the titles of each file in order, with the number of their log
    along = Window.partitionBy("path").orderBy("start", "id")
    titles = lines.where(title).select("path", "source_file", "start", "id", letter.alias("section"))
    opens = (F.col("section") == "V") & (F.count_if(F.col("section") == "A").over(along) > 0)
    titles = titles.withColumn("opens", opens).withColumn("log", F.count_if("opens").over(along))
    # a line belongs to the last title before it in its block, or else to the last one of the blocks before
    last = titles.groupBy("path", "start").agg(F.max(F.struct("id", "section")).alias("last"))
    blocks = lines.select("path", "start").distinct().join(last, ["path", "start"], "left")
    passed = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("path", "start", F.last("last", ignorenulls=True).over(passed).alias("before"))
    inside = Window.partitionBy("path", "start").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    placed = lines.select("path", "start", "id", "text").withColumn("own", F.last(F.when(title, F.struct("id", letter.alias("section"))), ignorenulls=True).over(inside))
    placed = placed.where(~title).join(blocks, ["path", "start"])
    placed = placed.withColumn("title", F.coalesce("own", "before")).select("start", "id", "text", F.col("title.id").alias("at"), F.col("title.section").alias("section"))
    header = (
        placed.where("section <> 'A'").join(titles.select(F.col("id").alias("at"), "path", "log"), "at")
        .withColumn("name", F.trim(F.split_part("text", F.lit("."), F.lit(1))))
        .withColumn("value", F.trim(F.regexp_extract("text", r"^[^.]*\.\S*\s*(.*?)\s*:[^:]*$", 1)))
    )

    def well_value(name: str):
        return F.max(F.when((F.col("section") == "W") & (F.upper("name") == name), F.col("value")))

    about = header.groupBy("path", "log").agg(
        F.array_sort(F.collect_list(F.when(F.col("section") == "C", F.struct("start", "id", "name")))).alias("c"),
        well_value("WELL").alias("well_name"), well_value("LOC").alias("location"), well_value("NULL").alias("missing"),
        F.max(F.when((F.col("section") == "V") & (F.upper("name") == "WRAP"), F.upper("value"))).alias("wrap"),
    )
    about = about.select(
        "path", "log", F.transform("c", lambda x: x["name"]).alias("names"), "well_name", "location",
        F.coalesce(F.col("missing").try_cast("double"), F.lit(-999.25)).alias("missing"),
        F.when(F.col("wrap").startswith("YES"), F.raise_error(F.lit("wrapped LAS files are not supported"))).alias("_w"),
    )
    about = about.join(titles.where("section = 'A'").select(F.col("id").alias("at"), "path", "log", "source_file"), ["path", "log"])
    samples = placed.where("section = 'A'").select("at", F.split("text", r"\s+").alias("v"))
    joined = samples.join(about, "at").where(F.col("_w").isNull())
    values = F.transform(
        "v", lambda x: F.when((x.try_cast("double") != F.col("missing")) & ~F.isnan(x.try_cast("double")), x.try_cast("double"))
    )
    return joined.select("source_file", "well_name", "location", "names", values.alias("values")).select(
        "source_file", "well_name", "location",
        F.try_element_at("values", F.lit(1)).alias("depth"),
        F.map_from_entries(F.transform(
            F.slice("names", 2, F.greatest(F.size("names") - 1, F.lit(0))), lambda name, i: F.struct(name, F.get("values", i + 1))
        )).alias("curves"),
    )


def las_table(logs: DataFrame, curves: Sequence[str]) -> DataFrame:
    """The chosen curves as columns."""
    return logs.select(
        "source_file", "well_name", "location", "depth",
        *[F.try_element_at("curves", F.lit(c)).alias(c) for c in curves],
    )


def load_configured(spark: SparkSession, config: Mapping[str, object]) -> DataFrame:
    """Source chosen by a configuration: landed API files, a database query, or any Spark format."""
    kind = config.get("type", "api")
    if kind == "api":
        return read_json_records(spark, str(config["path"]))
    if kind == "database":
        return read_jdbc(spark, str(config["connection_string"]), str(config["query"]))
    if kind == "format":
        return spark.read.format(str(config["format"])).options(**dict(config.get("options", {}))).load(config.get("path"))
    raise ValueError(f"unsupported source type {kind}")


def write_table(
    df: DataFrame, path: str, fmt: str = "csv", compression: str | None = None, partition_by: Sequence[str] = (),
    mode: str = "overwrite",
) -> str:
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format {fmt}")
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if compression:
        writer = writer.option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path
