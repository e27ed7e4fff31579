"""Session settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def local_session(app: str, cores: int | str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        "spark.driver.bindAddress": "127.0.0.1",
        "spark.driver.host": "127.0.0.1",
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a session without that setting (unit tests) gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not named and master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if not named:
        named = tempfile.mkdtemp(prefix="run-ckpt-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _freeing = threading.Lock(), {}


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Jobs started inside give back their shuffle files when they end; the session's own setting follows the last of them."""
    with _lock:
        users, own = _freeing.get(spark, (0, None))
        own = spark.conf.get(FREE_SHUFFLES, None) if not users else own
        _freeing[spark] = (users + 1, own)
        spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        with _lock:
            users, own = _freeing.pop(spark)
            if users > 1:
                _freeing[spark] = (users - 1, own)
            elif own is None:
                spark.conf.unset(FREE_SHUFFLES)
            else:
                spark.conf.set(FREE_SHUFFLES, own)


def materialise(df: DataFrame) -> DataFrame:
    """Write a table to the shared checkpoint folder and go on from there.

    Used between the passes of long plans, so later passes read the table instead of
    repeating its shuffles, and a lost executor costs only its own tasks. Nothing reads the
    write's shuffles again, so their files go with it and do not pile up from pass to pass.
    """
    path = f"{checkpoint_root(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
