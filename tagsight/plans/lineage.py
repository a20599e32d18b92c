"""Shared scratch space, durable cut points and size-checked small tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

MAX_DRIVER_ROWS = 100_000
BATCH_CONF, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 8_000_000
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it.

    In local mode a temporary folder stands in for a missing one. Anywhere else that is an error: executors would
    write to their own disks and later reads would miss rows.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting for what runs inside, unless the session has its own."""
    given = spark.conf.get(name, None)
    if given is None:
        spark.conf.set(name, value)
    try:
        yield
    finally:
        if given is None:
            spark.conf.unset(name)


def small_batches(spark: SparkSession):
    """What runs inside hands rows to Python in batches of at most `BATCH` bytes; a setting of the session's own stays."""
    return _setting(spark, BATCH_CONF, str(BATCH))


def passing_shuffles(spark: SparkSession):
    """Queries that are built and run inside leave no shuffle files behind, which else stay until the driver collects its garbage."""
    return _setting(spark, CLEANUP_CONF, "true")


def durable(df: DataFrame, **options: str) -> DataFrame:
    """Write the rows to the shared folder and read them back.

    Cuts the lineage and survives the loss of executors; unlike a row checkpoint the
    parquet copy keeps column pruning and known sizes for the plans built on it. Rows go to
    Python functions of the stage in batches of at most `BATCH` bytes (Spark: 64 MB), as both
    sides hold one for every task. ``options`` are those of the writer.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "stage")
    with small_batches(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def collect_small(df: DataFrame, cap: int = MAX_DRIVER_ROWS) -> list[Row]:
    """Fetch a table that must be small (labels, runs); refuses, never truncates."""
    rows = df.limit(cap + 1).collect()
    if len(rows) > cap:
        raise ValueError(f"expected at most {cap} rows on the driver")
    return rows


def small_table(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A driver-side list as a table, broadcast because its length is checked here."""
    rows = list(rows)
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= MAX_DRIVER_ROWS else df
