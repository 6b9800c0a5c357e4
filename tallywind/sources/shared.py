"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder in local mode, which has one machine, else a folder in the warehouse."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tallywind-") if master.split("[")[0] == "local" else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tallywind"
    return _own[app]


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/tallywind-core/{label}-{uuid.uuid4().hex[:16]}"


def save(df: DataFrame, label: str) -> DataFrame:
    """df written there and read back: its lineage ends, and a lost executor costs nothing. What was shuffled for it is removed."""
    return save_at(df, label)[0]


def save_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """As `save`, with the folder, for tables that are removed when they have been used."""
    path = new_folder(df.sparkSession, label)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written here are removed when it is written, and not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def place(path: str) -> tuple[fs.FileSystem, str]:
    """A path's file system and what it is called there."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def numbered(df: DataFrame, key: str, first: int = 0) -> DataFrame:
    """(key, number): the distinct values in ascending order, nulls first, numbered without gaps. Ranges are sorted apart;
    only a count a range, of as many as there are shuffle partitions, goes through one task."""
    at = F.monotonically_increasing_id()
    ranges = df.select(F.col(key).alias("key")).distinct().repartitionByRange("key").sortWithinPartitions("key")
    rows = save(ranges.select("key", at.alias("at")).select("key", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("row")), "numbered")
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(F.col("part").alias("of"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    return rows.join(before, F.col("part") == F.col("of")).select(F.col("key").alias(key), (F.col("before") + F.col("row") + first).alias("number"))
