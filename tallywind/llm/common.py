"""Shared-folder tables and files, and connected components, for the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_root: dict[str, str] = {}
_made: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset: a temporary
    folder in local mode, where there is one machine only, else a folder in the warehouse."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_root:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        _own_root[app] = "file://" + tempfile.mkdtemp(prefix="tallywind-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tallywind"
    return _own_root[app]


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses; removed when the driver's Python ends."""
    path = f"{shared_root(spark)}/tallywind/{label}-{uuid.uuid4().hex[:16]}"
    _made.append((spark, path))
    return path


def save(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and lost executors cost nothing."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def give_back() -> None:
    """Return to the system what this worker process has freed: it outlives its tasks, and shares an executor's memory."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it keeps what it has
        ctypes.CDLL(None).malloc_trim(0)


def free_name(columns: list[str], base: str) -> str:
    """A column name that none of `columns` has, in either case."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def spread(files: DataFrame, most: int = 10_000) -> int:
    """A number of partitions for a table that names files, so that tasks hold few files each."""
    return max(1, min(files.count(), most))


def shared_fs(uri: str):
    """(pyarrow filesystem, path in it), for files that Python workers write and read in the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_file(uri: str, data: bytes) -> None:
    """Write whole files only: a reader never sees the start of a file whose writer was lost."""
    fs, path = shared_fs(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(f"{path}.part", compression=None) as out:
        out.write(data)
    fs.move(f"{path}.part", path)


def read_range(uri: str, start: int, length: int) -> bytes:
    fs, path = shared_fs(uri)
    with fs.open_input_file(path) as f:
        f.seek(start)
        return f.read(length)


def read_file(uri: str) -> bytes:
    fs, path = shared_fs(uri)
    with fs.open_input_file(path) as f:
        return f.read()


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node that links reach.

    Alternates the large-star and small-star steps (Kiveris et al. 2014). Each step is an aggregate and an
    equi-join on narrow rows, their results are written to the shared folder, and only its row count
    and a hash of its rows come to the driver. A hub's minimum is pre-aggregated and its join can be split. Joins merge: none sends rows to the driver to be broadcast.
    Raises if the components still change in the last round: none are returned that may be wrong.
    """
    e = edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    e, before = save(e, "edges"), None
    for _ in range(rounds):
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        # Written: a join with a hub's rows can then be split, which it couldn't within the stage of the aggregate.
        least = save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").hint("merge").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.hint("merge").join(root, "hi").select(F.explode(F.array(F.struct(F.col("hi").alias("x"), "m"), F.struct(F.col("lo").alias("x"), "m"))).alias("s"))
        e = save(small.where("s.x != s.m").select(F.col("s.x").alias("hi"), F.col("s.m").alias("lo")).distinct(), "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components still changed after {rounds} rounds")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
