"""Folders, intermediate tables and small helpers that the operators share."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _is_local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """A new folder path below the checkpoint folder that driver and executors share.

    The session's ``spark.checkpoint.dir`` decides; only where neither it nor a checkpoint folder of
    the context is set and the master is local (tests, a laptop) a temporary folder is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        if got.isDefined():
            base = got.get()
        elif not _is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        else:
            base = "file://" + tempfile.mkdtemp(prefix="loomline-")
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/loomline-{uuid.uuid4().hex}"


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate results, through the file system that holds it."""
    fs, p = _hadoop_path(spark, path)
    fs.delete(p, True)


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Writes ``df`` as Parquet and reads it back: lineage ends here, so a lost executor costs the
    tasks of one phase only.  Shuffle files of the phase become garbage; on a cluster, where they can be
    large, they are freed at once.
    """
    spark, schema = df.sparkSession, df.schema
    df.write.mode("overwrite").parquet(path)
    del df
    if not _is_local(spark):  # Spark drops a shuffle's files when its driver's object is collected
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


#: keys with more rows are looked up in a broadcast table, as long as there are not too many such keys
FREQUENT = 1_000
MOST_FREQUENT = 1_000_000


def join_counted(rows: DataFrame, keys: DataFrame, on: list[str], k: str = "k", how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) with ``keys``, a written table with one row for each key and, in
    ``k``, the number of rows that have it.

    A merge join would deal all rows of a frequent key to one task.  There are at most one in
    ``FREQUENT`` rows such keys; they are counted, and broadcast while they are ``MOST_FREQUENT`` at most.
    Beyond that the merge join takes all, and Spark splits its skewed partitions.
    """
    frequent = keys.where(F.col(k) > FREQUENT)
    if frequent.count() > MOST_FREQUENT:
        return rows.join(keys.hint("merge"), on, how)
    rare = rows.join(F.broadcast(frequent.select(*on)), on, "left_anti").join(keys.where(F.col(k) <= FREQUENT).hint("merge"), on, how)
    return rare.unionByName(rows.join(F.broadcast(frequent), on))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(work: Callable) -> Callable:
    """A map over Arrow batches that gives its free memory back when it ends: workers live on and wait
    for the next task."""

    def run(batches):
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim is not None:
            trim(0)

    return run


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores where ``df`` has it: an operator's own column meets no caller's."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def only(df: DataFrame, *names: str) -> DataFrame:
    """The columns an operator reads, and no others: extra columns can't clash with its own."""
    return df.select(*[F.col(f"`{n}`") for n in names])
