"""Working folders that the driver and all executors share, and tables written there.

They stand below the folder that ``spark.checkpoint.dir`` names; where neither it nor a checkpoint folder
of the context is set, a local master (tests, a laptop) takes a temporary folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """A new folder path below the shared one; nothing is made yet."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        got = context._jsc.sc().getCheckpointDir()
        if got.isDefined():
            base = got.get()
        elif context.master == "local" or context.master.startswith("local["):
            base = "file://" + tempfile.mkdtemp(prefix="loomline-")
            context.setCheckpointDir(base)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/loomline-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file, written by the driver."""
    fs, p = _hadoop(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as Parquet in ``path``, read back: what follows starts from files that all can read."""
    schema = df.schema
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def plain_path(path: str) -> str:
    """The path of a local address on this machine; other addresses as they are."""
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path
