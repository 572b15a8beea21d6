"""Sort orders of results; ties end by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.folders import work_dir, written

FILE_SORTS = ("name", "comment", "blank", "code")
LANGUAGE_SORTS = ("name", "files", "comment", "blank", "code")
#: bits of a row number that Spark gives within a partition
_WITHIN = (1 << 33) - 1


def sort_keys(tag: str, by_file: bool) -> list[Column]:
    known = FILE_SORTS if by_file else LANGUAGE_SORTS
    if tag not in known:
        raise ValueError(f"sort must be one of {', '.join(known)}: {tag!r}")
    if tag == "name":
        return [F.col("name")]
    then = [] if tag == "code" else [F.col("code").desc()]
    return [F.col(tag).desc(), *then, F.col("name")]


def sort_files(files: DataFrame, tag: str = "code") -> DataFrame:
    return files.orderBy(*sort_keys(tag, True))


def sort_languages(languages: DataFrame, tag: str = "code") -> DataFrame:
    return languages.orderBy(*sort_keys(tag, False))


def with_position(rows: DataFrame, keys: list[Column], position: str = "position", first: int = 1) -> DataFrame:
    """``rows`` with their place in the order of ``keys``, without gaps from ``first`` on.

    Rows are dealt to ranges of the order, sorted within each and written with their place in it; the
    sizes of the ranges, one number for each partition, are added up and joined to them.  No task has to
    see more than its range and no row passes the driver.
    """
    spark = rows.sparkSession
    names = rows.columns
    numbered = rows.orderBy(*keys).withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(_WITHIN)})
    numbered = written(numbered, f"{work_dir(spark)}/ordered")
    sizes = sorted(numbered.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each partition
    before, total = [], first
    for part, n in sizes:
        before.append((part, total))
        total += n
    offsets = spark.createDataFrame(before, "__of int, __before long")
    out = numbered.join(F.broadcast(offsets), F.col("__part") == F.col("__of"))
    return out.select(*[F.col(f"`{n}`") for n in names if n != position], (F.col("__before") + F.col("__at")).alias(position))


def sort_files_with_position(files: DataFrame, tag: str = "code") -> DataFrame:
    """``files`` with their place in a report by file."""
    return with_position(files, sort_keys(tag, True))
