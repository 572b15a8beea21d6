"""Counts over files that arrive, an extension of the batch analysis.

``count_stream`` turns a streaming DataFrame of (path, content, and an event time) into running counts
by language, under the same options as a batch: path patterns, languages and, last of all, copies.
Classification is stateless for each file; the state is the aggregate's and the digests that have come
within the watermark's delay.  A copy is dropped if one of its kind came no longer ago than the delay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.detect import with_language
from ..functions.languages import LanguageRegistry
from ..plans.engine import classified, language_filters, path_filters
from ..plans.options import OptionError, Options


def count_stream(arriving: DataFrame, options: Options | None = None, registry: LanguageRegistry | None = None, event_time: str | None = None, delay: str = "10 minutes", window: str | None = None) -> DataFrame:
    """``dedup`` needs an event time, for without a watermark the digests would be kept for ever."""
    options, registry = options or Options(), registry or LanguageRegistry.default()
    options.check(arriving.sparkSession)
    if options.dedup and event_time is None:
        raise OptionError("dedup", "a stream needs an event time to forget digests by")
    if window is not None and event_time is None:
        raise OptionError("window", "a window needs an event time")
    times = [F.col(event_time).alias("at")] if event_time else []
    rows = arriving.select(F.col("path").cast("string").alias("path"), F.coalesce(F.col("content").cast("binary"), F.lit(b"")).alias("content"), *times)
    if event_time:
        rows = rows.withWatermark("at", delay)
    rows = rows.where(path_filters(F.col("path"), options))
    rows = with_language(rows, registry.keys).where(language_filters(F.col("language"), options, registry))
    if options.dedup:
        rows = rows.withColumn("digest", F.md5("content")).dropDuplicatesWithinWatermark(["digest"]).drop("digest")
    scanned = classified(rows, registry.languages)
    keys = [F.window("at", window).alias("window")] if window else []
    return scanned.groupBy(*keys, F.col("language").alias("name")).agg(F.count(F.lit(1)).alias("files"), *[F.sum(c).alias(c) for c in ("code", "comment", "blank")])
