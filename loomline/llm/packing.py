"""Packing (operator 9): power-of-two decomposition.

A document of n ids is cut into n // 1024 pieces of 1024 and one piece for each set bit of the
rest, largest first.  Each piece is a sequence of its own, so no sequence crosses documents and none
needs padding: all lengths are powers of two, and a batch takes sequences of one length.  Sequences
are written in buckets of equal length and read from there: in each file those of one length stand
together, so a reader of one length takes some row groups and skips the others.  A narrow map does it;
nothing is shuffled.

Defined results: a null text is empty and has the end id only.  Rows that repeat a ``doc_id`` are
packed each on its own.  Extra columns are ignored, an empty table gives no pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import only, tidy
from .textarrays import binary_array
from .token_files import token_batches

LONGEST = 1024
#: of a row group: so large that groups are few, so small that most hold one length
BUCKET_BYTES = 8 << 20


def binary_lengths(tokens: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of all pieces, and the number of pieces of each document."""
    bits = longest.bit_length() - 1
    whole = tokens // longest
    rest = ((tokens % longest)[:, None] >> np.arange(bits - 1, -1, -1)) & 1
    counts = whole + rest.sum(1)
    lengths = np.full(int(counts.sum()), longest, np.int64)
    first_rest = np.cumsum(counts) - rest.sum(1)
    doc, column = np.nonzero(rest)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(rest.sum(1)) - rest.sum(1), rest.sum(1))
    lengths[first_rest[doc] + nth] = 1 << (bits - 1 - column)
    return lengths, counts


def pack(documents: DataFrame, tokenizer: str, end_id: int = 0, longest: int = LONGEST) -> DataFrame:
    """One row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (binary,
    little-endian unsigned 32-bit).  ``sequence_id`` joins the number of the task and a counter.
    """
    if longest & (longest - 1) or longest < 1:
        raise ValueError("longest must be a power of two")

    @tidy
    def cut(batches):
        sequence = TaskContext.get().partitionId() << 40

        for doc, ids, at in token_batches(batches, tokenizer, end_id):
            size = np.diff(at)
            length, counts = binary_lengths(size, longest)
            stop = np.cumsum(length)
            owner = np.repeat(np.arange(len(size)), counts)
            yield pa.RecordBatch.from_arrays(
                [
                    doc.take(pa.array(owner)),
                    pa.array(stop - length - at[owner]),
                    pa.array(length),
                    pa.array(size[owner]),
                    pa.array(sequence + np.arange(len(length))),
                    pa.array(np.zeros(len(length), np.int64)),
                    binary_array(ids.astype("<i4").view(np.uint8), 4 * np.append(0, stop)),
                ],
                names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )
            sequence += len(length)

    rows = only(documents, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def write_buckets(packed: DataFrame, path: str) -> None:
    """Writes sequences by length, the longest first.  One file for each task, with the lengths of its
    row groups in the footer, and not one for each task and length."""
    packed.sortWithinPartitions(F.col("length").desc()).write.option("parquet.block.size", BUCKET_BYTES).parquet(path)


def read_buckets(spark: SparkSession, path: str, length: int | None = None) -> DataFrame:
    """The sequences of all buckets, or of the one of ``length``."""
    rows = spark.read.schema(PIECES).parquet(path)
    return rows if length is None else rows.where(F.col("length") == length)


def piece_digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
