"""Token-ID output (operator 3): ORC files of token ids, sorted by document id.

Rows are dealt by sampled ranges of ``doc_id`` and sorted, so every stripe covers a narrow range of
ids: the stripe and row-group statistics prune by id, the Bloom filter answers point look-ups, and
ORC's run-length encoding packs the integers.  Stripes are independent, so readers work in parallel.

Defined results: a null text is empty (it has the end id only).  Rows of equal ``doc_id`` stand in
order of their text, null ids first.  An empty table gives files without rows.  Extra columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encoding import Encoder
from .shared import only, tidy
from .textarrays import doc_chunks, ranges, utf8

ORC_OPTIONS = {
    "compression": "zstd",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"


def with_end(ids: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Appends ``end_id`` to each document's ids."""
    n = len(at) - 1
    out = np.full(len(ids) + n, end_id, np.int32)
    size = np.diff(at)
    out[ranges(at[:-1] + np.arange(n), size)] = ids
    return out, at + np.arange(n + 1)


def token_batches(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(doc ids, token ids, offsets) for bounded parts of each batch."""
    encoder = Encoder.of(path)
    for batch in batches:
        data, off = utf8(batch.column("text"))
        for i, j in doc_chunks(off):
            ids, at = encoder.encode(data[off[i] : off[j]], off[i : j + 1] - off[i])
            yield batch.column("doc_id").slice(i, j - i), *with_end(ids, at, end_id)


def write_token_files(documents: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Writes doc_id, part, part_start, n_tokens and ids.

    ``part_start`` counts the ids before the document in its own part; ``start_offsets`` turns it
    into the place in the whole sequence without touching the ids again.
    """

    @tidy
    def encode(batches):
        part, before = TaskContext.get().partitionId(), 0
        for doc, ids, at in token_batches(batches, tokenizer, end_id):
            size = np.diff(at)
            yield pa.RecordBatch.from_arrays(
                [
                    doc,
                    pa.array(np.full(len(size), part, np.int32)),
                    pa.array(before + at[:-1]),
                    pa.array(size),
                    pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)),
                ],
                names=["doc_id", "part", "part_start", "n_tokens", "ids"],
            )
            before += int(at[-1])

    rows = only(documents, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(encode, SCHEMA).write.options(**ORC_OPTIONS).orc(path)


def part_starts(tokens: DataFrame) -> DataFrame:
    """The ids before each part: one row for each file that was written."""
    sizes = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.select("part", before.alias("part_before"))


def with_starts(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """Replaces part and part_start by ``start``, the ids of all documents before."""
    rows = rows.join(part_starts(tokens), "part").withColumn("start", F.col("part_before") + F.col("part_start"))
    return rows.select("doc_id", "start", *[c for c in rows.columns if c not in ("doc_id", "start", "part", "part_start", "part_before")])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids; filters on doc_id reach the stripes."""
    tokens = spark.read.schema(SCHEMA).orc(path)
    return with_starts(tokens, tokens)


def id_checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, the CRC-32 of the ids as little-endian unsigned 32-bit
    integers.  The ids are summed where they are read; only the sums are dealt."""
    names = ["doc_id", "part", "part_start", "n_tokens"]

    @tidy
    def sums(batches):
        for batch in batches:
            lists = batch.column("ids")
            off = np.asarray(lists.offsets).astype(np.int64)
            raw = memoryview(np.ascontiguousarray(np.asarray(lists.values), dtype="<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(crc, pa.int64())], names=[*names, "ids_crc32"])

    tokens = spark.read.schema(SCHEMA).orc(path)
    rows = tokens.select(*names, "ids").mapInArrow(sums, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long")
    return with_starts(rows, tokens)
