"""What the two substring operators share: anchors, groups of occurrences, removed intervals.

Every window of a text has one anchor, chosen by the window's content alone, so equal windows have
equal anchors.  The phases, each cut by a written table:

1. a map finds anchors; consecutive windows with one anchor are one row (name, node, first, count);
2. names seen at more than one place of different texts stay, grouped for each text again;
3. one row of each text that still has candidates emits its windows for these names, dealt in buckets
   and sorted; a task sees whole groups of a name and marks repeated windows;
4. the marked intervals meet the texts, which are cut and digested.

Equal texts are one node: the anchors of copies fall together in map-side sums before anything is
dealt, and only one copy emits windows.  A name with more than ``HOT`` occurrences is dealt in blocks;
windows that a block can't settle are summed over all blocks, one row for each block, so no group must
fit a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import join_counted, materialize, only, remove, shared_dir, tidy
from .textarrays import binary_array, doc_chunks, utf8, whole_groups

HOT = 20_000
#: rows of a bucket, until there are ``MOST_BUCKETS``: then buckets grow.  Spark sorts them, and a task holds
#: a batch and one group at a time, so a large bucket costs time and no memory
BUCKET_ROWS = 100_000
MOST_BUCKETS = 100_000


@dataclass(frozen=True)
class Rules:
    """What tells one operator from the other."""

    #: (data, offsets) -> doc index, first window, a number that tells how many windows, name
    anchors: Callable
    #: (data, offsets) -> a function of (doc, first, that number) giving bytes and their offsets
    payload: Callable
    #: (table of whole groups) -> batches of SETTLED
    settle: Callable
    #: table of names with their counts -> function of (name, block, blocks) giving buckets, their number
    buckets: Callable
    #: the first occurrence, by (doc_id, node, place), is not marked
    later_only: bool
    hot: int = HOT


DEALT = "bucket int, name long, block int, blocks int, doc_id long, node binary, first int, n int, windows binary"
SETTLED = "node binary, start int, stop int, open binary, doc_id long, multi boolean"


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, text and node, the MD5 of the text; null is empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return only(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("node", F.unhex(F.md5(F.col("text").cast("binary"))))


def _chunks(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        data, off = utf8(batch.column("text"))
        for i, j in doc_chunks(off):
            yield batch, i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]


def candidates(found: DataFrame, path: str, hot: int) -> tuple[DataFrame, DataFrame]:
    """Names seen at two places or more, with their numbers of blocks; and the rows of ``found`` that
    have one, with blocks and their own block."""
    place = F.xxhash64("node", "first")
    names = found.groupBy("name").agg(F.min(place).alias("x"), F.max(place).alias("y"), F.count(F.lit(1)).alias("k")).where("x <> y")
    names = materialize(names.select("name", "k", F.ceil(F.col("k") / hot).cast("int").alias("blocks")), f"{path}/names")
    rows = join_counted(found, names, ["name"])
    return names, rows.withColumn("block", F.pmod(F.xxhash64("node", "first", F.lit(3)), F.col("blocks")).cast("int"))


def marked_intervals(documents: DataFrame, path: str, rules: Rules) -> DataFrame:
    """node and spans: the intervals [start, stop) of each text that repeated windows cover."""
    spark = documents.sparkSession
    texts = keyed(documents)

    @tidy
    def find(batches):
        for batch, i, j, data, off in _chunks(batches):
            doc, first, count, name = rules.anchors(data, off)
            if len(doc):
                yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(i + doc)), pa.array(name.view(np.int64)), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32))], names=["node", "name", "first", "n"])

    found = materialize(texts.select("text", "node").mapInArrow(find, "node binary, name long, first int, n int"), f"{path}/anchors")
    names, rows = candidates(found, path, rules.hot)
    wanted = rows.groupBy("node").agg(F.collect_set(F.struct("name", "first", "n", "blocks", "block")).alias("wanted"))
    wanted = materialize(wanted, f"{path}/wanted")
    remove(spark, f"{path}/anchors")
    bucket_of, n_buckets = rules.buckets(names)
    remove(spark, f"{path}/names")

    @tidy
    def deal(batches):
        for batch, i, j, data, off in _chunks(batches):
            lists = batch.column("wanted").slice(i, j - i)
            doc = np.repeat(np.arange(j - i), np.diff(np.asarray(lists.offsets)))
            flat = lists.flatten()
            name, first, n, blocks, block = (flat.field(c).to_numpy(zero_copy_only=False) for c in range(5))
            payload = rules.payload(data, off)
            bucket = bucket_of(name.view(np.uint64), block, blocks).astype(np.int32)
            for lo in range(0, len(doc), 4096):
                part = slice(lo, lo + 4096)
                raw, at = payload(doc[part], first[part].astype(np.int64), n[part].astype(np.int64))
                rows = pa.array(i + doc[part])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[part]), pa.array(name[part]), pa.array(block[part]), pa.array(blocks[part]), batch.column("doc_id").take(rows), batch.column("node").take(rows), pa.array(first[part]), pa.array(n[part]), binary_array(raw, at)],
                    names=["bucket", "name", "block", "blocks", "doc_id", "node", "first", "n", "windows"],
                )

    # of equal texts one row emits windows, that of the least doc_id; rows equal in both emit the same
    # windows, which fall together again.  These tables grow with the input: merge joins at every size
    least = materialize(texts.groupBy(F.col("node").alias("of")).agg(F.min(F.struct("doc_id"))["doc_id"].alias("least")), f"{path}/least")
    wanted = wanted.join(least, F.col("node") == F.col("of")).select("of", "wanted", "least")
    chosen = texts.join(wanted.hint("merge"), (F.col("node") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("least")))
    dealt = chosen.select("doc_id", "node", "text", "wanted").mapInArrow(deal, DEALT)

    @tidy
    def settle(batches):
        for t in whole_groups(batches, "name", "block"):
            yield from rules.settle(t)

    done = dealt.repartitionById(n_buckets, "bucket").sortWithinPartitions("bucket", "name", "block").mapInArrow(settle, SETTLED)
    done = materialize(done, f"{path}/settled")
    remove(spark, f"{path}/wanted")
    spans = done.where("open is null").select("node", "start", "stop")
    waiting = done.where("open is not null")
    if rules.later_only:
        best = waiting.groupBy("open").agg(F.min(F.struct("doc_id", "node", "start")).alias("best"))
        late = waiting.join(best, "open").where(F.struct("doc_id", "node", "start") != F.col("best"))
    else:
        best = waiting.groupBy("open").agg(F.count(F.lit(1)).alias("k"), F.max("multi").alias("m")).where("k > 1 or m").select("open")
        late = waiting.where("not multi").join(best, "open")
    spans = spans.unionByName(late.select("node", "start", "stop"))
    return materialize(spans.groupBy("node").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), f"{path}/spans")


@dataclass
class Groups:
    """The rows of one table of whole groups as arrays, in order of (doc_id, node, first), null doc_ids
    first; rows that repeat one of these (equal texts of one doc_id) are left out."""

    name: np.ndarray
    block: np.ndarray
    blocks: np.ndarray
    doc_id: pa.Array
    node: pa.Array
    first: np.ndarray
    n: np.ndarray
    data: np.ndarray
    start: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, t: pa.Table) -> Groups:
        flat = {c: t.column(c).combine_chunks() for c in ("doc_id", "node", "windows")}
        flat = {c: x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for c, x in flat.items()}
        data, at = _binary(flat["windows"])
        raw, _ = _binary(flat["node"])
        node = np.ascontiguousarray(raw).view(">u8").reshape(-1, 2).astype(np.uint64)
        first, name, block = (t.column(c).to_numpy() for c in ("first", "name", "block"))
        known = flat["doc_id"].is_valid().to_numpy(zero_copy_only=False)
        doc = flat["doc_id"].fill_null(0).to_numpy()
        order = np.lexsort((block, name, first, node[:, 1], node[:, 0], doc, known))
        keys = (known, doc, node[:, 0], node[:, 1], first, name, block)
        new = np.ones(len(order), bool)
        new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0) if len(order) > 1 else new[1:]
        order = order[new]
        take = pa.array(order)
        n = t.column("n").to_numpy()[order].astype(np.int64)
        return cls(name[order].view(np.uint64), block[order], t.column("blocks").to_numpy()[order], flat["doc_id"].take(take), flat["node"].take(take), first[order].astype(np.int64), n, data, at[:-1][order], np.diff(at)[order])

    def batch(self, row: np.ndarray, start: np.ndarray, stop: np.ndarray, open: pa.Array | None = None, multi: np.ndarray | None = None) -> pa.RecordBatch:
        take, n = pa.array(row), len(row)
        return pa.RecordBatch.from_arrays(
            [self.node.take(take), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)), pa.nulls(n, pa.binary()) if open is None else open, pa.nulls(n, pa.int64()) if open is None else self.doc_id.take(take), pa.array(np.zeros(n, bool) if multi is None else multi)],
            names=["node", "start", "stop", "open", "doc_id", "multi"],
        )


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)
    at = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8)[at[0] : at[-1]] if held is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def runs_of(row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of neighbouring places of one row; sorted by row, then place."""
    new = np.ones(len(row), bool)
    new[1:] = (np.diff(place) != 1) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    return head, np.append(head[1:], len(row)) - 1


def number_of_buckets(names: DataFrame) -> int:
    """So many that a bucket holds about ``BUCKET_ROWS`` rows, as long as a driver can plan that many tasks."""
    rows = names.agg(F.sum("k")).first()[0] or 0
    return max(1, min(-(-rows // BUCKET_ROWS), MOST_BUCKETS))


def with_spans(documents: DataFrame, spans: DataFrame, path: str) -> DataFrame:
    """doc_id, text, spans, copies (rows of equal text) and is_first (its least doc_id)."""
    texts = keyed(documents)
    groups = texts.groupBy(F.col("node").alias("g")).agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id"))["doc_id"].alias("least")).where("copies > 1")
    facts = spans.withColumnRenamed("node", "g").join(groups, "g", "full")
    facts = materialize(facts, f"{path}/facts")
    out = texts.join(facts.hint("merge"), F.col("node") == F.col("g"), "left")
    return out.select("doc_id", "text", "spans", F.coalesce("copies", F.lit(1)).alias("copies"), F.col("doc_id").eqNullSafe(F.col("least")).alias("is_first"))


def union_mask(length: int, spans) -> np.ndarray:
    """True where an interval covers."""
    edge = np.zeros(length + 1, np.int64)
    start, stop = spans
    np.add.at(edge, start, 1)
    np.add.at(edge, stop, -1)
    return np.cumsum(edge[:-1]) > 0


def new_path(documents: DataFrame) -> str:
    return shared_dir(documents.sparkSession)
