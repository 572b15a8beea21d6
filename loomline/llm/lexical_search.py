"""Ranked lexical search (operator 12): a blocked sparse product of items and documents.

Terms are runs of ASCII digits and letters (A-Z lower-cased) and of any other character beyond ASCII.
Three sparse matrices are made: items by terms (how often an item has a term, times the term's weight),
documents by terms (how often), and from it terms by documents with 64-bit integer impacts.  A task
takes its documents a block at a time, turns the block to rows of terms, and for each item adds up
the rows of its terms (Gustavson's row merging, in numpy), keeping the best ``k`` documents of each
item from block to block.  What tasks keep is put together by Spark, ``k`` rows of each item and task,
in two steps.

Items are taken in blocks of at most about ``ITEM_BYTES`` of terms, each a product of its own over all
documents, so what is broadcast has that bound and not the benchmark's size; an item alone may be
longer.  A term of a document is looked up by a hash and then compared byte by byte, so no two terms
are taken for each other.

The document matrix is written before weights are known (they need df of all documents): texts are
split once for each block of items.

Defined results: null and empty texts have no terms, are in no result and don't count in N; an item
without terms has no rows; each row of either table stands for itself, rows that repeat an id too
(item ids that repeat give a ranking for each row); equal scores are in order of doc_id, null last;
extra columns are ignored; an empty table on either side gives no rows.  Long texts are split
``CHUNK_BYTES`` at a time at bytes that belong to no term.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, only, shared_dir, tidy
from .textarrays import CHUNK_BYTES, eight_bytes, equal_spans, runs, utf8, word_hashes

BEST = 20
#: bytes of terms in a block of items, each term of an item with 24 bytes more
ITEM_BYTES = 8 << 20
#: documents and entries of a block of the document matrix
BLOCK_DOCUMENTS = 8_192
BLOCK_ENTRIES = 2_000_000
#: groups of tasks whose best are put together first
GROUPS = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[97:123] = _TERM[128:] = True
_INSIDE = _TERM.copy()
_INSIDE[65:91] = True


def byte_pieces(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of about ``most`` bytes that begin and end outside the runs of ``inside``, or between documents."""
    a, n = 0, len(data)
    while a < n:
        b = min(a + most, n)
        if b < n:
            gaps = np.flatnonzero(~inside[data[a:b]])
            edge = int(offsets[np.searchsorted(offsets, b, "right") - 1])
            cut = max(a + int(gaps[-1]) + 1 if len(gaps) else 0, edge)
            if cut > a:
                b = cut
            else:  # one run that is longer than a piece
                end = int(offsets[np.searchsorted(offsets, a, "right")])
                gaps = np.flatnonzero(~inside[data[b:end]])
                b = b + int(gaps[0]) if len(gaps) else end
        yield a, b
        a = b


def term_spans(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Lower-cased bytes, start, stop and row of each term, a piece at a time."""
    data, offsets = utf8(column)
    for a, b in byte_pieces(data, offsets, _INSIDE):
        part = _LOWER[data[a:b]]
        start, stop, _ = runs(_TERM[part], np.clip(offsets, a, b) - a)
        yield part, start, stop, np.searchsorted(offsets, start + a, "right") - 1


def item_terms(benchmark: DataFrame) -> DataFrame:
    """item (a number of the row), item_id, term, times."""
    rows = only(benchmark, "item_id", "text").select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))

    def split(batches):
        for batch in batches:
            for part, start, stop, row in term_spans(batch.column("text")):
                terms = [part[a:b].tobytes() for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column("item").take(row), batch.column("item_id").take(row), pa.array(terms, pa.binary())], names=["item", "item_id", "term"])

    found = rows.mapInArrow(tidy(split), "item long, item_id long, term binary")
    return found.groupBy("item", "item_id", "term").agg(F.count(F.lit(1)).alias("times"))


class Vocabulary:
    """Distinct terms with their places: looked up by hash, told apart by bytes."""

    def __init__(self, terms: list[bytes]):
        self.stops = np.cumsum([len(t) for t in terms], dtype=np.int64)
        self.starts = np.append(0, self.stops[:-1])
        self.data = np.frombuffer(b"".join(terms), np.uint8)
        h = word_hashes(self.data, self.starts, self.stops)
        self.order = np.argsort(h, kind="stable")
        self.hashes = h[self.order]
        self.most = int(np.unique(h, return_counts=True)[1].max(initial=1))  # terms that share a hash

    def find(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The place of each term, -1 for others."""
        h = word_hashes(data, start, stop)
        out = np.full(len(h), -1, np.int64)
        at, own, there = np.searchsorted(self.hashes, h), eight_bytes(self.data), eight_bytes(data)
        for step in range(self.most):
            k = at + step
            rows = np.flatnonzero((k < len(self.hashes)) & (out < 0))
            rows = rows[self.hashes[k[rows]] == h[rows]]
            place = self.order[k[rows]]
            size = stop[rows] - start[rows]
            same = size == self.stops[place] - self.starts[place]
            rows, place, size = rows[same], place[same], size[same]
            same = equal_spans(there, start[rows], own, self.starts[place], size)
            out[rows[same]] = place[same]
        return out


def document_rows(documents: DataFrame, vocabulary) -> DataFrame:
    """doc_id, n (terms with repeats), and the vocabulary's terms in it with their counts, as arrays of
    unsigned 32- and 64-bit numbers."""

    def split(batches):
        for batch in batches:
            known = vocabulary.value
            n, keys, counts = np.zeros(batch.num_rows, np.int64), [], []
            size = max(len(known.stops), 1)
            for part, start, stop, row in term_spans(batch.column("text")):
                n += np.bincount(row, minlength=batch.num_rows)
                place = known.find(part, start, stop)
                hit = place >= 0
                key, count = np.unique(row[hit] * size + place[hit], return_counts=True)
                keys.append(key)
                counts.append(count)
            key, back = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_inverse=True)
            count = np.zeros(len(key), np.int64)
            np.add.at(count, back, np.concatenate(counts) if counts else np.zeros(0, np.int64))
            edges = np.searchsorted(key, np.arange(batch.num_rows + 1) * size)
            term = (key % size).astype("<u4")
            cells = [[x[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)] for x in (term, count.astype("<u8"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), *(pa.array(c, pa.binary()) for c in cells)], names=["doc_id", "n", "terms", "counts"])

    rows = only(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(split), "doc_id long, n long, terms binary, counts binary")


def document_frequencies(matrix: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """N, L and df of each term: sums of what tasks have summed."""

    def count(batches):
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), "<u4"), minlength=n_terms)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["term", "df"])

    n, total = matrix.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
    rows = matrix.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    out = np.zeros(n_terms, np.int64)
    for r in rows.toLocalIterator():  # at most the terms of a block of items
        out[r.term] = r.df
    return int(n), int(total or 0), out


def weights(n: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def impacts(tf: np.ndarray, n: np.ndarray, n_documents: int, length: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 12 m), m = 75 + (25 n N) div L; products beyond 64 bits in whole numbers."""
    if int(n.max(initial=0)) * 25 * n_documents < 1 << 63:
        m = 75 + 25 * n * n_documents // length
    else:
        m = np.array([75 + 25 * x * n_documents // length for x in n.tolist()], np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


class Best:
    """The best ``k`` (score, doc_id) of each item so far."""

    def __init__(self, n_items: int, k: int):
        self.k, self.rows = k, [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))] * n_items

    def add(self, item: int, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        had = self.rows[item]
        least = max(1, int(had[0][-1]) if len(had[0]) == self.k else 1)
        some = np.flatnonzero(score >= least)
        if len(some) > self.k:
            kth = np.partition(score[some], len(some) - self.k)[len(some) - self.k]
            some = some[score[some] >= kth]
        if len(some):
            s, d, u = (np.concatenate(x) for x in zip(had, (score[some], doc[some], null[some]), strict=True))
            first = np.lexsort((d, u, -s))[: self.k]
            self.rows[item] = s[first], d[first], u[first]


def product(matrix: DataFrame, query, k: int) -> DataFrame:
    """item, doc_id, score: the best documents of each item in each task."""

    def multiply(batches):
        of, term, factor, n_terms, n_documents, length = query.value
        best = Best(len(of) - 1, k)
        for doc, null, n, rows, cells, tf in _blocks(batches):
            row = np.repeat(np.arange(len(n)), cells)
            value = impacts(tf, n[row], n_documents, length)
            order = np.argsort(rows, kind="stable")
            row, value = row[order], value[order]
            edges = np.searchsorted(rows[order], np.arange(n_terms + 1))
            score = np.empty(len(n), np.int64)
            for item in range(len(of) - 1):
                score[:] = 0
                for t, w in zip(term[of[item] : of[item + 1]].tolist(), factor[of[item] : of[item + 1]].tolist(), strict=True):
                    a, b = edges[t], edges[t + 1]
                    if a < b:
                        score[row[a:b]] += w * value[a:b]  # a document once in a term's row
                best.add(item, score, doc, null)
        size = [len(x[0]) for x in best.rows]
        s, d, u = (np.concatenate([none, *(x[c] for x in best.rows)]) for c, none in enumerate((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(size)), size)), pa.array(d, mask=u), pa.array(s)], names=["item", "doc_id", "score"])

    return matrix.where("n > 0").mapInArrow(tidy(multiply), "item long, doc_id long, score long")


def _blocks(batches) -> Iterator[tuple]:
    """doc ids, whether null, n, terms, terms of each document and counts of a block of documents."""
    held, entries, documents = [], 0, 0
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK_DOCUMENTS):
            part = batch.slice(a, BLOCK_DOCUMENTS)
            held.append(part)
            documents += part.num_rows
            entries += sum(len(x) for x in part.column("terms").to_pylist()) // 4
            if documents >= BLOCK_DOCUMENTS or entries >= BLOCK_ENTRIES:
                yield _block(held)
                held, entries, documents = [], 0, 0
    if held:
        yield _block(held)


def _block(held: list[pa.RecordBatch]) -> tuple:
    t = pa.Table.from_batches(held)
    terms = [x for c in t.column("terms").chunks for x in c.to_pylist()]
    doc = t.column("doc_id")
    tf = np.frombuffer(b"".join(x for c in t.column("counts").chunks for x in c.to_pylist()), "<u8").astype(np.int64)
    cells = np.array([len(x) // 4 for x in terms], np.int64)
    return doc.fill_null(0).to_numpy(), doc.is_null().to_numpy(), t.column("n").to_numpy(), np.frombuffer(b"".join(terms), "<u4"), cells, tf


def rank(documents: DataFrame, benchmark: DataFrame, k: int = BEST, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents with a score above 0 of each item."""
    spark = documents.sparkSession
    path = shared_dir(spark)
    items = materialize(item_terms(benchmark), f"{path}/items")
    size = items.agg(F.sum(F.octet_length("term") + 24)).first()[0] or 0
    n_blocks = max(1, -(-int(size) // item_bytes))
    block = F.pmod(F.xxhash64("item"), F.lit(n_blocks))
    parts = [_rank_block(documents, items.where(block == b), k, f"{path}/block{b}") for b in range(n_blocks)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _rank_block(documents: DataFrame, items: DataFrame, k: int, path: str) -> DataFrame:
    context = documents.sparkSession.sparkContext
    rows = sorted(items.toLocalIterator(), key=lambda r: r.item)  # one block
    terms = sorted({bytes(r.term) for r in rows})
    place = {t: i for i, t in enumerate(terms)}
    ids = {r.item: r.item_id for r in rows}
    number = {item: i for i, item in enumerate(ids)}
    matrix = materialize(document_rows(documents, context.broadcast(Vocabulary(terms))), f"{path}/documents")
    n_documents, length, df = document_frequencies(matrix, len(terms))
    term = np.array([place[bytes(r.term)] for r in rows], np.int64)
    factor = np.array([r.times for r in rows], np.int64) * weights(n_documents, df)[term] if rows else np.zeros(0, np.int64)
    of = np.searchsorted(np.array([number[r.item] for r in rows], np.int64), np.arange(len(ids) + 1))
    query = context.broadcast((of, term, factor, len(terms), n_documents, max(length, 1)))
    found = product(matrix, query, k)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for keys in (["item", "part"], ["item"]):
        if "part" in keys:
            found = found.withColumn("part", F.spark_partition_id() % GROUPS)
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
        if "part" in keys:
            found = found.drop("rank")
    named = documents.sparkSession.createDataFrame([(i, ids[item]) for item, i in number.items()], "of long, item_id long")
    return found.join(F.broadcast(named), F.col("item") == F.col("of")).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
