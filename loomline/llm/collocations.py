"""Phrase collocation mining (operator 13): n-grams mined by the partitions of their rarest words.

A first pass counts words.  Frequent words get codes, the smaller the more frequent, so the rarest word
of an n-gram, its pivot, is the one of the largest code (its first occurrence, where it repeats).  A
second pass rewrites each text to fragments: for each occurrence of a frequent word the up to three
words before it that are more frequent and the up to three after it that are not rarer, without
crossing a piece or an infrequent word.  These fragments hold exactly the n-grams of four words at most
that this occurrence is the pivot of; they are routed to the pivot's bucket, equal ones counted once with
a number, and each bucket is mined by itself, level by level from the pivot, so that n-grams are counted
there and nowhere else.

A pivot with more than ``HOT`` occurrences has its fragments dealt to several buckets, whose counts
are summed afterwards; the others' n-grams below the threshold never leave their task.  The codes of
the ``HEAD`` most frequent words are broadcast.  The frequent words beyond them, if there are any, are told
from infrequent ones by a bitmap of fixed size, in which a wrong yes costs time only; their code is their
hash, so they all count as rarer than the words of the head, by no particular order among themselves,
which changes who owns an n-gram and not its count.

Scores, the test for longer phrases and ranks are DataFrame operations over frequent n-grams.  Products
are decimals of 38 digits.  Words stand for a hash of 63 bits with their language; two frequent ones
of a table that share it would be taken for each other.

Defined results: null texts are empty, a null lang is ``und``; rows that repeat an id all count; ids are
not read; extra columns are ignored; an empty table gives no rows.  A text is taken
``CHUNK_BYTES`` at a time, cut between pieces; one piece must fit a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lexical_search import byte_pieces
from .shared import join_counted, materialize, only, shared_dir, tidy
from .textarrays import CHUNK_BYTES, U64, binary_array, mix, ranges, runs, utf8, whole_groups, word_hashes

LEAST = 30
LONGEST = 4
BEST = 2_000
#: a candidate goes if a longer one has this share of its occurrences, in hundredths
SHARE = 80
#: words whose codes are broadcast, 12 bytes each, and bits for those beyond
HEAD = 2_000_000
BITMAP = 27
#: occurrences beyond which a pivot is dealt to several buckets, and fragments in a bucket
HOT = 1_000_000
BUCKET = 1_000_000

_SIDE = LONGEST - 1
_NONE = U64(0xFFFFFFFFFFFFFFFF)
_TOP = U64(1 << 63)
_K = U64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
_WORD = ~_BREAK
_WORD[[32, 9]] = False


def word_spans(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Lower-cased bytes, start, stop, row and hash of each word, and whether it follows the one before
    it in the same piece; some megabytes of text at a time."""
    data, offsets = utf8(batch.column("text"))
    lang, edges = utf8(batch.column("lang"))
    salt = mix(word_hashes(lang, edges[:-1], edges[1:]))
    for a, b in byte_pieces(data, offsets, ~_BREAK, CHUNK_BYTES):
        part = _LOWER[data[a:b]]
        start, stop, _ = runs(_WORD[part], np.clip(offsets, a, b) - a)
        row = np.searchsorted(offsets, start + a, "right") - 1
        h = mix(word_hashes(part, start, stop) ^ salt[row]) | _TOP
        piece = np.cumsum(_BREAK[part])[start] if len(start) else start
        follows = np.zeros(len(start), bool)
        follows[1:] = (piece[1:] == piece[:-1]) & (row[1:] == row[:-1])
        yield part, start, stop, row, h, follows


def _texts(documents: DataFrame) -> DataFrame:
    return only(documents, "lang", "text").select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))


def count_words(documents: DataFrame) -> DataFrame:
    """lang, word, h, n: of each word; rows of an empty word have the number of all words of a language."""

    def count(batches):
        for batch in batches:
            for part, start, stop, row, h, _ in word_spans(batch):
                _, first, n = np.unique(h, return_index=True, return_counts=True)
                size = stop[first] - start[first]
                word = binary_array(part[ranges(start[first], size)], np.append(0, np.cumsum(size))).cast(pa.string())
                all_words = np.bincount(row, minlength=batch.num_rows)
                some = np.flatnonzero(all_words)
                langs = batch.column("lang").take(pa.array(np.append(row[first], some)))
                words = pa.concat_arrays([word, pa.array([""] * len(some), pa.string())])
                hashes = np.append(h[first], np.zeros(len(some), U64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([langs, words, pa.array(hashes), pa.array(np.append(n, all_words[some]))], names=["lang", "word", "h", "n"])

    return _texts(documents).mapInArrow(tidy(count), "lang string, word string, h long, n long").groupBy("lang", "word", "h").agg(F.sum("n").alias("n"))


class Codes:
    """Codes of words: the rank of a word of the head, the hash of another that may be frequent."""

    def __init__(self, head: np.ndarray, bitmap: np.ndarray | None, salts: np.ndarray):
        self.ranked, self.bitmap, self.salts = head, bitmap, salts
        order = np.argsort(head)
        self.hashes, self.rank = head[order], order.astype(np.uint32)

    def of(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), _NONE)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = self.hashes[at] == h
            out[hit] = self.rank[at[hit]]
        if self.bitmap is not None:
            rest = np.flatnonzero(out == _NONE)
            bit = (h[rest] & ~_TOP) >> U64(63 - BITMAP)
            may = self.bitmap[(bit >> U64(6)).astype(np.int64)] >> (bit & U64(63)) & U64(1)
            rest = rest[may.astype(bool)]
            out[rest] = h[rest]
        return out

    def hashes_of(self, codes: np.ndarray) -> np.ndarray:
        out = codes.copy()
        low = codes < _TOP
        out[low] = self.ranked[codes[low].astype(np.int64)]
        return out


def word_codes(frequent: DataFrame, head: int, hot: int) -> Codes:
    """The codes of a written table of frequent words (h, n)."""
    size = F.floor(F.log2("n") * 16).cast("int")
    sizes = sorted(((r.s, r.k) for r in frequent.groupBy(size.alias("s")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)  # at most 1,024 rows
    taken, least = 0, None
    for s, k in sizes:
        if taken + k > head:
            break
        taken, least = taken + k, s
    tail = least is None or least != min(s for s, _ in sizes)
    got = frequent.where(size >= least).select("h", "n").toArrow() if least is not None else None  # ``head`` rows at most
    h = got.column("h").to_numpy().astype(U64) if got is not None else np.zeros(0, U64)
    n = got.column("n").to_numpy() if got is not None else np.zeros(0, np.int64)
    order = np.lexsort((h, -n))
    h, n = h[order], n[order]
    bitmap = None
    if tail and sizes:
        bit = F.shiftrightunsigned(F.col("h").bitwiseAND((1 << 63) - 1), 63 - BITMAP)
        rows = frequent if least is None else frequent.where(size < least)
        words = rows.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("mask")).toArrow()
        bitmap = np.zeros(1 << (BITMAP - 6), U64)
        bitmap[words.column("at").to_numpy()] = words.column("mask").to_numpy().astype(U64)
    return Codes(h, bitmap, (-(-n[n > hot] // hot)).astype(np.uint64))


def fragments(code: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each occurrence that is the pivot of some n-gram: the codes around it, in which ``_SIDE`` words
    stand before and after it, and the number of these that belong to the fragment."""
    n = len(code)
    around = np.full(n + 2 * _SIDE, _NONE)
    around[_SIDE : n + _SIDE] = code
    joined = np.zeros(n + 2 * _SIDE, bool)
    joined[_SIDE : n + _SIDE] = follows
    frequent = code != _NONE
    before, after = np.zeros(n, np.int64), np.zeros(n, np.int64)
    left, right = frequent.copy(), frequent.copy()
    for k in range(1, _SIDE + 1):
        left &= joined[_SIDE - k + 1 : n + _SIDE - k + 1] & (around[_SIDE - k : n + _SIDE - k] < code)
        right &= joined[_SIDE + k : n + _SIDE + k] & (around[_SIDE + k : n + _SIDE + k] <= code)
        before += left
        after += right
    at = np.flatnonzero(before + after)
    before, after = before[at], after[at]
    out = around[at[:, None] + np.arange(2 * _SIDE + 1)]
    place = np.arange(-_SIDE, _SIDE + 1)
    out[(place < -before[:, None]) | (place > after[:, None])] = _NONE
    return out, before, after


def count_equal(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of different rows, how often each occurs, and their hashes.  Rows with equal hashes are
    compared; where different ones share a hash, a row may be given more than once."""
    h = np.zeros(len(rows), U64)
    for c in range(rows.shape[1]):
        h = mix(h * _K + rows[:, c])
    order = np.argsort(h)
    new = np.ones(len(order), bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]) | (rows[order[1:]] != rows[order[:-1]]).any(1)
    head = np.flatnonzero(new)
    return order[head], np.diff(np.append(head, len(order))), h[order[head]]


def route(documents: DataFrame, codes, n_buckets: int) -> DataFrame:
    """bucket, extent, times, words: the fragments of a bucket and a stretch of text in one row.  Those
    of pivots that are dealt to several buckets have buckets of their own, numbered from ``n_buckets``."""

    def cut(batches):
        for batch in batches:
            for _, _, _, _, h, follows in word_spans(batch):
                known = codes.value
                rows, before, after = fragments(known.of(h), follows)
                first, times, own = count_equal(rows)
                rows, before, after = rows[first], before[first], after[first]
                pivot = rows[:, _SIDE]
                hot = pivot < U64(len(known.salts))
                salt = np.zeros(len(rows), U64)
                salt[hot] = own[hot] % known.salts[pivot[hot].astype(np.int64)]
                bucket = (mix(pivot * _K + salt) % U64(n_buckets)).astype(np.int64) + n_buckets * hot
                order = np.argsort(bucket, kind="stable")
                bucket = bucket[order]
                edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)) if len(bucket) else np.zeros(1, np.int64)
                rows, times = rows[order], times[order].astype("<u4")
                extent = (before[order] | after[order] << 2).astype(np.uint8)
                full = rows != _NONE
                cells = []
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    words = rows[a:b][full[a:b]]
                    words = words if int(words.max()) >> 32 else words.astype("<u4")
                    cells.append((int(bucket[a]), extent[a:b].tobytes(), times[a:b].tobytes(), words.tobytes()))
                if cells:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "extent", "times", "words"])

    return _texts(documents).mapInArrow(tidy(cut), "bucket long, extent binary, times binary, words binary")


def _counted(keys: np.ndarray, times: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each key the number of its group, -1 if it occurs less than ``least`` times; a place and the
    occurrences of each group that stays."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    head = np.flatnonzero(new)
    total = np.add.reduceat(times[order], head) if len(head) else np.zeros(0, np.int64)
    stay = total >= least
    number = np.where(stay, np.cumsum(stay) - 1, -1)
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(number, np.diff(np.append(head, len(order))))
    return out, order[head[stay]], total[stay]


def mine(extent: np.ndarray, times: np.ndarray, words: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words and occurrences of the n-grams of two words and more that the fragments' pivots own.

    An n-gram is made of an owned one that is a word shorter, at its beginning or end, and a word; it
    begins at a fixed distance before its pivot, so each distance and length is counted for itself.
    """
    before, after = (extent & 3).astype(np.int64), (extent >> 2).astype(np.int64)
    pivot = np.cumsum(before + after + 1) - after - 1
    level = {0: words[pivot].astype(np.int64)}  # distance to the first word: group of the n-gram there
    for size in range(2, LONGEST + 1):
        found = {}
        for back in range(size):
            shorter = back - 1 if back == size - 1 else back  # what is left without the first, or the last word
            at = pivot - back if back == size - 1 else pivot - back + size - 1
            some = np.flatnonzero((before >= back) & (after >= size - 1 - back))
            some = some[level[shorter][some] >= 0]
            group, first, total = _counted(level[shorter][some].astype(U64) << U64(32) | words[at[some]].astype(U64), times[some], least)
            found[back] = np.full(len(extent), -1, np.int64)
            found[back][some] = group
            if len(first):
                yield words[(pivot[some[first]] - back)[:, None] + np.arange(size)], total
        level = found


def frequent_ngrams(routed: DataFrame, codes, n_buckets: int, least: int) -> DataFrame:
    """g (hashes of the words), a: n-grams of two words and more."""

    def count(batches):
        for table in whole_groups(batches, "bucket"):
            bucket = table.column("bucket").to_numpy()
            edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                part = table.slice(a, b - a)
                extent, times, words = (part.column(c).to_pylist() for c in ("extent", "times", "words"))
                wide = [len(w) == 8 * sum((x & 3) + (x >> 2) + 1 for x in e) for e, w in zip(extent, words, strict=True)] if codes.value.bitmap is not None else [False] * len(words)
                code = np.concatenate([np.frombuffer(w, "<u8" if big else "<u4").astype(U64 if any(wide) else np.uint32) for w, big in zip(words, wide, strict=True)])
                known = None
                if any(wide):
                    known, code = np.unique(code, return_inverse=True)
                partial = int(bucket[a]) >= n_buckets
                for grams, n in mine(np.frombuffer(b"".join(extent), np.uint8), np.frombuffer(b"".join(times), "<u4").astype(np.int64), code, 1 if partial else least):
                    h = codes.value.hashes_of((known[grams] if known is not None else grams).astype(U64).ravel()).astype(np.int64)
                    g = pa.ListArray.from_arrays(pa.array(np.arange(len(grams) + 1) * grams.shape[1], pa.int32()), pa.array(h))
                    yield pa.RecordBatch.from_arrays([g, pa.array(n), pa.array(np.full(len(n), partial))], names=["g", "a", "partial"])

    parts = 2 * n_buckets
    dealt = routed.repartition(min(parts, 100_000), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(tidy(count), "g array<long>, a long, partial boolean")


def _ratio(a: Column, b: Column, times: int) -> Column:
    """floor(times * a / b) in decimals."""
    return F.call_function("div", F.lit(times).cast("decimal(7,0)") * a.cast("decimal(20,0)"), b.cast("decimal(21,0)"))


def phrases(documents: DataFrame, least: int = LEAST, best: int = BEST, head: int = HEAD, hot: int = HOT, bucket: int = BUCKET) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``best`` phrases of each language."""
    spark = documents.sparkSession
    path = shared_dir(spark)
    counted = materialize(count_words(documents).where((F.col("word") == "") | (F.col("n") >= least)), f"{path}/words")
    totals = counted.where("word = ''").groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = counted.where("word <> ''")
    n_words = totals.agg(F.sum("n")).first()[0] or 0
    n_buckets = max(1, -(-int(n_words) // bucket))
    codes = spark.sparkContext.broadcast(word_codes(frequent, head, hot))
    mined = materialize(frequent_ngrams(route(documents, codes, n_buckets), codes, n_buckets, least), f"{path}/mined")
    summed = mined.where("partial").groupBy("g").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    grams = materialize(mined.where("not partial").select("g", "a").unionByName(summed), f"{path}/grams")
    stay = materialize(_without_longer(_scored(grams, frequent, path)), f"{path}/stay")
    return _ranked(stay, frequent, totals, best, path)


def _scored(grams: DataFrame, frequent: DataFrame, path: str) -> DataFrame:
    """grams with l, r and score of the lowest-scoring cut."""
    place = F.explode(F.sequence(F.lit(1), F.size("g") - 1)).alias("cut")
    cuts = grams.select("g", "a", place).select("g", "a", "cut", F.slice("g", F.lit(1), F.col("cut")).alias("first"), F.slice("g", F.col("cut") + 1, F.size("g") - F.col("cut")).alias("rest"))
    asked = cuts.select(F.col("first").alias("part")).unionByName(cuts.select(F.col("rest").alias("part"))).groupBy("part").agg(F.count(F.lit(1)).alias("k"))
    known = grams.select("g", "a").unionByName(frequent.select(F.array("h").alias("g"), F.col("n").alias("a")))
    parts = materialize(asked.join(known, F.col("part") == F.col("g")).select("part", F.col("a").alias("f"), "k"), f"{path}/parts")
    for side, name in (("first", "l"), ("rest", "r")):
        cuts = join_counted(cuts, parts.withColumnsRenamed({"part": side, "f": name}), [side]).drop("k")
    cuts = cuts.withColumn("score", _ratio(F.col("a"), F.col("l") + F.col("r"), 2_000_000))
    lowest = cuts.groupBy("g", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x"))
    return lowest.select("g", "a", "x.l", "x.r", "x.score")


def _without_longer(scored: DataFrame) -> DataFrame:
    """Without those that lie in a longer candidate with ``SHARE`` of their occurrences."""
    inner = F.expr("flatten(transform(sequence(2, size(g) - 1), s -> transform(sequence(1, size(g) - s + 1), i -> slice(g, i, s))))")
    longest = scored.where(F.size("g") > 2).select(F.explode(inner).alias("inner"), F.col("a").alias("longer")).groupBy("inner").agg(F.max("longer").alias("longer"))
    both = scored.join(longest, F.col("g") == F.col("inner"), "left")
    gone = F.lit(100).cast("decimal(3,0)") * F.col("longer").cast("decimal(20,0)") >= F.lit(SHARE).cast("decimal(3,0)") * F.col("a").cast("decimal(20,0)")
    return both.where(~F.coalesce(gone, F.lit(False))).drop("inner", "longer")


def _ranked(stay: DataFrame, frequent: DataFrame, totals: DataFrame, best: int, path: str) -> DataFrame:
    at = stay.select("g", F.posexplode("g").alias("place", "h"))
    asked = at.groupBy("h").agg(F.count(F.lit(1)).alias("k"))
    words = materialize(frequent.select("lang", "word", F.col("h").alias("word_h")).join(asked, F.col("word_h") == F.col("h")).select("h", "lang", "word", "k"), f"{path}/asked")
    spelt = join_counted(at, words, ["h"]).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("w"), F.first("lang").alias("lang"))
    named = stay.join(spelt.select(F.col("g").alias("of"), "lang", F.array_join("w.word", " ").alias("phrase")), F.col("g") == F.col("of"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    top = named.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= best)
    return top.join(totals.withColumnRenamed("lang", "l_"), F.col("lang") == F.col("l_")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
