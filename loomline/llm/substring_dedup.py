"""Substring dedup (operator 5): recompression.

Rounds alternate between naming runs and naming pairs of symbols.  A pair is named where the left
symbol's class bit is 0 and the right one's is 1, bits that the symbol and the round decide.  Names are
global without a table of names: a name is a 64-bit hash of what it stands for (symbol and run length, or
the two symbols), so every partition gives the same run or pair the same name in the same round.  Equal
substrings therefore get equal symbols in their interior.  For each symbol the span of words that its
making depended on is kept (neighbours that did not join it are part of it): a window that holds the
whole span has this symbol wherever the window occurs.

A table of names for each round, joined to the symbols, would deal every symbol of every round twice; the
hash makes the rounds one narrow map.  That two different runs or pairs may share a name costs nothing
but time: names only choose anchors and bring candidates together, all that must hold is that equal ones
have equal names.  The tests hold this with names of three bits.

The anchor of a window is the longest such symbol in it (ties: by hash), and its name the hash of
its span's words.  A window without one stands for itself.  Shared names reveal candidates; Spark sums
them over all texts, and windows of candidates are compared within a name by their own hashes, which are
polynomials over a field (see ``textarrays``).  See ``repeats`` for the phases.

Each word covered by a window of 35 words that also starts anywhere else goes.  Defined results: a
null text has no words; texts of fewer than 35 words lose nothing; all words of equal texts of 35
words or more go.  Rows that repeat a doc_id are texts of their own.  Extra columns are ignored.  A text
must fit a task, with about 40 bytes of memory for each of its bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import HOT, Groups, Rules, marked_intervals, new_path, number_of_buckets, runs_of, union_mask, with_spans
from .shared import tidy
from .textarrays import binary_array, mix, prefix_sums, ranges, span_hash, utf8, word_hashes, words

WINDOW = 35
ROUNDS = 4

_RUN, _PAIR = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


class Symbols:
    """A parse of the words of several documents: names, word spans, spans they depend on."""

    def __init__(self, names: np.ndarray, at: np.ndarray):
        n = len(names)
        self.name = names
        self.start, self.stop = np.arange(n), np.arange(1, n + 1)
        self.left, self.right = self.start.copy(), self.stop.copy()
        self.first = np.zeros(n, bool)  # of its document
        self.first[at[:-1][np.diff(at) > 0]] = True

    def _edges(self) -> tuple[np.ndarray, np.ndarray]:
        """What a symbol depends on if its neighbours matter; beyond a text's end lies the unknown."""
        left = np.empty_like(self.left)
        right = np.empty_like(self.right)
        left[1:], right[:-1] = self.left[:-1], self.right[1:]
        last = np.append(self.first[1:], True)
        left[self.first] = self.start[self.first] - 1
        right[last] = self.stop[last] + 1
        return left, right

    def _keep(self, head: np.ndarray, tail: np.ndarray, name: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        self.name, self.left, self.right = name, left, right
        self.start, self.stop, self.first = self.start[head], self.stop[tail], self.first[head]

    def name_runs(self) -> None:
        new = np.ones(len(self.name), bool)
        new[1:] = (self.name[1:] != self.name[:-1]) | self.first[1:]
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(self.name)) - 1
        size = (tail - head + 1).astype(np.uint64)
        left, right = self._edges()
        name = self.name[head]
        name = np.where(size > 1, mix(name * _RUN + size), name)
        self._keep(head, tail, name, left[head], right[tail])

    def name_pairs(self, round_: int) -> None:
        bit = (mix(self.name + np.uint64(round_ * 2 + 1)) >> np.uint64(63)).astype(bool)
        pair = np.zeros(len(self.name), bool)  # at the left one
        pair[:-1] = ~bit[:-1] & bit[1:] & ~self.first[1:]
        head = np.flatnonzero(~np.append(False, pair[:-1]))
        joined = pair[head]
        tail = head + joined
        left, right = self._edges()
        name = np.where(joined, mix(mix(self.name[head]) * _PAIR + self.name[tail]), self.name[head])
        alone_left, alone_right = ~joined & bit[head], ~joined & ~bit[head]
        self._keep(head, tail, name, np.where(alone_left, left[head], self.left[head]), np.where(alone_right, right[head], self.right[tail]))


def parse(names: np.ndarray, at: np.ndarray, rounds: int = ROUNDS) -> Symbols:
    s = Symbols(names, at)
    for r in range(rounds):
        if len(s.name):
            s.name_runs()
            s.name_pairs(r)
    return s


def word_anchors(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS):
    """Anchors of all windows; see ``repeats.Anchors``.  Places are word numbers in a document."""
    start, stop, at = words(data, offsets)
    hashed = word_hashes(data, start, stop)
    n = np.maximum(np.diff(at) - window + 1, 0)
    p = ranges(at[:-1], n)
    if not len(p):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    s = parse(hashed, at, rounds)
    sums = prefix_sums(hashed)
    size = np.minimum(s.stop - s.start, 63)
    key = ((63 - size).astype(np.uint64) << np.uint64(58)) | (mix(s.name) >> np.uint64(6))
    lo = np.searchsorted(s.left, p, "left")
    hi = np.searchsorted(s.right, p + window, "right")
    count = hi - lo
    best = np.full(len(p), -1, np.int64)
    level, least, where = 0, key, np.arange(len(key))  # the first least key of 2**level symbols
    while True:
        this = np.flatnonzero((count >= 1 << level) & (count < 2 << level))
        if len(this):
            a, b = lo[this], hi[this] - (1 << level)
            best[this] = np.where(least[a] <= least[b], where[a], where[b])
        if not (count >= 2 << level).any():
            break
        half = 1 << level
        where = np.where(least[:-half] <= least[half:], where[:-half], where[half:])
        least = np.minimum(least[:-half], least[half:])
        level += 1
    owner = np.repeat(np.arange(len(n)), n)
    new = np.ones(len(p), bool)
    new[1:] = (best[1:] != best[:-1]) | (owner[1:] != owner[:-1]) | (best[1:] < 0)
    head = np.flatnonzero(new)
    chosen = best[head]
    own = chosen < 0
    left = np.where(own, p[head], s.left[np.maximum(chosen, 0)])
    right = np.where(own, p[head] + window, s.right[np.maximum(chosen, 0)])
    return owner[head], p[head] - at[owner[head]], np.diff(np.append(head, len(p))), span_hash(sums, left, right)


def word_payload(data, offsets, window: int = WINDOW):
    """The hashes of each anchor's windows, eight bytes each."""
    start, stop, at = words(data, offsets)
    sums = prefix_sums(word_hashes(data, start, stop))

    def payload(doc, first, count):
        p = ranges(at[doc] + first, count)
        return span_hash(sums, p, p + window).view(np.uint8), 8 * np.append(0, np.cumsum(count))

    return payload


def hash_buckets(names: DataFrame):
    """Names of symbols have no order: they are dealt by their hash."""
    n = number_of_buckets(names)
    return (lambda name, block, blocks: mix(name + block.astype(np.uint64)) % np.uint64(n)), n


def settle_windows(t: pa.Table, window: int):
    """Marks windows that stand at two places; of split names each window once more, for all blocks."""
    g = Groups.of(t)
    row = np.repeat(np.arange(len(g.n)), g.n)
    place = ranges(g.first, g.n)
    h = g.data[ranges(g.start, g.size)].view(np.uint64)
    _, lead, which, counts = np.unique(h ^ mix(g.name)[row], return_index=True, return_inverse=True, return_counts=True)
    again = np.flatnonzero(counts[which] > 1)
    if len(again):
        head, tail = runs_of(row[again], place[again])
        yield g.batch(row[again[head]], place[again[head]], place[again[tail]] + window)
    split = np.flatnonzero(g.blocks[row[lead]] > 1)
    if len(split):
        at = lead[split]
        both = np.stack([h[at], g.name[row[at]]], 1)
        yield g.batch(row[at], place[at], place[at] + window, binary_array(both.view(np.uint8).reshape(-1), 16 * np.arange(len(at) + 1)), counts[split] > 1)


def word_rules(window: int = WINDOW, rounds: int = ROUNDS, hot: int = HOT) -> Rules:
    return Rules(
        anchors=lambda data, offsets: word_anchors(data, offsets, window, rounds),
        payload=lambda data, offsets: word_payload(data, offsets, window),
        settle=lambda t: settle_windows(t, window),
        buckets=hash_buckets,
        later_only=False,
        hot=hot,
    )


def remove_repeats(documents: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, hot: int = HOT) -> DataFrame:
    """doc_id, kept_text (kept words joined by one blank), n_words, n_removed, kept_sha256."""
    path = new_path(documents)
    spans = marked_intervals(documents, path, word_rules(window, rounds, hot))

    @tidy
    def cut(batches):
        for batch in batches:
            data, off = utf8(batch.column("text"))
            raw = data.tobytes()
            lists, copies = batch.column("spans"), batch.column("copies").to_numpy()
            bounds = np.asarray(lists.offsets)
            flat = lists.flatten()
            begin, end = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)
            base = bounds[0]
            out = []
            for k in range(batch.num_rows):
                w = raw[off[k] : off[k + 1]].split()
                n, gone = len(w), 0
                if copies[k] > 1 and n >= window:
                    w, gone = [], n
                elif bounds[k + 1] > bounds[k]:
                    mask = union_mask(n, (begin[bounds[k] - base : bounds[k + 1] - base], end[bounds[k] - base : bounds[k + 1] - base]))
                    gone = int(mask.sum())
                    w = [x for x, m in zip(w, mask.tolist(), strict=True) if not m]
                kept = b" ".join(w)
                out.append((kept.decode("utf-8"), n, gone, hashlib.sha256(kept).hexdigest()))
            text, n, gone, sha = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "kept_text", "n_words", "n_removed", "kept_sha256"])

    return with_spans(documents, spans, path).select("doc_id", "text", "spans", "copies").mapInArrow(cut, "doc_id long, kept_text string, n_words long, n_removed long, kept_sha256 string")
