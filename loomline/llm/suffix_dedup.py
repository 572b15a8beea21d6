"""Suffix-array dedup (operator 7).

A sparse suffix array over all texts: of each 100-byte window the suffix at its least 24-byte string, by
hash, is indexed, so equal windows index equal suffixes and about one byte in forty opens a suffix.
Suffixes whose leading bytes stand alone drop out before any content moves.

Splitters sampled from the leading bytes part the others in ranges; all suffixes with the same leading
bytes are of one range, so neighbours never stand on two sides of a boundary.  Each range is sorted by
multikey quicksort, eight bytes at a time, and what stands before each suffix is sorted likewise, read
backwards.  Two windows are equal if their suffixes are neighbours in the first order and what is before
them in the second, up to the bytes that the window has on each side: byte by byte, no hash decides.
Leading bytes with more than ``repeats.HOT`` suffixes are cut in several blocks; each block hands every
different window on once, under a 128-bit digest, and these are compared across the blocks' boundaries.

Each byte covered by a 100-byte string that also starts earlier (smaller doc_id, or the same
document and an earlier start) goes.  Defined results: a null text is empty; a null doc_id counts as
smaller than any; rows of equal doc_id stand in order of their text's MD5; rows equal in doc_id and
text are one document, and all get its result.  Extra columns are ignored.  A text must fit a task, with
about 30 bytes of memory for each of its bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import HOT, Groups, Rules, marked_intervals, new_path, number_of_buckets, runs_of, union_mask, with_spans
from .shared import tidy
from .textarrays import gram_hashes, mix, ranges, sliding_min, utf8

WIDTH = 100
LEADING = 24
#: names that splitters are taken from, for each bucket and at most
SAMPLE, MOST_SAMPLE = 50, 2_000_000
#: windows whose anchors are chosen in one step, and the bits that tell their places
SEGMENT, PLACE_BITS = 1 << 21, np.uint64(24)


def suffix_anchors(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH, leading: int = LEADING):
    """Anchors of all windows of ``width`` bytes; see ``repeats.Rules``.  The number is the count of
    windows and, from the ninth bit on, how far the anchor stands behind the first window's start.  A
    name is the three leading bytes and 40 bits of a hash of all leading ones: names are in order of
    leading bytes."""
    n = np.maximum(np.diff(offsets) - width + 1, 0)
    owner_of = np.repeat(np.arange(len(n)), n)
    places = ranges(offsets[:-1], n)
    mask = (np.uint64(1) << PLACE_BITS) - np.uint64(1)
    out = []
    for i in range(0, len(places), SEGMENT):  # some windows of a long text at a time
        p, owner = places[i : i + SEGMENT], owner_of[i : i + SEGMENT]
        lo, hi = p[0], p[-1] + 1
        h = gram_hashes(data[lo : hi + width - 1], leading)
        # the bits that stay must not depend on how many windows there are
        least = sliding_min((h & ~mask) | np.arange(len(h), dtype=np.uint64), width - leading + 1)
        best = (least[p - lo] & mask).astype(np.int64)
        new = np.ones(len(p), bool)
        new[1:] = (best[1:] != best[:-1]) | (owner[1:] != owner[:-1])
        head = np.flatnonzero(new)
        best = best[head]
        lead = sum(data[lo + best + k].astype(np.uint64) << np.uint64(56 - 8 * k) for k in range(3))
        number = np.diff(np.append(head, len(p))) | (lo + best - p[head]) << 8
        out.append((owner[head], p[head] - offsets[owner[head]], number, lead | h[best] >> np.uint64(24)))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def counted(number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of an anchor, and the place of the anchor behind the first one's start."""
    return number & 255, number >> 8


def suffix_payload(data, offsets, width: int = WIDTH):
    """The bytes that the windows of each anchor cover."""

    def payload(doc, first, number):
        size = counted(number)[0] + width - 1
        return data[ranges(offsets[doc] + first, size)], np.append(0, np.cumsum(size))

    return payload


def sampled_splitters(names: DataFrame):
    """Ranges of leading bytes with about the same number of suffixes each, from a sample of names.

    A name with several blocks is one that no splitter can cut; its blocks are dealt by hash.
    """
    n = number_of_buckets(names)
    total = names.count()
    share = min(1.0, min(SAMPLE * n, MOST_SAMPLE) / max(total, 1))
    sample = (names if share == 1 else names.sample(share, seed=1)).where("blocks = 1").select("name", "k").toArrow() if n > 1 else None
    if sample is None or not sample.num_rows:
        return (lambda name, block, blocks: np.zeros(len(name), np.int64)), n
    name = sample.column("name").to_numpy().view(np.uint64)
    order = np.argsort(name)
    upto = np.cumsum(sample.column("k").to_numpy()[order])
    at = np.searchsorted(upto, upto[-1] * np.arange(1, n) / n)
    splitters = np.unique(name[order][np.minimum(at, len(order) - 1)])

    def bucket(name, block, blocks):
        return np.where(blocks > 1, (mix(name + block.astype(np.uint64)) % np.uint64(n)).astype(np.int64), np.searchsorted(splitters, name, "right"))

    return bucket, n


def characters(data: np.ndarray, start: np.ndarray, length: np.ndarray, width: int, step: int = 1) -> np.ndarray:
    """Rows of ``width`` bytes from ``start`` on, forward or back, zeros beyond ``length``, as characters
    of eight bytes that compare as the bytes do."""
    k = np.arange(-(-width // 8) * 8)
    inside = k < np.minimum(length, width)[:, None]
    out = np.zeros(inside.shape, np.uint8)
    out[inside] = data[(start[:, None] + step * k)[inside]]
    return out.view(">u8").astype(np.uint64)


def multikey_sort(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows and how many bytes each shares with the one before it.

    Multikey quicksort, all groups at once: rows are parted by one character; only those that are equal
    so far go on to the next.
    """
    n, depth = chars.shape
    order = np.arange(n)
    shared = np.full(n, 8 * depth)
    shared[:1] = 0
    active, group = np.arange(n), np.zeros(n, np.int64)
    for d in range(depth):
        if len(active) < 2:
            break
        c = chars[order[active], d]
        by = np.lexsort((c, group)) if d else np.argsort(c, kind="stable")
        order[active] = order[active][by]
        c = c[by]
        one = group[1:] == group[:-1]
        differ = c[1:] ^ c[:-1]
        cut = np.flatnonzero(one & (differ != 0))
        equal = sum((differ[cut] < np.uint64(1 << (64 - 8 * k))).astype(np.int64) for k in range(1, 8))
        shared[active[cut + 1]] = 8 * d + equal
        group = np.cumsum(np.append(True, ~(one & (differ == 0)))) - 1
        more = np.bincount(group)[group] > 1
        active, group = active[more], group[more]
    return order, shared


class Ranks:
    """Classes of rows that are equal up to a depth."""

    def __init__(self, chars: np.ndarray):
        order, self.shared = multikey_sort(chars)
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))

    def classes(self, depth: int, rows: np.ndarray) -> np.ndarray:
        return np.cumsum(self.shared < depth)[self.place[rows]]


def settle_suffixes(t: pa.Table, width: int, leading: int):
    """Marks each window that equals an earlier one of a table of whole buckets.

    The suffixes that open at the anchors are sorted, and so are the bytes before the anchors, read
    backwards.  A window with its anchor ``back`` bytes behind its start equals another if both agree on
    ``back`` bytes before the anchor and on the other ``width - back`` from it on: neighbours in the two
    orders tell, byte by byte.  Of a name in several blocks each different window is handed on once.
    """
    g = Groups.of(t)
    count, back = counted(g.n)
    after = Ranks(characters(g.data, g.start + back, g.size - back, width))
    before = Ranks(characters(g.data, g.start + back - 1, back, width - leading, -1))
    late, firsts = [], []
    for k in range(width - leading + 1):
        rows = np.flatnonzero((back >= k) & (back - count < k))
        if not len(rows):
            continue
        key = before.classes(k, rows) * (len(back) + 1) + after.classes(width - k, rows)
        _, lead, which = np.unique(key, return_index=True, return_inverse=True)
        again = np.flatnonzero(lead[which] != np.arange(len(rows)))
        late.append((rows[again], (g.first + back - k)[rows[again]]))
        split = rows[lead][g.blocks[rows[lead]] > 1]
        firsts.append((split, (g.first + back - k)[split]))
    if late and sum(len(r) for r, _ in late):
        row, place = (np.concatenate(x) for x in zip(*late, strict=True))
        order = np.lexsort((place, row))
        row, place = row[order], place[order]
        head, tail = runs_of(row, place)
        yield g.batch(row[head], place[head], place[tail] + width)
    if firsts and sum(len(r) for r, _ in firsts):
        row, place = (np.concatenate(x) for x in zip(*firsts, strict=True))
        raw = g.data[ranges(g.start[row] + place - g.first[row], np.full(len(row), width))].tobytes()
        digests = [hashlib.blake2b(raw[i : i + width], digest_size=16).digest() for i in range(0, len(raw), width)]
        yield g.batch(row, place, place + width, pa.array(digests, pa.binary()))


def suffix_rules(width: int = WIDTH, leading: int = LEADING, hot: int = HOT) -> Rules:
    if not 8 <= leading <= width <= 255:
        raise ValueError("leading must be 8 to width, width 255 at most")
    return Rules(
        anchors=lambda data, offsets: suffix_anchors(data, offsets, width, leading),
        payload=lambda data, offsets: suffix_payload(data, offsets, width),
        settle=lambda t: settle_suffixes(t, width, leading),
        buckets=sampled_splitters,
        later_only=True,
        hot=hot,
    )


def remove_later_copies(documents: DataFrame, width: int = WIDTH, leading: int = LEADING, hot: int = HOT) -> DataFrame:
    """doc_id, kept (binary), n_bytes, n_removed, n_spans, kept_sha256."""
    path = new_path(documents)
    spans = marked_intervals(documents, path, suffix_rules(width, leading, hot))

    @tidy
    def cut(batches):
        for batch in batches:
            data, off = utf8(batch.column("text"))
            lists, later = batch.column("spans"), batch.column("later").to_numpy(zero_copy_only=False)
            bounds = np.asarray(lists.offsets)
            flat = lists.flatten()
            begin, end = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)
            base = bounds[0]
            out = []
            for k in range(batch.num_rows):
                b = data[off[k] : off[k + 1]]
                n, gone, runs = len(b), 0, 0
                if later[k] and n >= width:
                    b, gone, runs = b[:0], n, 1
                elif bounds[k + 1] > bounds[k]:
                    mask = union_mask(n, (begin[bounds[k] - base : bounds[k + 1] - base], end[bounds[k] - base : bounds[k + 1] - base]))
                    gone, runs = int(mask.sum()), int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
                    b = b[~mask]
                kept = b.tobytes()
                out.append((kept, n, gone, runs, hashlib.sha256(kept).hexdigest()))
            kept, n, gone, runs, sha = zip(*out, strict=True) if out else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = with_spans(documents, spans, path)
    rows = rows.withColumn("later", (F.col("copies") > 1) & ~F.col("is_first"))
    return rows.select("doc_id", "text", "spans", "later").mapInArrow(cut, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
