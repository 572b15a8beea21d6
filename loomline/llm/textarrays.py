"""Vectorised views of Arrow text columns: bytes, words, hashes, windows.

All functions work on a whole batch as one byte array plus document offsets, so the cost per
document is a few array elements and not a Python loop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: bytes of text that one numpy step holds; temporaries are some tens of bytes for each
CHUNK_BYTES = 1 << 20
#: bytes beyond which a word is no word
LONG_WORD = 256

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    n = len(column)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def doc_chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``most`` bytes together; a longer document stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: the field of the sequence hashes: residues modulo a Mersenne prime, two lanes of them
_PRIME = (1 << 31) - 1
_M, _31 = U64(_PRIME), U64(31)
_BASES = (0x2545F491, 0x5851F42D)
_powers: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}


def _fold(x: np.ndarray) -> np.ndarray:
    """A smaller number with the same residue; 64 bits become 34, twice 32."""
    high = x >> _31
    x &= _M
    x += high
    return x


def _residue(x: np.ndarray) -> np.ndarray:
    x = _fold(_fold(x))
    x[x >= _M] -= _M
    return x


def powers(n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """P**i and P**-i in the field for i < n, for each lane."""
    have = _powers.get(0)
    if have is None or len(have[0][0]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        have = ([], [])
        for base in _BASES:
            for to, p in zip(have, (base, pow(base, -1, _PRIME)), strict=True):
                x = np.empty(size, U64)
                x[0], done = 1, 1
                while done < size:  # doubling
                    k = min(done, size - done)
                    x[done : done + k] = _residue(x[:k] * U64(pow(p, done, _PRIME)))
                    done += k
                to.append(x.astype(np.uint32))
        if size == CHUNK_BYTES + 4096:  # those of a very long document are not kept
            _powers[0] = have
    return have


Sums = list[np.ndarray]
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
_BYTE_LANES = [_BYTE & _M, (_BYTE >> _31) & _M]


def _sums(lanes) -> Sums:
    out = []
    for k, x in enumerate(lanes):
        x *= powers(len(x) + 1)[0][k][: len(x)]
        s = np.zeros(len(x) + 1, U64)
        np.cumsum(_fold(x), out=s[1:])
        out.append(s)
    return out


def prefix_sums(values: np.ndarray) -> Sums:
    """Sums whose differences give, in each lane, values[k] * P**k over any span: a polynomial over a
    field, so that no structure of a text (as of one that doubles itself) makes two texts meet; the
    chance that two spans of n values meet is (n / 2**31)**2 at most for a random base, and 2**-62 for
    values that don't depend on it.
    """
    return _sums([values & _M, (values >> _31) & _M])


def byte_sums(data: np.ndarray) -> Sums:
    return _sums([lane[data] for lane in _BYTE_LANES])


def _joined(lanes, size) -> np.ndarray:
    low, high = lanes
    return mix((low | high << _31) + size * U64(0x9E3779B97F4A7C15))


def span_hash(sums: Sums, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A hash of values[start:stop] that does not depend on where they stand."""
    down = powers(len(sums[0]))[1]
    lanes = [_residue(_fold(_fold(s[stop] - s[start])) * d[start]) for s, d in zip(sums, down, strict=True)]
    return _joined(lanes, (stop - start).astype(U64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and stop of each run of non-space bytes, and the offsets of documents among them."""
    return runs(~_SPACE[data], offsets)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``words``, for runs of true elements."""
    n = len(inside)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, stop, np.searchsorted(start, offsets)


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """At each place the next eight bytes as a number; zeros follow the last byte."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def equal_spans(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ``size`` elements from two places are the same; ``a`` and ``b`` are from ``eight_bytes``."""
    out = np.ones(len(size), bool)
    rows, done = np.flatnonzero(size), 0
    while len(rows):
        left = size[rows] - done
        differ = a[a_start[rows] + done] ^ b[b_start[rows] + done]
        short = left < 8
        differ[short] &= (U64(1) << (U64(8) * left[short].astype(U64))) - U64(1)
        out[rows[differ != 0]] = False
        rows, done = rows[(left > 8) & (differ == 0)], done + 8
    return out


_K = U64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of the next ``width`` bytes, eight or more, of each place that has so many."""
    at = eight_bytes(data)
    n = max(len(data) - width + 1, 0)
    out = np.full(n, width, U64)
    for k in [*range(0, width - 8, 8), width - 8]:
        out ^= out >> U64(32)
        out += at[k : k + n]
        out *= _K
    return mix(out)


def word_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of words, eight bytes at a time; of those beyond ``LONG_WORD`` as of sequences."""
    size = stop - start
    out = mix(size.astype(U64) * _K)
    at, rows, done = eight_bytes(data), np.flatnonzero(size <= LONG_WORD), 0
    while len(rows):
        left = size[rows] - done
        w = at[start[rows] + done]
        short = left < 8
        w[short] &= (U64(1) << (U64(8) * left[short].astype(U64))) - U64(1)
        out[rows] = mix(out[rows] * _K + w)
        rows, done = rows[left > 8], done + 8
    for i in np.flatnonzero(size > LONG_WORD):
        sums = byte_sums(data[start[i] : stop[i]])
        out[i] = span_hash(sums, np.zeros(1, np.int64), size[i : i + 1])[0]
    return out


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... for length[0] elements, then the next, as one array."""
    length = np.asarray(length, np.int64)
    total = int(length.sum())
    before = np.cumsum(length) - length
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(start, np.int64) - before, length)


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of keys[i:i+width] for each i with a whole window."""
    m, have = keys, 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < width:
        m = np.minimum(m[: len(m) - (width - have)], m[width - have :])
    return m


def binary_array(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An Arrow binary column over one buffer; offsets are in bytes."""
    if offsets[-1] > (1 << 31) - 1:
        return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(values)])
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values)])


def whole_groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Regroups sorted batches so that each yielded table holds only whole groups of ``keys``.

    The open group of the last rows waits for the next batch; memory is one batch and one group.
    """
    waiting: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        same = np.ones(t.num_rows, bool)
        for k in keys:
            col = t.column(k)
            same &= pc.equal(col, col[-1]).to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut == 0:
            if waiting and all(waiting[-1].column(k)[-1] == t.column(k)[0] for k in keys):
                waiting.append(t)
                continue
            if waiting:
                yield pa.concat_tables(waiting).combine_chunks()
            waiting = [t]
            continue
        yield pa.concat_tables([*waiting, t.slice(0, cut)]).combine_chunks()
        waiting = [t.slice(cut)]
    if waiting:
        yield pa.concat_tables(waiting).combine_chunks()
