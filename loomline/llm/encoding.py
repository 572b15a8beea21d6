"""Token ids of whole texts by the ``tokenizers`` library, each distinct piece encoded once.

A byte-level BPE whose pre-tokenizer is the usual pattern never joins what lies on the two sides
of a single blank between two other characters: the blank opens the token after it.  A single line
feed between two such characters is a token of its own.  Texts are cut there, and only there; the
distinct pieces of a batch go to the library, whose answers are kept for later batches.  The ids
equal those of ``encode(text, add_special_tokens=False)`` on the whole text.
"""

from __future__ import annotations

import os

import numpy as np

from .textarrays import CHUNK_BYTES, eight_bytes, equal_spans, ranges, word_hashes

#: pieces kept for each worker; beyond that the memory starts anew
CACHE_PIECES = 1_000_000
CACHE_BYTES = 64 << 20
#: pieces that go to the library as one text
TOGETHER = 50

_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: first bytes of white space beyond ASCII, and the bytes that end it with those before them
_WS_LEAD = np.zeros(256, bool)
_WS_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_WS_BEFORE_LAST = np.zeros(256, bool)
_WS_BEFORE_LAST[[0xC2, 0x80, 0x81, 0x9A]] = True


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts may be cut without a change to any token; each document's start is a cut."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n > 2:
        ws = _WS[data]
        high = data >= 0x80
        # position i (1 <= i < n-1) holds a blank or line feed between two non-space characters
        left_bad = ws[:-2].copy()
        left_bad[1:] |= high[1:-2] & _WS_BEFORE_LAST[data[:-3]]
        right_bad = ws[2:] | _WS_LEAD[data[2:]]
        fine = ~(left_bad | right_bad)
        mid = data[1:-1]
        blank = np.flatnonzero(fine & (mid == 32)) + 1
        feed = np.flatnonzero(fine & (mid == 10)) + 1
        cut[blank] = True
        cut[feed] = True
        cut[feed + 1] = True
        # neighbours must be of the same document
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < n)]
        for e in (edge - 1, edge):  # a blank at a text's end or start is no place to cut
            lone = e[(data[e] == 32) | (data[e] == 10)]
            cut[lone] = False
            cut[lone[data[lone] == 10] + 1] = False
    cut[offsets[:-1]] = True
    cut[n] = False
    return np.flatnonzero(cut)


class Encoder:
    """Encodes Arrow batches; one for each worker process and vocabulary file.

    Pieces are looked up by a hash and taken only if all their bytes equal those that are kept;
    others are encoded on their own.  At most ``CACHE_PIECES`` are kept, in flat arrays.
    """

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        names = self.library.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(names.values()) + 1, np.int64)
        for name, i in names.items():  # one character of a byte-level name stands for one byte
            self.bytes_of[i] = len(name)
        self._forget()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _forget(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0
        self.text, self.text_used = np.zeros(1 << 16, np.uint8), 0
        # by slot: where a piece's ids and bytes begin, and how many there are
        self.start, self.count, self.text_start, self.size = (np.zeros(1 << 12, np.int32) for _ in range(4))

    def _library_ids(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces data[start:start+size], and how many each has."""
        last, second = data[start + size - 1], data[start + np.minimum(1, size - 1)]
        joins = (data[start] == 32) & (size > 1) & ~_WS[second] & ~_WS_LEAD[second] & ~_WS[last] & (last < 0x80)
        order = np.concatenate([np.flatnonzero(joins), np.flatnonzero(~joins)])
        n_join = int(joins.sum())
        # pieces that open with a blank are encoded some at a time; their bytes tell them apart again
        firsts = np.concatenate([np.arange(0, n_join, TOGETHER), np.arange(n_join, len(order))]).astype(np.int64)
        raw = data[ranges(start[order], size[order])].tobytes()
        ends = np.cumsum(size[order])
        at = np.append(ends[firsts] - size[order][firsts], len(raw)).tolist()
        got = self.library.encode_batch_fast([raw[i:j].decode("utf-8") for i, j in zip(at, at[1:], strict=False)], add_special_tokens=False)
        flat = np.concatenate([np.asarray(e.ids, np.int32) for e in got]) if got else np.zeros(0, np.int32)
        stop = np.cumsum(self.bytes_of[flat])
        upto = np.searchsorted(stop, ends, "left") + 1
        if len(flat) and not np.array_equal(stop[upto - 1], ends):
            raise RuntimeError("a token spans two pieces: this vocabulary's pre-tokenizer is not the byte-level one")
        counts = np.diff(upto, prepend=0)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        begin = upto - counts
        return flat[ranges(begin[back], counts[back])], counts[back].astype(np.int32)

    def _learn(self, keys: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        flat, counts = self._library_ids(data, start, size)
        begin, self.ids, self.used = _append(self.ids, self.used, flat, counts)
        text, self.text, self.text_used = _append(self.text, self.text_used, data[ranges(start, size)], size)
        n, more = len(self.keys), len(keys)
        if n + more > len(self.start):
            self.start, self.count, self.text_start, self.size = (np.resize(x, 2 * (n + more)) for x in (self.start, self.count, self.text_start, self.size))
        for to, x in ((self.start, begin), (self.count, counts), (self.text_start, text), (self.size, size)):
            to[n : n + more] = x
        where = np.searchsorted(self.keys, keys)
        self.keys, self.slot = np.insert(self.keys, where, keys), np.insert(self.slot, where, np.arange(n, n + more, dtype=np.int32))

    def _others(self, slots: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Pieces whose bytes are not those kept under their hash."""
        kept = np.ndarray((len(self.text) - 7,), "<u8", self.text, strides=(1,))
        same = self.size[slots] == size
        rows = np.flatnonzero(same)
        same[rows] = equal_spans(eight_bytes(data), begin[rows], kept, self.text_start[slots[rows]], size[rows])
        return np.flatnonzero(~same)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents one after another (int32) and where each document's ids begin."""
        if len(data) == 0:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        begin = piece_starts(data, offsets)
        size = np.diff(np.append(begin, len(data)))
        ids, counts = [], []
        i = 0
        while i < len(begin):  # some pieces of a long text at a time
            j = max(i + 1, int(np.searchsorted(begin, begin[i] + CHUNK_BYTES, "right")) - 1) if begin[-1] - begin[i] > CHUNK_BYTES else len(begin)
            stop = begin[j - 1] + size[j - 1]
            for to, x in zip((ids, counts), self._encode_pieces(data[begin[i] : stop], begin[i:j] - begin[i], size[i:j]), strict=True):
                to.append(x)
            i = j
        ends = np.append(0, np.cumsum(np.concatenate(counts)))
        return np.concatenate(ids), ends[np.searchsorted(begin, offsets)]

    def _encode_pieces(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and how many each has."""
        keys, first, which = np.unique(word_hashes(data, begin, begin + size), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > CACHE_PIECES or self.text_used > CACHE_BYTES:
            self._forget()
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != keys[inside]
        if new.any():
            self._learn(keys[new], data, begin[first[new]], size[first[new]])
            at = np.searchsorted(self.keys, keys)
        slots = self.slot[at][which]
        source, start, count = self.ids, self.start[slots].astype(np.int64), self.count[slots].astype(np.int64)
        others = self._others(slots, data, begin, size)
        if len(others):
            flat, counts = self._library_ids(data, begin[others], size[others])
            source = np.concatenate([self.ids[: self.used], flat])
            start[others], count[others] = self.used + np.cumsum(counts) - counts, counts
        return source[ranges(start, count)], count


def _append(held: np.ndarray, used: int, more: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Where each part of ``more`` begins in the grown array, that array, and how much of it is used;
    eight elements or more beyond are its own."""
    if used + len(more) + 8 > len(held):
        held = np.resize(held, max(2 * len(held), used + len(more) + 8))
    held[used : used + len(more)] = more
    return used + np.cumsum(counts) - counts, held, used + len(more)
