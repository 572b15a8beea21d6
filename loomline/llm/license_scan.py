"""License scans (operator 8): MinHash bands over overlapping windows, then exact containment.

Tokens are runs of ASCII letters and digits (case folded) and bytes beyond ASCII; a template is the
set S of its five-token shingles, of which it has W places.  A match is a stretch of the text: it opens
at a shingle of S, ``CONTAINMENT`` of S or more stand in the next W / ``CONTAINMENT`` places (an edited
copy may be longer), and it ends with the last of these places that brings one for the first time.
Matches of a template are found from left to right and share no shingle, so copies that stand side by
side are matches of their own, and scattered pieces of a template are none.

Windows of two kinds retrieve templates:

* long templates (24 shingles or more): windows of 16 shingles, every 8.  All windows of a template,
  at every place, are in the index under 16 bands of 2 MinHash values.  A copy of 24 shingles holds
  a whole window of the text whatever its place, which equals a window of the index: it is found
  with certainty; a window of Jaccard similarity 0.5 with probability 0.99.
* short templates: windows of one shingle, at every place.  All bands of a one-element set agree or
  none does, so the band is the shingle.

Each window found asks for its surroundings, one match length to both sides; surroundings of one
template that overlap are searched together, exactly as defined.  Texts are scanned whole, in one narrow
map.  Templates are a parameter that travels with the task; more than ``TEMPLATE_TOKENS`` tokens of them
are scanned for in several passes.

Defined results: a null or empty text matches nothing; templates of fewer than five tokens are one
shingle of all their tokens, which only a text of just these tokens has; templates without tokens
match nothing; rows that repeat a doc_id are scanned each on its own; extra columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import only
from .textarrays import doc_chunks, mix, prefix_sums, ranges, runs, span_hash, utf8, word_hashes

SHINGLE = 5
CONTAINMENT = 0.8
WIDE, STRIDE, LONG = 16, 8, 24
BANDS, ROWS = 16, 2
TEMPLATE_TOKENS = 1_000_000

# Fixed texts: public notices of common licenses
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)

_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_A = mix(np.arange(501, 501 + BANDS * ROWS, dtype=np.uint64)) | np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray):
    """Token spans, offsets of documents among tokens, shingle hashes, offsets among shingles.

    A document of one to four tokens has one shingle, all its tokens.
    """
    start, stop, at = runs(_TOKEN[data], offsets)
    hashed = word_hashes(_FOLD[data], start, stop)
    sums = prefix_sums(hashed)
    n = np.diff(at)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    first = ranges(at[:-1], count)
    last = np.minimum(first + SHINGLE, np.repeat(at[1:], count))
    return start, stop, at, span_hash(sums, first, last), np.append(0, np.cumsum(count))


def block_minima(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """MinHash values of blocks of ``STRIDE`` shingles, and the offsets of documents among blocks."""
    blocks = -(-np.diff(at) // STRIDE)
    begin = np.repeat(at[:-1], blocks) + STRIDE * (np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    out = np.empty((len(begin), len(_A)), np.uint32)
    for k in range(len(_A) if len(begin) else 0):
        out[:, k] = np.minimum.reduceat(h * _A[k], begin) >> np.uint64(32)
    return out, np.append(0, np.cumsum(blocks))


def band_keys(sig: np.ndarray) -> np.ndarray:
    wide = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    acc = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), wide.shape[:2]).copy()
    for r in range(ROWS):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + wide[:, :, r])
    return acc


class Index:
    """Templates by shingle and by band."""

    def __init__(self, templates=TEMPLATES, containment: float = CONTAINMENT):
        self.names = [t[0] for t in templates]
        data, off = utf8(pa.array([t[1] for t in templates], pa.string()))
        _, _, _, h, sat = shingles(data, off)
        self.sets = [np.unique(h[a:b]) for a, b in zip(sat, sat[1:], strict=False)]
        #: the places that a match may take
        self.reach = np.ceil(np.diff(sat) / containment - 1e-9).astype(np.int64)
        short = [(x, k) for k, s in enumerate(self.sets) if len(s) < LONG for x in s]
        long = []
        for k, (a, b) in enumerate(zip(sat, sat[1:], strict=False)):
            if len(self.sets[k]) >= LONG:
                sig = np.array([[int((h[i : i + WIDE] * c).min() >> np.uint64(32)) for c in _A] for i in range(a, b - WIDE + 1)], np.uint32)
                long += [(x, k) for x in np.unique(band_keys(sig))]
        self.short, self.long = self._table(short), self._table(long)

    @staticmethod
    def _table(pairs: list) -> tuple[np.ndarray, np.ndarray]:
        keys = np.array([p[0] for p in pairs], np.uint64)
        order = np.argsort(keys, kind="stable")
        return keys[order], np.array([p[1] for p in pairs], np.int64)[order]

    @staticmethod
    def look_up(table, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the key, template) for all entries of all keys."""
        if not len(table[0]):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lo = np.searchsorted(table[0], keys)
        hit = np.flatnonzero(table[0][np.minimum(lo, len(table[0]) - 1)] == keys)
        n = np.searchsorted(table[0], keys[hit], "right") - lo[hit]
        return np.repeat(hit, n), table[1][ranges(lo[hit], n)]

    def regions(self, h: np.ndarray, at: np.ndarray):
        """(doc, template, first shingle, last shingle) of merged surroundings of retrieved windows."""
        where, template = self.look_up(self.short, h)
        width = np.ones(len(where), np.int64)
        if len(self.long[0]) and len(h):
            minima, bat = block_minima(h, at)
            blocks = np.diff(bat)
            b = ranges(bat[:-1], np.maximum(blocks - 1, 0))
            keys = band_keys(np.minimum(minima[b], minima[b + 1]))
            w, t = self.look_up(self.long, keys.reshape(-1))
            owner = np.repeat(np.arange(len(blocks)), np.maximum(blocks - 1, 0))
            begin = at[owner] + STRIDE * (b - bat[owner])
            where = np.append(where, begin[w // BANDS])
            template = np.append(template, t)
            width = np.append(width, np.full(len(w), WIDE))
        doc = np.searchsorted(at, where, "right") - 1
        lo = np.maximum(where - self.reach[template], at[doc])
        hi = np.minimum(where + width + self.reach[template], at[doc + 1])
        order = np.lexsort((lo, template, doc))
        doc, template, lo, hi = doc[order], template[order], lo[order], hi[order]
        out: list[list[int]] = []
        for d, t, a, b in zip(doc.tolist(), template.tolist(), lo.tolist(), hi.tolist(), strict=True):
            if out and out[-1][0] == d and out[-1][1] == t and a <= out[-1][3]:
                out[-1][3] = max(out[-1][3], b)
            else:
                out.append([d, t, a, b])
        return out


def template_groups(templates) -> list[list[tuple[int, str, str]]]:
    """Numbered templates in groups of about ``TEMPLATE_TOKENS`` tokens (characters bound them)."""
    groups, size = [[]], 0
    for k, (name, text) in enumerate(templates):
        if groups[-1] and size + len(text) > TEMPLATE_TOKENS:
            groups.append([])
            size = 0
        groups[-1].append((k, name, text))
        size += len(text)
    return groups


def scan(documents: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, license, template (its number), start, stop (code points), containment: one row for
    each stretch of a text that holds a template."""
    rows = only(documents, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))

    def finder(group):
        def find(batches):
            index = Index([t[1:] for t in group], containment)
            for batch in batches:
                data, off = utf8(batch.column("text"))
                out = []
                for i, j in doc_chunks(off):
                    out += matches(index, data[off[i] : off[j]], off[i : j + 1] - off[i], containment, i)
                if out:
                    doc, name, template, *rest = zip(*out, strict=True)
                    columns = [pa.array(name, pa.string()), pa.array([group[t][0] for t in template], pa.int32()), *(pa.array(c, t) for c, t in zip(rest, (pa.int64(), pa.int64(), pa.float64()), strict=True))]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), *columns], names=["doc_id", "license", "template", "start", "stop", "containment"])

        return find

    found = [rows.mapInArrow(finder(g), "doc_id long, license string, template int, start long, stop long, containment double") for g in template_groups(templates)]
    return functools.reduce(DataFrame.unionByName, found)


def stretches(places: list[int], shingle: list[int], size: int, reach: int, containment: float):
    """(first place, last place, share) of the matches among the places that hold a template's shingles."""
    held: dict[int, int] = {}
    i = j = 0
    while i < len(places):
        while j < len(places) and places[j] < places[i] + reach:
            held[shingle[j]] = held.get(shingle[j], 0) + 1
            j += 1
        if len(held) >= containment * size - 1e-9:
            new: dict[int, int] = {}
            for k in range(i, j):
                new.setdefault(shingle[k], k)
            last = max(new.values())
            yield places[i], places[last], len(held) / size
            i, j = last + 1, last + 1
            held = {}
            continue
        held[shingle[i]] -= 1
        if not held[shingle[i]]:
            del held[shingle[i]]
        i += 1


def matches(index: Index, data: np.ndarray, off: np.ndarray, containment: float, base: int = 0) -> list[tuple]:
    start, stop, at, h, sat = shingles(data, off)
    out = []
    for d, t, a, b in index.regions(h, sat):
        own = index.sets[t]
        where = np.minimum(np.searchsorted(own, h[a:b]), len(own) - 1)
        hits = np.flatnonzero(own[where] == h[a:b])
        for i, j, share in stretches((hits + a).tolist(), where[hits].tolist(), len(own), int(index.reach[t]), containment):
            first, last = at[d] + i - sat[d], min(at[d] + j - sat[d] + SHINGLE, at[d + 1]) - 1
            chars = [int((data[off[d] : x] & 0xC0 != 0x80).sum()) for x in (start[first], stop[last])]
            out.append((base + d, index.names[t], t, *chars, share))
    return out
