"""Anchors and settlement of the two substring operators without Spark: structured texts, weak names."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from loomline.llm import substring_dedup, suffix_dedup
from loomline.llm.repeats import union_mask
from loomline.llm.textarrays import utf8

from . import brute, cases
from .test_encoding import doubling


def marked(rules, texts):
    """text -> the places that settled windows cover, all rows in one table of whole groups."""
    texts = list(dict.fromkeys(texts))
    data, off = utf8(pa.array(texts, pa.string()))
    doc, first, number, name = rules.anchors(data, off)
    raw, at = rules.payload(data, off)(doc, first, number)
    parts = [bytes(raw[i:j]) for i, j in zip(at, at[1:], strict=False)]
    nodes = [hashlib.md5(t.encode()).digest() for t in texts]
    table = pa.table({
        "name": pa.array(name.view(np.int64)), "block": pa.array(np.zeros(len(doc), np.int32)), "blocks": pa.array(np.ones(len(doc), np.int32)), "doc_id": pa.array(doc), "node": pa.array([nodes[d] for d in doc], pa.binary()),
        "first": pa.array(first.astype(np.int32)), "n": pa.array(number.astype(np.int32)), "windows": pa.array(parts, pa.binary()),
    })
    if not table.num_rows:
        return {t: [] for t in texts}
    order = np.random.default_rng(1).permutation(table.num_rows)  # rows come in any order
    spans = {n: [] for n in nodes}
    for batch in rules.settle(table.take(pa.array(order))):
        for n, a, b in zip(batch.column("node").to_pylist(), batch.column("start").to_pylist(), batch.column("stop").to_pylist(), strict=True):
            spans[n].append((a, b))
    return {t: spans[n] for t, n in zip(texts, nodes, strict=True)}


def words_left(texts, rules):
    out = []
    for d, (t, spans) in enumerate(marked(rules, texts).items()):
        w = t.encode().split()
        gone = union_mask(len(w), tuple(np.array(x, np.int64) for x in zip(*spans, strict=True))) if spans else np.zeros(len(w), bool)
        out.append((d, len(w), int(gone.sum()), brute.sha(b" ".join(x for x, m in zip(w, gone, strict=True) if not m))))
    return out


def bytes_left(texts, rules):
    out = []
    for d, (t, spans) in enumerate(marked(rules, texts).items()):
        b = np.frombuffer(t.encode(), np.uint8)
        gone = union_mask(len(b), tuple(np.array(x, np.int64) for x in zip(*spans, strict=True))) if spans else np.zeros(len(b), bool)
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((d, len(b), int(gone.sum()), runs, brute.sha(b[~gone].tobytes())))
    return out


def structured():
    one, other = doubling(11)
    spaced = [" ".join(x) for x in doubling(10, "x", "y")]
    long = doubling(10, "p", "q")
    return [one, other, *spaced, *(" ".join([w] * 3 + ["end"] * 50) for w in long), "ab" * 300, "a" * 500, "z " * 200]


def mixed(seed):
    rng = random.Random(seed)
    passages = [cases.prose(rng, rng.randrange(30, 90)) for _ in range(6)]
    return [" ".join(rng.choice([cases.prose(rng, rng.randrange(1, 40)), rng.choice(passages), "x " * rng.randrange(60)]) for _ in range(rng.randrange(1, 7))) for _ in range(25)]


TEXTS = [structured(), mixed(1), mixed(2), ["", " ", "é" * 80 + "字" * 40, "b"], []]


@pytest.mark.parametrize("weak", [False, True])
@pytest.mark.parametrize("texts", TEXTS)
def test_words(texts, weak, monkeypatch):
    if weak:  # names of three bits: whatever shares one must still be told apart
        strong = substring_dedup.mix
        monkeypatch.setattr(substring_dedup, "mix", lambda x: strong(x) & np.uint64(7 << 61))
    texts = list(dict.fromkeys(texts))
    assert words_left(texts, substring_dedup.word_rules()) == brute.substring_dedup(list(enumerate(texts)))


@pytest.mark.parametrize("weak", [False, True])
@pytest.mark.parametrize("texts", TEXTS)
def test_bytes(texts, weak, monkeypatch):
    if weak:
        strong = suffix_dedup.gram_hashes
        monkeypatch.setattr(suffix_dedup, "gram_hashes", lambda data, width: strong(data, width) & np.uint64(7 << 61))
    texts = list(dict.fromkeys(texts))
    assert bytes_left(texts, suffix_dedup.suffix_rules()) == brute.suffix_dedup(list(enumerate(texts)))


def test_segments_do_not_matter(monkeypatch):
    texts = list(dict.fromkeys(mixed(3)))
    want = bytes_left(texts, suffix_dedup.suffix_rules())
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 64)
    assert bytes_left(texts, suffix_dedup.suffix_rules()) == want == brute.suffix_dedup(list(enumerate(texts)))


def test_multikey_sort():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 300):
        rows = rng.integers(97, 99, (n, 24)).astype(np.uint8)
        rows[: n // 2, 8:16] = 97
        order, shared = suffix_dedup.multikey_sort(rows.view(">u8").astype(np.uint64))
        ranked = [rows[i].tobytes() for i in order]
        assert ranked == sorted(r.tobytes() for r in rows)
        for i in range(1, n):
            same = next((k for k in range(24) if ranked[i][k] != ranked[i - 1][k]), 24)
            assert shared[i] == same


def test_splitters_are_in_order_of_leading_bytes(spark):
    rng = np.random.default_rng(5)
    data, off = utf8(pa.array([" ".join(f"w{x}" for x in rng.integers(0, 3000, 20000))]))
    _, _, _, name = suffix_dedup.suffix_anchors(data, off)
    names = spark.createDataFrame([(int(x), 1, 1) for x in np.unique(name).view(np.int64)], "name long, k long, blocks int")
    import loomline.llm.repeats as repeats

    before, repeats.BUCKET_ROWS = repeats.BUCKET_ROWS, 200
    try:
        bucket, n = suffix_dedup.sampled_splitters(names)
    finally:
        repeats.BUCKET_ROWS = before
    name = np.sort(name)
    got = bucket(name, np.zeros(len(name), np.int32), np.ones(len(name), np.int32))
    assert n > 5 and (np.diff(got) >= 0).all() and 0 <= got.min() and got.max() < n
    assert np.bincount(got).max() < 4 * len(name) / n


def test_a_driver_can_plan_the_buckets_of_any_input(spark):
    from loomline.llm import repeats

    rows = lambda k: spark.createDataFrame([(1, k), (2, k)], "name long, k long")
    assert repeats.number_of_buckets(rows(0)) == 1
    assert repeats.number_of_buckets(rows(10**6)) == 20
    assert repeats.number_of_buckets(rows(10**14)) == 100_000
