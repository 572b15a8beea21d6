"""Operators 12 and 13 against plain versions, on awkward rows and with every bound made small."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from loomline.llm import collocations, lexical_search

from . import cases

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def search(documents, items, k=20):
    counts = [(d, Counter(TERM.findall((t or "").translate(UPPER)))) for d, t in documents]
    counts = [(d, c) for d, c in counts if c]
    n, length, df = len(counts), sum(sum(c.values()) for _, c in counts), Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        asked, scored = Counter(TERM.findall((text or "").translate(UPPER))), []
        for d, c in counts:
            m = 75 + 25 * sum(c.values()) * n // length
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, q in asked.items() if t in c)
            if s > 0:
                scored.append((-s, d is None, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def test_search(spark, monkeypatch):
    rng = random.Random(2)
    words = "Stone river LIGHT tall-green été 字字 x1 the of to".split()
    documents = [(r[0], r[1]) for r in cases.documents()] + [(100 + k, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for k in range(300)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(9)))) for k in range(25)] + [(None, "stone"), (3, "River of light"), (4, None), (5, "")]
    d = spark.createDataFrame([(*r, 1) for r in documents], "doc_id long, text string, rank int").repartition(5)
    q = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, score int")
    want = search(documents, items)
    got = lambda **o: sorted((tuple(r) for r in lexical_search.rank(d, q, **o).collect()), key=str)
    assert got() == want
    assert got(item_bytes=300) == want  # many blocks of items
    assert got(k=3) == search(documents, items, 3)
    assert lexical_search.rank(d.limit(0), q).count() == 0 and lexical_search.rank(d, q.limit(0)).count() == 0


def test_pieces_of_a_text_end_between_terms():
    rng = np.random.default_rng(4)
    inside = np.zeros(256, bool)
    inside[97:123] = True
    for _ in range(300):
        data = rng.choice(np.frombuffer(b"aaaaaab  ", np.uint8), rng.integers(0, 60))
        offsets = np.sort(np.append(rng.integers(0, len(data) + 1, 4), [0, len(data)]))
        edges = list(lexical_search.byte_pieces(data, offsets, inside, 7))
        assert [a for a, _ in edges[1:]] == [b for _, b in edges[:-1]]
        assert sum(b - a for a, b in edges) == len(data) and all(a < b for a, b in edges)
        for _, b in edges[:-1]:
            assert b in offsets or not (inside[data[b - 1]] and inside[data[b]])


def test_impacts_and_weights_beyond_64_bits():
    tf, n = np.array([3, 1], np.int64), np.array([10**9, 7], np.int64)
    docs, length = 10**12, 10**15
    want = [10**9 * a // (1000 * a + 12 * (75 + 25 * b * docs // length)) for a, b in zip(tf.tolist(), n.tolist())]
    assert lexical_search.impacts(tf, n, docs, length).tolist() == want


def test_terms_that_share_a_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(lexical_search, "word_hashes", lambda data, start, stop: np.full(len(start), 5, np.uint64))
    known = lexical_search.Vocabulary([b"ab", b"abc", b"zz"])
    data = np.frombuffer(b"abc zz ab x", np.uint8)
    assert known.find(data, np.array([0, 4, 7, 10]), np.array([3, 6, 9, 11])).tolist() == [1, 2, 0, -1]


def mined(documents, least, best=2000):
    count, total = Counter(), Counter()
    for lang, text in documents:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, 5):
                count.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    good = {g: a for g, a in count.items() if len(g) > 2 and a >= least}
    longer = Counter()
    for g, a in good.items():
        for k in range(2, len(g) - 1):
            for i in range(1, len(g) - k + 1):
                inner = (g[0], *g[i : i + k])
                longer[inner] = max(longer[inner], a)
    rows = {}
    for g, a in good.items():
        if 100 * longer[g] >= 80 * a:
            continue
        score, _, left, right = min((2_000_000 * a // (count[g[: 1 + k]] + count[(g[0], *g[1 + k :])]), k, count[g[: 1 + k]], count[(g[0], *g[1 + k :])]) for k in range(1, len(g) - 1))
        rows.setdefault(g[0], []).append((-score, -a, " ".join(g[1:]).encode(), left, right))
    return sorted((lang, r, p.decode(), -a, left, right, total[lang], -s) for lang, x in rows.items() for r, (s, a, p, left, right) in enumerate(sorted(x)[:best], 1))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(25)] + ["É", "字", "New", "york"]
    texts = [(rng.choice(["en", "fr", None, "und"]), "".join(rng.choice(words[: rng.choice([4, 29])]) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", "! "]) for _ in range(rng.randrange(80)))) for _ in range(250)]
    return texts + [(r[2], r[1]) for r in cases.documents()] + [("en", "a a a a a a a"), ("en", "a b a b a b"), ("en", None)]


@pytest.mark.parametrize("options", [{}, {"head": 0}, {"head": 9, "hot": 20}, {"hot": 5, "bucket": 50}, {"best": 3}])
def test_phrases(spark, corpus, options):
    df = spark.createDataFrame([(*r, "x", 2) for r in corpus], "lang string, text string, word string, n int").repartition(6)
    got = sorted(tuple(r) for r in collocations.phrases(df, least=5, **options).collect())
    assert got == mined(corpus, 5, options.get("best", 2000))
    assert len({r[0] for r in got}) == 3


def test_phrases_of_nothing(spark):
    df = spark.createDataFrame([("en", None), ("en", " .. ")], "lang string, text string")
    assert collocations.phrases(df).count() == 0 and collocations.phrases(df.limit(0)).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    a, b = 9 * 10**18, 9 * 10**18 + 7
    df = spark.createDataFrame([(a, b)], "a long, b long")
    from pyspark.sql import functions as F

    wide = F.col("b").cast("decimal(20,0)") + F.col("b").cast("decimal(20,0)")
    assert df.select(collocations._ratio(F.col("a"), wide, 2_000_000).alias("s")).first().s == 2_000_000 * a // (2 * b)
