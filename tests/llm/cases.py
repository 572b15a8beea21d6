"""Awkward rows that every operator must take: nulls, empties, ties, repeats, long texts, other columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, name string, kept boolean, h long"
PAGES = "page_id long, url string, html string, sha string, n long"


def prose(rng, n, words=None):
    words = words or "the of and to in that is for it with stone river light tall green walking quiet morning paper house under letter winter early road".split()
    return " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))


def documents():
    rng = random.Random(5)
    base = [prose(rng, n) for n in (0, 1, 3, 5, 34, 35, 36, 80, 120, 200, 400)]
    shared = prose(rng, 60)
    texts = [*base, None, "", " \n\t", "é" * 150 + " 字 " * 60, "x " * 90, "ab" * 120, base[9], base[9], base[9].replace(" ", "\n", 3)]
    for k in range(12):  # near copies, and passages that several texts share
        w = base[10].split()
        w[k * 7] = f"changed{k}"
        texts += [" ".join(w), prose(rng, 40) + " " + shared + " " + prose(rng, 30)]
    texts.append(" ".join(base[10].split() * 30))  # a long one
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, None), (None, base[8]), (7, base[7]), (7, base[7]), (7, base[6]), (3, shared)]
    return [(d, t, "en", "s", len(t or ""), "n", None, None, 1) for d, t in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(5)
