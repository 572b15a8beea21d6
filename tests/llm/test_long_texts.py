"""Texts beyond one chunk and texts that double themselves, through Spark, against plain versions."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomline.llm import decontaminate, license_scan, ngram_join, packing, quality, secret_scan, substring_dedup, suffix_dedup, token_files, warc
from loomline.llm.shared import shared_dir
from loomline.llm.textarrays import CHUNK_BYTES

from . import brute, cases
from .test_encoding import doubling

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(31)
    passage = cases.prose(rng, 80)
    notice = max((t for _, t in license_scan.TEMPLATES), key=len)
    long = f"{cases.prose(rng, 60_000)} {passage} {notice} key aZ3kQ9xW7vB2nM5pL8sD4fG6hJ1tR0yU {cases.prose(rng, 90_000)}"
    assert len(long.encode()) > CHUNK_BYTES
    one, other = doubling(11)
    words = [" ".join(x) for x in doubling(9, "x", "y")]
    big = doubling(10, "p", "q")
    return [long, long + " end", f"a {passage} b", cases.prose(rng, 50), one, other, *words, *(f"{w} and the {w}" for w in big)]


@pytest.fixture(scope="module")
def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).cache()


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_jaccard(frame, texts):
    assert rows(ngram_join.jaccard_classes(frame), "doc_id", "class_id", "n_links", "n_text_links") == sorted(brute.jaccard_classes(list(enumerate(texts))))


def test_words(frame, texts):
    assert rows(substring_dedup.remove_repeats(frame), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.substring_dedup(list(enumerate(texts))))


def test_bytes(frame, texts):
    assert rows(suffix_dedup.remove_later_copies(frame), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.suffix_dedup(list(enumerate(texts))))


def test_tokens(spark, frame, texts):
    path = shared_dir(spark)
    token_files.write_token_files(frame, f"{path}/t", PATH)
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_files.id_checksums(spark, f"{path}/t").collect()}
    packing.write_buckets(packing.pack(frame, PATH), f"{path}/p")
    pieces = {}
    for r in packing.read_buckets(spark, f"{path}/p").collect():
        pieces.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    for k, t in enumerate(texts):
        ids = WHOLE.encode(t, add_special_tokens=False).ids
        assert got[k] == (len(ids) + 1, zlib.crc32(np.array(ids + [2], "<u4").tobytes()))
        assert b"".join(x for _, x in sorted(pieces[k])) == np.array(ids + [0], "<u4").tobytes()


def test_others(spark, frame, texts):
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert rows(quality.judge(frame), *columns) == sorted(brute.quality(list(enumerate(texts))))
    found = rows(license_scan.scan(frame), "doc_id", "license", "template", "start", "stop", "containment")
    assert found == sorted(brute.licenses(list(enumerate(texts)), license_scan.TEMPLATES)) and {x[0] for x in found} == {0, 1}
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in secret_scan.scan(frame).collect()}
    assert all(spans[k] == brute.secrets(t) for k, t in enumerate(texts) if len(t) < 10_000) and len(spans[0]) == len(spans[1]) == 1
    item = " ".join(texts[3].split()[5:40])
    b = spark.createDataFrame([(1, item), (2, " ".join(texts[0].split()[150_000:150_030]))], "item_id long, text string")
    assert rows(decontaminate.find_items(frame, b), "doc_id", "item_id") == [(0, 2), (1, 2), (3, 1)]


def test_archives(spark, texts):
    path = shared_dir(spark)
    pages = spark.createDataFrame([(k, "u", t) for k, t in enumerate(texts)], "page_id long, url string, html string").repartition(3)
    warc.write_archives(pages, path)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type) for r in warc.resolved(warc.read_archives(spark, path)).collect()}
    assert got == {k: (len(t.encode()), warc.bare_sha1(t.encode()), "response") for k, t in enumerate(texts)}


def test_recall_of_links_near_the_threshold(spark):
    """Pairs of similarity 0.8 to 0.85: all of them, as counted exactly."""
    rng = random.Random(77)
    texts = []
    for _ in range(220):
        base = cases.prose(rng, rng.randrange(60, 260)).split()
        near = list(base)
        for i in sorted(rng.sample(range(len(base)), max(1, round(len(base) * rng.uniform(0.014, 0.026))))):
            near[i] = f"other{rng.randrange(10**6)}"
        texts += [" ".join(base), " ".join(near)]
    sets = [brute.shingles(t) for t in texts]
    close = {k for k in range(0, len(texts), 2) if 0.8 <= len(sets[k] & sets[k + 1]) / len(sets[k] | sets[k + 1]) < 0.85}
    assert len(close) >= 40
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    linked = {r.doc_id for r in ngram_join.jaccard_classes(df).where("n_text_links > 0").collect()}
    assert close <= linked
    assert linked == {k for k, c, n, m in brute.jaccard_classes(list(enumerate(texts))) if m}
