"""The pipeline against the operators' brute-force versions, stage by stage."""

import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from . import brute, cases

WHOLE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def masked(text):
    """Each union of overlapping secrets replaced, straight from their spans."""
    out, at = "", 0
    for _, a, b in brute.secrets(text):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def test_run(spark, tmp_path):
    import random

    rng = random.Random(9)

    def prose(n):
        return "the " + cases.prose(rng, n // 2) + " of and " + cases.prose(rng, n - n // 2)

    texts = [prose(120) for _ in range(6)]
    texts += [texts[0] + " tail", "too short", prose(60) + " password = hunter2222 " + cases.prose(rng, 20), None]
    leak = "the quick stone under early winter road is quiet and tall with green light of the morning paper"
    texts.append(prose(80) + " " + leak + ". " + cases.prose(rng, 10))
    docs = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    good = {r[0] for r in brute.quality(list(enumerate(texts))) if r[-1]}
    assert 7 not in good and 9 not in good and {0, 1, 8, 10} <= good
    kept = [(k, t) for k, t in enumerate(texts) if k in good]
    kept = {d for d, c, *_ in brute.jaccard_classes(kept) if d == c}
    assert 6 not in kept
    assert any("hunter" in texts[k] for k in kept) and 10 in kept
    want = []
    for k in kept - {10}:
        ids, at = WHOLE.encode(masked(texts[k]), add_special_tokens=False).ids + [0], 0
        while at < len(ids):
            size = min(1024, 1 << ((len(ids) - at).bit_length() - 1))
            want.append((k, at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes()), len(ids), 0))
            at += size
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.offset) for r in rows) == sorted(want)
    assert len({r.sequence_id for r in rows}) == len(rows)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and np.unique(names).size == 5
    out = spark.createDataFrame(docs, schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, str(tmp_path))
        assert out.columns == [c.split()[0] for c in schema.split(", ")]


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
