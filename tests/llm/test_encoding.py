import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomline.llm.encoding import Encoder
from loomline.llm.textarrays import CHUNK_BYTES, byte_sums, span_hash, utf8, word_hashes

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)


def check(texts):
    data, off = utf8(pa.array(texts, pa.string()))
    ids, at = Encoder.of(PATH).encode(data, off)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == WHOLE.encode(t or "", add_special_tokens=False).ids, repr(t)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\t\r\x0b\x1c \u0085 　é'sélA1,.#ー퟿😀"), max_size=14), max_size=6))
def test_pieces_equal_whole_texts(texts):
    check(texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=5))
def test_any_text(texts):
    check(texts)


@pytest.mark.parametrize("texts", [[], [None], ["", " ", "\n", "a", None], ["a ", " b", "c\n", "\nd"], ["it's a don't\n\nx  y", "<|endoftext|> a<|endoftext|>"]])
def test_edges(texts):
    check(texts)


def test_cache_overflow(monkeypatch):
    monkeypatch.setattr("loomline.llm.encoding.CACHE_PIECES", 8)
    check([" ".join(f"w{i}x" for i in range(k, k + 20)) for k in range(30)])
    assert isinstance(Encoder.of(PATH).ids, np.ndarray)


def doubling(n, a="a", b="b"):
    """A string of 2**n characters and its complement: polynomials modulo 2**64 can't tell them apart."""
    s = "0"
    for _ in range(n):
        s += s.translate({48: "1", 49: "0"})
    return s.translate({48: a, 49: b}), s.translate({48: b, 49: a})


@pytest.mark.parametrize("n", [10, 11, 12])
def test_doubling_texts(n):
    one, other = doubling(n)
    check([one, other, "x " + one, "x " + other])
    data, off = utf8(pa.array([one, other], pa.string()))
    a, b = span_hash(byte_sums(data), off[:-1], off[1:])
    assert a != b
    a, b = word_hashes(data, off[:-1], off[1:])
    assert a != b


def test_hashes_do_not_decide(monkeypatch):
    """Pieces that share a key, in one batch and between batches."""
    monkeypatch.setattr("loomline.llm.encoding.word_hashes", lambda data, start, stop: (stop - start).astype(np.uint64) % np.uint64(3))
    encoder = Encoder(PATH)
    for texts in (["one two six ten", "two one"], ["ten two nine seven é", "a bc def", "", "bc a"]):
        data, off = utf8(pa.array(texts, pa.string()))
        ids, at = encoder.encode(data, off)
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == WHOLE.encode(t, add_special_tokens=False).ids


def test_a_text_beyond_one_chunk():
    rng = np.random.default_rng(4)
    long = " ".join(f"w{x}é" for x in rng.integers(0, 10**6, 400_000))
    assert len(long.encode()) > CHUNK_BYTES
    check([long, "short", long[:100]])
