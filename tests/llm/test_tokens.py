"""Token ids: exactly those of the whole text, however it is cut."""

import random
from pathlib import Path

import pytest

K = pytest.importorskip("tickloom.llm.tokens")
PATH = Path("/opt/tokenizers/byte_bpe_50k.tiktoken")
pytestmark = pytest.mark.skipif(not PATH.exists(), reason="no vocabulary")

PIECES = ["the court", "  ", "\n\n", " ", "don't", "'s", "it's", "’s", "été", "é", "ß", "中文字符。", "これは", "ไทย ไทย", "नमस्ते", "مرحبا", "🙂", "👩‍👩‍👧", "<|endoftext|>", "12,345.67", "½", "²³", "​", "\xa0", "\x00", "\x1c", "\t\t", "...", "!!!", "_", "a" * 50, "7" * 30, " 's", "　", "﻿", "\x85", "ǅ", "Ⅷ", "ำ", "“x”", "\r\n", "   x"]


@pytest.fixture(scope="module")
def whole():
    return K.load_encoding(str(PATH))


@pytest.mark.parametrize("mask", [0, 1, 3, 7])
def test_random_texts(monkeypatch, whole, mask):
    monkeypatch.setattr(K, "MASK", mask)
    rnd = random.Random(mask)
    texts = ["".join(rnd.choice(PIECES) for _ in range(rnd.randrange(60))) for _ in range(400)]
    texts += [None, "", " ", "\n", "x", "x" * 100_000, " " * 5000, "".join(chr(rnd.randrange(1, 0xD800)) for _ in range(5000))]
    e = K.Encoder(str(PATH))
    for _ in range(2):  # from nothing, then all from the dictionary
        offsets, ids = e.batch(texts)
        for i, t in enumerate(texts):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == (whole.encode_ordinary(t) if t else [])


def test_pattern_is_the_published_one():
    P = pytest.importorskip("public_tokenizers")
    assert K.PATTERN == P.PATTERN


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
@pytest.mark.parametrize("pattern", [K.PATTERN, r"[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s+(?!\S)|\s+", r"\S+|\s+", r"(?s:.{1,4})"])
def test_bad_cuts_are_mended(name, pattern):
    """Cuts anywhere: within words, numbers, white space, contractions, and within pieces longer than several chunks."""
    import numpy as np

    path = str(PATH.parent / name)
    whole, e = K.load_encoding(path, pattern), K.Encoder(path, pattern)
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(PIECES) for _ in range(rnd.randrange(40))) for _ in range(150)]
    texts += [None, "", "don't", "a  b", "12345678", "x" * 300, " " * 40 + "x", "\n \n x"]

    def anywhere(codes, starts):
        cut = np.array([rnd.random() < 0.3 for _ in range(len(codes))])
        cut[starts] = True
        return np.flatnonzero(cut)

    for cut in (anywhere, lambda codes, starts: np.arange(len(codes)), K.cuts):
        offsets, ids = e.batch(texts, cut)
        for i, t in enumerate(texts):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == (whole.encode_ordinary(t) if t else []), t
    assert e.mended > 100


def test_no_text_of_good_cuts_is_mended(spark, data, whole):
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    e = K.Encoder(str(PATH))
    offsets, ids = e.batch(texts)
    assert e.mended == 0 and e.good
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == (whole.encode_ordinary(t) if t else [])


def test_dictionary_is_bounded(monkeypatch, whole):
    monkeypatch.setattr(K, "DICTIONARY", 5)
    e = K.Encoder(str(PATH))
    for _ in range(3):
        texts = [f"number {i} of them" for i in range(50)]
        offsets, ids = e.batch(texts)
        assert ids[offsets[7] : offsets[8]].tolist() == whole.encode_ordinary(texts[7])
    e.batch(["a b"])
    assert len(e.known) <= 5  # at the limit it starts anew with the next batch
    assert e.batch([])[0].tolist() == [0] and e.batch([None, ""])[0].tolist() == [0, 0, 0]


def test_other_vocabularies(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "über naïve 12,5")], "doc_id long, text string")
    multi = K.load_encoding(str(PATH.parent / "byte_bpe_multi_50k.tiktoken"))
    assert {r.doc_id: list(r.ids) for r in K.encode_corpus(df, name="byte_bpe_multi_50k.tiktoken").collect()} == {1: multi.encode_ordinary("a b"), 2: multi.encode_ordinary("über naïve 12,5")}


def test_frames(spark, whole):
    rows = [(1, "a b", 1), (1, "a b", 2), (2, None, 3), (3, "", 4), (None, "x" * 30_000, 5), (4, "<|endoftext|>", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted(((r.doc_id, list(r.ids)) for r in K.encode_corpus(df, characters=10).collect()), key=str)
    assert got == sorted(((d, whole.encode_ordinary(t) if t else []) for d, t, _ in rows), key=str)
    assert K.encode_corpus(df.limit(0)).count() == 0
    assert K.encode_corpus(df).dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
