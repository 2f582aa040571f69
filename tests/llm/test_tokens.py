import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracelake.llm.bpe import word_bpe
from tracelake.llm.bpe_codec import decode, encode, round_trip
from tracelake.llm.token_counts import token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
SCHEMA = "doc_id long, text string, ids long, n_tokens string"
TEXTS = ["Hello world", None, "", "  \t\n", "it's IT'LL they've", "ΣΑΣ İstanbul ﬁ Å", "a<|endoftext|>b<|startoftext|> c", "x\x1cy\x85z　w", "中文 한글 ١٢٣ 😀😀", "word " * 30_000, "y" * 5_000, "Hello world"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "The", "ß", "Σ", "İ", "é", " ", "\n", "\x1c", "\x85", "'s", "'", "12", "٣", "#$%", "<|endoftext|>", "<|", "한", "가", "😀", "thththth", " ", "_"]), max_size=30))
def test_like_the_library(parts):
    text = "".join(parts)
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    bpe = word_bpe(PATH)
    assert bpe.encode(text) == ids and bpe.count(text) == len(ids)
    assert bpe.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_every_code_point():
    """Between two letters, so that the character's class decides where words end."""
    bpe = word_bpe(PATH)
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for k in range(0, len(points), 50_000):
        texts = [f"a{chr(c)}b" for c in points[k : k + 50_000]]
        for text, encoding in zip(texts, LIBRARY.encode_batch_fast(texts, add_special_tokens=False)):
            assert bpe.encode(text) == encoding.ids, ascii(text)
            assert bpe.count(text) == len(encoding.ids), ascii(text)


#: The beginnings of blocks of many scripts, with marks that join to letters.
SCRIPTS = [0x20, 0x41, 0xC0, 0x300, 0x370, 0x400, 0x530, 0x590, 0x600, 0x900, 0xB80, 0xE00, 0x10A0, 0x1100, 0x1E00, 0x1F00, 0x2000, 0x2080, 0x2100, 0x3000, 0x3040, 0x4E00, 0xA7C0, 0xAC00, 0xFB00, 0xFF00, 0x10400, 0x10D50, 0x18D80, 0x1F600, 0xE0000]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(SCRIPTS).flatmap(lambda c: st.integers(c, c + 0x6F)).map(chr), st.characters(exclude_categories=["Cs"])), max_size=40).map("".join))
def test_mixed_scripts(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    bpe = word_bpe(PATH)
    assert bpe.encode(text) == ids and bpe.count(text) == len(ids)


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(None if k == 3 else k % 9, t, k, "clash") for k, t in enumerate(TEXTS)], SCHEMA)


def test_counts(docs):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs).collect())
    n = [len(LIBRARY.encode(t or "", add_special_tokens=False).ids) for t in TEXTS]
    assert got == sorted((str(None if k == 3 else k % 9), len((t or "").encode()), n[k], n[k] > 2048) for k, t in enumerate(TEXTS))
    assert token_counts(docs.limit(0)).count() == 0


def test_codec(docs):
    digest = lambda b: hashlib.sha256(b).hexdigest()
    expected = []
    for k, t in enumerate(TEXTS):
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        expected.append((str(None if k == 3 else k % 9), digest(np.array(ids, "<u4").tobytes()), digest(LIBRARY.decode(ids, skip_special_tokens=False).encode())))
    for both in (round_trip(docs), decode(encode(docs))):
        assert sorted((str(r.doc_id), digest(bytes(r.ids)), digest(r.decoded.encode())) for r in both.collect()) == sorted(expected)
    assert round_trip(docs.limit(0)).count() == 0 and zlib.crc32(b"") == 0
