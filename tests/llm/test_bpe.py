"""Byte-level BPE against the tiktoken library, and the round trip."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from factfold.llm.bpe import VOCABULARY, Coder, encode_documents, numbers_of

TEXTS = ["", " ", "a", "  a", "a  b\n\nc \n d\t\te\r\n", "\n\nX", "a\x1cb \x1c c", "x y  z", "a  b\xa0c", "don't won't 'll 're",
         "a" * 3000, " " * 500 + "x", "é" * 50 + "日本語" * 30, "\x00a\x00 b", "x\n", "\nx", "…'s's", "<|endoftext|> a"]


@pytest.fixture(scope="module")
def own():
    return Coder()


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path(VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def joined(ids) -> str:
    return ",".join(map(str, ids))


def test_same_ids_as_the_library(own, library):
    assert own.encode(TEXTS) == [joined(library.encode_ordinary(t)) for t in TEXTS]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), max_size=4))
def test_any_text(own, library, texts):
    assert own.encode(texts) == [joined(library.encode_ordinary(t)) for t in texts]


def test_long_pieces(own, library):
    """Words far longer than what a step-by-step table could hold, alone and together."""
    rng = random.Random(1)
    letters = ["".join(rng.choices("abcdefghijkl", k=k)) for k in (201, 1000, 5000)]
    texts = [*letters, "-" * 4000, "7" * 3000, "字符的测试文本" * 150, " ".join("".join(rng.choices("abcdefgh", k=700)) for _ in range(40))]
    assert own.encode(texts) == [joined(library.encode_ordinary(t)) for t in texts]
    assert own.decode([numbers_of(ids) for ids in own.encode(texts)]) == [t.encode() for t in texts]


def test_whole_table(spark, documents, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, None), (3, "again"), (None, "no id")]
    got = encode_documents(documents(rows)).collect()
    want = sorted((str(d), joined(library.encode_ordinary(t or "")), t or "") for d, t in rows)
    assert sorted((str(r.doc_id), joined(r.ids), r.decoded) for r in got) == want
    for r in got:
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(joined(r.ids).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()


def test_empty_table(documents):
    assert encode_documents(documents([])).count() == 0
