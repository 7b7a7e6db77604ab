"""Token id shards: the library's ids, exact boundaries, whole round trips; and length counts."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.fs
import pytest
from tokenizers import Tokenizer

from factfold.llm.idfile import VOCABULARY, Boundaries, Shard, new_folder, read_shards, word_coder, write_shards
from factfold.llm.lengths import for_limits, histogram, quantiles, with_suffix_sums

TEXTS = ["", "a\x85b c　d é ́x İstanbul ß ﬁ \x1c\x1d it's  don't 12345", "日本 語 🙂👍🏽 a  b", "K Å", "word " * 5000, "  \n\t"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(VOCABULARY))


def test_ids(library):
    coder = word_coder()
    assert [np.frombuffer(c, coder.kind).tolist() for c in coder.encode(TEXTS)] == [library.encode(t, add_special_tokens=False).ids for t in TEXTS]


def test_added_tokens_in_capitals(library):
    coder = word_coder()
    texts = ["<|ENDOFTEXT|>", "<|endoftext|>", "a<|StartOfText|>B.", "A<|endoftext|>B<|ENDOFTEXT|>!", "É<|ENDOFTEXT|>", "<|ENDOFTEXT", "A|. <|X|>"]
    assert [np.frombuffer(c, coder.kind).tolist() for c in coder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_boundaries():
    rng = random.Random(1)
    for _ in range(200):
        values = sorted(rng.randint(0, rng.choice([0, 1, 50, 100_000])) for _ in range(rng.randint(1, 300)))
        coded = Boundaries.of(values, values[-1])
        assert coded.all().tolist() == values and [coded.select(i) for i in range(len(values))] == values
    n, largest = 10_000, 4_000_000
    coded = Boundaries.of(np.sort(np.random.default_rng(1).integers(0, largest, n)), largest)
    assert 8 * (len(coded.low) + len(coded.high)) < n * (2.1 + np.log2(largest / n))


@pytest.mark.parametrize("shard_chars", [40, 10**9])
def test_round_trip(spark, documents, library, shard_chars):
    rows = [(d, t) for d, t in zip([7, 3, 5, 3, 11, None], TEXTS, strict=True)] + [(20, None), (1, "x")]
    manifest = write_shards(documents(rows), new_folder(spark), shard_chars=shard_chars)
    got = sorted(map(tuple, read_shards(manifest).collect()), key=lambda r: r[1])
    coded = {}
    for d, t in rows:
        coded.setdefault(d, []).append(np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4"))
    assert [r[0] for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))
    start = 0
    for d, at, n, crc in got:
        assert at == start and (n, crc) in {(len(c), zlib.crc32(c.tobytes())) for c in coded[d]}
        start += n
    first = manifest.orderBy("shard").first()
    system, path = pyarrow.fs.FileSystem.from_uri(first.path)
    shard = Shard(system.open_input_stream(path).read())
    assert [shard.document(i).tolist() for i in range(first.n_docs)][0][-1] == 1


def test_empty(spark, documents):
    assert read_shards(write_shards(documents([]), new_folder(spark))).count() == 0
    assert with_suffix_sums(histogram(documents([]))).count() == 0
    assert for_limits(with_suffix_sums(histogram(documents([]))), [5]).count() == 0


@pytest.mark.parametrize("block", [4, 1024])
def test_lengths(documents, library, block):
    texts = [None, "", "a b c", "a b", "c d", *("w " * n for n in range(0, 40, 3))]
    lengths = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    sums = with_suffix_sums(histogram(documents([(1, t) for t in texts])), block).cache()
    for r in sums.collect():
        assert r.n_docs == lengths.count(r.length) and r.docs_at_least == sum(n >= r.length for n in lengths)
        assert r.tokens_at_least == sum(n for n in lengths if n >= r.length)
        assert r.truncated_tokens == sum(min(n, r.length) for n in lengths)
        assert r.share_at_most == sum(n <= r.length for n in lengths) / len(lengths)
    limits = [0, 1, 4, 17, 1000]
    assert {tuple(r) for r in for_limits(sums, limits).collect()} == {(x, sum(min(n, x) for n in lengths), sum(n > x for n in lengths)) for x in limits}
    assert {tuple(r) for r in quantiles(sums, [0.5, 1.0]).collect()} == {(0.5, sorted(lengths)[(len(lengths) + 1) // 2 - 1]), (1.0, max(lengths))}
