"""Passages found by the index against a scan."""

import hashlib
import random

import numpy as np

from factfold.llm import decontam
from factfold.llm.decontam import FmIndex, drop_contaminated, find_passages, judge, words_of


def scan(text, items, window):
    words = words_of(text)
    hit, found = [False] * len(words), set()
    for item, other in items:
        own = words_of(other)
        for at in range(max(1, len(own) - window + 1) if own else 0):
            part = own[at : at + window]
            for place in range(len(words) - len(part) + 1):
                if words[place : place + len(part)] == part:
                    found.add(item)
                    hit[place : place + len(part)] = [True] * len(part)
    return len(words), sum(hit), sorted(found, key=decontam.id_order)


def test_against_a_scan(spark, documents, monkeypatch):
    rng = random.Random(4)
    vocabulary = ["a", "B", "c", "é", "9"]
    for block in (10**9, 7):
        monkeypatch.setattr(decontam, "BLOCK_WORDS", block)
        items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 5, 6, 9])))) for i in range(12)] + [
            (50, None), (11, "a a a a"), (None, "a a a a"), (None, "c é 9 a"), (None, None)]
        docs = [(d, "-".join(rng.choices([*vocabulary, "zz"], k=rng.randint(0, 60)))) for d in range(40)] + [(99, None), (98, ""), (None, "a b")]
        found = find_passages(documents(docs), spark.createDataFrame(items, "item_id bigint, text string"), window=4) if block > 100 else None
        if found is None:
            blocks = decontam.phrase_blocks(spark.createDataFrame(items, "item_id bigint, text string"), 4, block)
            assert len(blocks) > 2
            for (_, text), (n, spans, hit) in zip(docs, decontam._shard([t or "" for _, t in docs], blocks), strict=True):
                assert (n, sum(b - a for a, b in spans), hit) == scan(text, items, 4)
            continue
        want = {d: scan(t, items, 4) for d, t in docs}
        for r in judge(found).collect():
            n, hit, its = want[r.doc_id]
            assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(its), hit > 0 and 20 * hit >= n)
            assert r.items_sha256 == hashlib.sha256(",".join(sorted(str(i) for i in its if i is not None)).encode()).hexdigest()
        kept = drop_contaminated(documents(docs), spark.createDataFrame(items, "item_id bigint, text string"), window=4)
        assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, (n, hit, _) in want.items() if not (hit and 20 * hit >= n))


def test_items_without_an_id(spark, documents):
    # Two of them share their window with a named item, and one has a window of its own.
    items = spark.createDataFrame([(None, "a b"), (None, "A, B"), (3, "a b"), (None, "x y")], "item_id bigint, text string")
    docs = documents([(1, "a b c"), (2, "x y"), (3, "c"), (None, "a b x y")])
    got = {r.doc_id: r for r in judge(find_passages(docs, items)).collect()}
    assert {d: (r.n_hit, r.n_items, r["items"]) for d, r in got.items()} == {
        1: (2, 2, [3, None]), 2: (2, 1, [None]), 3: (0, 0, []), None: (4, 2, [3, None])}
    digest = {w: hashlib.sha256(w.encode()).hexdigest() for w in ("", "3")}
    assert {d: r.items_sha256 for d, r in got.items()} == {1: digest["3"], 2: digest[""], 3: digest[""], None: digest["3"]}
    assert [r.doc_id for r in drop_contaminated(docs, items).collect()] == [3]


def test_empty_benchmark_and_table(spark, documents):
    nothing = spark.createDataFrame([], "item_id bigint, text string")
    assert [r.n_hit for r in judge(find_passages(documents([(1, "a b")]), nothing)).collect()] == [0]
    assert find_passages(documents([]), nothing).count() == 0


def test_index():
    rng = np.random.default_rng(2)
    for _ in range(30):
        text = rng.integers(1, 4, rng.integers(1, 60))
        index = FmIndex(text, 5)
        patterns = rng.integers(1, 6, (10, rng.integers(1, 4)))
        low, high = index.search(patterns)
        for pattern, a, b in zip(patterns, low, high, strict=True):
            want = [i for i in range(len(text) - len(pattern) + 1) if (text[i : i + len(pattern)] == pattern).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want
