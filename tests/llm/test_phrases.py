"""Collocations against a plain count of all phrases."""

import collections
import random
import re

import numpy as np
import pytest

from factfold.llm import phrases
from factfold.llm.phrases import Miner, collocations

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def counts_of(rows):
    counts, words = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\n-\r]", (text or "").encode().translate(LOWER)):
            w = re.findall(rb"[^ \t]+", piece)
            words[lang] += len(w)
            for n in range(1, 5):
                for i in range(len(w) - n + 1):
                    counts[lang][tuple(w[i : i + n])] += 1
    return counts, words


def brute(rows, first, least):
    counts, words = counts_of(rows)
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {p[i:j] for p, a in candidates.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1)
                if j - i < len(p) and p[i:j] in candidates and 100 * a >= 80 * candidates[p[i:j]]}
        scored = []
        for p, a in candidates.items():
            if p not in gone:
                score, _, left, right = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, b" ".join(p), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:first], 1):
            out.append((lang, rank, p.decode(), -a, left, right, words[lang], -score))
    return sorted(out)


def corpus(seed, count=120):
    rng = random.Random(seed)
    vocabulary = ["The", "the", "of", "a b", "é", "Éa", "x", "new", "york", "city", "hall", "rare"] + [f"w{i}" for i in range(30)]
    fixed = ["new york city hall", "new  york\tcity", "of the"]
    rows = []
    for _ in range(count):
        parts = [rng.choice(fixed) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        rows.append((rng.choice(["en", "en", "und", None]), "".join(p + rng.choice([" ", " ", " ", "\t", ". ", "\r\n", ",", "\x0b"]) for p in parts)))
    return rows + [("en", None), ("en", ""), ("fr", "one two"), (None, "x x x x x x x x")] + rows[:3]


def table(spark, rows):
    return spark.createDataFrame([(i, lang, text, "x", 3) for i, (lang, text) in enumerate(rows)],
                                 "doc_id bigint, lang string, text string, phrase string, times int")


@pytest.mark.parametrize("sample", [1, 3, 10**9])
def test_against_a_count(spark, sample):
    rows = corpus(sample % 7)
    got = sorted(tuple(r) for r in collocations(table(spark, rows), first=40, least=6, sample=sample).collect())
    assert got == brute(rows, 40, 6) and len(got) > 30


def test_passes_close_the_border(spark):
    """A useless sample needs an expansion, a perfect one none; the counts are the same."""
    rows = corpus(5)
    counts, words = counts_of(rows)
    want = {(lang, b" ".join(p).decode()): a for lang, f in counts.items() for p, a in f.items() if a >= 6}
    want |= {(lang, ""): n for lang, n in words.items() if n}
    passes = []
    for sample in (1, 10**9):
        miner = Miner(table(spark, rows), 6, 4, sample)
        assert {(r.lang, r.phrase): r.times for r in miner.run().collect()} == want
        passes.append(miner.passes)
    assert passes == [1, 2]


def test_empty(spark):
    assert collocations(table(spark, [])).count() == 0
    assert collocations(table(spark, [(None, None)])).count() == 0


def test_long_text_in_parts():
    import pyarrow as pa
    rng = random.Random(2)
    text = "".join(rng.choice(["a", "bb", "c", "Longer"]) + rng.choice([" ", "  ", ". "]) for _ in range(400))
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "en"]), pa.array([text.encode(), b"a bb c"], pa.binary())], ["lang", "data"])
    for size in (10**6, 300, 50):
        got = collections.Counter()
        for part in phrases._counter((1, 2, 3, 4), None, None, True, size)(iter([batch])):
            for row in part.to_pylist():
                got[row["phrase"]] += row["times"]
        counts, words = counts_of([("en", text), ("en", "a bb c")])
        assert got == {b" ".join(p).decode(): a for p, a in counts["en"].items()} | {"": words["en"]}


def test_hashes_agree():
    data = np.frombuffer(b"new york city hall\n", np.uint8)
    seeds = np.array([phrases._language("en")], np.uint64)
    low, high, _ = phrases._words(data)
    word = phrases._word_hashes(data, low, high)
    h = phrases.mix64(word ^ seeds[0])
    assert phrases.phrase_hashes(["en", "en"], ["new", "york"]).tolist() == h[:2].tolist()
    assert phrases.phrase_hashes(["en"], ["york city hall"])[0] == phrases._chain(phrases._chain(h[1:2], word[2:3]), word[3:4])[0]
