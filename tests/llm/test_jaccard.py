"""The Jaccard join against all pairs."""

import random

import pytest

from factfold.llm import jaccard
from factfold.llm.jaccard import components, keep_first, link_documents, pack, unpack


def brute(docs, words=4):
    sets, owner = [], list(range(len(docs)))
    for _, t in docs:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset())

    def find(x):
        while owner[x] != x:
            x = owner[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                x, y = find(i), find(j)
                owner[max(x, y)] = min(x, y)
    smallest = {}
    for i, (d, _) in enumerate(docs):
        smallest[find(i)] = min(smallest.get(find(i), d), d)
    return sorted((d, len(sets[i]), smallest[find(i)]) for i, (d, _) in enumerate(docs))


def corpus(seed):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(n)] for n in (30, 60, 61, 100, 12, 5)]
    shared = [f"c{i}" for i in range(30)]
    docs = []
    for i in range(240):
        b = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            b[rng.randrange(len(b))] = rng.choice("xyz") + str(rng.randint(0, 30))
        if rng.random() < 0.3:
            b = shared + [f"u{i}_{k}" for k in range(rng.randint(1, 6))]
        if rng.random() < 0.1:
            b = b[: rng.randint(0, 4)]
        docs.append((i, " ".join(b)))
    return docs + [(1000, None), (1001, ""), (1002, " \n"), (1003, "A b"), (1004, "a B"), (1005, docs[3][1]), (3, docs[3][1]), (7, "É é")]


@pytest.mark.parametrize("common", [2, 32])
def test_all_pairs(documents, monkeypatch, common):
    monkeypatch.setattr(jaccard, "COMMON", common)
    docs = corpus(common)
    got = link_documents(documents(docs)).drop("text_hash", "component").collect()
    assert sorted(map(tuple, got)) == brute(docs)


def test_one_of_each_group_stays(documents):
    docs = [(5, "a b c d e f"), (2, "a b c d e f"), (9, "A B C D E F"), (4, None), (6, ""), (2, "other words stand in this one"),
            (None, "a row without an id"), (8, "x y z")]
    kept = keep_first(documents(docs))
    assert kept.columns == ["doc_id", "text", "score", "spans", "n"]
    assert sorted(((r.doc_id or 0, r.text) for r in kept.collect()), key=str) == sorted(
        [(2, "a b c d e f"), (4, None), (6, ""), (2, "other words stand in this one"), (0, "a row without an id"), (8, "x y z")], key=str)


def test_empty(documents):
    assert link_documents(documents([])).count() == 0 and keep_first(documents([])).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    owner = {n: n for e in edges for n in e}
    for _ in owner:
        for a, b in edges:
            owner[a] = owner[b] = min(owner[a], owner[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    alone = {n for n in owner if all(a == b for a, b in edges if n in (a, b))}
    assert got == {n: c for n, c in owner.items() if n not in alone}


def test_packing():
    import numpy as np

    for values in ([], [0], [1, 2**63, 2**64 - 1]):
        assert unpack(pack(np.array(values, np.uint64))).tolist() == values
