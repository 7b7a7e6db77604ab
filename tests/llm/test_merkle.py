"""Proofs from the store against the whole tree."""

import hashlib
import random
import zlib

from factfold.llm import merkle
from factfold.llm.merkle import Manifest, manifest_proofs

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf string, root int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def digest(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def path(levels, at):
    out = []
    for level in levels[:-1]:
        out.append((level[at ^ 1], (at ^ 1) < at) if (at ^ 1) < len(level) else ("", False))
        at //= 2
    return out


def brute(rows):
    langs = {}
    for row in rows:
        langs.setdefault(row[2], []).append(row)
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        own = sorted(langs[name], key=lambda r: (r[0] is not None, r[0] or 0, digest(r[:5])))
        trees[name] = own, tree([digest(r[:5]) for r in own])
    top = tree([trees[n][1][-1][0] for n in names])
    out = []
    for number, name in enumerate(names):
        own, levels = trees[name]
        for at, row in enumerate(own):
            steps = path(levels, at) + path(top, number)
            changed = list(row[:5])
            if zlib.crc32(("" if row[0] is None else str(row[0])).encode()) % 7 == 0 and row[3] is not None:
                changed[3] += 1
            folded = digest(changed)
            for other, left in steps:
                folded = h(other, folded) if left else h(folded, other)
            out.append((row[0], digest(row[:5]), levels[-1][0], top[-1][0], h(*(o for o, _ in steps)), folded, folded == top[-1][0]))
    return out


def test_against_the_whole_tree(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(400), rng.choice(["s", None, "ü:1"]), rng.choice(["de", "en", "en", "en", None, "ß", "zz"]),
             rng.choice([None, 3, 12]), rng.choice([None, "", "text é", "x" * 5000]), "clash", i) for i in range(90)]
    rows += [(1000, "s", "one", 5, "alone", None, None), (None, None, "en", None, None, None, None), (None, None, None, None, None, None, None)]
    rows += rows[:3]
    got = [tuple(r) for r in manifest_proofs(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(rows)))
    assert {r[-1] for r in got} == {True, False}


def test_several_pages(spark):
    """Trees of more than one page, with a last page of one leaf, and many languages."""
    for count in (256, 257, 700):
        rows = [(i, "s", "en" if i < count else f"l{i:04d}", i, f"t{i}", None, None) for i in range(count + 300)]
        got = [tuple(r) for r in manifest_proofs(spark.createDataFrame(rows, SCHEMA)).collect()]
        assert sorted(map(str, got)) == sorted(map(str, brute(rows)))


def test_pages():
    for n in range(1, 20):
        leaves = [h(str(i)) for i in range(n)]
        assert merkle._levels(leaves, (n - 1).bit_length())[-1] == tree(leaves)[-1]


def test_small_and_empty(spark):
    assert manifest_proofs(spark.createDataFrame([], SCHEMA)).count() == 0
    one = [(5, "s", "en", 3, "abc", None, None)]
    assert [tuple(r) for r in manifest_proofs(spark.createDataFrame(one, SCHEMA)).collect()] == brute(one)
    twice = one * 2
    assert sorted(map(str, (tuple(r) for r in manifest_proofs(spark.createDataFrame(twice, SCHEMA)).collect()))) == sorted(map(str, brute(twice)))


def test_store_is_content_addressed(spark):
    """Every record's digest follows from its children."""
    rows = [(i, "s", "en", i, f"t{i}", None, None) for i in range(600)]
    records = Manifest(spark.createDataFrame(rows, SCHEMA)).store.collect()
    assert len({r.digest for r in records}) == len(records) == 4
    assert all(merkle._levels(r.children, r.levels)[-1] == [r.digest] for r in records)
