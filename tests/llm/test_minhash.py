"""Fingerprints: edited texts, neighbours and likeness against plain Python."""

import hashlib
import random

import pytest

from factfold.llm import minhash
from factfold.llm.minhash import fingerprints


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("ids_per_range", [3, 200_000])
def test_edits_and_likeness(documents, monkeypatch, ids_per_range):
    rng = random.Random(7)
    monkeypatch.setattr(minhash, "RANGE", ids_per_range)
    monkeypatch.setattr(minhash.neighbours, "__defaults__", (ids_per_range,))
    words = [f"wé{i}" for i in range(400)]
    texts = {d: " ".join(rng.choices(words, k=rng.choice([0, 2, 50, 300, 900]))) for d in rng.sample(range(1000), 30)}
    texts[2000] = texts[min(texts)]
    texts[2001] = None
    near = (texts[2000] or "a b c d e f") + " tail"
    texts[2002] = near
    order = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in fingerprints(documents(list(texts.items()))).collect()}
    assert len(got) == len(texts)
    errors = []
    for at, d in enumerate(order):
        text, following = texts[d] or "", texts[order[(at + 1) % len(order)]] or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + following[:k]
        r = got[d]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if len(text.split()) >= 50:
            errors += [abs(r.near_edited - jaccard(text, edited)), abs(r.near_next - jaccard(text, following))]
    assert sum(errors) / len(errors) < 0.05 and max(errors) < 0.25
    assert got[2000].fingerprint == got[min(texts)].fingerprint
    assert got[2001].fingerprint == ""


def test_edge_cases(documents):
    one = fingerprints(documents([(5, "a b c d e f g")])).first()
    assert one.near_next == 1.0 and len(one.fingerprint) == minhash.BINS
    assert fingerprints(documents([])).count() == 0
    rows = fingerprints(documents([(1, "x y"), (1, "x y"), (1, None), (None, "abc def"), (None, ""), (3, "long " * 30_000)])).collect()
    assert len(rows) == 6
    assert {(r.near_next, r.edited_sha256) for r in rows if r.doc_id is None} == {
        (None, hashlib.sha256(b"abc d").hexdigest()), (None, hashlib.sha256(b"").hexdigest())}
