"""Removal of repeated byte strings against a scan of all windows."""

import hashlib
import random

import numpy as np

from factfold.llm import repeats
from factfold.llm.repeats import _later_windows, keyed, remove_repeats


def brute(docs, length):
    """Result per distinct (doc_id, text), documents in the operator's order."""
    seen, out = set(), {}
    for number, text, *_ in docs:
        data = (text or "").encode()
        cover = np.zeros(len(data), bool)
        for at in range(len(data) - length + 1):
            window = data[at : at + length]
            if window in seen:
                cover[at : at + length] = True
            seen.add(window)
        runs = int((np.diff(cover.astype(int), prepend=0) == 1).sum())
        kept = bytes(np.frombuffer(data, np.uint8)[~cover])
        out[number, text] = (len(data), int(cover.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def check(spark, documents, rows, length=100, **more):
    df = documents(rows)
    ties = {(r.doc_id, r.t): (r.did, r.tie) for r in keyed(df).selectExpr("doc_id", "did", "tie", "cast(data as string) as t").collect()}
    order = sorted({(d, t or "") for d, t in rows}, key=lambda x: ties[x])
    want = brute(order, length)
    got = [tuple(r) for r in remove_repeats(df, length, **more).collect()]
    assert sorted(map(str, got)) == sorted(str((d, *want[d, t or ""])) for d, t in rows)
    return got


def texts(seed, count=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(2, 8)))
    passages = [" ".join(word() for _ in range(n)) for n in (12, 25, 40, 60, 200)]
    out = []
    for _ in range(count):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 6))]
        out.append(" ".join(parts))
    out += [out[3], out[3], out[5][: len(out[5]) // 2] + "X" + out[5][len(out[5]) // 2 :], "a" * 700, "ab" * 300, "a" * 99, "a" * 100, "", None]
    return out


def test_against_a_scan(spark, documents):
    rows = [(100 - i, t) for i, t in enumerate(texts(1))] + [(None, texts(1)[2]), (None, "b" * 150), (7, "other text of the same id " * 12)]
    rows += [rows[4], rows[4], rows[-1]]
    got = check(spark, documents, rows)
    assert sum(r[2] for r in got) > 1000


def test_crowded_anchors_and_buckets(spark, documents):
    rows = list(enumerate(texts(2)))
    check(spark, documents, rows, most=2)
    check(spark, documents, rows, length=64, bucket_bytes=500)


def test_hot_anchors(spark, documents):
    """One text holds most anchors."""
    rng = random.Random(6)
    passage = "".join(rng.choices("abcdef ", k=150))
    check(spark, documents, [(i, passage if i % 3 else passage[:70] + str(i) + passage[70:]) for i in range(40)])


def test_pieces_of_a_long_text(monkeypatch):
    """Fragments of pieces cover every window of the text once."""
    import pyarrow as pa
    rng = random.Random(3)
    data = bytes(rng.choices(b"abc ", k=5000))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([data], pa.binary())], ["did", "tie", "data"])
    for size in (10**6, 700, 101):
        monkeypatch.setattr(repeats, "PIECE_BYTES", size)
        got = pa.Table.from_batches(repeats._read_anchors(100, True)(iter([batch])))
        starts = sorted(a + k for a, n in zip(got["at"].to_pylist(), got["windows"].to_pylist(), strict=True) for k in range(n))
        assert starts == list(range(len(data) - 99))


def test_nothing(spark, documents):
    assert remove_repeats(documents([])).count() == 0
    assert [r.n_removed for r in remove_repeats(documents([(1, None), (2, "")])).collect()] == [0, 0]


def test_interval_expansion():
    rng = random.Random(1)
    for _ in range(200):
        length = rng.choice([1, 2, 3, 5, 8])
        fragments = [bytes(rng.choices(b"abc"[: rng.choice([1, 2, 3])], k=rng.randint(1, 20))) for _ in range(rng.randint(1, 8))]
        found = _later_windows(fragments, np.arange(len(fragments)), np.zeros(len(fragments), int), length)
        seen, want = set(), set()
        for i, f in enumerate(fragments):
            for s in range(len(f) - length + 1):
                if f[s : s + length] in seen:
                    want.add((i, s))
                seen.add(f[s : s + length])
        assert {(f, s) for f, a, b in zip(*(x.tolist() for x in found), strict=True) for s in range(a, b + 1)} == want
