"""WARC archives: exact round trips, revisits, and one order of all captures."""

import hashlib
import heapq
import random

import pytest

from factfold.llm.warc import broken_revisits, loser_tree, merge_indexes, new_folder, read_archives, url_key, write_archives

COLUMNS = "page_id bigint, url string, html string, time string, path string, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, None, "x", "y") for r in rows], COLUMNS)


@pytest.mark.parametrize("archive_bytes", [500, 10**9])
def test_round_trip(spark, archive_bytes):
    rng = random.Random(2)
    bodies = ["é" * 60, "b" * 100, "c" * 99, "", "d" * 5000, "tab\tline\r\n\r\n" * 20]
    rows = [(i * 3, f"http://www.h{rng.randint(0, 4)}.Example.org/p/{rng.randint(0, 9)}?q=ü {i}", rng.choice(bodies)) for i in range(60)]
    rows += [(1000, None, None), (1001, "", "z" * 200), (None, "http://x/", "z" * 200), (7, "no scheme", "w" * 150), (7, "no scheme/2", "w" * 150)]
    manifest = write_archives(pages(spark, rows), new_folder(spark), archive_bytes=archive_bytes)
    got = read_archives(manifest).collect()
    first = {}
    for p, u, h in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        first.setdefault(h or "", p)
    assert len(got) == len(rows)
    texts = {(p, u or ""): h or "" for p, u, h in rows}
    responses = {}
    for r in got:
        payload = texts[r.page_id, r.url].encode()
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
        responses.setdefault(r.payload_digest, []).append(r)
        if len(payload) < 100:
            assert (r.record_type, r.refers_to) == ("response", None)
        elif r.record_type == "revisit":
            want = first[payload.decode()]
            assert r.refers_to == (-(1 << 63) if want is None else want)
        else:
            assert r.page_id == first[payload.decode()] and r.refers_to is None
    for rs in responses.values():
        if rs[0].payload_bytes >= 100:
            assert sum(r.record_type == "response" for r in rs) == 1

    order = [(r.url_key, r.time, r.page_id or -(1 << 63)) for r in merge_indexes(manifest, ranges=4).orderBy("part", "rank").collect()]
    assert order == sorted(order) and len(order) == len(rows)


def test_recaptures_keep_their_own_payloads(spark):
    # One id and URL with several payloads, null ids with null or empty URLs, exact repeats, and short ones.
    rows = [(1, "http://a/", "a" * 150), (2, "http://b/", "b" * 150), (3, "http://b/", "a" * 150), (3, "http://b/", "b" * 150),
            (3, "http://b/", "unique " * 30), (3, "http://b/", "short"), (4, "http://c/", "d" * 120), (4, "http://c/", "d" * 120),
            (4, "http://c/", "d" * 120), (None, None, "e" * 130), (None, "", "f" * 130), (None, None, "short"), (None, "", "e" * 130),
            (5, "http://d/", "f" * 130), (6, "http://e/", "x" * 99), (6, "http://e/", "x" * 99)]
    got = read_archives(write_archives(pages(spark, rows), new_folder(spark))).collect()
    digest = {h: hashlib.sha256(h.encode()).hexdigest() for _, _, h in rows}
    sort = lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else x for x in r)
    assert sorted(((r.page_id, r.payload_digest) for r in got), key=sort) == sorted(((p, digest[h]) for p, _, h in rows), key=sort)
    for html, code in digest.items():
        same = [r for r in got if r.payload_digest == code]
        ids = [-(1 << 63) if p is None else p for p, _, h in rows if h == html]
        responses = [r for r in same if r.record_type == "response"]
        assert all(r.refers_to is None for r in responses)
        if len(html) < 100:
            assert len(responses) == len(ids)
        else:
            assert [r.page_id for r in responses] == [None if min(ids) == -(1 << 63) else min(ids)]
            assert all(r.refers_to == min(ids) for r in same if r.record_type == "revisit")


def test_earliest_of_exact_repeats_is_the_response(spark):
    rows = [(1, "http://a/", "a" * 150, t) for t in ("2024-03-01T00:00:00Z", "2024-01-01T00:00:00Z", "2024-02-01T00:00:00Z")]
    manifest = write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string, time string"), new_folder(spark))
    at = {r.offset: r.time for r in merge_indexes(manifest).collect()}
    got = {at[r.offset]: (r.record_type, r.refers_to) for r in read_archives(manifest).collect()}
    assert got == {rows[1][3]: ("response", None), rows[2][3]: ("revisit", 1), rows[0][3]: ("revisit", 1)}


def test_urls_and_record_ids_survive(spark):
    urls = ["http://x/%41%2Fb", "http://x/A/b", "http://x/a b", "http://x/a%20b", "http://x/'q'", "http://x/\r\nWARC-Type: x", "%", "%zz ü", "<>\"", " ", ""]
    rows = [(i, u, h) for i, u in enumerate(urls) for h in ("a" * 150, "s", "s", f"{i}" * 120, f"{i}" * 120)]
    records = read_archives(write_archives(pages(spark, rows), new_folder(spark)))
    got = records.collect()
    assert sorted((r.page_id, r.url) for r in got) == sorted((i, u) for i, u, _ in rows)
    assert len({r.record_id for r in got}) == len(rows)
    at = {r.record_id: r for r in got}
    for r in got:
        if r.record_type == "revisit":
            named = at[r.refers_to_id]
            assert (named.record_type, named.page_id, named.payload_digest) == ("response", r.refers_to, r.payload_digest)
    assert broken_revisits(records).count() == 0
    lost = records.filter("record_type = 'revisit' or page_id > 0")
    assert {r.refers_to for r in broken_revisits(lost).collect()} == {0}


def test_many_runs_and_cuts(spark):
    rows = [(i, f"http://hot.org/{i % 7}", "x") for i in range(900)]
    manifest = write_archives(pages(spark, rows), new_folder(spark), archive_bytes=100)
    merged = merge_indexes(manifest, ranges=5)
    order = [(r.url_key, r.time, r.page_id) for r in merged.orderBy("part", "rank").collect()]
    assert order == sorted(order) and len(order) == 900


def test_empty(spark):
    manifest = write_archives(pages(spark, []), new_folder(spark))
    assert read_archives(manifest).count() == 0 and merge_indexes(manifest).count() == 0


def test_loser_tree():
    rng = random.Random(5)
    for n in range(9):
        runs = [sorted((rng.randint(0, 9), i) for _ in range(rng.randint(0, 6))) for i in range(n)]
        assert list(loser_tree([iter(r) for r in runs], lambda x: x)) == list(heapq.merge(*runs))


def test_url_key():
    assert url_key("https://www.Example.org:8080/A/b?C=1#f") == "org,example:8080)/a/b?c=1"
    assert url_key("") == ")/"
