"""URL verdicts against SQL on the supplied pages and on hand-made ones."""

import duckdb
import pyarrow as pa
import pytest

from factfold.llm.urls import ORACLE, judge_urls

HARD = [None, "", "no scheme/en/1", "http://", "HTTP://EXAMPLE.ORG/ES/1", "http://Example.Org/es/1", "http://a.example.org/en/12/x?q=http://b",
        "http://notexample.org/es/", "http://org/", "http://com/fr/x", "http://x.com/de/1?a#b", "http://x.com/de", "http://x.com?u=/de/", "a://b://c/d",
        "http://x.com/fr/" + "y/" * 300, "http://é.com/de/", "http://x.com//de/"]


def same(spark, rows):
    got = sorted(map(str, (tuple(r) for r in judge_urls(rows).select("page_id", "host", "path", "rule", "verdict", "template", "purity").collect())))
    db = duckdb.connect()
    kept = rows.collect()
    pages = pa.table({"page_id": [r.page_id for r in kept], "url": pa.array([r.url for r in kept], pa.string())})
    db.register("pages", pages)
    want = sorted(map(str, db.sql(ORACLE).fetchall()))
    assert got == want
    return got


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_supplied_pages(spark, name):
    assert same(spark, spark.read.parquet(f"/root/testdata/{name}/pages.parquet").select("page_id", "url"))


def test_hard_urls(spark):
    rows = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(HARD + HARD[3:5])], "page_id bigint, url string, host string, rule string")
    same(spark, rows)
    verdicts = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(rows).collect()}
    assert verdicts[0][:3] == ("", "", None) and verdicts[5] == ("example.org", "/es/1", "example.org/es/", "block")
    assert verdicts[6][2] == "example.org/en/1" and verdicts[7][2] == "org/" and verdicts[10][3] == "block" and verdicts[11][2] is None
    assert judge_urls(rows.limit(0)).count() == 0


def test_impure_template_is_rejected(spark):
    blocked = [(i, f"http://h{i % 3}.net/spam/{i}") for i in range(90)] + [(i, f"http://h{i % 3}.net/ok/{i}") for i in range(90, 180)]
    rules = (("block", "h0.net/spam/1"), ("block", "h0.net/spam/2"), ("block", "h0.net/spam/3"), ("block", "h0.net/spam/6"), ("allow", "h0.net/ok/1"))
    found = judge_urls(spark.createDataFrame(blocked, "page_id bigint, url string"), rules).filter("rule is null and host = 'h0.net'").collect()
    assert {(r.template.split("/")[0], r.verdict) for r in found} == {("spam", "block"), ("ok", "allow")}
