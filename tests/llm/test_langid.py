"""Language identification: held-out accuracy, exact paths, edge cases."""

import itertools

import numpy as np

from factfold.llm.langid import Model, best_paths, identify, keep_identified, train
from factfold.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = QUERIES["op10_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").select(
        "held_out", "lang", "lang_pred", "score").collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in rows if r.held_out]) > 0.97


def test_paths_are_the_best():
    rng = np.random.default_rng(3)
    sizes = np.array([5, 0, 1, 4])
    starts = np.cumsum(sizes) - sizes
    scores = rng.normal(0, 2, (10, 3)).astype(np.float32)
    path = best_paths(scores, starts, sizes, 1.5)
    for a, n in zip(starts, sizes, strict=True):
        def value(p, a=a, n=n):
            return sum(scores[a + i, p[i]] for i in range(n)) - 1.5 * sum(p[i] != p[i - 1] for i in range(1, n))
        best = max(map(value, itertools.product(range(3), repeat=int(n))))
        assert abs(value(path[a : a + n]) - best) < 1e-4


def test_mixed_text_and_edge_cases(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = train(docs)
    pick = {r.lang: r.text[:800] for r in docs.filter("n_chars > 900").select("lang", "text").collect()}
    rows = [(1, pick["en"] + "\n" + pick["fr"]), (2, None), (3, ""), (4, "123 -- 45 ²"), (5, pick["de"]), (5, pick["es"]), (None, pick["en"]),
            (7, "Слово и дело"), (8, "x" * 100_000)]
    found = {(r.doc_id, r.lang_pred): r for r in identify(documents(rows), model).collect()}
    assert {s.lang for s in found[next(k for k in found if k[0] == 1)].spans} == {"en", "fr"}
    assert (2, "und") in found and (3, "und") in found and (4, "und") in found and (5, "de") in found and (5, "es") in found
    assert found[2, "und"].score == 0 and len(found) == 9
    assert found[5, "de"].spans[0]["from"] == 0
    kept = keep_identified(documents(rows), model)
    assert kept.columns == documents(rows).columns and {r.doc_id for r in kept.collect()} >= {1, 5, None}
    assert not {2, 3, 4} & {r.doc_id for r in kept.collect()}
    assert train(docs.limit(0)).languages == []
    assert {r.lang_pred for r in identify(documents(rows), Model([], None, None)).collect()} == {"und"}
    assert identify(documents([]), model).count() == 0


def test_rare_languages_are_learned(spark):
    rare = [("жук", "a"), ("γάτα", "b"), ("ქართული", "c"), ("कुत्ता", "d"), ("สวัสดี", "e"), ("שלום", "f")]
    docs = spark.range(100_000).selectExpr("id as doc_id", "'the cat' as text", "'en' as lang").union(
        spark.createDataFrame([(-1 - i, *r) for i, r in enumerate(rare)], "doc_id bigint, text string, lang string"))
    model = train(docs)
    assert model.languages == ["a", "b", "c", "d", "e", "en", "f"]
    assert {r.lang_pred for r in identify(docs.filter("doc_id < 0"), model).collect()} == {*"abcdef"}


def test_many_languages_in_a_task(spark):
    docs = spark.createDataFrame([(i, f"word{chr(97 + i % 26)} same{chr(97 + i // 26)} same", f"l{i:03d}") for i in range(200)] * 2,
                                 "doc_id bigint, text string, lang string")
    whole, parted = train(docs.coalesce(1)), train(docs.repartition(7))
    assert len(whole.languages) == 200 and whole.languages == parted.languages
    assert np.array_equal(whole.scores, parted.scores) and np.array_equal(whole.scripts, parted.scripts)


def test_scripts_narrow(spark, documents):
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate([("the cat and the dog", "en"), ("кошка и собака", "ru"), ("der hund und die katze", "de")] * 5)],
                                 "doc_id bigint, text string, lang string")
    found = {r.doc_id: r.lang_pred for r in identify(documents([(1, "собака"), (2, "the dog"), (3, "die katze")]), train(docs)).collect()}
    assert found == {1: "ru", 2: "en", 3: "de"}
