"""The pipeline: stages against their operators, whole rows, and nothing from empty tables."""

import random

import corpus_pipeline
from factfold.llm import bpe, decontam, jaccard, langid, quality
from factfold.llm.common import keep
from factfold.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    want = {}
    for name, stage in corpus_pipeline.STAGES:
        made = keep(stage(spark, docs, SF))
        if name == "quality":
            scores = quality.score_documents(docs, quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet")))
            want = {r.doc_id for r in scores.filter("score >= 0.3").collect()}
        elif name == "language":
            want = {r.doc_id for r in langid.identify(docs, langid.train(docs)).filter("lang_pred <> 'und' and score >= 0.5").collect()}
        elif name == "near_duplicates":
            want = {r.component_id for r in jaccard.link_documents(docs).collect()}
        elif name == "decontamination":
            found = decontam.judge(decontam.find_passages(docs, spark.read.parquet(f"{SF}/benchmark.parquet")))
            want = {r.doc_id for r in found.filter("not contaminated").collect()}
        else:
            assert sorted(r.decoded_sha256 for r in made.collect()) == sorted(
                r.decoded_sha256 for r in bpe.encode_documents(docs, ids=False).collect())
            break
        assert made.columns == columns and {r.doc_id for r in made.collect()} == want
        assert made.exceptAll(docs).count() == 0
        docs = made
    assert 0 < made.count() < 200
    assert sorted(r.ids_sha256 for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r.ids_sha256 for r in made.collect())


def test_near_duplicates_by_brute_force(spark, documents):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for group in range(12):
        text = rng.choices(words, k=200)
        rows.append((100 * group, " ".join(text)))
        # 5-word similarity 0.815 and 4-word similarity 0.816 with 20 words, under 0.8 with 30
        rows += [(100 * group + n, " ".join(text[:-n] + rng.choices(words, k=n))) for n in (2, 20, 30)[: 1 + group % 3]]
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t in rows}
    first = {d: d for d in sets}
    for _ in sets:  # smallest id of the component
        for a in sets:
            for b in sets:
                if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                    first[a] = first[b] = min(first[a], first[b])
    docs = documents(rows)
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    assert sorted(r.doc_id for r in stage(spark, docs, SF).collect()) == sorted(set(first.values()))
    assert len(set(first.values())) < jaccard.keep_first(docs).count()


def test_no_language_to_learn(spark):
    docs = spark.createDataFrame([(1, "a clean text", None), (2, "", None), (3, "12 - 3", None), (4, None, None), (5, "é", None), (6, None, "en")],
                                 "doc_id bigint, text string, lang string")
    assert sorted(r.doc_id for r in corpus_pipeline.known_language(spark, docs, SF).collect()) == [1, 5]


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, SF))
    assert docs.count() == 0


def test_registered():
    assert {int(name[2:].split("_")[0]) for name in QUERIES} == set(range(1, 14)) and set(ORACLES) <= set(QUERIES)
