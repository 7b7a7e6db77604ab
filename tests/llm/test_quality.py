"""Held-out accuracy, gradients against differences, and edge cases of the quality classifier."""

import numpy as np

from factfold.llm.queries import QUERIES
from factfold.llm.quality import BUCKETS, Model, encode, fit, keep_good, score_documents, train

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    scored = QUERIES["op2_quality"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert scored.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = scored.filter("held_out").join(labels, "doc_id").select("predicted", "quality").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_gradients():
    random = np.random.default_rng(0)
    x, bags, target = random.random((7, BUCKETS)), np.array([3, 1, 3]), np.array([1.0, 0.0, 1.0])
    net = fit(x.astype(np.float32), bags, target, epochs=1)
    net.weights = {k: v.astype(float) for k, v in net.weights.items()}

    def loss():
        p = net.forward(x, bags)["p"]
        return -np.mean(target * np.log(p) + (1 - target) * np.log(1 - p))

    for name, gradient in net.gradients(x, bags, target).items():
        weight = net.weights[name]
        at = np.unravel_index(np.abs(gradient).argmax(), weight.shape)
        kept, h = weight[at], 1e-6
        weight[at] = kept + h
        up = loss()
        weight[at] = kept - h
        assert abs((up - loss()) / (2 * h) - gradient[at]) < 1e-5
        weight[at] = kept


def test_every_word_counts():
    x, bags = encode(["a b c", "", "w " * 1000])
    assert bags.tolist() == [1, 1, 21] and len(x) == 23
    assert np.isfinite(x).all()
    assert encode(["w " * 1000], most=4)[1].tolist() == [4]


def test_fitted_on_all_passages(spark, documents, monkeypatch):
    texts = {i: " ".join(f"w{i}x{n}" for n in range(size)) for i, size in enumerate([3000, 48, 0, 20_000, 900])}
    seen = {}

    def record(x, bags, target, starts):
        seen.update(bags=bags.tolist(), x=[x[np.arange(s, s + b)] for s, b in zip(starts, bags, strict=True)])

    monkeypatch.setattr("factfold.llm.quality.fit", record)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in texts], "doc_id bigint, quality int, toxic int")
    train(documents(texts.items()), labels)
    assert seen["bags"] == [63, 1, 1, 417, 19]
    for i, text in texts.items():
        assert np.allclose(seen["x"][i], encode([text])[0], atol=1 / 4096)


def test_edge_cases(spark, documents):
    docs = documents([(1, "good text here"), (2, None), (3, ""), (4, "x" * 50_000), (None, "no id"), (1, "good text here")])
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (9, 0, 0)], "doc_id bigint, quality int, toxic int")
    model = train(docs, labels)
    assert model.network is None and {r.score for r in score_documents(docs, model).collect()} == {model.share}
    assert keep_good(docs, model).columns == docs.columns
    assert train(docs.limit(0), labels.limit(0)) == Model(None, 0.5)
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (1, 0, 0), (3, 0, 0)], "doc_id bigint, quality int, toxic int")
    scores = {(r.doc_id, r.score) for r in score_documents(docs, train(docs, labels)).collect()}
    assert len([s for d, s in scores if d == 1]) == 1 and all(0 <= s <= 1 for _, s in scores)
    assert score_documents(docs.limit(0), model).count() == 0
