import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factfold.operators import capture, clustering, retrieval
from factfold.operators.knn import nearest
from factfold.params import KnnParams, PolicyParams, RetrievalParams

N = 240


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(6, 16))
    x = np.concatenate([c + 0.4 * rng.normal(size=(N // 6, 16)) for c in centres]).astype("float32")
    x[7] = x[90]  # an exact tie
    unit = x.astype("float64") / np.linalg.norm(x.astype("float64"), axis=1, keepdims=True)
    rows = [(i, "b" if i % 3 else "a", [float(v) for v in x[i]], (i * 37) % N) for i in range(N)]
    return rows, np.round(unit @ unit.T, 6)


@pytest.mark.parametrize("k, by, earlier, floor, params", [
    (3, ["g"], True, -1.0, KnnParams()), (3, ["g"], True, -1.0, KnnParams(20, 8, 0)), (5, [], False, -1.0, KnnParams()),
    (5, [], False, -1.0, KnnParams(40, 8, 0)), (5, ["g"], False, 0.75, KnnParams(40, 8, 0)), (1, [], True, -1.0, KnnParams(30, 6, 0))])
def test_nearest_equals_brute_force(spark, cloud, k, by, earlier, floor, params):
    rows, s = cloud
    df = spark.createDataFrame(rows, "id long, g string, v array<float>, pos long")
    q = df.select(F.col("id").alias("q_id"), "g", F.col("v").alias("q_vec"), F.col("pos").alias("q_pos"))
    d = df.select(F.col("id").alias("d_id"), "g", F.col("v").alias("d_vec"), F.col("pos").alias("d_pos"))
    got = {tuple(r) for r in nearest(q, d, k, by, earlier, floor, params).select("q_id", "d_id", "score", "rank").collect()}
    want = set()
    for i, gi, _, pi in rows:
        ok = sorted((-s[i, j], j) for j, gj, _, pj in rows
                    if (not by or gi == gj) and (not earlier or pj < pi) and s[i, j] >= floor)[:k]
        want |= {(i, j, -c, n + 1) for n, (c, j) in enumerate(ok)}
    assert got == want


def leader(rows, near):
    """The sequential rule, one report at a time."""
    founders, out = {}, {}
    for key, cid, value, vec, _ in sorted(rows, key=lambda r: r[4]):
        digits = sorted(float(x) for x in "".join(c if c.isdigit() else " " for c in value).split())
        for f_value, f_vec, f_digits in founders.setdefault(key, []):
            if digits != f_digits:
                continue
            if vec is None or f_vec is None:
                same = value == f_value
            else:
                a, b = np.array(vec), np.array(f_vec)
                same = round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 6) >= near
            if same:
                out[cid] = f_value
                break
        else:
            founders[key].append((value, vec, digits))
            out[cid] = value
    return out


@pytest.mark.parametrize("block", [2048, 7])
def test_clusters_equal_the_sequential_rule(spark, block):
    rnd = random.Random(4)
    base = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = []
    for i in range(150):
        vec = None if i % 17 == 0 else [x + rnd.gauss(0, 0.5) for x in base[i % 5]]
        value = f"gauge word{i % 40} {i % 2}"
        rows.append((f"k{i % 2 if i % 10 else 0}", i, value, vec, i))
    df = spark.createDataFrame(rows, "corroboration_key string, id long, value string, vec array<double>, seq long").repartition(5)
    got = {r.id: r.value_cluster for r in clustering.assign_value_cluster(df, block_rows=block).collect()}
    keys = {r[1]: r[0] for r in rows}
    want = {i: hashlib.md5(f"{keys[i]}\0{v}".encode()).hexdigest() for i, v in leader(rows, 0.86).items()}
    assert got == want


def scored(spark, **over):
    row = {"capture_id": 1, "value": "all calm", "neighbour_value": "all calm", "similarity": 0.5, "novelty": 0.5,
           "novelty_basis": "neighbour", "status": "new", "client_timestamp_ns": 1, "reporter_device_id": "d", **over}
    types = ("capture_id long, value string, neighbour_value string, similarity double, novelty double, novelty_basis string, "
             "status string, client_timestamp_ns long, reporter_device_id string")
    return spark.createDataFrame([tuple(row.values())], types)


@pytest.mark.parametrize("over, verdict, priority", [
    ({"similarity": 0.5}, "QUEUE_HIGH", "URGENT"), ({"similarity": 0.8}, "QUEUE_LOW", "ROUTINE"),
    ({"similarity": 0.8, "status": None}, "KEEP_LOCAL", "HELD"), ({"similarity": 0.5, "status": None}, "QUEUE_HIGH", "URGENT"),
    ({"similarity": 0.97}, "REJECT", "HELD"), ({"similarity": 0.97, "value": "not calm"}, "QUEUE_LOW", "ROUTINE"),
    ({"similarity": 0.99, "value": "not calm"}, "KEEP_LOCAL", "HELD"),
    ({"similarity": 0.8, "value": "GAS here", "neighbour_value": "GAS"}, "QUEUE_HIGH", "URGENT"),
    ({"similarity": 0.5, "value": "mail a@b.com", "neighbour_value": None}, "KEEP_LOCAL", "HELD"),
    ({"similarity": 0.97, "value": "mail a@b.com gas", "neighbour_value": None}, "REDACT_AND_QUEUE", "ROUTINE"),
    ({"similarity": 0.98, "value": "mail a@b.com gas", "neighbour_value": "mail"}, "REJECT", "HELD")])
def test_decisions(spark, over, verdict, priority):
    got = capture.decide(scored(spark, **over), PolicyParams()).first()
    assert (got.verdict, got.sync_priority, got.syncable) == (verdict, priority, int(priority != "HELD"))


def test_recaptured_point_gets_the_baseline(spark):
    rows = [(1, 10, "d", "text", [1.0, 0.0], "a", 1), (2, 11, "d", "text", [0.9, 0.1], "b", 2), (3, 10, "d", "text", [1.0, 0.0], "a", 3)]
    df = spark.createDataFrame(rows, "capture_id long, point_id long, device_id string, slot string, vec array<double>, value string, client_sequence long")
    got = {r.capture_id: (r.similarity, r.novelty_basis) for r in capture.novelty(df).collect()}
    assert got[1] == (0.75, "none") and got[3] == (0.75, "own copy") and got[2][1] == "neighbour"


@pytest.mark.parametrize("a, b, same", [("C", "C", True), ("C", "c ", True), ("C", "D", False), (None, "C", False), (None, None, False)])
def test_same_zone(spark, a, b, same):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(capture.same_zone(F.col("a"), F.col("b")).alias("x")).first().x is same


def test_lexical_paths_agree(spark):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(60)] + ["Été", "straße"]
    docs = spark.createDataFrame([(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 40)))) for i in range(200)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, " ".join(rnd.sample(words, 4)).upper()) for i in range(10)], "query_id long, text string")
    by_batch = retrieval.bm25_topk(asked, docs, 7).collect()
    by_join = retrieval.bm25_topk(asked, docs, 7, max_query_terms=1).collect()
    assert sorted(by_batch) == sorted(by_join) and len(by_batch) == 70


def test_fusion_prefers_agreement(spark):
    leg = "query_id long, doc_id long, score double, rank int"
    a = spark.createDataFrame([(1, 1, 9.0, 1), (1, 2, 8.0, 2)], leg)
    b = spark.createDataFrame([(1, 2, 5.0, 1), (1, 3, 4.0, 2)], leg)
    assert [r.doc_id for r in retrieval.rrf_fuse([a, b], RetrievalParams()).orderBy("rank").collect()] == [2, 1, 3]


@pytest.mark.parametrize("ordered", [True, False])
def test_large_blocks_equal_brute_force_with_tags_and_copies(spark, ordered):
    from factfold.operators import knn

    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 8))
    x[100:400] = x[7]  # one large group of exact ties
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(unit @ unit.T, 6)
    df = spark.createDataFrame([(i, (i * 7) % 1500, i % 3, x[i].tolist()) for i in range(1500)], "id long, pos long, tag long, v array<double>")
    side = lambda p: df.select(*[F.col(a).alias(f"{p}_{b}") for a, b in (("id", "id"), ("v", "vec"), ("pos", "pos"), ("tag", "tag"))])
    got = {(r.q_id, r.d_id, r.score) for r in nearest(side("q"), side("d"), 4, earlier_only=ordered, min_score=0.2,
                                                      params=KnnParams(64, 8, 0)).collect()}
    pos, tag, ids = (np.arange(1500) * 7) % 1500, np.arange(1500) % 3, np.arange(1500)
    want = set()
    for i in range(1500):
        ok = (tag != tag[i]) & (s[i] >= 0.2) & ((pos < pos[i]) if ordered else True)
        near = ids[ok][np.lexsort((ids[ok], -s[i][ok]))][:4]
        want |= {(i, int(j), s[i, j]) for j in near}
    assert got == want
    # However small a block may be, the copies of a row are few, until a block holds too many bytes.
    copies = spark.range(1).select(knn.fanout(F.lit(100_000), F.lit(64), 64), knn.fanout(F.lit(10_000_000), F.lit(64), 64)).first()
    assert copies[0] <= 8 and copies[1] == 77


def test_clusters_of_many_founders_take_few_rounds(spark, monkeypatch):
    kept = []
    plain = clustering.keep
    monkeypatch.setattr(clustering, "keep", lambda df, *a: kept.append(1) or plain(df, *a))
    rows = [("k", i, "same words", [float(j == i) for j in range(120)], i) for i in range(120)]
    df = spark.createDataFrame(rows, "corroboration_key string, id long, value string, vec array<double>, seq long")
    assert clustering.assign_value_cluster(df, block_rows=7).count() == 120
    assert len(kept) <= 1 + 2 * 5  # 7, 14, 28, 56 and 112 founders


def test_texts_are_counted_in_small_slices():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(["a b a"] * 1000)], names=["doc_id", "text"])
    got = list(retrieval._count_terms({"a": 0})([batch]))
    assert max(b.num_rows for b in got) <= 256 and sum(b.num_rows for b in got) == 1000
    assert got[0].column(2)[0].as_py() == [{"t": 0, "n": 2}] and set(got[3].column(1).to_pylist()) == {3}


def test_blocks_send_each_row_to_few_tasks(spark):
    from factfold.operators import knn

    counts = lambda *a: tuple(spark.range(1).select(*knn.block_counts(*map(F.lit, a[:4]), a[4])).first())
    assert counts(100_000, 100_000, 96, 3, 64) == (2, 2)
    docs, queries = counts(400_000, 100_000, 96, 12, 512)
    assert docs * queries == 12 and 400_000 * queries + 100_000 * docs <= 1_400_000  # six blocks on each side: 3,000,000
    assert counts(50, 50, 96, 12, 64) == (1, 1)
    assert counts(10_000_000, 1000, 64, 8, 64)[0] == 77  # no block beyond its bytes


def test_conflicts_are_asked_without_joins_of_vectors(spark, monkeypatch):
    rows = spark.createDataFrame([(1, 1, "d", "text", [1.0], "a", "z", "k", 1)],
                                 "capture_id long, point_id long, device_id string, slot string, vec array<double>, value string, zone string, "
                                 "corroboration_key string, client_sequence long")
    sides = []
    plain = capture.nearest
    monkeypatch.setattr(capture, "nearest", lambda q, d, *a, **k: sides.extend([q, d]) or plain(q, d, *a, **k))
    capture.possible_conflicts(rows, rows.withColumn("shard", F.lit("mutable")))
    assert [s._jdf.queryExecution().optimizedPlan().toString().count("Join") for s in sides] == [1, 0]


def test_stored_captures_are_decided_once(spark):
    from factfold.plans.pipelines import capture_pipeline
    from factfold.plans.views import table

    got = capture_pipeline(table(spark, "/root/testdata/sf0.001", "captures").drop("point_id"))
    assert "CoGroup" not in got.facts._jdf.queryExecution().optimizedPlan().toString()


def test_scores_of_the_join_are_cut_inside_the_tasks(spark):
    docs = spark.createDataFrame([(i, f"a b w{i % 7}") for i in range(400)], "doc_id long, text string")
    asked = spark.createDataFrame([(q, f"a w{q}") for q in range(5)] + [(9, "unseen"), (10, None)], "query_id long, text string")
    blocks = spark.sparkContext.defaultParallelism
    assert retrieval._bm25_by_join(retrieval.query_terms(asked), docs, 2, RetrievalParams()).count() <= 2 * 5 * blocks  # before: 2,000
    got = sorted(retrieval.bm25_topk(asked, docs, 2, max_query_terms=0).collect())
    assert got == sorted(retrieval.bm25_topk(asked, docs, 2).collect()) and len(got) == 10


def test_runs_of_texts_are_not_shuffled(spark, monkeypatch):
    from factfold.plans import retrieval_queries

    docs = spark.createDataFrame([(1, "x one two three y"), (2, "one two"), (3, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "one two three"), (2, "two")], "query_id long, text string")
    made, plain = {}, retrieval_queries.keep
    monkeypatch.setattr(retrieval_queries, "keep", lambda df, name="kept": made.update({name: df}) or plain(df, name))
    found = retrieval_queries.passages_in_documents(asked, docs)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1), (2, 1), (2, 2)]
    plan = made["pairs"]._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_texts_are_not_joined_again_for_passages(spark):
    from factfold.plans import retrieval_queries

    docs = spark.createDataFrame([(1, "so x One two ONE three y"), (2, "one two three"), (3, "x One two ONE thr")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "x One two ONE thr"), (2, "one two"), (3, "x one two ONE thr"), (4, "Two"), (5, None)], "query_id long, text string")
    found = retrieval_queries.passages_in_documents(asked, docs)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1), (1, 3), (2, 2)]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()  # before: the texts once more, in each of three uses


def test_texts_are_not_shuffled_when_ids_are_too_many_to_broadcast(spark, tmp_path, monkeypatch):
    from factfold.operators import evaluation
    from factfold.plans import retrieval_queries
    from factfold.plans.registry import QUERIES

    # Vectors 0, 1, 2, 4 and 7: documents of 3 (mod 5) have none.
    texts = {i: f"alpha w{i} beta gamma delta w{i % 3} omega" for i in range(40)}
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [1.0 + i, 2.0, 0.5 * i]) for i in (0, 1, 2, 4, 7)], "vec_id long, embedding array<float>").write.parquet(
        f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, f"alpha w{i} beta gamma delta") for i in (1, 2, 3, 5, 6)], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    made, plain = {}, retrieval_queries.keep
    for module in (retrieval_queries, retrieval, evaluation):
        monkeypatch.setattr(module, "keep", lambda df, name="kept": made.update({name: df}) or plain(df, name))
    run = lambda: sorted(map(tuple, QUERIES["score_recall"](spark, str(tmp_path)).collect()))
    want, old = run(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    assert [r[:2] for r in want] == [("all", 5), ("other", 4), ("third", 1)]  # 3 and its short form occur in document 3 alone
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert run() == want  # sent all the same, as they were counted
        monkeypatch.setattr(retrieval_queries, "_SENT_IDS", 0, raising=False)
        assert run() == want
        for name in ("pairs", "terms"):
            plan = made[name].select("*")._jdf.queryExecution().sparkPlan()
            joins = [n for n in _nodes(plan) if n.nodeName() == "SortMergeJoin"]
            assert joins and not any("text" in n.output().mkString(",") for n in joins)  # before: of the texts with the ids
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _nodes(node):
    yield node
    children = node.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def test_blocks_are_dealt_to_all_cores(spark):
    from factfold.operators import knn

    grid = lambda *a: tuple(spark.range(1).select(*knn.task_grid(*map(F.lit, a[:4]), a[4])).first())
    for docs, queries, tasks in ((2_461_536, 615_384, 12), (2_461_536, 615_384, 8), (410_256, 102_564, 12), (100_000, 100_000, 7)):
        runs, blocks = grid(docs, queries, 64, tasks, 512)
        waves = -(-runs * blocks // tasks)
        assert runs * blocks >= 0.9 * waves * tasks and queries * 64 * 8 / blocks <= 64 << 20
        assert docs * blocks + queries * runs <= 2.2 * (docs * queries * tasks) ** 0.5 + 6 * docs
    assert grid(50, 50, 64, 12, 64) == (1, 1) and grid(1000, 1, 64, 1, 64) == (1, 1)
    rows = spark.range(2000).select(F.col("id").alias("q_id"), F.array(F.rand(1), F.rand(2), F.rand(3)).alias("q_vec"), F.lit(0).alias("_all"))
    pairs = knn._multiply_blocks(rows, rows.select("_all", F.col("q_id").alias("d_id"), F.col("q_vec").alias("d_vec")), ["_all"], 3, False, -1.0,
                                 KnnParams(64, 8, 0))
    # Before, the pairs of blocks were hashed into as many partitions as shuffles have, here 4.
    assert pairs.select(F.spark_partition_id().alias("p")).distinct().count() == spark.sparkContext.defaultParallelism


def test_documents_pass_by_in_lots(spark, monkeypatch):
    import pyarrow as pa

    from factfold.operators import knn

    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 8))
    x[np.arange(0, 3000, 50)] = x[7]  # equal scores in every lot
    x[13] = 0.0
    ids = [f"d{i:04d}" for i in rng.permutation(3000)]
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    s = np.round(unit[:300] @ unit.T, 6)
    want = {(q, ids[d], s[q, d]) for q in range(300) for d in np.lexsort((ids, -s[q]))[:5]}
    scored = []
    plain = knn._Best.add
    monkeypatch.setattr(knn._Best, "add", lambda self, rows, *a: scored.append(len(rows)) or plain(self, rows, *a))
    q = pa.table({"q_id": list(range(300)), "q_vec": x[:300].tolist()})
    d = pa.table({"d_id": ids, "d_vec": x.tolist()})
    for lot in (3000, 700):
        scored.clear()
        search = knn._Search(q, 5, False, -1.0, 1)
        for at in range(0, 3000, lot):
            search.add(d.slice(at, lot))
        rows, docs, scores = search.found()
        assert set(zip(rows.to_pylist(), docs.to_pylist(), scores.tolist())) == want
        # A later lot is measured by what the earlier ones left; before, each had its own five best.
        assert sum(scored) < 300 * 60
    monkeypatch.setattr(knn, "_BLOCK_BYTES", 64 * 8 * 8)  # 64 documents at once
    frame = spark.createDataFrame([(i, x[i].tolist()) for i in range(300)], "id long, v array<double>")
    side = lambda p: frame.select(*[F.col(a).alias(f"{p}_{b}") for a, b in (("id", "id"), ("v", "vec"))])
    got = {(r.q_id, r.d_id, r.score) for r in nearest(side("q"), side("d"), 3, params=KnnParams(64, 8, 0)).collect()}
    assert got == {(i, int(j), s[i, j]) for i in range(300) for j in np.lexsort((np.arange(300), -s[i, :300]))[:3]}


def test_many_queries_hold_no_documents(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2100, 4))
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(2100)], "id long, v array<double>")
    got = retrieval.dense_topk(df.select(F.col("id").alias("query_id"), F.col("v").alias("vec")),
                               df.select(F.col("id").alias("doc_id"), F.col("v").alias("vec")), 3)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" not in plan and "FlatMapGroupsInArrow" in plan  # before, both sides of a pair of blocks were held whole
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(unit @ unit.T, 6)
    want = {(i, int(j)) for i in range(2100) for j in np.lexsort((np.arange(2100), -s[i]))[:3]}
    assert {(r.query_id, r.doc_id) for r in got.collect()} == want
