import random

import pytest
from pyspark.sql import functions as F

from factfold.operators import evidence, ingest, monitor, ranking, stamps, sync
from factfold.params import GateParams, RetentionParams

QUEUE = "device_id string, id string, bytes long, value double, age_s double, urgent boolean, client_sequence long"


def chosen(spark, rows, budget, **kw):
    df = spark.createDataFrame(rows, QUEUE)
    return {(r.device_id, r.id) for r in sync.select_batch(df, GateParams(budget, **kw), salts=4).filter("selected").collect()}


def test_batch_hand_cases(spark):
    four = [("d", "A", 100, 0.1, 0.0, True, 9), ("d", "B", 100, 0.9, 0.0, False, 2), ("d", "C", 100, 0.9, 0.0, False, 1),
            ("d", "D", 100, 0.5, 0.0, False, 3)]
    assert chosen(spark, four, 250) == {("d", "A"), ("d", "C")}
    big = [("d", "big", 5000, 0.1, 0.0, True, 1), ("d", "small", 100, 0.9, 0.0, False, 2)]
    assert chosen(spark, big, 250) == {("d", "big")}
    dense = [("d", "big", 1000, 1.0, 0.0, False, 1), ("d", "small", 10, 0.5, 0.0, False, 2)]
    assert chosen(spark, dense, 1000) == {("d", "small")}
    assert len(chosen(spark, four, 0)) == 4 and len(chosen(spark, four, None)) == 4


@pytest.mark.parametrize("seed", range(3))
def test_batch_equals_the_walk(spark, seed):
    rnd = random.Random(seed)
    rows = [(f"d{rnd.choice([0, 0, 0, 1, 2])}", f"r{i:03}", rnd.choice([5, 20, 20, 60, 150, 300, 1200][:6 + seed % 2]),
             rnd.choice([0.2, 0.5, 0.9]), float(rnd.randint(0, 50)), rnd.random() < 0.2, rnd.randint(0, 30)) for i in range(300)]
    want = set()
    for dev in ("d0", "d1", "d2"):
        used = 0
        mine = [r for r in rows if r[0] == dev]
        mine.sort(key=lambda r: (not r[5], -(r[3] * (1 + 0.01 * r[4]) / max(1, r[2])), r[6], r[1]))
        for r in mine:
            if r[2] > 1000 or used + r[2] <= 1000:
                want.add((dev, r[1]))
                used += r[2]
    assert chosen(spark, rows, 1000) == want


def test_outbox_limit_comes_before_priority(spark):
    df = spark.createDataFrame([("d", i, i, "URGENT" if i == 3 else "ROUTINE", 0, 1) for i in range(4)],
                               "device_id string, point_id long, client_sequence long, sync_priority string, synced int, syncable int")
    assert {r.point_id for r in sync.outbox(df, 3).collect()} == {0, 1, 2}
    assert sync.outbox(df, 4).orderBy("push_rank").first().point_id == 3


def test_ranks_survive_one_hot_group_and_one_hot_value(spark):
    rows = [("hot" if i % 3 else f"g{i % 5}", 7 if i % 2 else i, f"t{i:04}", i % 11) for i in range(600)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, o long, t string, n long")
    got = {r.t: (r.rn, r.before) for r in ranking.distributed_running_sum(
        ranking.distributed_rank(df, ["g"], ["o", "t"]), ["g"], ["o", "t"], "n", "before").collect()}
    for g in {r[0] for r in rows}:
        total = 0
        for pos, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])), 1):
            assert got[r[2]] == (pos, total)
            total += r[3]
    everything = ranking.distributed_rank(df, [], ["o", "t"]).collect()
    assert [r.t for r in sorted(everything, key=lambda r: r.rn)] == [r[2] for r in sorted(rows, key=lambda r: (r[1], r[2]))]


def test_eviction_never_touches_waiting_rows(spark):
    df = spark.createDataFrame([("d", i, i, int(i % 2), 1) for i in range(10)],
                               "device_id string, point_id long, client_sequence long, synced int, syncable int")
    assert {r.point_id for r in sync.eviction_plan(df, RetentionParams(max_points=7)).collect()} == {1, 3, 5}
    assert {r.point_id for r in sync.eviction_plan(df, RetentionParams(max_points=2)).collect()} == {1, 3, 5, 7, 9}
    assert sync.eviction_plan(df, RetentionParams(max_points=10)).count() == 0


def test_nothing_is_synced_without_an_ack(spark):
    df = spark.createDataFrame([(1, 0), (2, 0)], "point_id long, synced int")
    assert sync.apply_acks(df, None).filter("synced = 1").count() == 0
    acked = sync.apply_acks(df, spark.createDataFrame([(2,), (9,)], "point_id long"))
    assert {r.point_id for r in acked.filter("synced = 1").collect()} == {2}


def test_lookup_falls_back_to_the_prefix(spark):
    df = spark.createDataFrame([("123456789012345",), ("123456789012999",), ("5",)], "point_id string")
    assert [r.point_id for r in sync.lookup_fact(df, "123456789012345").collect()] == ["123456789012345"]
    assert sync.lookup_fact(df, "123456789012777").count() == 2
    assert sync.lookup_fact(df, "5").count() == 1


def test_ingest_is_idempotent(spark):
    schema = "point_id decimal(20,0), device_id string, client_sequence long, received_at_ns long, corroboration_key string, value string"
    rows = [(1, "a", 1, 10, "k", "x"), (1, "b", 1, 11, "k", "x"), (1, "a", 1, 12, "k", "x"), (2, "a", 2, 5, "k", "y")]
    batch = spark.createDataFrame([(__import__("decimal").Decimal(r[0]), *r[1:]) for r in rows], schema)
    none = batch.limit(0).withColumn("event_id", F.lit("")).withColumn("seq", F.lit(0).cast("long"))
    first = ingest.ingest_batch(batch, batch.limit(0), none)
    assert first.facts.count() == 2 and first.events.count() == 3 and first.acks.count() == 2
    assert [(int(r.point_id), r.device_id, r.seq) for r in first.events.orderBy("seq").collect()] == [(2, "a", 1), (1, "a", 2), (1, "b", 3)]
    again = ingest.ingest_batch(batch, first.facts, first.events)
    assert again.facts.count() == 0 and again.events.count() == 0 and again.acks.count() == 2


@pytest.mark.parametrize("bucket_s", [1.0, 3.0, 1000.0])
def test_counter_rate_equals_the_walk(spark, bucket_s):
    rnd = random.Random(7)
    rows = []
    for dev in ("a", "b"):
        t, usage = 100.0, 0.0
        for i in range(150):
            t += rnd.choice([0.0, 0.05, 0.1, 0.2, 0.3, 1.7])
            usage = 0.0 if i == 80 else usage + rnd.random() * 1e5
            rows.append((dev, i, round(t, 3), usage))
    got = {(r.device_id, r.id): (r.pct, r.fresh) for r in monitor.counter_rate(
        spark.createDataFrame(rows, "device_id string, id long, t double, usage_usec double"), 2.0, 0.25, bucket_s).collect()}
    for dev in ("a", "b"):
        base = None
        for _, i, t, usage in sorted((r for r in rows if r[0] == dev), key=lambda r: (r[2], r[1])):
            fresh = base is None or not 0 < t - base[0] < 0.25
            if fresh:
                pct = 0.0
                if base is not None and t > base[0] and usage >= base[1]:
                    pct = (usage - base[1]) / 1e6 / (t - base[0]) / 2.0 * 100
                base = (t, usage, pct)
            assert got[dev, i] == (pytest.approx(base[2]), fresh)


def test_counter_rate_calls_no_function_per_bucket(spark):
    rows = spark.createDataFrame([("a", 1, 0.0, 1.0), (None, 2, 0.0, 1.0), ("b", 3, None, 1.0)], "device_id string, id long, t double, usage_usec double")
    rates = monitor.counter_rate(rows)
    assert "FlatMapGroups" not in rates._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in rates.collect()] == [("a", 1, 0.0, 0.0, True)]


def test_tampering_shows(spark):
    schema = "corroboration_key string, device_id string, value string, event_type string, seq long, device_trust_at_report double"
    rows = [("k", "a", "x", "OBSERVED", 1, 0.8), ("k", "b", "x", "OBSERVED", 5000, 0.8), ("k", "c", "y", "OBSERVED", 20_000_000, 0.3),
            ("j", "a", "z", "OBSERVED", 4, 0.8)]
    log = spark.createDataFrame(rows, schema)
    packets = evidence.keep(evidence.evidence_packets(log, secret="s"), "p")

    def checks(p, events, secret="s"):
        r = evidence.verify_packets(p, events, secret=secret).filter("corroboration_key = 'k'").first()
        return {c for c in evidence.CHECKS if not r[c.lower()]}

    assert checks(packets, log) == set()
    assert checks(packets.withColumn("value", F.lit("y")), log) == {"SEAL", "FOLD"}
    assert checks(packets, log, secret="other") == {"SIGN"}
    edited = spark.createDataFrame([rows[0], rows[1], ("k", "c", "y", "OBSERVED", 20_000_000, 0.4), rows[3]], schema)
    assert checks(packets, edited) == {"SEAL"}
    assert "FOLD" in checks(packets, spark.createDataFrame([*rows[1:]], schema))
    assert checks(packets.withColumn("fold_code_sha256", F.lit("0")), log) == {"SEAL", "MODULE"}
    assert checks(packets.withColumn("trust_digest", F.lit("0")), log) == {"SEAL", "TRUST"}


def test_model_space_guard(spark):
    a = stamps.compute_stamp(spark, "text", "hash")
    assert stamps.stamp_problems(a, stamps.compute_stamp(spark, "text", "hash")).count() == 0
    other = stamps.compute_stamp(spark, "text", "hash", salt="v2")
    assert stamps.stamp_problems(a, other).first().problem == "space differs"
    with pytest.raises(ValueError, match="incompatible"):
        stamps.merge_stamps(a, other)
    assert stamps.merge_stamps(a, other, rebuild=True).first().space_id == other.first().space_id
    assert stamps.merge_stamps(a, stamps.compute_stamp(spark, "image", "hash")).count() == 2


def test_checked_events_are_joined_to_their_packets_once(spark, monkeypatch):
    from factfold.plans.consensus_queries import _tampered
    from factfold.plans.views import table

    log = table(spark, "/root/testdata/sf0.001", "decided_events")
    packets, left = _tampered(evidence.evidence_packets(log, secret="s"), log)
    read, plain = [], evidence._unsealed
    monkeypatch.setattr(evidence, "_unsealed", lambda events, *a: read.append(events) or plain(events, *a))
    evidence.verify_packets(packets, left)
    assert len(read) == 2 and not any("Join" in e._jdf.queryExecution().optimizedPlan().toString() for e in read)


def test_only_unseen_keys_are_compared_by_row(spark, monkeypatch):
    rows = spark.createDataFrame([("a", 5, "late"), ("a", 3, "early"), ("b", 1, "known"), ("c", 2, "one"), ("d", 4, "y"), ("d", 4, "x"), ("d", None, "untimed"),
                                  (None, 7, "null")], "id string, received_at_ns long, value string")
    held = spark.createDataFrame([("b",), (None,)], "id string")
    compared, plain = [], ingest._first_of
    monkeypatch.setattr(ingest, "_first_of", lambda part, key: compared.append(part.count()) or plain(part, key))
    got = {r.id: r.value for r in ingest.first_unseen(rows, held, "id").collect()}
    assert got == {"a": "early", "c": "one", "d": "untimed", None: "null"} and compared == [5]
    assert ingest.first_unseen(rows.filter("id = 'b'"), held, "id").count() == 0 and compared == [5]


def test_ranks_of_all_rows_need_no_window(spark):
    ranked = ranking.distributed_rank(spark.range(100).selectExpr("id", "id % 7 as o"), [], ["o", "id"])
    assert [r.rn for r in ranked.orderBy("o", "id").collect()] == list(range(1, 101))
    assert "Window" not in ranked._jdf.queryExecution().optimizedPlan().toString()


def test_a_retry_folds_nothing(spark, monkeypatch):
    from factfold.functions.ids import fact_point_id
    from factfold.session import scratch_folder
    from factfold.sources.tables import Store
    from factfold.streaming import feeds

    store, folds, plain = Store(spark, scratch_folder(spark, "retry"), buckets=2), [], feeds.refold
    monkeypatch.setattr(feeds, "refold", lambda *args: folds.append(1) or plain(*args))
    rows = spark.createDataFrame([("a", "k", "open", 1, 10), ("b", "k", "shut", 1, 11)],
                                 "device_id string, corroboration_key string, value string, client_sequence long, received_at_ns long")
    batch, step = rows.withColumn("point_id", fact_point_id(F.col("corroboration_key"), F.col("value"))), feeds.ingest_step(store)
    step(batch, 1)
    step(batch, 2)
    assert len(folds) == 1 and store.events().count() == 2 and feeds.latest_verdicts(store).count() == 1
