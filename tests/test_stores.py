import json

import pytest
from pyspark.sql import functions as F

from factfold import schemas
from factfold.functions.ids import fact_point_id
from factfold.operators import stamps
from factfold.operators.fold import KEY
from factfold.plans import pipelines
from factfold.session import scratch_folder
from factfold.sources import files
from factfold.sources.tables import Store, conform
from factfold.streaming import feeds


def test_jsonl(spark, tmp_path):
    path = tmp_path / "f.jsonl"
    path.write_text('{"scenario_id": "a", "shape": "contested"}\n\n{"scenario_id": "b"}\n')
    assert files.read_jsonl(spark, str(path), schemas.CONFLICT_FIXTURE).count() == 2
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_jsonl(spark, str(tmp_path / "none.jsonl"), schemas.CONFLICT_FIXTURE)


def test_gas_file(spark, tmp_path):
    (tmp_path / "gas.txt").write_text("Time (seconds), Methane, Ethylene\n0.00  0.0 60.0 1 2\n0.01 x 2\n1 2\n0.02\t300 0 5\n")
    assert [(r.time_s, r.methane_ppm, r.ethylene_ppm) for r in files.read_gas(spark, str(tmp_path / "gas.txt")).orderBy("time_s").collect()] == [
        (0.0, 0.0, 60.0), (0.02, 300.0, 0.0)]


def test_messages_pick_the_preferred_column(spark, tmp_path):
    spark.createDataFrame([(1, "raw", "said"), (2, "raw", None)], "id long, text string, message string").write.parquet(str(tmp_path / "m"))
    assert [r.text for r in files.read_messages(spark, str(tmp_path / "m")).collect()] == ["said"]
    assert files.message_column(["a", "b"]) == "a"


def test_images_and_scenarios(spark, tmp_path):
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "one.jpg").write_bytes(b"pixels")
    rows = [{"image_id": f"i{n}", "file": f"img/{f}", "zone": "z", "device_id": "cam", "corroboration_key": "k", "caption": c,
             "client_timestamp_ns": n} for n, f, c in [(1, "one.jpg", "smoke pooling"), (2, "two.jpg", "calm")]]
    (tmp_path / "m.jsonl").write_text("\n".join(map(json.dumps, rows)))
    got = pipelines.image_captures(files.read_image_manifest(spark, str(tmp_path / "m.jsonl"), str(tmp_path / "img")))
    assert {r.image_id: (r.label, r.content is not None) for r in got.collect()} == {"i1": ("smoke", True), "i2": ("none", False)}
    stored = pipelines.capture_pipeline(got.withColumn("status", F.lit("new")))
    assert stored.facts.count() == 2

    scenario = {"scenario_id": "s", "corroboration_key": "k", "zone": "z", "ground_truth": "fire", "reports": [
        {"device_id": "a", "value": "fire", "device_ts": "2026-09-30T10:01:40Z"}, {"device_id": "b", "value": "fire", "device_ts": "10:010:40"}]}
    (tmp_path / "s.jsonl").write_text(json.dumps(scenario))
    read = files.read_jsonl(spark, str(tmp_path / "s.jsonl"), schemas.TEXT_SCENARIOS)
    events = files.scenario_events(read).orderBy("seq").collect()
    assert [e.device_ts is None for e in events] == [False, True]
    assert pipelines.score_scenarios(read).first().match


def test_snapshot_round_trip(spark, tmp_path):
    store = Store(spark, str(tmp_path / "hub"))
    facts = conform(spark.createDataFrame([(1, "a", 0), (2, "b", 1)], "point_id int, value string, tombstoned int"), schemas.FACTS)
    own = stamps.compute_stamp(spark, "text", "hash")
    assert store.export_snapshot(facts.limit(0), own, "v0") is None
    path = store.export_snapshot(facts, own, "v1")
    local = facts.limit(0).select("point_id", "shard", F.lit(1).alias("synced"), "client_timestamp_ns")
    pulled = store.import_snapshot(path, local, own, 0)
    assert [(int(r.point_id), r.shard) for r in pulled.collect()] == [(1, "immutable")]
    with pytest.raises(ValueError):
        store.import_snapshot(path, local, stamps.compute_stamp(spark, "text", "hash", salt="x"), 0)


def stream_of(spark, df, name):
    source = scratch_folder(spark, name)
    df.write.parquet(source)
    return spark.readStream.schema(df.schema).parquet(source)


def drain(spark, df, step, name):
    feeds.run(stream_of(spark, df, name), step, scratch_folder(spark, name + "-cp")).awaitTermination()


def reports(spark, rows):
    df = spark.createDataFrame(rows, "device_id string, corroboration_key string, value string, client_sequence long, received_at_ns long, vec array<float>")
    return df.withColumn("point_id", fact_point_id(F.col(KEY), F.col("value")))


def test_ingest_retract_resolve(spark):
    store = Store(spark, scratch_folder(spark, "hub"), buckets=4)
    first = reports(spark, [("a", "k", "open wide", 1, 10, [1.0, 0.0]), ("b", "k", "wide open", 1, 11, [0.99, 0.01]), ("c", "k", "shut", 1, 12, [0.0, 1.0]),
                            ("a", "j", "solo", 2, 13, [1.0, 0.0])])
    step = feeds.ingest_step(store, cluster=True)
    drain(spark, first, step, "one")
    drain(spark, first, step, "again")
    assert store.events().count() == 4 and store.facts().count() == 4
    drain(spark, reports(spark, [("d", "k", "open, wide", 1, 20, [1.0, 0.02])]), step, "two")
    clusters = {r.device_id: r.value_cluster for r in store.events_for_key("k").collect()}
    assert clusters["a"] == clusters["b"] == clusters["d"] != clusters["c"]
    assert sorted(r.seq for r in store.events().collect()) == [1, 2, 3, 4, 5]
    now = {r[KEY]: r for r in feeds.latest_verdicts(store).collect()}
    assert now["k"].status == "CONFIRMED" and now["k"].value == "open wide" and now["j"].status == "LWW"

    request = reports(spark, [("a", "j", "solo", 3, 0, None)]).select("device_id", "point_id", "client_sequence", F.lit(None).cast("string").alias(KEY))
    unknown = request.withColumn("device_id", F.lit("stranger"))
    drain(spark, request.unionByName(unknown), feeds.retraction_step(store), "gone")
    assert {r[KEY]: r.status for r in feeds.latest_verdicts(store).collect()}["j"] == "ABSENT"
    assert store.read("rejects", "device_id string").count() == 1
    assert feeds.current_facts(store).filter("tombstoned = 1").count() == 1

    decision = spark.createDataFrame([("r1", "k", "shut", "chief", 99)], "request_id string, corroboration_key string, value string, resolver_id string, received_at_ns long")
    drain(spark, decision, feeds.resolution_step(store), "rule")
    drain(spark, decision, feeds.resolution_step(store), "rule-again")
    now = {r[KEY]: r for r in feeds.latest_verdicts(store).collect()}
    assert (now["k"].status, now["k"].value) == ("RESOLVED", "shut")
    lost = feeds.current_facts(store).filter("superseded = 1")
    assert {r.value for r in lost.collect()} == {"open wide", "wide open", "open, wide"}
    assert store.events().filter("event_type = 'RESOLVED'").count() == 1


def test_decision_feed(spark):
    store = Store(spark, scratch_folder(spark, "feed"))
    schema = ("capture_id string, point_id decimal(20,0), device_id string, slot string, vec array<float>, value string, client_sequence long, "
              "status string, client_timestamp_ns long, reporter_device_id string")
    from decimal import Decimal
    one = spark.createDataFrame([("c1", Decimal(1), "d", "text", [1.0, 0.0], "calm", 1, "new", 1, "d")], schema)
    two = spark.createDataFrame([("c2", Decimal(2), "d", "text", [1.0, 0.001], "calm", 2, "new", 2, "d")], schema)
    for name, df in (("a", one), ("b", two), ("b2", two)):
        drain(spark, df, feeds.decision_step(store), name)
    got = {r.capture_id: r.verdict for r in store.read("decision_feed", "capture_id string, verdict string").collect()}
    assert got == {"c1": "QUEUE_LOW", "c2": "REJECT"} and store.read("decision_feed", "capture_id string").count() == 2


def test_bounded_dedupe(spark):
    df = reports(spark, [("a", "k", "x", 1, 10, None)] * 3).withColumn("received_at", F.timestamp_seconds("received_at_ns"))
    query = feeds.dedupe_within(stream_of(spark, df, "dup"), "1 hour").writeStream.format("memory").queryName("dup").trigger(
        availableNow=True).option("checkpointLocation", scratch_folder(spark, "dup-cp")).start()
    query.awaitTermination()
    assert spark.table("dup").count() == 1


def test_streamed_cursor_and_latest_equal_batch(spark):
    from factfold.operators.fold import latest_by_device
    from factfold.operators.ingest import delta_cursor
    from factfold.plans.views import table

    log = table(spark, "/root/testdata/sf0.001", "fact_events")
    for name, op, keys in (("cursor", delta_cursor, ["device_id"]), ("latest", latest_by_device, [KEY, "device_id"])):
        query = op(stream_of(spark, log, name)).writeStream.format("memory").outputMode("complete").queryName(name).trigger(
            availableNow=True).option("checkpointLocation", scratch_folder(spark, name + "-cp")).start()
        query.awaitTermination()
        assert spark.table(name).orderBy(*keys).collect() == op(log).orderBy(*keys).collect()


class Crash(Exception):
    pass


def crash_in_turn(step, store, batch, batch_id=1):
    """Run a step as often as it has writes, failing one write after the other, then to its end."""
    plain = store.append
    for failing in range(20):
        count = iter(range(100))

        def append(*args, **kwargs):
            if next(count) == failing:
                raise Crash
            return plain(*args, **kwargs)

        store.append = append
        try:
            step(batch, batch_id)
            return failing
        except Crash:
            continue
        finally:
            store.append = plain
    raise AssertionError("no end")


def test_every_step_survives_a_crash_at_every_write(spark):
    from decimal import Decimal

    store = Store(spark, scratch_folder(spark, "crash"), buckets=2)
    first = reports(spark, [("a", "k", "open", 1, 10, [1.0, 0.0]), ("b", "k", "shut", 1, 11, [0.0, 1.0]), ("a", "j", "solo", 2, 12, [1.0, 0.0])])
    assert crash_in_turn(feeds.ingest_step(store), store, first) > 1
    assert store.events().count() == 3 and store.facts().count() == 3 and feeds.latest_verdicts(store).count() == 2
    gone = first.filter("value = 'solo'").select("device_id", "point_id", (F.col("client_sequence") + 5).alias("client_sequence"), F.lit(None).cast("string").alias(KEY))
    unknown = gone.withColumn("device_id", F.lit("stranger"))
    assert crash_in_turn(feeds.retraction_step(store), store, gone.unionByName(unknown), 2) > 1
    assert store.events().filter("event_type = 'RETRACTED'").count() == 1
    assert store.read("rejects", feeds.REJECTS).count() == 1 and store.read("tombstones", feeds.POINTS).count() == 1
    decision = spark.createDataFrame([("r1", "k", "shut", "chief", 99)], "request_id string, corroboration_key string, value string, resolver_id string, received_at_ns long")
    assert crash_in_turn(feeds.resolution_step(store), store, decision, 3) > 1
    assert store.events().filter("event_type = 'RESOLVED'").count() == 1 and store.read("superseded", feeds.POINTS).count() == 1
    assert {r[KEY]: r.status for r in feeds.latest_verdicts(store).collect()} == {"k": "RESOLVED", "j": "ABSENT"}
    schema = ("capture_id string, point_id decimal(20,0), device_id string, slot string, vec array<float>, value string, client_sequence long, "
              "status string, client_timestamp_ns long, reporter_device_id string")
    one = spark.createDataFrame([("c1", Decimal(1), "d", "text", [1.0, 0.0], "calm", 1, "new", 1, "d")], schema)
    assert crash_in_turn(feeds.decision_step(store), store, one, 4) > 1
    assert store.read("decision_feed", "capture_id string").count() == 1 and store.read("captures", "capture_id string").count() == 1


def test_conflict_register(spark):
    from factfold.sources.tables import CONFLICTS

    store = Store(spark, scratch_folder(spark, "register"))
    assert store.conflicts().count() == 0
    rows = spark.createDataFrame([("1", "dev-1"), ("2", "dev-2")], "capture_id string, device_id string")
    store.register_conflicts(rows)
    assert [r.capture_id for r in store.conflicts("dev-1").collect()] == ["1"]
    store.clear_conflicts("dev-1")
    assert [r.device_id for r in store.conflicts().collect()] == ["dev-2"] and "score" in CONFLICTS
    store.register_conflicts(rows.limit(1))
    assert store.conflicts("dev-1").count() == 1


def test_point_lookup_reaches_the_scan(spark, tmp_path):
    from factfold.operators.sync import local_events, lookup_fact

    spark.createDataFrame([(n,) for n in (12, 120, 1234567890123, 12345678901239, 7)], "point_id long").selectExpr(
        "cast(point_id as decimal(20,0)) as point_id", "1 as seq").write.parquet(str(tmp_path / "facts"))
    facts = spark.read.parquet(str(tmp_path / "facts"))
    assert [int(r.point_id) for r in lookup_fact(facts, "12").collect()] == [12]
    assert sorted(int(r.point_id) for r in lookup_fact(facts, "123456789012999").collect()) == [1234567890123, 12345678901239]
    assert lookup_fact(facts, "x1").count() == 0
    plan = local_events(facts, "120")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(point_id), EqualTo(point_id,120)]" in plan


def test_the_resolutions_query_decides_every_report(spark):
    from factfold.plans.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    want = {f"r{r.o_orderkey}" for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey").collect()}
    assert {r.request_id for r in QUERIES["stream_resolutions"](spark, sf).collect()} == want


def test_the_lookup_query_does_not_work_out_ids_again(spark):
    from factfold.plans.registry import QUERIES

    found = QUERIES["lookup_fact"](spark, "/root/testdata/sf0.001")
    assert found.count() > 0 and "md5" not in found._jdf.queryExecution().toString()
