"""Dedupe for ever: nothing twice, few files opened, few files kept, replays change nothing."""

from pyspark.sql import functions as F

from factfold.sources.id_index import IdIndex, dedupe_step
from factfold.sources.tables import Store


def ids(spark, low, high):
    return spark.range(low, high).select(F.concat(F.lit("r"), "id").alias("id"), F.col("id").alias("payload"))


def test_batches_replays_and_merges(spark, tmp_path):
    store = Store(spark, str(tmp_path / "hub"))
    index = IdIndex(store, buckets=4, merge_at=3)
    step = dedupe_step(index, "records")
    for batch, (low, high) in enumerate([(0, 40), (30, 60), (60, 90), (0, 20), (85, 100), (100, 120), (5, 130)]):
        step(ids(spark, low, high), batch)
        if batch in (1, 4):
            step(ids(spark, low, high), batch)  # replayed after its last write
    got = spark.read.parquet(store.path("records"))
    assert got.count() == got.select("id").distinct().count() == 130
    assert len(index.generations()) <= 2 * 3
    assert index.unknown(ids(spark, 0, 130)).count() == 0


def test_only_files_that_may_hold_an_id_are_opened(spark, tmp_path):
    index = IdIndex(Store(spark, str(tmp_path / "hub")), buckets=4, merge_at=100)
    for batch in range(6):
        index.add(ids(spark, 1000 * batch, 1000 * batch + 1000), batch)
    assert index.unknown(ids(spark, 2500, 2501)).count() == 0
    assert {g for g, _ in index.opened} == {"b2"} and len(index.opened) == 1
    assert index.unknown(ids(spark, 90_000, 90_001)).count() == 1
    assert len(index.opened) <= 1  # a false hit is possible and harmless
    assert len(index.generations()) == 6


def test_null_and_repeated_ids(spark, tmp_path):
    store = Store(spark, str(tmp_path / "hub"))
    rows = spark.createDataFrame([("a", 1), (None, 2), ("a", 3), ("b", 4)], "id string, payload bigint")
    dedupe_step(IdIndex(store), "records")(rows, 0)
    assert sorted(r.id for r in spark.read.parquet(store.path("records")).collect()) == ["a", "b"]
    dedupe_step(IdIndex(store), "records")(rows.limit(0), 1)
    assert spark.read.parquet(store.path("records")).count() == 2
