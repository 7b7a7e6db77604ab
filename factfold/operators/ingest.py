"""Idempotent ingest and the sequences it assigns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factfold.functions.ids import event_id
from factfold.operators.fold import OBSERVED
from factfold.operators.ranking import distributed_rank
from factfold.session import keep


@dataclass
class Ingested:
    """What one batch adds, and the ids it acknowledges."""

    facts: DataFrame
    events: DataFrame
    acks: DataFrame


def _first_of(batch: DataFrame, key: str) -> DataFrame:
    """The first row of each key by arrival. The times of arrival are compared first, and whole rows only where those are equal."""
    row = F.struct(*[c for c in batch.columns if c != key])
    ids = [c for c in ("device_id", "client_sequence") if c in batch.columns and c != key]
    order = F.struct("received_at_ns", *ids, F.to_json(row))
    times = keep(batch.groupBy(F.col(key).alias("_key")).agg(F.min("received_at_ns").alias("_first"), F.count_if(
        F.col("received_at_ns").isNull()).alias("_untimed")), "arrivals")
    first = F.when(F.col("_untimed") > 0, F.col("received_at_ns").isNull()).otherwise(F.col("received_at_ns") == F.col("_first"))
    early = batch.join(times, F.col(key).eqNullSafe(F.col("_key"))).filter(first).select(*batch.columns)
    return early.groupBy(key).agg(F.min_by(row, order).alias("r")).select(key, "r.*")


def first_unseen(rows: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """The first row of each key that ``held`` does not have. ``rows`` are read several times.

    Keys alone are counted first; rows are compared only where a key has several of them, and none when all keys are known.
    A null is never known.
    """
    known = held.select(key).filter(F.col(key).isNotNull()).withColumn("_mine", F.lit(0))
    counts = rows.select(key).withColumn("_mine", F.lit(1)).unionByName(known).groupBy(F.col(key).alias("_key")).agg(
        F.sum("_mine").alias("_rows"), F.count_if(F.col("_mine") == 0).alias("_held"))
    # Keys of a single new row, which are most of them as a rule, are not written out.
    others = keep(counts.filter("_rows > 1 or (_rows = 1 and _held > 0)"), "keys")
    repeated = others.filter("_held = 0")
    seen, several = others.agg(F.coalesce(F.sum(F.when(F.col("_held") > 0, F.col("_rows"))), F.lit(0)), F.count_if(F.col("_held") == 0)).first()
    if seen and seen == rows.count():
        return rows.limit(0)
    same = F.col(key).eqNullSafe(F.col("_key"))
    fresh = rows.join(others, same, "left_anti")
    return fresh.unionByName(_first_of(rows.join(repeated, same, "left_semi"), key)) if several else fresh


def assign_hub_sequence(new_events: DataFrame, high_water: int | Column) -> DataFrame:
    """Number new events after ``high_water`` in order of arrival, then event id."""
    ranked = distributed_rank(new_events, [], ["received_at_ns", "event_id"], "_n")
    start = F.lit(high_water) if isinstance(high_water, int) else high_water
    return ranked.withColumn("seq", (start + F.col("_n")).cast("bigint")).drop("_n")


def assign_device_sequence(captures: DataFrame, stored_max: DataFrame | None = None) -> DataFrame:
    """Continue each device's own counter over new captures (``ts``, ``id``)."""
    ranked = distributed_rank(captures, ["device_id"], ["ts", "id"], "_n")
    if stored_max is None:
        return ranked.withColumn("client_sequence", F.col("_n").cast("bigint")).drop("_n")
    return ranked.join(stored_max.select("device_id", F.col("client_sequence").alias("_max")), "device_id",
                       "left").withColumn("client_sequence", (F.coalesce("_max", F.lit(0)) + F.col("_n")).cast(
                           "bigint")).drop("_n", "_max")


def delta_cursor(events: DataFrame, devices: DataFrame | None = None) -> DataFrame:
    """Highest device sequence the hub holds; -1 for a device it has not heard of."""
    top = events.groupBy("device_id").agg(F.max("client_sequence").alias("client_sequence"))
    if devices is not None:
        top = devices.select("device_id").distinct().join(top, "device_id", "left")
    return top.withColumn("client_sequence", F.coalesce("client_sequence", F.lit(-1)))


def new_rows(batch: DataFrame, facts: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New facts and new events, not yet numbered, of a written batch that has its ``event_id``."""
    new_events = first_unseen(batch, events, "event_id")
    if "event_type" not in new_events.columns:
        new_events = new_events.withColumn("event_type", F.lit(OBSERVED))
    return first_unseen(batch.drop("event_id"), facts, "point_id"), new_events


def ingest_batch(batch: DataFrame, facts: DataFrame, events: DataFrame, high_water: int | None = None) -> Ingested:
    """Insert-if-absent of facts and events.

    ``batch``: point_id, device_id, client_sequence, received_at_ns and payload columns. A second
    device's identical report adds an event but no fact row. Every id is acknowledged, known or
    not. In-batch repeats count once, the first one wins; a retry keeps its original sequence.
    """
    reports = keep(with_event_id(batch), "batch")
    new_facts, new_events = new_rows(reports, facts, events)
    if high_water is None:
        high_water = events.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    return Ingested(new_facts, assign_hub_sequence(new_events, int(high_water)), reports.select("point_id").distinct())


def with_event_id(reports: DataFrame) -> DataFrame:
    return reports.withColumn("event_id", event_id(F.col("device_id"), F.col("point_id"), F.col("client_sequence")))
