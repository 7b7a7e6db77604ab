"""Outbox, batch selection, acknowledgement, retention, snapshots and pulls."""

from __future__ import annotations

import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factfold.functions.labels import fact_score, sync_state
from factfold.operators.ranking import distributed_rank, distributed_running_sum, first_rows
from factfold.params import GateParams, RetentionParams

_PRIORITIES = ("URGENT", "ROUTINE", "HELD")


def _priority_rank(column: Column) -> Column:
    rank = F.lit(len(_PRIORITIES))
    for i, name in reversed(list(enumerate(_PRIORITIES))):
        rank = F.when(column == name, F.lit(i)).otherwise(rank)
    return rank


def outbox(facts: DataFrame, limit: int | None = None, salts: int = 64) -> DataFrame:
    """Rows waiting to be sent: per device the first ``limit`` in order, then ranked by priority.

    An urgent row beyond the limit is not seen, as on a device. ``push_rank`` is the send order.
    """
    pending = facts.filter((F.col("synced") == 0) & (F.col("syncable") == 1))
    if limit is None:
        return pending
    first = first_rows(pending, ["device_id"], [F.col("client_sequence"), F.col("point_id")], limit,
                       "point_id", salts, "_seq_rank")
    order = Window.partitionBy("device_id").orderBy(
        _priority_rank(F.col("sync_priority")), "client_sequence", "point_id")
    return first.withColumn("push_rank", F.row_number().over(order)).drop("_seq_rank")


def pending_retractions(markers: DataFrame) -> DataFrame:
    """Unsent withdrawals in their own order."""
    return markers.filter(F.col("synced") == 0).orderBy("device_id", "client_sequence")


def select_batch(candidates: DataFrame, gate: GateParams, salts: int = 64) -> DataFrame:
    """Mark what each device sends now under its byte budget: ``selected`` true or false.

    Order is urgent first, then value per byte, then device sequence; a row that does not fit is
    skipped and later rows may still fit; a row larger than the whole budget is always sent and
    uses the budget up. ``candidates``: device_id, id, bytes, value, age_s, urgent,
    client_sequence.

    Only the rows that could fit are walked one by one. After the first oversize row nothing else
    fits. Among rows of equal size those taken are a prefix (room only shrinks), of at most
    budget / size rows. Both cuts are exact, so a device's walk is bounded by its budget and not
    by its queue.
    """
    if gate.budget_bytes is None or gate.budget_bytes <= 0:
        return candidates.withColumn("selected", F.lit(True))
    budget = int(gate.budget_bytes)
    scored = candidates.withColumns({
        "_size": F.greatest(F.lit(1), F.coalesce("bytes", F.lit(1)).cast("bigint")),
        "_late": F.when(F.coalesce("urgent", F.lit(False)), 0).otherwise(1),
        "_drop": -fact_score(F.coalesce("value", F.lit(0.0)), F.coalesce("age_s", F.lit(0.0)),
                             F.coalesce("bytes", F.lit(1)), gate.aging_factor),
    })
    order = F.struct("_late", "_drop", "client_sequence", "id")
    keyed = scored.withColumn("_order", order)
    oversize = keyed.filter(F.col("_size") > budget)
    stop = oversize.groupBy("device_id").agg(F.min("_order").alias("_stop"))
    fitting = keyed.filter(F.col("_size") <= budget).join(stop, "device_id", "left").filter(
        F.col("_stop").isNull() | (F.col("_order") < F.col("_stop"))).drop("_stop")
    walk = first_rows(fitting, ["device_id", "_size"], [F.col("_order")], F.floor(F.lit(budget) / F.col("_size")),
                      "id", salts, "_r")
    id_type = candidates.schema["id"].dataType.simpleString()
    dev_type = candidates.schema["device_id"].dataType.simpleString()

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values(["_late", "_drop", "client_sequence", "id"])
        room, taken = budget, []
        for row_id, size in zip(ordered["id"], ordered["_size"]):
            if size <= room:
                room -= size
                taken.append(row_id)
        return pd.DataFrame({"device_id": [rows["device_id"].iloc[0]] * len(taken), "id": taken})

    taken = walk.select("device_id", "id", "_late", "_drop", "client_sequence", "_size").groupBy(
        "device_id").applyInPandas(fill, f"device_id {dev_type}, id {id_type}")
    sent = taken.unionByName(oversize.select("device_id", "id")).withColumn("_sent", F.lit(True))
    return candidates.join(sent, ["device_id", "id"], "left").withColumn(
        "selected", F.coalesce("_sent", F.lit(False))).drop("_sent")


def apply_acks(facts: DataFrame, acked: DataFrame | None) -> DataFrame:
    """Set ``synced`` for acknowledged ids only; without an acknowledgement nothing changes."""
    if acked is None:
        return facts
    ids = acked.select("point_id").distinct().withColumn("_acked", F.lit(True))
    return facts.join(ids, "point_id", "left").withColumn(
        "synced", F.when(F.col("_acked"), F.lit(1)).otherwise(F.col("synced"))).drop("_acked")


def drain_markers(markers: DataFrame, acked: DataFrame | None) -> DataFrame:
    """Withdrawal markers still to be sent after an acknowledgement."""
    if acked is None:
        return markers
    return markers.join(acked.select("point_id").distinct(), "point_id", "left_anti")


def memory_status(facts: DataFrame, retention: RetentionParams = RetentionParams()) -> DataFrame:
    """Use of each device's store against its cap."""
    return facts.groupBy("device_id").agg(
        F.count(F.lit(1)).alias("used"), F.count_if(F.col("synced") == 1).alias("synced_count"),
    ).withColumns({
        "cap": F.lit(retention.max_points).cast("bigint"),
        "over_cap": F.col("used") > retention.max_points,
        "status": F.when(F.col("used") > retention.max_points, "memory_full").otherwise("ok"),
    })


def pending_by_priority(facts: DataFrame) -> DataFrame:
    """Waiting rows per device and priority; held rows are never waiting, so theirs is 0."""
    return outbox(facts).groupBy("device_id").agg(
        *[F.count_if(F.col("sync_priority") == p).alias(p.lower()) for p in _PRIORITIES])


def evictable(facts: DataFrame) -> DataFrame:
    """Rows that may be dropped: sent, or never to be sent."""
    return facts.filter((F.col("synced") == 1) | (F.col("syncable") == 0))


def eviction_plan(facts: DataFrame, retention: RetentionParams = RetentionParams(), min_evict: int = 1) -> DataFrame:
    """Rows to drop: the oldest evictable ones, by sequence and never by clock, of each device over its cap."""
    excess = facts.groupBy("device_id").agg(F.count(F.lit(1)).alias("_n")).filter(
        F.col("_n") > retention.max_points).select(
            "device_id", F.greatest(F.col("_n") - retention.max_points, F.lit(min_evict)).alias("_evict"))
    ranked = distributed_rank(evictable(facts).join(excess, "device_id"), ["device_id"],
                              ["client_sequence", "point_id"], "evict_rank")
    return ranked.filter(F.col("evict_rank") <= F.col("_evict")).drop("_evict")


def is_image(df: DataFrame) -> Column:
    thumb = F.coalesce("thumbnail_url", F.lit("")) != ""
    return thumb | F.coalesce(F.col("modality") == "vision", F.lit(False))


def tier_protected() -> Column:
    """Rows that keep their thumbnail whatever the pressure."""
    return (F.coalesce(F.col("consensus_state").isin("CONFIRMED", "DISPUTED"), F.lit(False))
            | F.coalesce(F.col("sync_priority") == "URGENT", F.lit(False)))


def demotion_plan(facts: DataFrame, retention: RetentionParams) -> DataFrame:
    """Images to reduce to their embedding: oldest sent ones until the bytes of a device fit its cap."""
    cap = retention.max_thumbnail_bytes
    if cap <= 0:
        return facts.limit(0)
    full = facts.filter((F.col("synced") == 1) & is_image(facts) & (F.coalesce("tier", F.lit("full")) == "full"))
    sized = full.withColumn("_size", F.greatest(F.lit(0), F.coalesce("thumbnail_bytes", F.lit(0))).cast("bigint"))
    totals = sized.groupBy("device_id").agg(F.sum("_size").alias("_total")).filter(F.col("_total") > cap)
    open_rows = sized.filter(~tier_protected()).join(totals, "device_id")
    summed = distributed_running_sum(open_rows, ["device_id"], ["client_sequence", "point_id"], "_size", "_freed")
    return summed.filter(F.col("_total") - F.col("_freed") > cap).drop("_size", "_total", "_freed")


def demote(facts: DataFrame, plan: DataFrame) -> DataFrame:
    """Apply a demotion plan: the thumbnail goes, the vector stays."""
    ids = plan.select("device_id", "point_id").withColumn("_demoted", F.lit(True))
    return facts.join(ids, ["device_id", "point_id"], "left").withColumns({
        "tier": F.when(F.col("_demoted"), "embedding_only").otherwise(F.col("tier")),
        "thumbnail_url": F.when(F.col("_demoted"), F.lit(None).cast("string")).otherwise(F.col("thumbnail_url")),
    }).drop("_demoted")


def live_facts(facts: DataFrame, reporter: str | None = None) -> DataFrame:
    """Facts neither withdrawn nor superseded, of the whole fleet or of one reporter."""
    rows = facts.filter((F.coalesce("tombstoned", F.lit(0)) != 1) & (F.coalesce("superseded", F.lit(0)) != 1))
    return rows if reporter is None else rows.filter(F.col("reporter_device_id") == reporter)


def _as_id(number: int) -> Column:
    return F.lit(Decimal(number)).cast("decimal(20,0)")


def same_id(column: str, text: str) -> Column:
    """An id given as text, compared as a number so that the filter reaches the scan; other text matches nothing."""
    return F.col(column) == _as_id(int(text)) if re.fullmatch(r"[0-9]{1,20}", text) else F.lit(False)


def id_starts_with(column: str, digits: str) -> Column:
    """Ids whose decimal text starts with ``digits``: a number range for every length."""
    if not re.fullmatch(r"0|[1-9][0-9]{0,19}", digits):
        return F.lit(False)
    ranges = [(int(digits) * 10**more, (int(digits) + 1) * 10**more - 1) for more in range(1 if digits == "0" else 21 - len(digits))]
    found = F.lit(False)
    for low, high in ranges:
        found = found | F.col(column).between(_as_id(low), _as_id(high))
    return found


def lookup_fact(facts: DataFrame, point_id: str) -> DataFrame:
    """One fact by id; failing that, those whose id starts with its first twelve characters."""
    exact = same_id("point_id", point_id)
    close = facts.filter(id_starts_with("point_id", point_id[:12])).withColumn("_exact", exact)
    any_exact = close.filter("_exact").limit(1).select(F.lit(True).alias("_found"))
    # At most one row on the right.
    return close.join(F.broadcast(any_exact), how="left").filter(
        F.col("_exact") | F.col("_found").isNull()).drop("_exact", "_found")


def local_events(events: DataFrame, point_id: str) -> DataFrame:
    """The log of one point in hub order."""
    return events.filter(same_id("point_id", point_id)).orderBy("seq")


def stale_after_pull(facts: DataFrame, sync_ts_ns: int) -> Column:
    """Sent rows that a snapshot taken at ``sync_ts_ns`` already contains; waiting rows never are."""
    return (F.col("synced") == 1) & (F.col("client_timestamp_ns") <= F.lit(sync_ts_ns))


def apply_snapshot(local: DataFrame, snapshot: DataFrame, sync_ts_ns: int) -> DataFrame:
    """Replace the pulled shard by the snapshot and drop own rows the snapshot covers."""
    own = local.filter(F.col("shard") == "mutable").filter(
        ~F.coalesce(stale_after_pull(local, sync_ts_ns), F.lit(False)))
    return own.unionByName(snapshot.withColumn("shard", F.lit("immutable")), allowMissingColumns=True)


def withdrawn_ids(facts: DataFrame) -> DataFrame:
    """Ids taken back or overruled, distinct and sorted, with the kind."""
    kinds = F.array_compact(F.array(
        F.when(F.coalesce("tombstoned", F.lit(0)) == 1, F.lit("retracted")),
        F.when(F.coalesce("superseded", F.lit(0)) == 1, F.lit("superseded"))))
    return facts.select(F.explode(kinds).alias("kind"), "point_id").distinct().orderBy("kind", "point_id")


def apply_withdrawals(local: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """Drop withdrawn ids from both shards."""
    return local.join(withdrawn.select("point_id").distinct(), "point_id", "left_anti")


def first_shard_wins(facts: DataFrame) -> DataFrame:
    """One row per id; the device's own copy before a pulled one."""
    everything = F.struct(*facts.columns)
    hashed = [c for c, kind in facts.dtypes if "map<" not in kind]
    precedence = F.struct(F.when(F.col("shard") == "mutable", 0).otherwise(1), -F.col("client_timestamp_ns"), F.xxhash64(*hashed))
    return facts.groupBy(F.col("point_id").alias("_pid")).agg(F.min_by(everything, precedence).alias("f")).select("f.*")


def memory_listing(facts: DataFrame, limit: int, offset: int = 0, value: str | None = None,
                   state: str | None = None, modality: str | None = None, zone: str | None = None) -> DataFrame:
    """A page of the store, newest first. Count ``matching_facts`` for the total."""
    return matching_facts(facts, value, state, modality, zone).orderBy(
        F.col("client_timestamp_ns").desc(), F.col("point_id")).offset(offset).limit(limit)


def matching_facts(facts: DataFrame, value: str | None = None, state: str | None = None,
                   modality: str | None = None, zone: str | None = None) -> DataFrame:
    """The rows a listing pages through, after dedupe."""
    labelled = facts.withColumn("sync_state", sync_state(F.col("synced"), F.col("syncable")))
    for name, wanted in (("value", value), ("sync_state", state), ("modality", modality), ("zone", zone)):
        if wanted is not None:
            labelled = labelled.filter(F.col(name) == wanted)
    return first_shard_wins(labelled)


def purge_tagged(tables: dict[str, DataFrame], tag: str = "demo") -> tuple[dict[str, DataFrame], DataFrame]:
    """Drop rows whose ``tag`` is 1 from every table; also the number dropped per table."""
    hit = F.coalesce(F.col(tag), F.lit(0)) == 1
    kept = {name: df.filter(~hit) for name, df in tables.items()}
    counts = [df.agg(F.count_if(hit).alias("dropped")).select(F.lit(name).alias("table"), "dropped")
              for name, df in tables.items()]
    report = counts[0]
    for other in counts[1:]:
        report = report.unionByName(other)
    return kept, report


def orphan_files(files: DataFrame, facts: DataFrame) -> DataFrame:
    """Files (``path``) that no fact's thumbnail names; a report, the caller deletes."""
    def base(c: Column) -> Column:
        return F.element_at(F.split(c, "/"), -1)

    named = facts.filter(F.coalesce("thumbnail_url", F.lit("")) != "").select(
        base(F.col("thumbnail_url")).alias("_name")).distinct()
    return files.withColumn("_name", base(F.col("path"))).join(named, "_name", "left_anti").drop("_name")
