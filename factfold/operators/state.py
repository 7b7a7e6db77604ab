"""The trusted table, its copy on the facts, and what is shown when there is no log."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factfold.functions.ids import resolve_event_id
from factfold.functions.labels import display_state, iso_time
from factfold.operators.fold import (
    KEY, RESOLVED, RETRACTED, Ballots, fold_consensus, keep_ballots, ranked_values,
)
from factfold.operators.trust import derive_device_trust, point_liveness
from factfold.params import FoldParams, TrustParams
from factfold.session import keep


def modality_filter(df: DataFrame, modality: str | None) -> DataFrame:
    """``vision`` also keeps whatever carries a thumbnail; other modalities match exactly."""
    if modality is None:
        return df
    if modality == "vision":
        return df.filter((F.col("modality") == "vision") | (F.coalesce("thumbnail_url", F.lit("")) != ""))
    return df.filter(F.col("modality") == modality)


def cloud_state(events: DataFrame, fold: FoldParams = FoldParams(), trust: TrustParams = TrustParams(),
                now: Column | None = None, modality: str | None = None) -> DataFrame:
    """One row per key with something to show, weighted by trust derived over the whole log."""
    ballots = keep_ballots(events.filter(F.coalesce(KEY, F.lit("")) != ""), fold)
    device_trust = keep(derive_device_trust(ballots, trust, fold), "trust")
    verdicts = fold_consensus(ballots, fold, device_trust).filter(
        (F.col("status") != "ABSENT") & (F.coalesce("value", F.lit("")) != ""))
    rows = verdicts.join(ballots.seen, KEY)
    backed = F.col("winner_devices")
    if ballots.decided:
        theirs = replace(ballots, latest=ballots.latest.join(ballots.resolutions.select(KEY), KEY, "left_semi"))
        decided = ballots.resolutions.select(KEY, F.col("resolved_value").alias("value"))
        order = F.struct(-F.col("support"), F.col("first_device"))
        named = ranked_values(theirs, fold, device_trust).join(decided, [KEY, "value"]).groupBy(KEY).agg(
            F.min_by("devices", order).alias("_decided_devices"))
        rows = rows.join(named, KEY, "left")
        backed = F.when(F.col("status") == RESOLVED, F.coalesce("_decided_devices", F.lit(0))).otherwise(backed)
    shown = rows.select(
        KEY, display_state(F.col("status")).alias("state"), "value", "confidence",
        backed.cast("bigint").alias("corroborating_devices"),
        iso_time(F.col("e.client_timestamp_ns"), F.current_timestamp() if now is None else now).alias("updated_at"),
        F.coalesce(F.col("e.modality"), F.lit("text")).alias("modality"),
        F.col("e.thumbnail_url").alias("thumbnail_url"))
    return modality_filter(shown, modality)


def degraded_state(facts: DataFrame, modality: str | None = None) -> DataFrame:
    """Without a log: per key the value most devices hold, never shown as settled."""
    known = facts.filter(F.coalesce(KEY, F.lit("")) != "")
    holders = known.groupBy(KEY, "value", "device_id").agg(
        F.max("client_timestamp_ns").alias("ts"), F.max("thumbnail_url").alias("thumb"),
        F.max(F.coalesce(F.col("modality") == "vision", F.lit(False))).alias("vision"))
    values = holders.groupBy(KEY, "value").agg(
        F.count(F.lit(1)).alias("devices"), F.max("ts").alias("ts"), F.max("thumb").alias("thumb"),
        F.max("vision").alias("vision"))
    best = F.min_by(F.struct("value", "devices"), F.struct(-F.col("devices"), F.col("value")))
    rows = values.groupBy(KEY).agg(best.alias("b"), F.max("ts").alias("updated_ns"),
                                   F.max("thumb").alias("thumbnail_url"), F.max("vision").alias("vision"))
    return modality_filter(rows.select(
        KEY, F.lit("UNCORROBORATED").alias("state"), F.col("b.value").alias("value"),
        F.lit(None).cast("double").alias("confidence"), F.col("b.devices").alias("corroborating_devices"),
        "updated_ns", "thumbnail_url",
        F.when(F.col("vision"), "vision").otherwise("text").alias("modality")), modality)


def stamp_consensus_state(facts: DataFrame, events: DataFrame, keys: DataFrame | None = None,
                          fold: FoldParams = FoldParams(), trust: TrustParams = TrustParams()) -> DataFrame:
    """Write state and confidence on the facts of the given keys (all, if none are given).

    Trust is taken from each key's own events, so a device can weigh differently on two keys.
    """
    log = events if keys is None else events.join(keys.select(KEY).distinct(), KEY, "left_semi")
    verdicts = fold_with_key_trust(log, fold, trust).select(
        KEY, display_state(F.col("status")).alias("_state"), F.col("confidence").alias("_confidence"))
    return facts.join(verdicts, KEY, "left").withColumns({
        "consensus_state": F.coalesce("_state", "consensus_state"),
        "confidence": F.coalesce("_confidence", "confidence"),
    }).drop("_state", "_confidence")


def fold_with_key_trust(events: DataFrame | Ballots, fold: FoldParams = FoldParams(),
                        trust: TrustParams = TrustParams()) -> DataFrame:
    """The fold with trust scored within each key."""
    ballots = keep_ballots(events, fold)
    return fold_consensus(ballots, fold, derive_device_trust(ballots, trust, fold, per_key=True))


def retract(events: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Withdrawals with their fact key, and the requests for which no key can be found.

    ``requests``: device_id, point_id, client_sequence and an optional corroboration_key.
    """
    # Kept, so that Spark knows how few they are and does not shuffle the log for them.
    unkeyed = keep(requests.filter(F.coalesce(KEY, F.lit("")) == "").select("device_id", "point_id").distinct(), "unkeyed")
    stored = events.filter(F.col(KEY).isNotNull()).join(unkeyed, ["device_id", "point_id"], "left_semi").groupBy(
        "device_id", "point_id").agg(F.min(KEY).alias("_stored"))
    keyed = requests.join(stored, ["device_id", "point_id"], "left").withColumn(
        KEY, F.coalesce(F.when(F.col(KEY) != "", F.col(KEY)), F.col("_stored"))).drop("_stored")
    found = keyed.filter(F.col(KEY).isNotNull()).withColumn("event_type", F.lit(RETRACTED))
    return found, keyed.filter(F.col(KEY).isNull())


def tombstones(events: DataFrame, points: DataFrame | None = None, hub_order: bool = True) -> DataFrame:
    """Points no device asserts any more."""
    log = events if points is None else events.join(points.select("point_id").distinct(), "point_id", "left_semi")
    return point_liveness(log, hub_order).filter(~F.col("live")).select("point_id")


def resolve(facts: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Operator decisions as RESOLVED events, and the facts that lost by them.

    ``decisions``: corroboration_key, value, resolver_id, seq. The winning cluster is that of a
    stored fact with the decided value (smallest id), null when there is none.
    """
    clusters = facts.groupBy(KEY, "value").agg(F.min_by("value_cluster", "point_id").alias("value_cluster"))
    events = decisions.join(clusters, [KEY, "value"], "left").withColumns({
        "event_type": F.lit(RESOLVED),
        "event_id": resolve_event_id(F.col(KEY), F.col("resolver_id"), F.col("seq")),
    })
    # Numbers first, which Spark combines without sorting; a key's newest decision is then one row.
    last = decisions.groupBy(F.col(KEY).alias("_key")).agg(F.max("seq").alias("_last"))
    newest = events.join(last, (F.col(KEY) == F.col("_key")) & F.col("seq").eqNullSafe(F.col("_last"))).groupBy(KEY).agg(
        F.max_by(F.struct("value", "value_cluster"), "seq").alias("r"))
    same = (F.col("value").eqNullSafe(F.col("r.value"))
            | (F.col("value_cluster").isNotNull() & (F.col("value_cluster") == F.col("r.value_cluster"))))
    losers = facts.join(newest, KEY).filter(~F.coalesce(same, F.lit(False))).select("point_id", KEY)
    return events, losers


