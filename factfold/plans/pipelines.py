"""Pipelines made of the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factfold.functions.geo import resolve_location
from factfold.functions.ids import fact_point_id, hash_bits, hash_mod, image_point_id
from factfold.functions.labels import classify_gas, gas_text, image_label
from factfold.functions.vectors import hash_embed
from factfold.operators.capture import decide, flag_conflicts, novelty, possible_conflicts
from factfold.operators.evaluation import compare_with_truth
from factfold.operators.fold import KEY, fold_consensus
from factfold.operators.monitor import facet_counts, hash_sample, systematic_sample
from factfold.operators.sync import eviction_plan
from factfold.params import DEFAULT_KNN, FoldParams, KnnParams, PolicyParams, RetentionParams
from factfold.session import keep
from factfold.sources.files import parse_gas_lines, scenario_events

# Fleet, zones and categories messages are spread over.
MESSAGE_DEVICES = ("dev-01", "dev-02", "dev-03", "dev-04")
MESSAGE_ZONES = ("zone_a", "zone_b", "zone_c", "zone_d")
MESSAGE_CATEGORIES = ("earthquake", "flood", "fire", "hurricane", "storm", "tornado", "shelter", "evacuation",
                      "rescue", "missing_person", "supply_request")


@dataclass
class Captured:
    """Decisions on the captures, the possible conflicts, what is stored, and what had to go."""

    decisions: DataFrame
    conflicts: DataFrame
    facts: DataFrame
    evicted: DataFrame


def capture_pipeline(captures: DataFrame, policy: PolicyParams = PolicyParams(),
                     retention: RetentionParams = RetentionParams(), conflict_threshold: float = 0.75,
                     zone_coords: DataFrame | None = None, knn: KnnParams = DEFAULT_KNN) -> Captured:
    """Ids, position, novelty, decision, conflicts, store and eviction for a table of captures.

    ``captures``: capture_id, device_id, slot, vec, value, zone, corroboration_key,
    client_sequence, modality, client_timestamp_ns; images carry ``content`` for their id.
    """
    text_id = fact_point_id(F.col(KEY), F.col("value"))
    ids = text_id if "content" not in captures.columns else F.when(
        F.col("content").isNotNull(), image_point_id(F.col(KEY), F.col("content"))).otherwise(text_id)
    rows = captures.withColumn("point_id", ids)
    if zone_coords is not None:
        rows = resolve_location(rows, zone_coords)
    decided = decide(novelty(rows, policy, knn), policy)
    earlier = rows.withColumn("shard", F.lit("mutable"))
    conflicts = possible_conflicts(rows, earlier, conflict_threshold, earlier_only=True, knn=knn)
    # Written once: what is stored and what is evicted both follow from it. The newest are found by their ids alone.
    flagged = keep(flag_conflicts(decided, conflicts), "decided")
    newest = Window.partitionBy("device_id", "point_id").orderBy(F.col("client_sequence").desc(), F.col("capture_id").desc())
    stored = flagged.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") == 1).drop("_n").select(
        "device_id", "point_id", *[c for c in flagged.columns if c not in ("device_id", "point_id")])
    evicted = eviction_plan(stored, retention)
    facts = stored.join(evicted.select("device_id", "point_id"), ["device_id", "point_id"], "left_anti")
    return Captured(flagged, conflicts, facts, evicted)


def message_captures(messages: DataFrame, limit: int | None = None, dim: int = 64) -> DataFrame:
    """Messages (``text``) as captures: a stable sample, spread over the fleet by hash."""
    rows = messages if limit is None else hash_sample(messages, "text", limit)
    text = F.col("text")

    def pick(names: tuple[str, ...], at) -> object:
        return F.element_at(F.array(*[F.lit(n) for n in names]), at.cast("int") + 1)

    zone = pick(MESSAGE_ZONES, hash_bits(text, 2, 2))
    category = pick(MESSAGE_CATEGORIES, hash_mod(text, 4, len(MESSAGE_CATEGORIES)))
    return rows.withColumns({
        "device_id": pick(MESSAGE_DEVICES, hash_bits(text, 0, 2)), "zone": zone,
        KEY: F.concat_ws(".", zone, category), "value": text, "slot": F.lit("text"), "modality": F.lit("text"),
        "vec": hash_embed(text, dim),
    })


def gas_captures(lines: DataFrame, order: str, target: int) -> DataFrame:
    """Sensor lines (``value`` and a unique line number) as labelled records, sampled evenly."""
    read = parse_gas_lines(lines)
    kept = systematic_sample(read, [order], target, valid=F.col("valid")).drop("value", "valid")
    label = classify_gas(F.col("methane_ppm"), F.col("ethylene_ppm"))
    return kept.withColumn("label", label).select(
        F.format_string("gas_%04d", "sample_index").alias("scenario_id"),
        F.concat(F.col("zone"), F.lit(".gas_"), F.col("label")).alias(KEY), "zone",
        gas_text(F.col("methane_ppm"), F.col("ethylene_ppm"), F.col("label")).alias("value"), "label",
        F.round("methane_ppm", 2).alias("methane_ppm"), F.round("ethylene_ppm", 4).alias("ethylene_ppm"),
        F.round("time_s", 2).alias("time_s"))


def gas_labels(records: DataFrame) -> DataFrame:
    """Distribution of the hazard labels."""
    return facet_counts(records, "label")


def image_captures(manifest: DataFrame, dim: int = 64) -> DataFrame:
    """Image manifest rows (with ``content`` where read) as captures."""
    payload = F.coalesce(F.col("content"), F.col("image_id").cast("binary")) if "content" in manifest.columns \
        else F.col("image_id").cast("binary")
    return manifest.withColumns({
        "capture_id": F.col("image_id"), "value": F.col("caption"), "slot": F.lit("image"),
        "modality": F.lit("vision"), "label": image_label(F.col("label"), F.col("caption")),
        "client_sequence": F.col("client_timestamp_ns"), "vec": hash_embed(payload, dim, "image"),
    })


def score_scenarios(scenarios: DataFrame, value_field: str = "value", fold: FoldParams = FoldParams()) -> DataFrame:
    """Fold every scenario's reports and compare the verdict with its ground truth."""
    verdicts = fold_consensus(scenario_events(scenarios, value_field), fold)
    truths = scenarios.select(F.col("scenario_id").alias(KEY), "ground_truth")
    return compare_with_truth(verdicts, truths).withColumnRenamed(KEY, "scenario_id")
