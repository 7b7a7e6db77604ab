"""Model-space stamps: two tables may only be mixed when their vectors mean the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factfold.functions.sealing import canonical_json
from factfold.functions.vectors import hash_embed, stamp_cosine

PROBE_TEXT = "factfold probe: pressure 12.5 bar, valve not open"
PROBE_PLACES = 6
SAME_SPACE = 0.999


def with_space_id(stamps: DataFrame) -> DataFrame:
    """Round the probe vector and label the space by model identity and behaviour."""
    probe = F.transform("probe", lambda x: F.round(x.cast("double"), PROBE_PLACES))
    fields = {n: F.col(n) for n in ("name", "modality", "dim", "probe")}
    return stamps.withColumn("probe", probe).withColumn(
        "space_id", F.substring(F.sha2(canonical_json(fields), 256), 1, 16))


def compute_stamp(spark: SparkSession, slot: str, name: str, modality: str = "text", dim: int = 64,
                  salt: str = "", embed=hash_embed) -> DataFrame:
    """The stamp of one embedder: it embeds the probe the way it embeds captures."""
    row = spark.range(1).select(F.lit(slot).alias("slot"), F.lit(name).alias("name"),
                                F.lit(modality).alias("modality"), F.lit(dim).alias("dim"),
                                embed(F.lit(PROBE_TEXT), dim, salt).cast("array<double>").alias("probe"))
    return with_space_id(row)


def stamp_problems(local: DataFrame, incoming: DataFrame) -> DataFrame:
    """Slots both sides know whose vectors cannot be mixed. Any row refuses the whole batch."""
    other = incoming.select("slot", *[F.col(c).alias(f"in_{c}") for c in ("name", "modality", "dim", "probe", "space_id")])
    both = local.join(other, "slot")
    shape = (F.col("name") == F.col("in_name")) & (F.col("modality") == F.col("in_modality")) & (
        F.col("dim") == F.col("in_dim"))
    same = (F.col("space_id") == F.col("in_space_id")) | (stamp_cosine(F.col("probe"), F.col("in_probe")) >= SAME_SPACE)
    why = F.when(~shape, "model differs").otherwise("space differs")
    return both.filter(~F.coalesce(shape & same, F.lit(False))).select(
        "slot", "name", "in_name", "space_id", "in_space_id", why.alias("problem"))


def new_slots(local: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stamps of slots not seen before, to be registered."""
    return incoming.join(local.select("slot"), "slot", "left_anti")


def merge_stamps(local: DataFrame, incoming: DataFrame, rebuild: bool = False) -> DataFrame:
    """The stamp table after a batch; raises on a mismatch unless ``rebuild`` restamps."""
    if rebuild:
        return local.join(incoming.select("slot"), "slot", "left_anti").unionByName(incoming)
    problems = stamp_problems(local, incoming).limit(20).collect()
    if problems:
        raise ValueError("incompatible model space: " + "; ".join(f"{p['slot']}: {p['problem']}" for p in problems))
    return local.unionByName(new_slots(local, incoming))
