"""Stored tables: event log, facts, snapshots, conflict register.

A store is a folder on shared storage. The log and the facts are append-only and laid out by a
hash of the key, so that a refold of a few keys reads only their part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factfold import schemas
from factfold.operators.fold import KEY

BUCKET = "key_bucket"
CONFLICTS = ("capture_id string, device_id string, status string, new_point_id decimal(20,0), existing_point_id decimal(20,0), "
             "score double, zone string, new_value string, existing_value string, new_key string, existing_key string")


def key_bucket(column: str = KEY, buckets: int = 64):
    return F.pmod(F.xxhash64(F.coalesce(column, F.lit(""))), F.lit(buckets)).cast("int")


@dataclass
class Store:
    """Paths of one deployment's tables."""

    spark: SparkSession
    root: str
    buckets: int = 64

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def read(self, name: str, schema: str) -> DataFrame:
        """The table, or an empty one before its first write."""
        full = schemas.struct_type(schema)
        try:
            return self.spark.read.schema(full).parquet(self.path(name))
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], full)

    def append(self, name: str, rows: DataFrame, partition_by: str | None = None) -> None:
        writer = rows.write.mode("append")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(self.path(name))

    def append_new(self, name: str, rows: DataFrame, schema: str) -> None:
        """Append the rows that the table does not hold yet, each once; nulls are equal here."""
        shaped = conform(rows, schema).distinct()
        held = self.read(name, schema)
        same = [shaped[c].eqNullSafe(held[c]) for c in shaped.columns]
        self.append(name, shaped.join(held, same, "left_anti"))

    def events(self) -> DataFrame:
        return self.read("fact_events", schemas.FACT_EVENTS + f", {BUCKET} int")

    def touched(self, keys: DataFrame) -> list[int]:
        """Buckets the given keys fall in; at most ``buckets`` numbers."""
        return [r[0] for r in keys.select(key_bucket(KEY, self.buckets)).distinct().collect()]

    def events_for_keys(self, keys: DataFrame) -> DataFrame:
        """Events of the given keys; only the folders of their buckets are read."""
        near = self.events().filter(F.col(BUCKET).isin(self.touched(keys)))
        return near.join(keys.select(KEY).distinct(), KEY, "left_semi")

    def events_for_key(self, key: str) -> DataFrame:
        bucket = self.spark.range(1).select(key_bucket_of(key, self.buckets)).first()[0]
        return self.events().filter((F.col(BUCKET) == bucket) & (F.col(KEY) == key))

    def append_events(self, rows: DataFrame) -> None:
        shaped = conform(rows, schemas.FACT_EVENTS).withColumn(BUCKET, key_bucket(KEY, self.buckets))
        self.append("fact_events", shaped.repartition(BUCKET, F.pmod(F.xxhash64("event_id"), F.lit(8))), BUCKET)

    def facts(self) -> DataFrame:
        return self.read("facts", schemas.FACTS + f", {BUCKET} int")

    def append_facts(self, rows: DataFrame) -> None:
        shaped = conform(rows, schemas.FACTS).withColumn(BUCKET, key_bucket(KEY, self.buckets))
        self.append("facts", shaped.repartition(BUCKET, F.pmod(F.xxhash64("point_id"), F.lit(8))), BUCKET)

    def export_snapshot(self, facts: DataFrame, stamps: DataFrame, version: str) -> str | None:
        """Live facts with their vectors and the model stamps; nothing when there are no facts."""
        from factfold.operators.sync import live_facts

        live = live_facts(facts)
        if live.isEmpty():
            return None
        target = self.path(f"snapshots/{version}")
        live.write.mode("errorifexists").parquet(f"{target}/facts")
        stamps.write.mode("errorifexists").parquet(f"{target}/space_stamps")
        return target

    def import_snapshot(self, path: str, local: DataFrame, local_stamps: DataFrame, sync_ts_ns: int,
                        rebuild: bool = False) -> DataFrame:
        """Local table after a pull; refuses a snapshot made with another model."""
        from factfold.operators.stamps import merge_stamps
        from factfold.operators.sync import apply_snapshot

        merged = merge_stamps(local_stamps, self.spark.read.parquet(f"{path}/space_stamps"), rebuild)
        merged.write.mode("append").parquet(self.path(f"space_stamps/pulled_ns={sync_ts_ns}"))
        return apply_snapshot(local, self.spark.read.parquet(f"{path}/facts"), sync_ts_ns)

    def stamps(self) -> DataFrame | None:
        """The stamps registered by the newest pull; None before the first."""
        try:
            rows = self.spark.read.parquet(self.path("space_stamps"))
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return None
        newest = rows.agg(F.max("pulled_ns").alias("_newest"))
        return rows.join(F.broadcast(newest), F.col("pulled_ns") == F.col("_newest")).drop("pulled_ns", "_newest").distinct()

    def verdict_changes(self) -> DataFrame:
        """Every change that ``feeds.run_changes`` recorded."""
        from factfold.streaming.changes import CHANGES

        return self.read("verdict_changes", CHANGES + ", batch_id bigint")

    def register_conflicts(self, conflicts: DataFrame) -> None:
        """Add the conflicts, each with the time of its registration."""
        shaped = conform(conflicts, CONFLICTS).withColumn("registered_us", F.unix_micros(F.current_timestamp()))
        self.append("conflicts", shaped)

    def clear_conflicts(self, device: str) -> None:
        """Forget the conflicts registered so far for a device."""
        self.append("conflicts_cleared", self.spark.range(1).select(
            F.lit(device).alias("device_id"), F.unix_micros(F.current_timestamp()).alias("cleared_us")))

    def conflicts(self, device: str | None = None) -> DataFrame:
        """Conflicts that are registered and not cleared, of one device or of all."""
        rows = self.read("conflicts", CONFLICTS + ", registered_us bigint")
        cleared = self.read("conflicts_cleared", "device_id string, cleared_us bigint").groupBy("device_id").agg(
            F.max("cleared_us").alias("_cleared"))
        open_ = rows.join(cleared, "device_id", "left").filter(
            F.col("_cleared").isNull() | (F.col("registered_us") > F.col("_cleared"))).drop("_cleared", "registered_us")
        return open_ if device is None else open_.filter(F.col("device_id") == device)


def key_bucket_of(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.lit(key)), F.lit(buckets)).cast("int")


def conform(rows: DataFrame, schema: str) -> DataFrame:
    """Columns of a stored table in order, missing ones null."""
    return rows.select(*[
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schemas.struct_type(schema).fields])
