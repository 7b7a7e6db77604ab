"""Input files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factfold import schemas
from factfold.operators.fold import KEY, OBSERVED
from factfold.operators.ranking import distributed_rank

# Columns a message file may keep its text in, in order of preference.
MESSAGE_COLUMNS = ("message", "original_text", "translated", "text")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a fixed schema; blank lines are skipped, a missing path raises."""
    df = spark.read.schema(schemas.struct_type(schema)).json(path)
    return df.dropna(how="all")


def message_column(columns: list[str]) -> str:
    return next((c for c in MESSAGE_COLUMNS if c in columns), columns[0])


def pick_messages(df: DataFrame) -> DataFrame:
    """The message column of a table as ``text``, nulls dropped."""
    return df.select(F.col(message_column(df.columns)).cast("string").alias("text")).dropna()


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    return pick_messages(spark.read.parquet(path))


def parse_gas_lines(lines: DataFrame) -> DataFrame:
    """``value`` lines to readings; short or non-numeric lines have ``valid`` false."""
    parts = F.split(F.trim("value"), r"\s+")
    named = {n: F.try_element_at(parts, F.lit(i + 1)).try_cast("double")
             for i, n in enumerate(("time_s", "methane_ppm", "ethylene_ppm"))}
    rows = lines.withColumns(named)
    ok = F.col("time_s").isNotNull() & F.col("methane_ppm").isNotNull() & F.col("ethylene_ppm").isNotNull()
    return rows.withColumn("valid", ok)


def read_gas(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace-separated readings; header and unreadable lines dropped."""
    return parse_gas_lines(spark.read.text(path)).filter("valid").drop("value", "valid")


def read_image_manifest(spark: SparkSession, manifest: str, image_dir: str | None = None) -> DataFrame:
    """Manifest rows, with the bytes of their files when a folder is given."""
    rows = read_jsonl(spark, manifest, schemas.IMAGE_MANIFEST)
    if image_dir is None:
        return rows
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(image_dir).select(
        F.element_at(F.split("path", "/"), -1).alias("_name"), "content")
    return rows.withColumn("_name", F.element_at(F.split("file", "/"), -1)).join(files, "_name", "left").drop("_name")


def report_time(text):
    """Device time of a report; malformed stamps become null."""
    return F.try_to_timestamp(text)


def scenario_events(scenarios: DataFrame, value_field: str = "value") -> DataFrame:
    """One event per report of each scenario, in report order."""
    rows = scenarios.select("scenario_id", KEY, "zone", "ground_truth", F.posexplode("reports").alias("pos", "report"))
    fields = rows.schema["report"].dataType.fieldNames()
    stamp = report_time(F.col("report.device_ts")) if "device_ts" in fields else F.lit(None).cast("timestamp")
    return rows.select(
        "scenario_id", F.col(KEY).alias("fact_key"), F.col("scenario_id").alias(KEY), "zone", "ground_truth",
        F.col("report.device_id").alias("device_id"), F.col(f"report.{value_field}").alias("value"),
        stamp.alias("device_ts"), (F.col("pos") + 1).cast("bigint").alias("seq"), F.lit(OBSERVED).alias("event_type"))


def export_messages(messages: DataFrame, serial_order: str | None = None) -> DataFrame:
    """Messages as export rows: blanks dropped, trimmed, with ids and constants.

    Ids hash the text unless ``serial_order`` names a unique number to count along.
    """
    rows = messages.withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", "")).filter(F.col("text") != "")
    if serial_order is None:
        ids = rows.withColumn("id", F.concat(F.lit("dr_"), F.substring(F.sha2("text", 256), 1, 16)))
    else:
        ids = distributed_rank(rows, [], [serial_order], "_n").withColumn(
            "id", F.format_string("dr_%06d", F.col("_n") - 1))
    return ids.select("id", "text", F.lit("disaster_response_messages").alias("source"), F.lit("text").alias("type"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)
