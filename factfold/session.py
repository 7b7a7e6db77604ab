"""Session settings shared by the queries, the benchmark and the tests."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "factfold", cpus: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session; on a cluster the caller passes in its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("FACTFOLD_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a scratch one only where none is configured."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    path = tempfile.mkdtemp(prefix="factfold-ckpt-")  # one process is the whole cluster here
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder for tables a job writes for itself, on the shared checkpoint storage."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/factfold-{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str = "kept") -> DataFrame:
    """Write ``df`` once to shared storage and read it back.

    For results that several later steps use: they are computed once, survive the loss of an
    executor, are read column by column, and have a known size when a join is planned.
    """
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that their Python finds it.

    The archive is served by the driver for as long as the application runs.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="factfold-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder, f"factfold-{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(target, "w") as zipped:
        for source in sorted(package.rglob("*.py")):
            zipped.write(source, source.relative_to(package.parent))
    context.addPyFile(str(target))


def spread(df: DataFrame) -> DataFrame:
    """Deal out a plain file scan that has fewer splits than the cluster has cores; leave others alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
