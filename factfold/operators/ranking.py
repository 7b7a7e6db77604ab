"""Ranks and running sums that keep one hot group spread over many tasks.

A window over a hot key would sort that key in a single task. Here rows are range-partitioned on
group, order and tie together, so a hot group, and even a hot order value, is cut into even parts.
The parts are written once; totals per part are summed over the few parts of a group and joined
back, and the remaining window covers one part of one group at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factfold.session import keep


def _in_parts(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    return keep(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "ranges")


def _offsets(parts: DataFrame, by: Sequence[str], total: str) -> DataFrame:
    """Sum of ``total`` over the earlier parts of a group; one row per group and part."""
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(*by, "_part", F.coalesce(F.sum(total).over(before), F.lit(0)).alias("_off"))


def _rank_of_all(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Ranks without groups: the parts are sorted as they are written, and a row's place in its part is taken down."""
    at, part = F.monotonically_increasing_id(), F.shiftright("_at", 33).cast("int").alias("_part")  # a task's rows from its number << 33
    placed = keep(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at), "ranges")
    counts = placed.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    # Kept, so that Spark knows how small it is and does not shuffle the rows for it.
    offsets = keep(_offsets(counts, [], "_n"), "offsets")
    return (placed.withColumn("_part", part).join(offsets, "_part")
            .withColumn(out, F.col("_off") + F.col("_at") - F.shiftleft(F.col("_part").cast("bigint"), 33) + 1).drop("_part", "_off", "_at"))


def distributed_rank(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str = "rn") -> DataFrame:
    """``row_number() over (partition by ``by`` order by ``order``)``; ``order`` ends in a unique column."""
    if not by:
        return _rank_of_all(df, order, out)
    placed = _in_parts(df, by, order)
    counts = placed.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    local = Window.partitionBy(*by, "_part").orderBy(*order)
    return (placed.join(_offsets(counts, by, "_n"), [*by, "_part"])
            .withColumn(out, F.col("_off") + F.row_number().over(local)).drop("_part", "_off"))


def distributed_running_sum(df: DataFrame, by: Sequence[str], order: Sequence[str], amount: str,
                            out: str) -> DataFrame:
    """Sum of the whole number ``amount`` over the rows strictly before each row of its group."""
    placed = _in_parts(df, by, order)
    sums = placed.groupBy(*by, "_part").agg(F.sum(amount).alias("_s"))
    local = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (placed.join(_offsets(sums, by, "_s"), [*by, "_part"])
            .withColumn(out, F.col("_off") + F.coalesce(F.sum(amount).over(local), F.lit(0))).drop("_part", "_off"))


def first_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column], limit: Column | int,
               salt_on: str, salts: int = 64, out: str = "rn") -> DataFrame:
    """The first ``limit`` rows of each group, found per salt first and then among the survivors."""
    cap = F.lit(limit) if isinstance(limit, int) else limit
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_on), F.lit(salts)))
    inner = Window.partitionBy(*by, "_salt").orderBy(*order)
    kept = salted.withColumn("_r", F.row_number().over(inner)).filter(F.col("_r") <= cap).drop("_r", "_salt")
    outer = Window.partitionBy(*by).orderBy(*order)
    return kept.withColumn(out, F.row_number().over(outer)).filter(F.col(out) <= cap)
