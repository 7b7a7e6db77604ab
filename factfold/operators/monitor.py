"""Device and fleet figures: counters, latencies, pushes, activity, facets."""

from __future__ import annotations

from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from factfold.functions.labels import backoff_ms
from factfold.operators.ranking import distributed_rank, first_rows
from factfold.params import BackoffParams

MIN_INTERVAL_S = 0.25


def last_n(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The newest ``n`` rows overall; each task keeps its own ``n`` before they meet."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def feed(df: DataFrame, limit: int, device: str | None = None, kind: str | None = None,
         modality: str | None = None) -> DataFrame:
    """Newest entries of an activity or decision table that match the given filters."""
    for name, wanted in (("device_id", device), ("kind", kind), ("modality", modality)):
        if wanted is not None:
            df = df.filter(F.col(name) == wanted)
    return last_n(df, limit, "ts", "id")


def facet_counts(df: DataFrame, field: str) -> DataFrame:
    """Rows per value of a field."""
    return df.groupBy(F.col(field).alias("facet")).agg(F.count(F.lit(1)).alias("n"))


def hash_sample(df: DataFrame, text: str, n: int) -> DataFrame:
    """A stable sample: the ``n`` texts with the smallest hash."""
    return df.orderBy(F.sha2(F.col(text), 256), *[c for c in df.columns if c != text]).limit(n)


def systematic_sample(df: DataFrame, order: list[str], target: int,
                      valid: Column | None = None,
                      zones: tuple[str, ...] = ("zone_a", "zone_b", "zone_c", "zone_d")) -> DataFrame:
    """Every ``max(1, total // target)``-th row in order; kept ``valid`` rows take the zones in turn."""
    total = df.agg(F.count(F.lit(1))).first()[0]
    step = max(1, total // target)
    kept = distributed_rank(df, [], order, "_n").filter(F.pmod(F.col("_n") - 1, F.lit(step)) == 0)
    if valid is not None:
        kept = kept.filter(valid)
    # Fewer than 2 * target rows are left, so one window over them is small.
    position = F.row_number().over(Window.orderBy("_n")) - 1
    cycle = F.array(*[F.lit(z) for z in zones])
    return kept.withColumn("sample_index", position.cast("bigint")).withColumn(
        "zone", F.element_at(cycle, (F.pmod("sample_index", F.lit(len(zones))) + 1).cast("int"))).drop("_n")


def cap_per_label(images: DataFrame, n: int) -> DataFrame:
    """The first ``n`` images of each class in path order; images with several classes are left out."""
    single = images.groupBy("path").agg(F.min("label").alias("label"), F.max("label").alias("_other")).filter(
        F.col("label") == F.col("_other")).drop("_other")
    return first_rows(single, ["label"], [F.col("path")], n, "path")


def activity_sparkline(activity: DataFrame, devices: DataFrame, columns: int = 12) -> DataFrame:
    """All entries of each device in equal columns from old to new; filter ``activity`` for a time span."""
    recent = activity.groupBy("device_id").agg(F.count(F.lit(1)).alias("n"))
    width = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(columns)))
    filled = F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda i: F.greatest(
        F.lit(0), F.least(width, F.col("n") - i * width)).cast("bigint"))
    return devices.select("device_id").distinct().join(recent, "device_id", "left").withColumn(
        "n", F.coalesce("n", F.lit(0))).select("device_id", filled.alias("sparkline"))


def push_summary(pushes: DataFrame) -> DataFrame:
    """The last push of each device."""
    row = F.struct(*[c for c in pushes.columns if c != "device_id"])
    return pushes.groupBy("device_id").agg(F.max_by(row, F.struct("ts", "push_id")).alias("p")).select("device_id", "p.*")


def failure_backoff(attempts: DataFrame, params: BackoffParams = BackoffParams()) -> DataFrame:
    """Failures since the last success of each device and the delay they call for (``ok``, ``ts``)."""
    success = attempts.filter("ok").groupBy("device_id").agg(F.max("ts").alias("_ok_ts"))
    failed_since = F.count_if(~F.col("ok") & (F.col("_ok_ts").isNull() | (F.col("ts") > F.col("_ok_ts"))))
    return attempts.join(success, "device_id", "left").groupBy("device_id").agg(
        failed_since.alias("failures")).withColumn("next_retry_ms", backoff_ms(F.col("failures"), params))


def recent_latency(samples: DataFrame, window_s: int) -> DataFrame:
    """p50 and p95 of the samples (``ts``, ``id``, ``value``) of the last ``window_s`` seconds; 0 when there are none.

    The order statistics come from ranks, so the window may hold any number of samples.
    """
    newest = samples.agg(F.max("ts").alias("_newest"))
    recent = samples.crossJoin(F.broadcast(newest)).filter(
        F.col("ts") > F.col("_newest") - F.make_dt_interval(secs=F.lit(window_s))).drop("_newest")
    n = recent.agg(F.count(F.lit(1)).alias("n"))
    at = F.col("_n") - 1
    picked = distributed_rank(recent, [], ["value", "id"], "_n").crossJoin(F.broadcast(n))
    return picked.agg(
        F.coalesce(F.max(F.when(at == F.floor(F.col("n") / 2), F.col("value"))), F.lit(0.0)).alias("p50"),
        F.coalesce(F.max(F.when(at == F.least(F.floor(F.col("n") * F.lit(0.95)), F.col("n") - 1), F.col("value"))), F.lit(0.0)).alias("p95"))


def latency_report(samples: DataFrame, by: list[str]) -> DataFrame:
    """Exact median, p95, min and max per group; order statistics come from ranks, not from one list."""
    ranked = distributed_rank(samples, by, ["value", "id"], "_n")
    sizes = samples.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("min"),
                                     F.max("value").alias("max"))
    r, n = F.col("_n") - 1, F.col("n")
    middle = (r == F.floor((n - 1) / 2)) | (r == F.floor(n / 2))
    high = r == F.floor((n - 1) * F.lit(0.95))
    joined = ranked.join(sizes, by).filter(middle | high) if by else ranked.crossJoin(F.broadcast(sizes)).filter(
        middle | high)
    return joined.groupBy(*by).agg(
        F.avg(F.when(middle, F.col("value"))).alias("p50"), F.max(F.when(high, F.col("value"))).alias("p95"),
        F.max("min").alias("min"), F.max("max").alias("max"), F.max("n").alias("n"))


def _busy(prev: tuple[float, float], now: tuple[float, float], quota: float) -> float:
    elapsed, used = now[0] - prev[0], now[1] - prev[1]
    return 0.0 if elapsed <= 0 or used < 0 else used / 1e6 / elapsed / quota * 100.0


def _by(batches, keys: int):
    """Runs of rows with equal first columns; the rows come sorted."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    return groupby(rows, key=itemgetter(*range(keys)))


def _emit(rows, schema: pa.Schema):
    """Rows as batches of bounded size."""
    while held := list(islice(rows, 1 << 16)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _next(t: list[float], i: int, base_t: float, gap: float) -> int:
    while i < len(t) and 0 < t[i] - base_t < gap:
        i += 1
    return i


def counter_rate(samples: DataFrame, quota: float = 1.0, gap_s: float = MIN_INTERVAL_S,
                 bucket_s: float = 3600.0) -> DataFrame:
    """Busy percentage from a cumulative counter: ``pct`` and ``fresh`` per sample.

    ``samples``: device_id, t (seconds), usage_usec, id. A sample closer than ``gap_s`` to the last
    accepted one repeats its reading. Which samples are accepted depends on all earlier ones, so a
    device is cut into time buckets: each bucket first lists where it would end for every possible
    first acceptance (only its opening ``gap_s`` matters), the short lists are chained per device,
    and every bucket is then read with its true starting point.
    """
    dev = samples.schema["device_id"].dataType.simpleString()
    id_type = samples.schema["id"].dataType.simpleString()
    marked = samples.select("device_id", F.floor(F.col("t") / F.lit(bucket_s)).cast("bigint").alias("b"), F.col("t").cast("double").alias("t"),
                            F.col("usage_usec").cast("double").alias("usage"), "id").filter("device_id is not null and b is not null")

    def ends(batches):
        for (device, b), rows in _by(batches, 2):
            t, usage = zip(*((r[2], r[3]) for r in rows))
            opening = t[0] // bucket_s * bucket_s + gap_s
            for first in range(len(t)):
                last, before, i = first, None, _next(t, first + 1, t[first], gap_s)
                while i < len(t):
                    before, last = last, i
                    i = _next(t, i + 1, t[i], gap_s)
                prior = (None, None) if before is None else (t[before], usage[before])
                yield device, b, first, t[first], t[last], usage[last], *prior
                if t[first] >= opening:
                    break

    def chain(batches):
        for device, rows in _by(batches, 1):
            base, settled, begun = None, None, None
            for _, b, _, ft, lt, lu, pt, pu in rows:
                if begun != b:
                    begun, entered = b, base
                    yield device, b, *(base or (None, None, None))
                if settled == b or (entered is not None and ft - entered[0] < gap_s):
                    continue
                settled, end = b, (lt, lu)
                if pt is not None:
                    base = (*end, _busy((pt, pu), end, quota))
                else:
                    base = (*end, 0.0 if entered is None else _busy(entered[:2], end, quota))

    def read(batches):
        for (device, _), rows in _by(batches, 2):
            base = None
            for _, _, sample, t, usage, id_, pct in rows:
                if not sample:
                    base = None if t is None else (t, usage, pct)
                    continue
                accepted = base is None or not 0 < t - base[0] < gap_s
                if accepted:
                    base = (t, usage, 0.0 if base is None else _busy(base[:2], (t, usage), quota))
                yield device, id_, t, base[2], accepted

    def in_runs(rows: DataFrame, keys: list[str], order: list[str], made, schema: str) -> DataFrame:
        """One pass over sorted rows for all buckets of a task; many small groups cost no call each."""
        arrow = to_arrow_schema(_parse_datatype_string(schema))
        return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(lambda batches: _emit(made(batches), arrow), schema)

    bucket = ["device_id", "b"]
    options = in_runs(marked, bucket, ["t", "id"], ends,
                      f"device_id {dev}, b bigint, pos int, ft double, lt double, lu double, pt double, pu double")
    starts = in_runs(options, ["device_id"], ["b", "pos"], chain, f"device_id {dev}, b bigint, bt double, bu double, bp double")
    # The start of a bucket sorts before its samples.
    both = marked.select(*bucket, F.lit(True).alias("sample"), "t", "usage", "id", F.lit(None).cast("double").alias("pct")).union(
        starts.select(*bucket, F.lit(False), "bt", "bu", F.lit(None).cast(id_type), "bp"))
    return in_runs(both, bucket, ["sample", "t", "id"], read, f"device_id {dev}, id {id_type}, t double, pct double, fresh boolean")


def device_summary(devices: DataFrame, facts: DataFrame, pushes: DataFrame, trust: DataFrame,
                   activity: DataFrame) -> DataFrame:
    """Per device: attributes, stored and waiting rows, last push, trust and activity."""
    from factfold.operators.sync import pending_by_priority

    counts = facts.groupBy("device_id").agg(F.count(F.lit(1)).alias("stored"))
    pushed = push_summary(pushes).select("device_id", F.col("ts").alias("last_sync"))
    lines = activity_sparkline(activity, devices)
    return (devices.join(counts, "device_id", "left").join(pending_by_priority(facts), "device_id", "left")
            .join(pushed, "device_id", "left").join(trust.select("device_id", "trust"), "device_id", "left")
            .join(lines, "device_id", "left")
            .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("stored", "urgent", "routine", "held")}))
