"""Streams over a store. Every batch may be replayed: writes are insert-if-absent by id.

The hub sequence has one writer: the steps of one store run in one application, one at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factfold.functions.ids import event_id
from factfold.functions.labels import display_state
from factfold.operators.capture import decide, novelty
from factfold.operators.clustering import assign_value_cluster
from factfold.operators.fold import KEY, OBSERVED, RESOLVED
from factfold.operators.ingest import assign_hub_sequence, first_unseen, new_rows, with_event_id
from factfold.operators.state import fold_with_key_trust, resolve, retract, tombstones
from factfold.params import FoldParams, PolicyParams, TrustParams
from factfold.session import keep
from factfold.sources.tables import BUCKET, Store, conform, key_bucket

VERDICTS = f"{KEY} string, status string, value string, confidence double, as_of bigint, recorded_us bigint, {BUCKET} int"
POINTS = "point_id decimal(20,0)"
REJECTS = "device_id string, point_id decimal(20,0), client_sequence bigint"
HUB_META = "batch_id bigint, high_water bigint"
FOLDED = "high_water bigint"
CAPTURES = ("capture_id string, point_id decimal(20,0), device_id string, slot string, vec array<double>, "
            "value string, client_sequence bigint")


def run(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start ``step`` on every micro-batch; ``once`` drains what is there and stops."""
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def run_changes(log: DataFrame, store: Store, checkpoint: str, params: FoldParams = FoldParams(), once: bool = True) -> StreamingQuery:
    """Feed a stream of log rows to the stateful judge and record every change of a verdict.

    A micro-batch has a folder of its own, which a replay writes again; nothing is read back.
    """
    from factfold.streaming.changes import state_maps, verdict_changes as changed

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store.path('verdict_changes')}/batch_id={batch_id}")

    with state_maps(store.spark):
        writer = changed(log, params).writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()


def dedupe_within(stream: DataFrame, delay: str, time_col: str = "received_at") -> DataFrame:
    """Bounded-state dedupe by event id. Exact, for ever, is the anti-join of ``ingest_step``."""
    ids = stream.withColumn("event_id", event_id(F.col("device_id"), F.col("point_id"), F.col("client_sequence")))
    return ids.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["event_id"])


def high_water(store: Store) -> int:
    """Highest hub sequence handed out; one small row per batch is read, never the log."""
    return store.read("hub_meta", HUB_META).agg(F.coalesce(F.max("high_water"), F.lit(0))).first()[0]


def _number(store: Store, events: DataFrame, batch_id: int) -> DataFrame:
    # Reserve the range before the log is written: a crash may leave a gap, never a repeat.
    start = high_water(store)
    numbered = assign_hub_sequence(events, start)
    reserved = store.spark.createDataFrame([(batch_id, start + numbered.count())], HUB_META)
    store.append("hub_meta", reserved)
    return numbered


def cluster_new(store: Store, events: DataFrame) -> DataFrame:
    """Clusters of new reports, given the founders their keys already have."""
    log = store.events_for_keys(events).filter((F.col("event_type") == OBSERVED) & F.col("value_cluster").isNotNull())
    founders = log.groupBy(KEY, "value_cluster").agg(
        F.min_by(F.struct("point_id", "value", "seq"), "seq").alias("f")).select(KEY, "f.*")
    held = store.facts().filter(F.col(BUCKET).isin(store.touched(events)))
    vectors = held.groupBy("point_id").agg(F.first(F.col("vectors")["text"]).alias("vec"))
    old = founders.join(vectors, "point_id", "left").withColumn("event_id", F.lit(None).cast("string"))
    both = events.select(KEY, "point_id", "value", "seq", "vec", "event_id").unionByName(
        old.select(KEY, "point_id", "value", "seq", "vec", "event_id"))
    found = assign_value_cluster(both).filter(F.col("event_id").isNotNull()).select("event_id", "value_cluster")
    return events.drop("value_cluster").join(found, "event_id", "left")


def _newest(log: DataFrame) -> DataFrame:
    """The rows of a log that its fold can depend on: per key and device the newest decision, and the newest of the others.

    Only numbers are compared, which Spark combines without sorting the log. Ties stay in for the fold to settle.
    """
    decided = F.col("event_type").eqNullSafe(RESOLVED)
    at = F.when(decided, F.col("seq")).otherwise(F.coalesce("client_sequence", "seq"))
    ends = log.groupBy(F.col(KEY).alias("_key"), F.col("device_id").alias("_device"), decided.alias("_decided")).agg(
        F.max(at).alias("_at"), F.max("seq").alias("_seq"))
    ends = keep(ends, "ends")  # kept, so that Spark knows how small it is and does not shuffle the log for it
    same = (F.col(KEY).eqNullSafe(F.col("_key")) & F.col("device_id").eqNullSafe(F.col("_device")) & (decided == F.col("_decided")))
    newest = at.eqNullSafe(F.col("_at")) | F.col("seq").eqNullSafe(F.col("_seq"))
    return log.join(ends, same & newest, "left_semi")


def refold(store: Store, keys: DataFrame, fold: FoldParams = FoldParams(),
           trust: TrustParams = TrustParams()) -> DataFrame:
    """Fold the given keys again and record the verdicts that changed.

    ``as_of`` is the hub sequence reached, which orders the changes of all streams of a store.
    """
    log = store.events_for_keys(keys)
    if not fold.decisions_compete:
        log = _newest(log)
    fresh = fold_with_key_trust(log, fold, trust).select(KEY, "status", "value", "confidence")
    near = F.col(BUCKET).isin(store.touched(keys))
    known = latest_verdicts(store, near).select(KEY, *[F.col(c).alias(f"_{c}") for c in ("status", "value", "confidence")])
    changed = fresh.join(known, KEY, "left").filter(
        ~(F.col("status").eqNullSafe(F.col("_status")) & F.col("value").eqNullSafe(F.col("_value"))
          & F.col("confidence").eqNullSafe(F.col("_confidence"))))
    rows = keep(changed.select(KEY, "status", "value", "confidence",
                               F.lit(high_water(store)).cast("bigint").alias("as_of"),
                               F.unix_micros(F.current_timestamp()).alias("recorded_us")).withColumn(BUCKET, key_bucket(KEY, store.buckets)))
    store.append("verdicts", rows, BUCKET)
    return rows


def refold_new(store: Store, fold: FoldParams = FoldParams(), trust: TrustParams = TrustParams()) -> None:
    """Fold every key with events that no fold has seen, whichever batch brought them.

    How far the log is folded is noted after the verdicts are written: a replay after a lost write folds again what was
    not noted, and a retry that adds nothing folds nothing.
    """
    done, reached = store.read("folded", FOLDED).agg(F.coalesce(F.max("high_water"), F.lit(0))).first()[0], high_water(store)
    if reached > done:
        refold(store, keep(store.events().filter(F.col("seq") > done).select(KEY).distinct(), "keys"), fold, trust)
        store.append("folded", store.spark.createDataFrame([(reached,)], FOLDED))


def verdict_changes(store: Store) -> DataFrame:
    """Every recorded change of a key's verdict; a streaming read of the same folder is the change feed."""
    return store.read("verdicts", VERDICTS)


def latest_verdicts(store: Store, where: Column | None = None) -> DataFrame:
    """The verdict each key has now."""
    row = F.struct("status", "value", "confidence")
    rows = verdict_changes(store) if where is None else verdict_changes(store).filter(where)
    return rows.groupBy(KEY).agg(F.max_by(row, F.struct("as_of", "recorded_us")).alias("v")).select(KEY, "v.*")


def ingest_step(store: Store, fold: FoldParams = FoldParams(), trust: TrustParams = TrustParams(),
                cluster: bool = False) -> Callable[[DataFrame, int], None]:
    """Ingest one micro-batch: new facts and events, sequence, clusters, verdicts of touched keys."""
    def step(batch: DataFrame, batch_id: int) -> None:
        # Written once: a micro-batch is read and turned into rows again by every use, whatever columns that needs.
        reports = keep(with_event_id(batch), "batch")
        if reports.isEmpty():
            return
        # An id depends on the key, so only the buckets of this batch can hold a repeat.
        near = F.col(BUCKET).isin(store.touched(reports))
        facts, events = new_rows(reports, store.facts().filter(near), store.events().filter(near))
        facts = keep(facts)
        numbered = _number(store, events, batch_id)
        if cluster:
            numbered = cluster_new(store, keep(numbered))
        store.append_events(numbered)
        if "vec" in facts.columns:
            facts = facts.withColumn("vectors", F.when(F.col("vec").isNotNull(), F.create_map(F.lit("text"), "vec")))
        store.append_facts(facts)
        refold_new(store, fold, trust)
    return step


def retraction_step(store: Store, fold: FoldParams = FoldParams()) -> Callable[[DataFrame, int], None]:
    """Withdrawals: log them, tombstone points nobody asserts any more, refold their keys."""
    def step(batch: DataFrame, batch_id: int) -> None:
        if "received_at_ns" not in batch.columns:
            batch = batch.withColumn("received_at_ns", F.unix_micros(F.current_timestamp()) * 1000)
        batch = keep(batch, "batch")
        if batch.isEmpty():
            return
        found, rejected = retract(store.events(), batch)
        found = keep(with_event_id(found), "found")
        near = F.col(BUCKET).isin(store.touched(found))
        store.append_events(_number(store, first_unseen(found, store.events().filter(near), "event_id"), batch_id))
        gone = tombstones(store.events_for_keys(found), batch)
        store.append_new("tombstones", gone, POINTS)
        store.append_new("rejects", rejected.select("device_id", "point_id", "client_sequence"), REJECTS)
        refold_new(store, fold)
    return step


def resolution_step(store: Store, fold: FoldParams = FoldParams()) -> Callable[[DataFrame, int], None]:
    """Operator decisions (corroboration_key, value, resolver_id, received_at_ns, request_id)."""
    def step(batch: DataFrame, batch_id: int) -> None:
        batch = keep(batch, "batch")
        if batch.isEmpty():
            return
        # The log row carries the request's id, so the log itself tells which requests were written.
        near = F.col(BUCKET).isin(store.touched(batch))
        known = store.events().filter(near).select(F.col("event_id").alias("request_id"))
        fresh = first_unseen(batch, known, "request_id").withColumn("event_id", F.col("request_id"))
        numbered = _number(store, fresh, batch_id).drop("event_id")
        events, _ = resolve(store.facts().filter(near), numbered)
        store.append_events(events.withColumns({"device_id": F.col("resolver_id"), "event_id": F.col("request_id")}))
        # What lost follows from the log, so a replay after a lost write finds it again.
        decisions = store.events_for_keys(batch).filter(F.col("event_type") == RESOLVED).select(KEY, "value", "resolver_id", "seq")
        _, losers = resolve(store.facts().filter(near), decisions)
        store.append_new("superseded", losers.select("point_id"), POINTS)
        refold_new(store, fold)
    return step


def decision_step(store: Store, policy: PolicyParams = PolicyParams()) -> Callable[[DataFrame, int], None]:
    """One decision per capture as it arrives, judged against what its device already holds."""
    def step(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        held = store.read("captures", CAPTURES)
        devices = batch.select("device_id").distinct()
        history = held.join(devices, "device_id", "left_semi").join(
            batch.select("capture_id"), "capture_id", "left_anti")
        vectors = batch.withColumn("vec", F.col("vec").cast("array<double>"))
        decided = keep(decide(novelty(vectors, policy, history=history), policy))
        known = held.select("capture_id")
        # Each table is asked for itself, so a crash between the two writes repeats neither.
        fresh = decided.join(store.read("decision_feed", "capture_id string"), "capture_id", "left_anti")
        store.append("decision_feed", fresh.select(
            "capture_id", "device_id", "verdict", "reason", "sync_priority", "novelty", "urgency",
            F.lit(batch_id).cast("bigint").alias("batch_id")))
        store.append("captures", conform(batch, CAPTURES).dropDuplicates(["capture_id"]).join(known, "capture_id", "left_anti"))
    return step


def current_facts(store: Store) -> DataFrame:
    """Facts with withdrawal, decision and consensus state laid over them."""
    gone = store.read("tombstones", POINTS).distinct().withColumn("_gone", F.lit(1))
    lost = store.read("superseded", POINTS).distinct().withColumn("_lost", F.lit(1))
    states = latest_verdicts(store).select(KEY, display_state(F.col("status")).alias("_state"),
                                           F.col("confidence").alias("_confidence"))
    rows = store.facts().join(gone, "point_id", "left").join(lost, "point_id", "left").join(states, KEY, "left")
    return rows.withColumns({
        "tombstoned": F.coalesce("_gone", "tombstoned", F.lit(0)),
        "superseded": F.coalesce("_lost", "superseded", F.lit(0)),
        "consensus_state": F.coalesce("_state", "consensus_state"),
        "confidence": F.coalesce("_confidence", "confidence"),
    }).drop("_gone", "_lost", "_state", "_confidence")
