"""Queries over the queue of records: outbox, batches, retention, snapshots, ingest, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from factfold.operators import ingest, sync
from factfold.operators.fold import KEY
from factfold.params import GateParams, RetentionParams
from factfold.plans.consensus_queries import fold_ctes, resolved_ctes, trust_ctes
from factfold.plans.registry import query, with_ctes
from factfold.plans.views import ctes, table
from factfold.session import keep, scratch_folder
from factfold.sources.tables import Store

QUEUE = ctes("queue")
LIMIT = 20
RETENTION = RetentionParams(max_points=200, max_thumbnail_bytes=1000)
BUDGET = 20_000
PULL_NS = 852_076_800_000_000_000  # 1997-01-01, inside the order dates
_PRIORITY = "case sync_priority when 'URGENT' then 0 when 'ROUTINE' then 1 when 'HELD' then 2 else 3 end"


@query("outbox", with_ctes(QUEUE, f"""
    select id, device_id, row_number() over (partition by device_id order by {_PRIORITY}, client_sequence, id) as push_rank
    from (select * from queue where synced = 0 and syncable = 1
          qualify row_number() over (partition by device_id order by client_sequence, id) <= {LIMIT}) t"""))
def outbox(spark, sf):
    return sync.outbox(table(spark, sf, "queue"), LIMIT).select("id", "device_id", "push_rank")


@query("pending_retractions", with_ctes(QUEUE, "select id, device_id, client_sequence from queue where synced = 0"))
def pending_retractions(spark, sf):
    return sync.pending_retractions(table(spark, sf, "queue")).select("id", "device_id", "client_sequence")


_SCORED = f"""scored as (select *, greatest(1, bytes) as size, row_number() over (partition by device_id order by
    case when urgent then 0 else 1 end, -(value * (1 + 0.01 * greatest(0, age_s)) / greatest(1, bytes)), client_sequence, id) as pos
    from queue)"""


@query("select_batch", with_ctes(QUEUE + [_SCORED, f"""
    walked as (select device_id, list_reduce(list({{'size': size, 'id': id, 'used': 0::bigint, 'taken': []::bigint[]}} order by pos),
        lambda a, x: case when x.size > {BUDGET} or a.used + x.size <= {BUDGET}
            then {{'size': 0::bigint, 'id': 0::bigint, 'used': a.used + x.size, 'taken': list_append(a.taken, x.id)}}
            else {{'size': 0::bigint, 'id': 0::bigint, 'used': a.used, 'taken': a.taken}} end,
        {{'size': 0::bigint, 'id': 0::bigint, 'used': 0::bigint, 'taken': []::bigint[]}}) as w from scored group by device_id)""",
    "taken as (select device_id, unnest(w.taken) as id from walked)"], """
    select q.id, q.device_id, t.id is not null as selected from queue q left join taken t on t.id = q.id"""))
def select_batch(spark, sf):
    return sync.select_batch(table(spark, sf, "queue"), GateParams(budget_bytes=BUDGET)).select("id", "device_id", "selected")


@query("apply_acks", with_ctes(QUEUE, """
    select id, case when syncable = 1 and urgent then 1 else synced end as synced from queue"""))
def apply_acks(spark, sf):
    q = table(spark, sf, "queue")
    return sync.apply_acks(q, q.filter("syncable = 1 and urgent").select("point_id")).select("id", "synced")


@query("drain_markers", with_ctes(QUEUE, "select id from queue where not urgent"))
def drain_markers(spark, sf):
    q = table(spark, sf, "queue")
    return sync.drain_markers(q, q.filter("urgent").select("point_id")).select("id")


@query("memory_status", with_ctes(QUEUE, f"""
    select device_id, count(*) as used, count_if(synced = 1)::bigint as synced_count, {RETENTION.max_points}::bigint as cap,
           count(*) > {RETENTION.max_points} as over_cap, case when count(*) > {RETENTION.max_points} then 'memory_full' else 'ok' end as status
    from queue group by all"""))
def memory_status(spark, sf):
    return sync.memory_status(table(spark, sf, "queue"), RETENTION)


@query("pending_by_priority", with_ctes(QUEUE, """
    select device_id, count_if(sync_priority = 'URGENT')::bigint as urgent, count_if(sync_priority = 'ROUTINE')::bigint as routine,
           count_if(sync_priority = 'HELD')::bigint as held from queue where synced = 0 and syncable = 1 group by all"""))
def pending_by_priority(spark, sf):
    return sync.pending_by_priority(table(spark, sf, "queue"))


@query("evictable", with_ctes(QUEUE, "select id from queue where synced = 1 or syncable = 0"))
def evictable(spark, sf):
    return sync.evictable(table(spark, sf, "queue")).select("id")


@query("eviction_plan", with_ctes(QUEUE, f"""
    select id, device_id, evict_rank from (
        select q.id, q.device_id, row_number() over (partition by q.device_id order by client_sequence, id) as evict_rank,
               greatest(n - {RETENTION.max_points}, 1) as quota
        from queue q join (select device_id, count(*) as n from queue group by all) t using (device_id)
        where n > {RETENTION.max_points} and (synced = 1 or syncable = 0)) r where evict_rank <= quota"""))
def eviction_plan(spark, sf):
    return sync.eviction_plan(table(spark, sf, "queue"), RETENTION).select("id", "device_id", "evict_rank")


_FULL_IMAGES = """full_images as (select *, coalesce(thumbnail_bytes, 0) as size,
        coalesce(consensus_state in ('CONFIRMED', 'DISPUTED'), false) or sync_priority = 'URGENT' as protected
    from queue where synced = 1 and tier = 'full' and (modality = 'vision' or coalesce(thumbnail_url, '') <> ''))"""


DEMOTION_SQL = QUEUE + [_FULL_IMAGES, f"""
    freed as (select o.*, coalesce(sum(size) over (partition by device_id order by client_sequence, id
                  rows between unbounded preceding and 1 preceding), 0) as freed
        from full_images o where not protected)""", f"""
    plan as (select id, device_id from freed join (select device_id, sum(size) as total from full_images group by all) t using (device_id)
        where total > {RETENTION.max_thumbnail_bytes} and total - freed > {RETENTION.max_thumbnail_bytes})"""]


@query("demotion_plan", with_ctes(DEMOTION_SQL, "select id, device_id from plan"))
def demotion_plan(spark, sf):
    return sync.demotion_plan(table(spark, sf, "queue"), RETENTION).select("id", "device_id")


@query("demote", with_ctes(DEMOTION_SQL, """
    select q.id, case when p.id is not null then 'embedding_only' else tier end as tier,
           case when p.id is null then thumbnail_url end as thumbnail_url from queue q left join plan p on p.id = q.id"""))
def demote(spark, sf):
    q = table(spark, sf, "queue")
    return sync.demote(q, sync.demotion_plan(q, RETENTION)).select("id", "tier", "thumbnail_url")


@query("tier_protected", with_ctes(QUEUE, """
    select id from queue where coalesce(consensus_state in ('CONFIRMED', 'DISPUTED'), false) or sync_priority = 'URGENT'"""))
def tier_protected(spark, sf):
    return table(spark, sf, "queue").filter(sync.tier_protected()).select("id")


@query("live_facts", with_ctes(QUEUE, "select id from queue where tombstoned <> 1 and coalesce(superseded, 0) <> 1"))
def live_facts(spark, sf):
    return sync.live_facts(table(spark, sf, "queue")).select("id")


@query("live_facts_of_reporter", with_ctes(QUEUE, """
    select id from queue where tombstoned <> 1 and coalesce(superseded, 0) <> 1 and device_id = 'dev-7'"""))
def live_facts_of_reporter(spark, sf):
    q = table(spark, sf, "queue").withColumn("reporter_device_id", F.col("device_id"))
    return sync.live_facts(q, "dev-7").select("id")


@query("lookup_fact", with_ctes(ctes("reports"), """
    select o_orderkey from reports where point_id = (select min(point_id) from reports)"""))
def lookup_fact(spark, sf):
    # Written out, so that an id is worked out once for a row and not for each range it is compared with.
    reports = keep(table(spark, sf, "reports").select("point_id", "o_orderkey"), "points")
    wanted = reports.agg(F.min("point_id").cast("string")).first()[0]
    return sync.lookup_fact(reports, wanted).select("o_orderkey")


@query("apply_snapshot", with_ctes(QUEUE, f"""
    select id, shard from queue where shard = 'mutable' and not (synced = 1 and client_timestamp_ns <= {PULL_NS})
    union all select id, 'immutable' as shard from queue where tombstoned <> 1 and coalesce(superseded, 0) <> 1"""))
def apply_snapshot(spark, sf):
    q = table(spark, sf, "queue")
    return sync.apply_snapshot(q, sync.live_facts(q), PULL_NS).select("id", "shard")


@query("withdrawn_ids", with_ctes(QUEUE, """
    select distinct kind, id as point_id from (select id, 'retracted' as kind from queue where tombstoned = 1
        union all select id, 'superseded' from queue where superseded = 1) t"""))
def withdrawn_ids(spark, sf):
    return sync.withdrawn_ids(table(spark, sf, "queue"))


@query("apply_withdrawals", with_ctes(QUEUE, "select id from queue where tombstoned <> 1 and coalesce(superseded, 0) <> 1"))
def apply_withdrawals(spark, sf):
    q = table(spark, sf, "queue")
    return sync.apply_withdrawals(q, sync.withdrawn_ids(q)).select("id")


_TWICE = """twice as (select * replace (id % 4000 as point_id) from queue)"""


@query("first_shard_wins", with_ctes(QUEUE + [_TWICE], """
    select id, point_id, shard from twice qualify row_number() over (partition by point_id
        order by case when shard = 'mutable' then 0 else 1 end, client_timestamp_ns desc, id desc) = 1"""))
def first_shard_wins(spark, sf):
    q = table(spark, sf, "queue").withColumn("client_timestamp_ns", F.col("client_timestamp_ns") + F.col("id"))
    return sync.first_shard_wins(q.withColumn("point_id", F.col("id") % 4000)).select("id", "point_id", "shard")


@query("memory_listing", with_ctes(QUEUE, """
    select id, case when synced = 1 then 'synced' when syncable = 0 then 'local_only' else 'pending' end as sync_state
    from queue where modality = 'vision' and zone = 'z1' and not synced = 1 and syncable = 1
    order by client_timestamp_ns desc, id limit 25 offset 10"""))
def memory_listing(spark, sf):
    return sync.memory_listing(table(spark, sf, "queue"), 25, 10, state="pending", modality="vision", zone="z1").select(
        "id", "sync_state")


@query("purge_tagged", with_ctes(QUEUE + ctes("places"), """
    select 'queue' as "table", count_if(demo = 1)::bigint as dropped from queue
    union all select 'places', count_if(c_custkey % 23 = 0)::bigint from places"""))
def purge_tagged(spark, sf):
    places = table(spark, sf, "places").withColumn("demo", F.when(F.col("c_custkey") % 23 == 0, 1))
    _, report = sync.purge_tagged({"queue": table(spark, sf, "queue"), "places": places})
    return report


@query("orphan_files", with_ctes(QUEUE, """
    select '/data/thumbnails/thumb_' || o_orderkey || '.jpg' as path from orders
    where o_orderkey not in (select id from queue where thumbnail_url is not null)"""))
def orphan_files(spark, sf):
    files = table(spark, sf, "orders").select(
        F.concat(F.lit("/data/thumbnails/thumb_"), F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("path"))
    return sync.orphan_files(files, table(spark, sf, "queue"))


# --- ingest ---------------------------------------------------------------------------------

INGEST_SQL = ctes("reports") + [
    f"""batch as (select *, md5(device_id || ':' || point_id || ':' || client_sequence) as event_id from reports)""",
    f"stored_facts as (select distinct point_id from reports where client_timestamp_ns <= {PULL_NS} and device_id <> 'dev-3')",
    f"stored_events as (select distinct event_id from batch where client_timestamp_ns <= {PULL_NS})"]


def _ingested(spark, sf):
    batch = table(spark, sf, "reports")
    earlier = batch.filter(F.col("client_timestamp_ns") <= PULL_NS)
    facts = earlier.filter("device_id <> 'dev-3'").select("point_id").distinct()
    events = ingest.ingest_batch(earlier, facts.limit(0), facts.limit(0).withColumn("event_id", F.lit("")), 0).events
    return ingest.ingest_batch(batch, facts, events, high_water=1000)


@query("ingest_facts", with_ctes(INGEST_SQL, """
    select point_id::varchar as point_id, arg_min(o_orderkey, received_at_ns) as o_orderkey from batch
    where point_id not in (select point_id from stored_facts) group by all"""))
def ingest_facts(spark, sf):
    return _ingested(spark, sf).facts.select(F.col("point_id").cast("string").alias("point_id"), "o_orderkey")


@query("ingest_events", with_ctes(INGEST_SQL + [
    """fresh as (select event_id, min(received_at_ns) as received_at_ns, arg_min(o_orderkey, received_at_ns) as o_orderkey from batch
        where event_id not in (select event_id from stored_events) group by event_id)"""], """
    select event_id, o_orderkey, 1000 + row_number() over (order by received_at_ns, event_id) as seq from fresh"""))
def ingest_events(spark, sf):
    return _ingested(spark, sf).events.select("event_id", "o_orderkey", "seq")


@query("ingest_acks", with_ctes(ctes("reports"), "select distinct point_id::varchar as point_id from reports"))
def ingest_acks(spark, sf):
    return _ingested(spark, sf).acks.select(F.col("point_id").cast("string").alias("point_id"))


@query("delta_cursor", with_ctes(ctes("reports"), """
    select c.device_id, coalesce(max(client_sequence), -1) as client_sequence
    from (select distinct 'dev-' || c_custkey % 60 as device_id from customer) c left join reports using (device_id) group by all"""))
def delta_cursor(spark, sf):
    devices = table(spark, sf, "customer").select(
        F.concat(F.lit("dev-"), (F.col("c_custkey") % 60).cast("string")).alias("device_id"))
    return ingest.delta_cursor(table(spark, sf, "reports"), devices)


@query("device_sequence", with_ctes(ctes("metrics"), """
    select id, device_id, coalesce(m, 0) + row_number() over (partition by device_id order by ts, id) as client_sequence
    from metrics left join (select 'dev-' || c_custkey as device_id, c_nationkey::bigint as m from customer) t using (device_id)"""))
def device_sequence(spark, sf):
    stored = table(spark, sf, "customer").select(
        F.concat(F.lit("dev-"), F.col("c_custkey").cast("string")).alias("device_id"),
        F.col("c_nationkey").cast("bigint").alias("client_sequence"))
    return ingest.assign_device_sequence(table(spark, sf, "metrics"), stored).select("id", "device_id", "client_sequence")


# --- streams --------------------------------------------------------------------------------

def _files(spark) -> int:
    """Files in which a batch of a stream is written, one for each core."""
    return max(2, spark.sparkContext.defaultParallelism)


def _streamed(spark, sf, name: str):
    """The reports sent through the ingest stream in several micro-batches, twice over."""
    from factfold.streaming import feeds

    store = Store(spark, scratch_folder(spark, name))
    source = scratch_folder(spark, name + "-in")
    reports = table(spark, sf, "reports").withColumn("point_id", F.col("point_id").cast("decimal(20,0)"))
    shaped = reports.select("point_id", "device_id", KEY, "value", "zone", "modality", "client_sequence",
                            "client_timestamp_ns", "received_at_ns")
    files = _files(spark)
    shaped.repartitionByRange(files, "received_at_ns").write.parquet(source)
    # A full retry of everything: it must add nothing. Copied from the files, so that the ids are not worked out again.
    spark.read.schema(shaped.schema).parquet(source).coalesce(files).write.mode("append").parquet(source)
    stream = spark.readStream.schema(shaped.schema).option("maxFilesPerTrigger", files).parquet(source)
    feeds.run(stream, feeds.ingest_step(store), scratch_folder(spark, name + "-cp")).awaitTermination()
    return store


STREAM_LOG = ctes("reports") + [
    """stream_log as (select corroboration_key, device_id, value, 'OBSERVED' as event_type, client_sequence, modality,
        min(received_at_ns) as received_at_ns, client_sequence as seq, null::double as device_trust_at_report, null::varchar as value_cluster
        from reports group by all)"""]


# Numbers are distinct and without a gap from 1 when their count, least and greatest say so.
@query("stream_ingest_events", with_ctes(INGEST_SQL, "select event_id, true as numbered from batch group by event_id"))
def stream_ingest_events(spark, sf):
    log = _streamed(spark, sf, "ingest").events()
    n = F.count(F.lit(1))
    whole = log.agg(((F.count_distinct("seq") == n) & (F.min("seq") == 1) & (F.max("seq") == n)).alias("numbered"))
    return log.select("event_id").crossJoin(F.broadcast(whole))


def _send_twice(spark, rows, step, name: str) -> None:
    """Drain ``rows`` through a step, and once more as a retry that must add nothing."""
    from factfold.streaming import feeds

    source = scratch_folder(spark, name + "-in")
    rows.write.parquet(source)
    for turn in ("first", "retry"):
        stream = spark.readStream.schema(rows.schema).parquet(source)
        feeds.run(stream, step, scratch_folder(spark, f"{name}-{turn}-cp")).awaitTermination()


@query("stream_resolutions", with_ctes(ctes("reports"), """
    select 'r' || o_orderkey as request_id, corroboration_key, value, 'op-' || o_orderkey % 3 as resolver_id from reports"""))
def stream_resolutions(spark, sf):
    """A decision for every report."""
    from factfold.streaming import feeds

    store = _streamed(spark, sf, "resolutions")
    decisions = table(spark, sf, "reports").select(
        F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("request_id"), KEY, "value",
        F.concat(F.lit("op-"), (F.col("o_orderkey") % 3).cast("string")).alias("resolver_id"), "received_at_ns")
    _send_twice(spark, decisions, feeds.resolution_step(store), "decisions")
    return store.events().filter("event_type = 'RESOLVED'").select(F.col("event_id").alias("request_id"), KEY, "value", "resolver_id")


@query("stream_retractions", with_ctes(ctes("reports"), """
    select device_id, point_id::varchar as point_id, max(client_sequence) + 1000000000 as client_sequence, corroboration_key
    from reports group by all"""))
def stream_retractions(spark, sf):
    from factfold.streaming import feeds

    """A withdrawal of every point by every device that reported it."""
    store = _streamed(spark, sf, "retractions")
    requests = table(spark, sf, "reports").groupBy("device_id", F.col("point_id").cast("decimal(20,0)").alias("point_id"), KEY).agg(
        (F.max("client_sequence") + 1000000000).alias("client_sequence"), F.max("received_at_ns").alias("received_at_ns"))
    _send_twice(spark, requests, feeds.retraction_step(store), "withdrawals")
    return store.events().filter("event_type = 'RETRACTED'").select(
        "device_id", F.col("point_id").cast("string").alias("point_id"), "client_sequence", KEY)


@query("stream_cursor", with_ctes(ctes("fact_events"), """
    select device_id, max(client_sequence) as client_sequence from fact_events group by all"""))
def stream_cursor(spark, sf):
    from factfold.streaming import feeds

    source, target = scratch_folder(spark, "cursor-in"), scratch_folder(spark, "cursor")
    log = table(spark, sf, "fact_events").select("device_id", "client_sequence")
    log.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(source)

    def step(state, batch_id):
        state.write.mode("overwrite").parquet(target)

    writer = ingest.delta_cursor(stream).writeStream.outputMode("complete").foreachBatch(step)
    writer.option("checkpointLocation", scratch_folder(spark, "cursor-cp")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target)


@query("stream_dedupe", with_ctes(ctes("reports"), "select distinct device_id || ':' || o_orderkey as id, corroboration_key, value from reports"))
def stream_dedupe(spark, sf):
    """Every report sent three times, in batches that mix first and later sendings."""
    from factfold.sources.id_index import IdIndex, dedupe_step
    from factfold.streaming import feeds

    source, store = scratch_folder(spark, "dedupe-in"), Store(spark, scratch_folder(spark, "dedupe"))
    reports = table(spark, sf, "reports").select(F.concat_ws(":", "device_id", "o_orderkey").alias("id"), KEY, "value")
    files = _files(spark)
    reports.unionByName(reports).unionByName(reports).repartition(4 * files).write.parquet(source)
    stream = spark.readStream.schema(reports.schema).option("maxFilesPerTrigger", files).parquet(source)
    step = dedupe_step(IdIndex(store, merge_at=2), "records")
    feeds.run(stream, step, scratch_folder(spark, "dedupe-cp")).awaitTermination()
    return store.read("records", f"id string, {KEY} string, value string, batch_id bigint").drop("batch_id")


@query("stream_verdict_changes", with_ctes(ctes("decided_events") + fold_ctes("decided_events") + resolved_ctes("decided_events"),
                                           "select corroboration_key, status, value, confidence from final"))
def stream_verdict_changes(spark, sf):
    """The last change of every key, the log sent in several micro-batches, in no order."""
    from factfold.streaming import changes, feeds

    log, source = table(spark, sf, "decided_events"), scratch_folder(spark, "changes-in")
    files = _files(spark)
    log.repartition(3 * files).write.parquet(source)
    store = Store(spark, scratch_folder(spark, "changes"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", files).parquet(source)
    feeds.run_changes(stream, store, scratch_folder(spark, "changes-cp")).awaitTermination()
    return changes.current_verdicts(store.verdict_changes()).select(KEY, "status", "value", "confidence")


@query("stream_verdicts", with_ctes(STREAM_LOG + trust_ctes("stream_log", "dt", per_key=True)
                                    + fold_ctes("stream_log", trust="dt", per_key=True),
                                    "select corroboration_key, status, value, confidence from verdict"))
def stream_verdicts(spark, sf):
    from factfold.streaming import feeds

    return feeds.latest_verdicts(_streamed(spark, sf, "verdicts"))
