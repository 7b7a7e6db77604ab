"""Queries over samples, pushes and input files."""

from __future__ import annotations

from pyspark.sql import functions as F

from factfold.operators import monitor
from factfold.operators.fold import KEY
from factfold.plans import pipelines
from factfold.plans.consensus_queries import fold_ctes
from factfold.plans.registry import query, with_ctes
from factfold.plans.views import ctes, table
from factfold.sources import files

METRICS = ctes("metrics")
PUSHES = ctes("pushes")


@query("recent_latency", with_ctes(METRICS, """
    select v[n // 2 + 1] as p50, v[least(floor(n * 0.95::double)::bigint, n - 1) + 1] as p95
    from (select list_sort(list(value)) as v, count(*) as n from metrics
          where ts > (select max(ts) from metrics) - interval 2 days) s"""))
def recent_latency(spark, sf):
    return monitor.recent_latency(table(spark, sf, "metrics"), 2 * 86400)


@query("latency_report", with_ctes(METRICS, """
    select event_type, case when n % 2 = 1 then v[n // 2 + 1] else (v[n // 2] + v[n // 2 + 1]) / 2 end as p50,
           v[((n - 1) * 0.95)::double::int - case when ((n - 1) * 0.95)::double::int > (n - 1) * 0.95 then 1 else 0 end + 1] as p95,
           v[1] as min, v[n] as max, n
    from (select event_type, list_sort(list(value)) as v, count(*) as n from metrics group by all) t"""))
def latency_report(spark, sf):
    return monitor.latency_report(table(spark, sf, "metrics"), ["event_type"])


# The sequential rule as a fold: the state is the last accepted sample, ``o`` the readings so far.
@query("counter_rate", with_ctes(METRICS + [
    """counted as (select device_id, list({'t': t, 'u': t * 1e5::double, 'p': 0.0::double, 'o': [{'id': id, 'pct': 0.0::double, 'fresh': true}]}
        order by t, id) as l from metrics group by all)""",
    """walked as (select device_id, list_reduce(l, lambda s, x: case
        when x.t - s.t > 0 and x.t - s.t < 3600
        then {'t': s.t, 'u': s.u, 'p': s.p, 'o': list_append(s.o, {'id': x.o[1].id, 'pct': s.p, 'fresh': false})}
        else {'t': x.t, 'u': x.u, 'p': case when x.t > s.t and x.u >= s.u then (x.u - s.u) / 1e6::double / (x.t - s.t) / 2.0::double * 100.0::double else 0.0::double end,
              'o': list_append(s.o, {'id': x.o[1].id, 'fresh': true, 'pct':
                  case when x.t > s.t and x.u >= s.u then (x.u - s.u) / 1e6::double / (x.t - s.t) / 2.0::double * 100.0::double else 0.0::double end})} end) as w
        from counted)"""], """
    select device_id, o.id as id, round(o.pct, 6) as pct, o.fresh as fresh from (select device_id, unnest(w.o) as o from walked) r"""))
def counter_rate(spark, sf):
    rows = table(spark, sf, "metrics").select("device_id", "id", "t", (F.col("t") * F.lit(1e5)).alias("usage_usec"))
    rates = monitor.counter_rate(rows, quota=2.0, gap_s=3600.0, bucket_s=5 * 86400.0)
    return rates.select("device_id", "id", F.round("pct", 6).alias("pct"), "fresh")


@query("activity_sparkline", with_ctes(METRICS, """
    select device_id, array_to_string(list_transform(range(12), lambda i: greatest(0, least(w, n - i * w))), ',') as sparkline
    from (select device_id, coalesce(n, 0) as n, greatest(1, ceil(coalesce(n, 0) / 12))::bigint as w
          from (select distinct device_id from metrics) d left join (
              select device_id, count(*) as n from metrics group by all) c
          using (device_id)) t"""))
def activity_sparkline(spark, sf):
    m = table(spark, sf, "metrics")
    return monitor.activity_sparkline(m, m).withColumn("sparkline", F.array_join(F.col("sparkline").cast("array<string>"), ","))


@query("activity_feed", with_ctes(METRICS, """
    select id, device_id from metrics where event_type = 'purchase' order by ts desc, id desc limit 50"""))
def activity_feed(spark, sf):
    m = table(spark, sf, "metrics").withColumn("kind", F.col("event_type"))
    return monitor.feed(m, 50, kind="purchase").select("id", "device_id")


@query("push_summary", with_ctes(PUSHES, """
    select device_id, push_id, bytes, duration_ms, attempted, accepted, failed, urgent, routine, mode from pushes
    qualify row_number() over (partition by device_id order by ts desc, push_id desc) = 1"""))
def push_summary(spark, sf):
    return monitor.push_summary(table(spark, sf, "pushes")).drop("ts", "ok")


@query("failure_backoff", with_ctes(PUSHES + ["good as (select device_id, max(ts) as t from pushes where ok group by all)"], """
    select device_id, count_if(not ok and (t is null or ts > t))::bigint as failures,
           (case when count_if(not ok and (t is null or ts > t)) = 0 then 0
                else least(60000, 1000 * pow(2, count_if(not ok and (t is null or ts > t))::bigint - 1)) end)::bigint as next_retry_ms
    from pushes left join good using (device_id) group by device_id"""))
def failure_backoff(spark, sf):
    return monitor.failure_backoff(table(spark, sf, "pushes"))


@query("facet_counts", "select lang as facet, count(*) as n from documents group by all")
def facet_counts(spark, sf):
    return monitor.facet_counts(table(spark, sf, "documents"), "lang")


@query("hash_sample", "select doc_id from documents order by sha256(text), doc_id limit 100")
def hash_sample(spark, sf):
    return monitor.hash_sample(table(spark, sf, "documents").select("doc_id", "text"), "text", 100).select("doc_id")


@query("cap_per_label", """
    with seen as (select lang as label, 'p' || doc_id // 2 as path from documents),
         single as (select path, min(label) as label from seen group by path having count(distinct label) = 1)
    select path, label, row_number() over (partition by label order by path) as rn from single qualify rn <= 20""")
def cap_per_label(spark, sf):
    pages = table(spark, sf, "documents").select(
        F.col("lang").alias("label"), F.concat(F.lit("p"), F.floor(F.col("doc_id") / 2).cast("string")).alias("path"))
    return monitor.cap_per_label(pages, 20)


_LINES = """lines as (select event_id, case when event_id % 50 = 0 then 'bad line here' else
    (event_id * 0.5)::double || '  ' || (value * 12)::double || ' ' || ((user_id % 80) * 0.75)::double end as value from events)"""


def _gas_lines(spark, sf):
    joined = F.concat_ws(" ", (F.col("event_id") * 0.5).cast("string"), F.lit(""), (F.col("value") * 12).cast("string"),
                         ((F.col("user_id") % 80) * 0.75).cast("string"))
    return table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 50 == 0, "bad line here").otherwise(
        joined).alias("value"))


@query("gas_lines", with_ctes([_LINES], """
    select event_id, p[1]::double as time_s, round(p[2]::double, 6) as methane_ppm, p[3]::double as ethylene_ppm
    from (select event_id, regexp_split_to_array(trim(value), '\\s+') as p from lines where event_id % 50 <> 0) t"""))
def gas_lines(spark, sf):
    return files.parse_gas_lines(_gas_lines(spark, sf)).filter("valid").select(
        "event_id", "time_s", F.round("methane_ppm", 6).alias("methane_ppm"), "ethylene_ppm")


GAS_SQL = ["""numbered as (select *, row_number() over (order by event_id) - 1 as i, count(*) over () as total from events)""",
           """kept as (select *, row_number() over (order by event_id) - 1 as j from numbered
               where i % greatest(1, total // 500) = 0 and event_id % 50 <> 0)""",
           """labelled as (select j, value * 12 as m, (user_id % 80) * 0.75::double as e, event_id * 0.5::double as t from kept)""",
           """gas as (select *, ['zone_a', 'zone_b', 'zone_c', 'zone_d'][j % 4 + 1] as zone,
               case when m >= 1000 and e >= 50 then 'combined_hazard' when m >= 1000 then 'methane_high' when e >= 50 then 'ethylene_high'
                    when m >= 250 then 'methane_low' when e >= 5 then 'ethylene_low' else 'safe' end as label from labelled)"""]


@query("gas_captures", with_ctes(GAS_SQL, """
    select 'gas_' || lpad(j::varchar, 4, '0') as scenario_id, zone || '.gas_' || label as corroboration_key, zone, label,
           round(m, 2) as methane_ppm, round(e, 4) as ethylene_ppm, round(t, 2) as time_s from gas"""))
def gas_captures(spark, sf):
    return pipelines.gas_captures(_gas_lines(spark, sf), "event_id", 500).drop("value")


@query("gas_labels", with_ctes(GAS_SQL, "select label as facet, count(*) as n from gas group by all"))
def gas_labels(spark, sf):
    return pipelines.gas_labels(pipelines.gas_captures(_gas_lines(spark, sf), "event_id", 500))


@query("message_column", "select text from documents where text is not null")
def message_column(spark, sf):
    return files.pick_messages(table(spark, sf, "documents").select("doc_id", "lang", "text"))


@query("export_messages", """
    select 'dr_' || lpad((row_number() over (order by doc_id) - 1)::varchar, 6, '0') as id, t as text,
           'disaster_response_messages' as source, 'text' as type
    from (select doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as t from documents) d where t <> ''""")
def export_messages(spark, sf):
    return files.export_messages(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


@query("export_messages_hashed", """
    select 'dr_' || substr(sha256(t), 1, 16) as id, t as text, 'disaster_response_messages' as source, 'text' as type
    from (select regexp_replace(text, '^\\s+|\\s+$', '', 'g') as t from documents) d where t <> ''""")
def export_messages_hashed(spark, sf):
    return files.export_messages(table(spark, sf, "documents").select("text"))


@query("message_captures", """
    select doc_id, text as value, 'dev-0' || (h % 4 + 1) as device_id,
           ['zone_a', 'zone_b', 'zone_c', 'zone_d'][(h // 4 % 4)::bigint + 1] as zone
    from (select doc_id, text, ('0x' || substr(sha256(text), 57, 8))::ubigint as h from documents) t""")
def message_captures(spark, sf):
    rows = pipelines.message_captures(table(spark, sf, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "value", "device_id", "zone")


def _scenarios(spark, sf):
    """Each order as a scenario: its lines are the reports, its status the truth."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(
        "l_linenumber", F.concat(F.lit("dev-"), F.col("l_suppkey").cast("string")).alias("device_id"),
        F.col("l_linestatus").alias("value"), F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("device_ts")))).alias("r"))
    orders = table(spark, sf, "orders")
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey).select(
        F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("scenario_id"),
        F.concat(F.lit("order."), F.col("o_orderkey").cast("string")).alias(KEY), F.lit("zone").alias("zone"),
        F.col("o_orderstatus").alias("ground_truth"),
        F.transform("r", lambda x: F.struct(x["device_id"].alias("device_id"), x["value"].alias("value"),
                                            x["device_ts"].alias("device_ts"))).alias("reports"))


SCENARIO_REPORTS = ["""reports_log as (select 's' || l_orderkey as corroboration_key, 'dev-' || l_suppkey as device_id,
        l_linestatus as value, row_number() over (partition by l_orderkey order by l_linenumber, 'dev-' || l_suppkey, l_linestatus, l_shipdate) as seq,
        'OBSERVED' as event_type, l_shipdate, null::bigint as client_sequence, null::varchar as modality,
        null::varchar as value_cluster, null::double as device_trust_at_report, null::bigint as received_at_ns
    from lineitem join orders on o_orderkey = l_orderkey)"""]


@query("scenario_events", with_ctes(SCENARIO_REPORTS, """
    select corroboration_key, device_id, value, seq, epoch_us(l_shipdate) // 1000000 as device_s from reports_log"""))
def scenario_events(spark, sf):
    return files.scenario_events(_scenarios(spark, sf)).select(
        KEY, "device_id", "value", "seq", F.unix_timestamp("device_ts").alias("device_s"))


@query("score_scenarios", with_ctes(SCENARIO_REPORTS + fold_ctes("reports_log"), """
    select v.corroboration_key as scenario_id, status, value, confidence, coalesce(value = o_orderstatus, false) as match
    from verdict v join orders on 's' || o_orderkey = v.corroboration_key"""))
def score_scenarios(spark, sf):
    return pipelines.score_scenarios(_scenarios(spark, sf)).select("scenario_id", "status", "value", "confidence", "match")


@query("device_summary", with_ctes(ctes("queue") + PUSHES + METRICS, """
    select d.device_id, coalesce(q.stored, 0) as stored, coalesce(q.urgent, 0)::bigint as urgent, coalesce(q.routine, 0)::bigint as routine,
           p.last_us, coalesce(m.n, 0) as recent
    from (select distinct 'dev-' || c_custkey % 60 as device_id from customer) d
    left join (select device_id, count(*) as stored, count_if(synced = 0 and syncable = 1 and sync_priority = 'URGENT') as urgent,
                      count_if(synced = 0 and syncable = 1 and sync_priority = 'ROUTINE') as routine from queue group by all) q using (device_id)
    left join (select device_id, epoch_us(max(ts)) as last_us from pushes group by all) p using (device_id)
    left join (select device_id, count(*) as n from metrics group by all) m using (device_id)"""))
def device_summary(spark, sf):
    devices = table(spark, sf, "customer").select(
        F.concat(F.lit("dev-"), (F.col("c_custkey") % 60).cast("string")).alias("device_id")).distinct()
    trust = table(spark, sf, "queue").groupBy("device_id").agg(F.avg("value").alias("trust"))
    rows = monitor.device_summary(devices, table(spark, sf, "queue"), table(spark, sf, "pushes"), trust,
                                  table(spark, sf, "metrics"))
    return rows.select("device_id", "stored", "urgent", "routine",
                       F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', last_sync)").alias("last_us"),
                       F.aggregate("sparkline", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("recent"))
