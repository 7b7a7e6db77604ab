"""Queries over the event log: fold, trust, state, explanation, evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from factfold.functions.sealing import canonical_json
from factfold.operators import evidence, explain as explain_op, fold, state, sync, trust
from factfold.operators.evaluation import (
    expand_scenarios, lww_resolve, resolver_resolve, score_resolver_vs_lww,
)
from factfold.params import FoldParams, TrustParams
from factfold.plans.registry import query, with_ctes
from factfold.plans.views import ctes, table
from factfold.session import keep

# The checks fold at a fixed instant, the last day of the supplied events.
NOW_NS = 1_706_745_600_000_000_000
HALF_LIFE_NS = float(7 * 24 * 3600 * 1_000_000_000)
DECAY = 0.0005
SMOOTH = TrustParams(alpha=1.0, beta=1.0, floor=0.05, ceiling=0.95)
KEY = fold.KEY


def fold_ctes(log: str, *, p: str = "", trust: str | None = None, per_key: bool = False, decay: float = 0.0,
              clock: bool = False, threshold: float = 0.66) -> list[str]:
    """CTEs latest, votes, groups, verdict of a fold; ``p`` prefixes their names."""
    if trust is None:
        trust_expr, trust_join = "coalesce(device_trust_at_report, 0.7::double)", ""
    else:
        on = " and t.corroboration_key = l.corroboration_key" if per_key else ""
        trust_expr = "coalesce(t.trust, 0.7::double)"
        trust_join = f" left join {trust} t on t.device_id = l.device_id{on}"
    if clock:
        recency = (f"coalesce(pow(0.5::double, greatest(0::double, {float(NOW_NS)}::double - received_at_ns::double)"
                   f" / {HALF_LIFE_NS}::double), 1.0::double)")
    elif decay:
        recency = f"exp(-{decay}::double * (max(seq) over (partition by l.corroboration_key) - seq))"
    else:
        recency = "1.0::double"
    return [
        f"""{p}latest as (select * from {log} where event_type <> 'RESOLVED'
            qualify row_number() over (partition by corroboration_key, device_id
                                       order by coalesce(client_sequence, seq) desc, seq desc) = 1)""",
        f"""{p}votes as (select l.* exclude (device_trust_at_report), {trust_expr} as trust, {recency} as recency,
                coalesce(nullif(value_cluster, ''), value) as cluster, coalesce(modality, 'text') as kind,
                {trust_expr} * {recency} as weight
            from {p}latest l{trust_join} where event_type = 'OBSERVED')""",
        f"""{p}groups as (select corroboration_key, cluster, sum(weight) as raw_support, min(value) as value,
                min(device_id) as first_device, count(*) as devices,
                product(1 - greatest(0, least(1, weight))) as doubt, count(distinct kind) > 1 as mixed,
                round(sum(weight), 6) as support
            from {p}votes group by all)""",
        f"""{p}totals as (select corroboration_key, sum(raw_support) as total, sum(devices) as live,
                count(*) as value_count, round(sum(support), 6) as total_support from {p}groups group by all)""",
        f"""{p}winners as (select * from {p}groups qualify row_number() over (
                partition by corroboration_key order by support desc, value, first_device) = 1)""",
        f"""{p}keys as (select distinct corroboration_key from {p}latest)""",
        f"""{p}scored as (select k.corroboration_key, w.value, w.cluster, w.support, w.devices, w.mixed, w.first_device,
                coalesce(t.live, 0) as live, coalesce(t.value_count, 0) as value_count,
                coalesce(t.total_support, 0) as total_support,
                case when t.live is null then 0 else round((1 - w.doubt * case when w.mixed then 0.7::double else 1 end)
                    * case when t.total <> 0 then w.support / t.total else 0 end, 6) end as confidence
            from {p}keys k left join {p}totals t using (corroboration_key)
            left join {p}winners w using (corroboration_key))""",
        f"""{p}verdict as (select *, case when live = 0 then 'ABSENT' when live = 1 then 'LWW'
                when confidence >= {threshold} then 'CONFIRMED' else 'DISPUTED' end as status from {p}scored)""",
    ]


def resolved_ctes(log: str, p: str = "") -> list[str]:
    """CTEs that lay the newest decision of each key over its verdict."""
    return [
        f"""{p}decided as (select corroboration_key, value as r_value, value_cluster as r_cluster, resolver_id, seq as r_seq
            from {log} where event_type = 'RESOLVED'
            qualify row_number() over (partition by corroboration_key order by seq desc) = 1)""",
        f"""{p}later as (select v.corroboration_key, v.device_id, v.value, v.seq, d.r_seq
            from {p}votes v join {p}decided d using (corroboration_key)
            where v.seq > d.r_seq and case when coalesce(r_cluster, '') = '' then v.value is distinct from r_value
                                           else v.cluster is distinct from r_cluster end)""",
        f"""{p}final as (select v.corroboration_key, v.live, v.cluster, v.support, v.devices, v.first_device, v.mixed,
                v.value_count, v.total_support, v.value as w_value,
                case when d.r_seq is not null then 'RESOLVED' else v.status end as status,
                case when d.r_seq is not null then d.r_value else v.value end as value,
                case when d.r_seq is not null then 1.0 else v.confidence end as confidence,
                d.resolver_id as resolved_by, d.r_seq as resolved_seq,
                case when d.r_seq is not null then coalesce(n.n, 0) end as post_resolution_conflicts
            from {p}verdict v full outer join {p}decided d using (corroboration_key)
            left join (select corroboration_key, count(*) as n from {p}later group by all) n using (corroboration_key))""",
    ]


def trust_ctes(log: str, out: str, *, per_key: bool = False, decay: float = 0.0,
               params: TrustParams = TrustParams(), threshold: float = 0.66) -> list[str]:
    """CTE ``out`` (device_id, trust and, per key, the key)."""
    p = f"{out}_"
    scope = "corroboration_key, device_id" if per_key else "device_id"
    return [
        *fold_ctes(log, p=p, decay=decay, threshold=threshold),
        f"""{p}decided as (select corroboration_key, value as r_value from {log} where event_type = 'RESOLVED'
            qualify row_number() over (partition by corroboration_key order by seq desc) = 1)""",
        f"""{p}truth as (select v.corroboration_key, coalesce(d.r_value, case when v.status = 'CONFIRMED' then v.value end) as truth
            from {p}verdict v left join {p}decided d using (corroboration_key) where v.live > 0)""",
        f"""{p}won as (select corroboration_key, arg_min(cluster, device_id) as won from {p}votes
            join {p}truth using (corroboration_key) where value = truth group by all)""",
        f"""{p}tally as (select {scope}, sum(case when cluster = coalesce(won, truth) or value = truth then recency else 0 end) as agree,
                sum(recency) as total
            from {p}votes join {p}truth using (corroboration_key) left join {p}won using (corroboration_key)
            where truth is not null group by all)""",
        f"""{out} as (select {scope}, round(greatest({params.floor}, least({params.ceiling},
                (agree + {params.alpha}) / (total + {params.alpha + params.beta}))), 6) as trust
            from {p}tally where total + {params.alpha + params.beta} > 0)""",
    ]


LOG = ctes("decided_events")
VERDICT_SELECT = """select corroboration_key, status, value, confidence, coalesce(live, 0)::bigint as live_device_count,
    coalesce(mixed, false) as cross_modal, coalesce(value_count, 0)::bigint as value_count, resolved_by, resolved_seq,
    post_resolution_conflicts from {p}final"""


def _verdict(df):
    return df.select(KEY, "status", "value", "confidence", "live_device_count", "cross_modal", "value_count",
                     "resolved_by", "resolved_seq", "post_resolution_conflicts")


@query("latest_by_device", with_ctes(ctes("fact_events"), """
    select corroboration_key, device_id, event_type, value, seq from fact_events
    qualify row_number() over (partition by corroboration_key, device_id
                               order by coalesce(client_sequence, seq) desc, seq desc) = 1"""))
def latest_by_device(spark, sf):
    return fold.latest_by_device(table(spark, sf, "fact_events")).select(KEY, "device_id", "event_type", "value", "seq")


@query("fold_consensus", with_ctes(ctes("fact_events") + fold_ctes("fact_events"), """
    select corroboration_key, status, value, confidence, live::bigint as live_device_count,
           coalesce(mixed, false) as cross_modal, value_count::bigint as value_count from verdict"""))
def fold_consensus(spark, sf):
    return fold.fold_consensus(table(spark, sf, "fact_events")).select(
        KEY, "status", "value", "confidence", "live_device_count", "cross_modal", "value_count")


@query("fold_with_resolutions", with_ctes(LOG + fold_ctes("decided_events") + resolved_ctes("decided_events"),
                                          VERDICT_SELECT.format(p="")))
def fold_with_resolutions(spark, sf):
    return _verdict(fold.fold_consensus(table(spark, sf, "decided_events")))


@query("fold_with_sequence_decay", with_ctes(
    ctes("fact_events") + fold_ctes("fact_events", decay=DECAY),
    "select corroboration_key, status, value, confidence from verdict"))
def fold_with_sequence_decay(spark, sf):
    return fold.fold_consensus(table(spark, sf, "fact_events"), FoldParams(decay=DECAY)).select(
        KEY, "status", "value", "confidence")


@query("fold_with_half_life", with_ctes(
    ctes("fact_events") + fold_ctes("fact_events", clock=True),
    "select corroboration_key, status, value, confidence from verdict"))
def fold_with_half_life(spark, sf):
    params = FoldParams(now_ns=NOW_NS, half_life_ns=HALF_LIFE_NS)
    return fold.fold_consensus(table(spark, sf, "fact_events"), params).select(
        KEY, "status", "value", "confidence")


@query("ranked_values", with_ctes(ctes("fact_events") + fold_ctes("fact_events"), """
    select corroboration_key, cluster, value, support, devices, first_device from groups"""))
def ranked_values(spark, sf):
    return fold.ranked_values(table(spark, sf, "fact_events"))


@query("contributions", with_ctes(ctes("fact_events") + fold_ctes("fact_events", clock=True), """
    select corroboration_key, device_id as device, value, round(trust, 6) as trust, round(recency, 6) as recency,
           round(weight, 6) as weight from votes"""))
def contributions(spark, sf):
    params = FoldParams(now_ns=NOW_NS, half_life_ns=HALF_LIFE_NS)
    return fold.contributions(table(spark, sf, "fact_events"), params).drop("cluster")


@query("modal_votes", with_ctes(ctes("fact_events") + fold_ctes("fact_events"), """
    select v.corroboration_key, v.kind as modality, count(*) as devices, round(sum(v.weight), 6) as weight
    from votes v join winners w using (corroboration_key, cluster) group by all"""))
def modal_votes(spark, sf):
    return fold.modal_votes(table(spark, sf, "fact_events"))


@query("noisy_or_by_key", with_ctes(ctes("fact_events") + fold_ctes("fact_events"), """
    select corroboration_key, round(1 - product(1 - greatest(0, least(1, weight))), 6) as combined
    from votes group by all"""))
def noisy_or_by_key(spark, sf):
    votes = fold.weigh(fold.latest_by_device(table(spark, sf, "fact_events")), FoldParams()).filter("live")
    return votes.groupBy(KEY).agg(F.round(fold.noisy_or(F.col("weight")), 6).alias("combined"))


@query("latest_resolutions", with_ctes(LOG, """
    select corroboration_key, value as resolved_value, resolver_id as resolved_by, seq as resolved_seq
    from decided_events where event_type = 'RESOLVED'
    qualify row_number() over (partition by corroboration_key order by seq desc) = 1"""))
def latest_resolutions(spark, sf):
    return fold.latest_resolutions(table(spark, sf, "decided_events")).select(
        KEY, "resolved_value", "resolved_by", "resolved_seq")


@query("post_resolution_conflicts", with_ctes(
    LOG + fold_ctes("decided_events") + resolved_ctes("decided_events"),
    "select corroboration_key, device_id, value, seq, r_seq as resolved_seq from later"))
def post_resolution_conflicts(spark, sf):
    return fold.post_resolution_conflicts(table(spark, sf, "decided_events"))


@query("device_trust", with_ctes(LOG + trust_ctes("decided_events", "dt"), "select device_id, trust from dt"))
def device_trust(spark, sf):
    return trust.derive_device_trust(table(spark, sf, "decided_events"))


@query("device_trust_smoothed", with_ctes(LOG + trust_ctes("decided_events", "dt", decay=DECAY, params=SMOOTH),
                                          "select device_id, trust from dt"))
def device_trust_smoothed(spark, sf):
    return trust.derive_device_trust(table(spark, sf, "decided_events"), SMOOTH, FoldParams(decay=DECAY))


@query("device_trust_per_key", with_ctes(LOG + trust_ctes("decided_events", "dt", per_key=True),
                                         "select corroboration_key, device_id, trust from dt"))
def device_trust_per_key(spark, sf):
    return trust.derive_device_trust(table(spark, sf, "decided_events"), per_key=True)


CLOUD_STATE_SQL = with_ctes(
    LOG + trust_ctes("decided_events", "dt") + fold_ctes("decided_events", trust="dt")
    + resolved_ctes("decided_events")
    + ["""newest as (select corroboration_key, modality, thumbnail_url, client_timestamp_ns from decided_events
          qualify row_number() over (partition by corroboration_key order by seq desc) = 1)""",
       """decided_backers as (select f.corroboration_key, g.devices from final f
          join groups g on g.corroboration_key = f.corroboration_key and g.value = f.value
          where f.status = 'RESOLVED' qualify row_number() over (
              partition by f.corroboration_key order by g.support desc, g.first_device) = 1)"""], """
    select corroboration_key, case status when 'LWW' then 'UNCORROBORATED' else status end as state, value, confidence,
           (case when status <> 'RESOLVED' then f.devices else coalesce(b.devices, 0) end)::bigint
               as corroborating_devices,
           strftime(make_timestamp(client_timestamp_ns // 1000), '%Y-%m-%dT%H:%M:%S.%f') as updated_at, modality, thumbnail_url
    from final f join newest using (corroboration_key) left join decided_backers b using (corroboration_key)
    where status <> 'ABSENT' and coalesce(value, '') <> ''""")


@query("cloud_state", CLOUD_STATE_SQL)
def cloud_state(spark, sf):
    rows = state.cloud_state(table(spark, sf, "decided_events"))
    return rows.withColumn("updated_at", F.substring("updated_at", 1, 26))


@query("cloud_state_vision", f"""select * from ({CLOUD_STATE_SQL}) s
    where modality = 'vision' or coalesce(thumbnail_url, '') <> ''""")
def cloud_state_vision(spark, sf):
    rows = state.cloud_state(table(spark, sf, "decided_events"), modality="vision")
    return rows.withColumn("updated_at", F.substring("updated_at", 1, 26))


@query("explain_verdicts", with_ctes(
    LOG + fold_ctes("decided_events") + resolved_ctes("decided_events")
    + ["""kinds as (select corroboration_key, count(distinct kind) as n, string_agg(distinct kind, ', ' order by kind) as names
          from votes join winners using (corroboration_key, cluster) group by all)""",
       """parts as (select corroboration_key, status, n, names, mixed,
            case when total_support <> 0 then round(support / total_support, 6) else 0.0 end as agreement, f.* exclude
            (corroboration_key, status, mixed)
          from final f left join kinds using (corroboration_key))""",
       """reasons as (select corroboration_key, status, case status
          when 'RESOLVED' then 'Decided by ''' || resolved_by || ''' at sequence ' || resolved_seq || ': ''' || value || ''' for '''
            || corroboration_key || '''. Later reports that differ: ' || post_resolution_conflicts || '.'
          when 'ABSENT' then 'All reports on ''' || corroboration_key || ''' were withdrawn.'
          when 'LWW' then 'Only ''' || first_device || ''' reports ''' || value || '''; confidence ' || confidence
            || ' of the 0.66 needed.'
          when 'CONFIRMED' then devices || ' of ' || live || ' devices report ''' || value || ''' with support ' || support
            || ' of ' || total_support || ' (share ' || agreement || '); confidence ' || confidence || ' reaches 0.66.'
          else live || ' devices report ' || value_count || ' values; ''' || value || ''' leads with support ' || support
            || ' of ' || total_support || ' (share ' || agreement || '), but confidence ' || confidence || ' is below 0.66.' end as reason,
          case when mixed then 'The value is backed by ' || n || ' modalities (' || names || '), which counts as one more vote.' end
            as cross_modal_reason
          from parts)"""],
    "select *, concat_ws(' ', reason, cross_modal_reason) as summary from reasons"))
def explain_verdicts(spark, sf):
    log = fold.keep_ballots(table(spark, sf, "decided_events"))
    return explain_op.explain(fold.fold_consensus(log), fold.modal_votes(log))


@query("competing_values", with_ctes(LOG + fold_ctes("decided_events"), """
    select corroboration_key, value, '''' || value || ''' (support ' || support || ')' as phrase from groups"""))
def competing_values(spark, sf):
    values = fold.ranked_values(fold.keep_ballots(table(spark, sf, "decided_events")))
    return explain_op.competing_values(values).select(KEY, "value", "phrase")


@query("point_trust", with_ctes(ctes("point_events") + [
    "ends as (select point_id, max(seq) as newest, arg_max(event_type, seq) as last_type from point_events group by all)"], """
    select point_id::varchar as point_id, round(case when last_type = 'RETRACTED' then 0 else 1 / (1 + exp(-score)) end, 5) as trust
    from (select point_id, any_value(last_type) as last_type,
                 sum(case when event_type = 'OBSERVED' then 1 else -1 end * exp(-0.001::double * (newest - seq))) as score
          from point_events join ends using (point_id) group by all)"""))
def point_trust(spark, sf):
    rows = trust.fold_point_trust(table(spark, sf, "point_events"), decay=0.001)
    return rows.select(F.col("point_id").cast("string").alias("point_id"), F.round("trust", 5).alias("trust"))


@query("point_lww_trust", with_ctes(ctes("point_events"), """
    select point_id::varchar as point_id, case when arg_max(event_type, seq) = 'OBSERVED' then 1.0 else 0.0 end as trust
    from point_events group by all"""))
def point_lww_trust(spark, sf):
    return trust.lww_trust(table(spark, sf, "point_events")).withColumn("point_id", F.col("point_id").cast("string"))


@query("point_liveness", with_ctes(ctes("point_events"), """
    select point_id::varchar as point_id, bool_or(last = 'OBSERVED') as live
    from (select point_id, device_id, arg_max(event_type, seq) as last from point_events group by all) group by all"""))
def point_liveness(spark, sf):
    return trust.point_liveness(table(spark, sf, "point_events")).withColumn("point_id", F.col("point_id").cast("string"))


@query("point_liveness_fold_order", with_ctes(ctes("point_events"), """
    select point_id::varchar as point_id, bool_or(event_type = 'OBSERVED') as live
    from (select * from point_events qualify row_number() over (
            partition by point_id, device_id order by client_sequence desc, seq desc) = 1) group by all"""))
def point_liveness_fold_order(spark, sf):
    rows = trust.point_liveness(table(spark, sf, "point_events"), hub_order=False)
    return rows.withColumn("point_id", F.col("point_id").cast("string"))


def _facts_of(log):
    return log.filter("event_type = 'OBSERVED'").groupBy("point_id", KEY, "value").agg(
        F.min_by("device_id", "seq").alias("device_id"), F.max("client_timestamp_ns").alias("client_timestamp_ns"),
        F.max("thumbnail_url").alias("thumbnail_url"), F.min_by("modality", "seq").alias("modality")).withColumns({
            "consensus_state": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double"),
            "value_cluster": F.lit(None).cast("string")})


FACTS_CTE = """facts as (select point_id, corroboration_key, value, arg_min(device_id, seq) as device_id
    from point_events where event_type = 'OBSERVED' group by all)"""


@query("stamp_consensus_state", with_ctes(
    ctes("point_events") + trust_ctes("point_events", "dt", per_key=True)
    + fold_ctes("point_events", trust="dt", per_key=True) + [FACTS_CTE], """
    select point_id::varchar as point_id, corroboration_key, f.value, case status when 'LWW' then 'UNCORROBORATED' else status end
        as consensus_state, confidence from facts f left join verdict using (corroboration_key)"""))
def stamp_consensus_state(spark, sf):
    log = table(spark, sf, "point_events")
    rows = state.stamp_consensus_state(_facts_of(log), log)
    return rows.select(F.col("point_id").cast("string").alias("point_id"), KEY, "value", "consensus_state", "confidence")


@query("degraded_state", with_ctes(ctes("fact_events") + [
    """held as (select corroboration_key, value, count(distinct device_id) as devices, max(client_timestamp_ns) as ts,
         max(thumbnail_url) as thumb, bool_or(modality = 'vision') as vision from fact_events group by all)"""], """
    select corroboration_key, 'UNCORROBORATED' as state, arg_min(value, row(-devices, value)) as value,
           arg_min(devices, row(-devices, value)) as corroborating_devices, max(ts) as updated_ns,
           max(thumb) as thumbnail_url, case when bool_or(vision) then 'vision' else 'text' end as modality
    from held group by all"""))
def degraded_state(spark, sf):
    return state.degraded_state(table(spark, sf, "fact_events")).drop("confidence")


@query("local_events", with_ctes(ctes("point_events"), """
    select seq, device_id, event_type from point_events where point_id = (select min(point_id) from point_events)"""))
def local_events(spark, sf):
    log = table(spark, sf, "point_events")
    wanted = log.agg(F.min("point_id").cast("string")).first()[0]
    return sync.local_events(log, wanted).select("seq", "device_id", "event_type")


@query("tombstones", with_ctes(ctes("point_events"), """
    select point_id::varchar as point_id from (select point_id, device_id, arg_max(event_type, seq) as last from point_events group by all)
    group by point_id having not bool_or(last = 'OBSERVED')"""))
def tombstones(spark, sf):
    return state.tombstones(table(spark, sf, "point_events")).withColumn("point_id", F.col("point_id").cast("string"))


def _retract_requests(log):
    """Every withdrawal in the log, without its key, and one request per device for a point nobody stored."""
    asked = log.filter("event_type = 'RETRACTED'").select("device_id", "point_id", "client_sequence")
    lost = log.groupBy("device_id").agg(F.max("client_sequence").alias("client_sequence")).withColumn(
        "point_id", F.lit(1).cast("decimal(20,0)")).select("device_id", "point_id", "client_sequence")
    return asked.unionByName(lost).withColumn(KEY, F.lit(None).cast("string"))


@query("retract_keyed", with_ctes(ctes("point_events") + [
    "stored as (select device_id, point_id, min(corroboration_key) as corroboration_key from point_events group by all)"], """
    select device_id, point_id::varchar as point_id, r.client_sequence, s.corroboration_key, 'RETRACTED' as event_type
    from point_events r join stored s using (device_id, point_id) where r.event_type = 'RETRACTED'"""))
def retract_keyed(spark, sf):
    log = table(spark, sf, "point_events")
    found, _ = state.retract(log, _retract_requests(log))
    return found.withColumn("point_id", F.col("point_id").cast("string"))


@query("retract_rejects", with_ctes(ctes("point_events"), """
    select device_id, '1' as point_id, max(client_sequence) as client_sequence from point_events group by all"""))
def retract_rejects(spark, sf):
    log = table(spark, sf, "point_events")
    _, rejected = state.retract(log, _retract_requests(log))
    return rejected.select("device_id", F.col("point_id").cast("string").alias("point_id"), "client_sequence")


def _decisions(log):
    """Two decisions per key, for its oldest and its newest report."""
    report = F.struct("seq", "value")
    ends = log.filter("event_type = 'OBSERVED'").groupBy(KEY).agg(F.min(report).alias("a"), F.max(report).alias("b"))
    return ends.select(KEY, F.explode(F.array_distinct(F.array("a", "b"))).alias("d")).select(
        KEY, "d.value", F.concat(F.lit("op-"), (F.col("d.seq") % 3).cast("string")).alias("resolver_id"), "d.seq")


DECISIONS_CTE = """decisions as (select corroboration_key, value, 'op-' || (seq % 3) as resolver_id, seq
    from point_events where event_type = 'OBSERVED'
    qualify seq in (min(seq) over (partition by corroboration_key), max(seq) over (partition by corroboration_key)))"""


@query("resolution_events", with_ctes(ctes("point_events") + [DECISIONS_CTE], """
    select corroboration_key, value, resolver_id, seq, 'RESOLVED' as event_type,
           md5('RESOLVED:' || corroboration_key || ':' || resolver_id || ':' || seq) as event_id from decisions"""))
def resolution_events(spark, sf):
    log = table(spark, sf, "point_events")
    events, _ = state.resolve(_facts_of(log), _decisions(log))
    return events.drop("value_cluster")


@query("superseded_facts", with_ctes(ctes("point_events") + [FACTS_CTE, DECISIONS_CTE, """
    newest as (select corroboration_key, arg_max(value, seq) as won from decisions group by all)"""], """
    select point_id::varchar as point_id, corroboration_key from facts join newest using (corroboration_key)
    where value is distinct from won"""))
def superseded_facts(spark, sf):
    log = table(spark, sf, "point_events")
    _, losers = state.resolve(_facts_of(log), _decisions(log))
    return losers.select(F.col("point_id").cast("string").alias("point_id"), KEY)


@query("lww_resolve", with_ctes(ctes("fact_events"), """
    select corroboration_key, arg_max(value, seq) as lww_value from fact_events where event_type = 'OBSERVED' group by all"""))
def lww_resolve_query(spark, sf):
    return lww_resolve(table(spark, sf, "fact_events"))


@query("resolver_resolve", with_ctes(ctes("fact_events") + fold_ctes("fact_events"), """
    select corroboration_key, case when status in ('CONFIRMED', 'LWW') then value end as resolver_value from verdict"""))
def resolver_resolve_query(spark, sf):
    return resolver_resolve(table(spark, sf, "fact_events"))


SCENARIO_LOG = ctes("scenarios") + [
    """plans as (select * from (values
        ('minority_late_wrong', 1, true, 0.8), ('minority_late_wrong', 2, true, 0.8), ('minority_late_wrong', 3, true, 0.8),
        ('minority_late_wrong', 4, false, 0.3), ('contested', 1, true, 0.6), ('contested', 2, false, 0.6),
        ('contested', 3, true, 0.6), ('contested', 4, false, 0.6), ('late_correction', 1, false, 0.3),
        ('late_correction', 2, false, 0.3), ('late_correction', 3, true, 0.8), ('corroboration_foiled', 1, true, 0.4),
        ('corroboration_foiled', 2, false, 0.9), ('corroboration_foiled', 3, false, 0.9)) p(shape, seq, truthful, trust))""",
    """scenario_log as (select scenario_id as corroboration_key, shape, 'dev-' || scenario_id || '-' || seq as device_id,
        case when truthful then correct_value else decoy_value end as value, 'OBSERVED' as event_type, seq::bigint as seq,
        trust::double as device_trust_at_report, null::bigint as client_sequence, null::varchar as modality,
        null::varchar as value_cluster, null::bigint as received_at_ns
        from scenarios join plans using (shape))""",
]


@query("expand_scenarios", with_ctes(SCENARIO_LOG, """
    select corroboration_key, shape, device_id, value, event_type, seq, device_trust_at_report from scenario_log"""))
def expand_scenarios_query(spark, sf):
    return expand_scenarios(table(spark, sf, "scenarios")).select(
        KEY, "shape", "device_id", "value", "event_type", "seq", "device_trust_at_report")


@query("score_resolver_vs_lww", with_ctes(SCENARIO_LOG + fold_ctes("scenario_log") + [
    "lww as (select corroboration_key, arg_max(value, seq) as lww_value from scenario_log group by all)",
    """picks as (select s.shape, case when v.status in ('CONFIRMED', 'LWW') then v.value end as pick,
            coalesce(case when v.status in ('CONFIRMED', 'LWW') then v.value end = correct_value, false) as r_ok,
            lww_value = correct_value as l_ok
        from scenarios s join verdict v on v.corroboration_key = s.scenario_id
        join lww l on l.corroboration_key = s.scenario_id)"""], """
    select coalesce(shape, 'all') as shape, count(*) as scenarios, count_if(r_ok)::bigint as resolver_correct,
           count_if(l_ok)::bigint as lww_correct, count_if(pick is null)::bigint as resolver_abstained,
           round(count_if(r_ok)::bigint / count(*), 4) as resolver_accuracy,
           round(count_if(l_ok)::bigint / count(*), 4) as lww_accuracy,
           round((count_if(r_ok)::bigint - count_if(l_ok)::bigint) / count(*), 4) as accuracy_delta
    from picks group by rollup(shape)"""))
def score_resolver_query(spark, sf):
    return score_resolver_vs_lww(table(spark, sf, "scenarios"))


_JSON = """'{"client_sequence":' || client_sequence || ',"device_id":"' || device_id || '","device_trust_at_report":'
    || round(device_trust_at_report, 6) || ',"event_type":"' || event_type || '","modality":"' || modality || '","resolver_id":'
    || coalesce('"' || resolver_id || '"', 'null') || ',"seq":' || seq || ',"value":"' || value || '","value_cluster":null}'"""


@query("canonical_json_seal", with_ctes(LOG, f"""
    select corroboration_key, device_id, seq, {_JSON} as canonical, sha256({_JSON}) as seal from decided_events"""))
def canonical_json_seal(spark, sf):
    log = table(spark, sf, "decided_events")
    fields = {n: (F.round(n, 6) if n == "device_trust_at_report" else F.col(n)) for n in evidence.EVENT_FIELDS}
    text = canonical_json(fields)
    return log.select(KEY, "device_id", "seq", text.alias("canonical"), F.sha2(text, 256).alias("seal"))


@query("evidence_event_digests", with_ctes(LOG + [
    f"""l0 as (select corroboration_key as k, seq as run, device_id as d, sha256({_JSON}) as digest from decided_events)""",
    "l1 as (select k, run >> 12 as run, sha256(string_agg(digest, '' order by run, d)) as digest, count(*) as n from l0 group by k, l0.run >> 12)",
    "l2 as (select k, run >> 12 as run, sha256(string_agg(digest, '' order by run)) as digest, sum(n) as n from l1 group by k, l1.run >> 12)",
    "l3 as (select k, run >> 12 as run, sha256(string_agg(digest, '' order by run)) as digest, sum(n) as n from l2 group by k, l2.run >> 12)",
], """select k as corroboration_key, sha256(string_agg(digest, '' order by run)) as events_digest, sum(n)::bigint as event_count
    from l3 group by k"""))
def evidence_event_digests(spark, sf):
    return evidence.events_digest(table(spark, sf, "decided_events"))


SECRET = "hub-secret"


def _signed_sql(text: str) -> str:
    """HMAC of a text column with the secret, whose padded forms are constants here."""
    inner, outer = (bytes(b ^ pad for b in SECRET.encode().ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))
    return f"sha256(unhex('{outer}' || sha256(unhex('{inner}' || hex(encode({text}))))))"


def _json_sql(fields: dict[str, str], quoted: tuple[str, ...]) -> str:
    """Canonical JSON of SQL expressions; the ``quoted`` ones are texts."""
    shown = [f"""'"{n}":' || coalesce({f"'\"' || {e} || '\"'" if n in quoted else f"({e})::varchar"}, 'null')""" for n, e in sorted(fields.items())]
    return "'{' || " + " || ',' || ".join(shown) + " || '}'"


def _digest_ctes(log: str, p: str) -> list[str]:
    """CTE {p}events: digest and number of the events of each key."""
    steps = [f"""{p}l{n} as (select k, run >> 12 as run, sha256(string_agg(digest, '' order by run{', d' if n == 1 else ''})) as digest,
        {'count(*)' if n == 1 else 'sum(n)'} as n from {p}l{n - 1} group by k, {p}l{n - 1}.run >> 12)""" for n in (1, 2, 3)]
    return [f"{p}l0 as (select corroboration_key as k, seq as run, device_id as d, sha256({_JSON}) as digest from {log})", *steps,
            f"""{p}events as (select k as corroboration_key, sha256(string_agg(digest, '' order by run)) as events_digest,
                sum(n)::bigint as event_count from {p}l3 group by k)"""]


def _unsealed_ctes(log: str, p: str, threshold: float = 0.66) -> list[str]:
    """CTE {p}fresh: verdict, trust digest and event digest of each key, before sealing."""
    leaf = _json_sql({"device_id": "device_id", "trust": "trust"}, ("device_id",))
    return [
        *trust_ctes(log, f"{p}dt", per_key=True, threshold=threshold),
        *fold_ctes(log, p=p, trust=f"{p}dt", per_key=True, threshold=threshold), *resolved_ctes(log, p), *_digest_ctes(log, p),
        f"""{p}runs as (select corroboration_key, md5(device_id)[1:3] as run, sha256(string_agg(sha256({leaf}), '' order by device_id)) as digest
            from {p}dt group by corroboration_key, md5(device_id)[1:3])""",
        f"""{p}trusts as (select corroboration_key, sha256(string_agg(digest, '' order by run)) as trust_digest from {p}runs group by all)""",
        f"""{p}fresh as (select f.corroboration_key, f.status, f.value, f.confidence, coalesce(f.live, 0)::bigint as live_device_count,
                coalesce(f.mixed, false) as cross_modal, round(f.support, 6) as winner_support, coalesce(f.devices, 0)::bigint as winner_devices,
                coalesce(f.value_count, 0)::bigint as value_count, f.resolved_by, f.resolved_seq, f.post_resolution_conflicts,
                e.events_digest, e.event_count, t.trust_digest
            from {p}final f join {p}events e using (corroboration_key) left join {p}trusts t using (corroboration_key))""",
    ]


_TEXTS = ("corroboration_key", "events_digest", "fold_code_sha256", "fold_params", "resolved_by", "schema_version", "status",
          "trust_digest", "value")
_CORE = {n: n for n in (*evidence.VERDICT_FIELDS, "corroboration_key", "trust_digest", "events_digest", "event_count")} | {
    "schema_version": f"'{evidence.SCHEMA_VERSION}'", "fold_params": f"'{evidence.parameter_text(FoldParams(), TrustParams())}'",
    "fold_code_sha256": f"'{evidence.fold_code_sha256()}'"}


@query("evidence_packets", with_ctes(LOG + _unsealed_ctes("decided_events", "o_") + [
    f"sealed as (select *, sha256({_json_sql(_CORE, _TEXTS)}) as hash from o_fresh)"], f"""
    select *, {_signed_sql('hash')} as signature, {_CORE['schema_version']} as schema_version, {_CORE['fold_params']} as fold_params,
        {_CORE['fold_code_sha256']} as fold_code_sha256 from sealed"""))
def evidence_packets(spark, sf):
    return evidence.evidence_packets(table(spark, sf, "decided_events"), secret=SECRET)


# A key's class, from 0 to 6, says what was tampered with: 0 value, 1 confidence, 2 the events (the newest is lost), 3 signature,
# 4 the code's hash, 6 the threshold; 5 nothing.
_CLASS_SQL = "(strpos('0123456789abcdef', md5(corroboration_key)[1:1]) - 1) % 7"
STRICT = FoldParams(threshold=0.9)


def _tampered(packets, log):
    kind = (F.expr("instr('0123456789abcdef', substring(md5(corroboration_key), 1, 1))") - 1) % 7
    strict = evidence.parameter_text(STRICT, TrustParams())
    forged = packets.withColumns({
        "value": F.when(kind == 0, F.lit("forged")).otherwise(F.col("value")),
        "confidence": F.when(kind == 1, F.lit(0.123456)).otherwise(F.col("confidence")),
        "signature": F.when(kind == 3, F.lit("0" * 64)).otherwise(F.col("signature")),
        "fold_code_sha256": F.when(kind == 4, F.lit("0" * 64)).otherwise(F.col("fold_code_sha256")),
        "fold_params": F.when(kind == 6, F.lit(strict)).otherwise(F.col("fold_params"))})
    newest = log.groupBy(KEY).agg(F.max("seq").alias("_newest"))
    left = log.join(newest, KEY).filter((kind != 2) | (F.col("seq") != F.col("_newest"))).drop("_newest")
    return forged, left


@query("verify_packets", with_ctes(
    LOG + _unsealed_ctes("decided_events", "o_")
    + [f"""lost as (select * from decided_events
        qualify not ({_CLASS_SQL} = 2 and seq = max(seq) over (partition by corroboration_key)))"""]
    + _unsealed_ctes("lost", "a_") + _unsealed_ctes("decided_events", "h_", STRICT.threshold) + [f"""
    judged as (select o.corroboration_key, {_CLASS_SQL.replace('corroboration_key', 'o.corroboration_key')} as kind,
        {' and '.join(f'o.{n} is not distinct from a.{n}' for n in evidence.VERDICT_FIELDS)} as folds,
        {' and '.join(f'o.{n} is not distinct from h.{n}' for n in evidence.VERDICT_FIELDS)} as folds_strictly,
        a.corroboration_key is not null and o.trust_digest is not distinct from a.trust_digest as trusts,
        o.trust_digest is not distinct from h.trust_digest as trusts_strictly
        from o_fresh o left join a_fresh a using (corroboration_key) left join h_fresh h using (corroboration_key)),
    checks as (select corroboration_key, kind in (3, 5) as seal,
        kind not in (0, 1) and case when kind = 2 then folds when kind = 6 then folds_strictly else true end as fold,
        case when kind = 2 then trusts when kind = 6 then trusts_strictly else true end as trust,
        kind <> 4 as module, kind <> 3 as sign from judged)"""],
    "select *, seal and fold and trust and module and sign as verified from checks"))
def verify_packets(spark, sf):
    log = table(spark, sf, "decided_events")
    packets, left = _tampered(keep(evidence.evidence_packets(log, secret=SECRET), "packets"), log)
    return evidence.verify_packets(packets, left, secret=SECRET)


# --- a log with value clusters --------------------------------------------------------------

CLUSTERED = ctes("clustered_events")


@query("fold_clustered", with_ctes(CLUSTERED + fold_ctes("clustered_events") + resolved_ctes("clustered_events"), VERDICT_SELECT.format(p="")))
def fold_clustered(spark, sf):
    return _verdict(fold.fold_consensus(table(spark, sf, "clustered_events")))


@query("device_trust_clustered", with_ctes(CLUSTERED + trust_ctes("clustered_events", "dt"), "select device_id, trust from dt"))
def device_trust_clustered(spark, sf):
    return trust.derive_device_trust(table(spark, sf, "clustered_events"))


@query("conflicts_after_clustered_decisions", with_ctes(
    CLUSTERED + fold_ctes("clustered_events") + resolved_ctes("clustered_events"),
    "select corroboration_key, device_id, value, seq, r_seq as resolved_seq from later"))
def conflicts_after_clustered_decisions(spark, sf):
    return fold.post_resolution_conflicts(table(spark, sf, "clustered_events"))


@query("superseded_by_cluster", with_ctes(CLUSTERED + [
    "held as (select corroboration_key, value, min(value_cluster) as value_cluster, min(seq) as point_id from clustered_events"
    " where event_type = 'OBSERVED' group by all)",
    "newest as (select corroboration_key, arg_max(value, seq) as won from clustered_events where event_type = 'RESOLVED' group by all)",
    "picked as (select n.corroboration_key, won, h.value_cluster as won_cluster from newest n left join held h"
    " on n.corroboration_key = h.corroboration_key and h.value = won)"], """
    select h.point_id, h.corroboration_key from held h join picked p using (corroboration_key)
    where h.value is distinct from won and not coalesce(h.value_cluster = won_cluster, false)"""))
def superseded_by_cluster(spark, sf):
    log = table(spark, sf, "clustered_events")
    held = log.filter("event_type = 'OBSERVED'").groupBy(KEY, "value").agg(
        F.min("value_cluster").alias("value_cluster"), F.min("seq").alias("point_id"))
    decisions = log.filter("event_type = 'RESOLVED'").select(KEY, "value", "resolver_id", "seq")
    return state.resolve(held, decisions)[1].select("point_id", KEY)
