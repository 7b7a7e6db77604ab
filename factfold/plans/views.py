"""Operator inputs derived from the supplied tables.

Each view is one SQL text; only a few expressions differ between Spark and the reference
dialect the results are checked with.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from factfold.session import spread

_SPARK_LE = ",".join(f"substring(md5({{0}}),{i},2)" for i in range(15, 0, -2))


def _spark_point(text: str) -> str:
    return f"cast(conv(concat({_SPARK_LE.format(text)}), 16, 10) as decimal(20,0))"


def _render(sql: str, spark: bool) -> str:
    """Fill in the dialect: <K> json field, <S> string type, <US:x> microseconds, <ID:x> point id, ..."""
    out = []
    rest = sql
    while "<" in rest:
        head, sep, tail = rest.partition("<")
        tag, close, after = tail.partition(">")
        name, _, arg = tag.partition(":")
        if not close or name not in ("K", "S", "US", "ID", "MIX", "DOUBLES"):
            out.append(head + sep)
            rest = tail
            continue
        if name == "K":
            text = "get_json_object(props, '$.k')" if spark else "json_extract_string(props, '$.k')"
        elif name == "S":
            text = "string" if spark else "varchar"
        elif name == "US":
            text = f"timestampdiff(MICROSECOND, timestamp_ntz '1970-01-01 00:00:00', {arg})" if spark else f"epoch_us({arg})"
        elif name == "DOUBLES":
            text = f"cast({arg} as array<double>)" if spark else f"cast({arg} as double[])"
        elif name == "MIX":
            text = ("zip_with(a, b, (x, y) -> w * x + (1 - w) * y)" if spark
                    else "list_transform(list_zip(a, b), lambda p: w * p[1] + (1 - w) * p[2])")
        else:
            text = _spark_point(arg) if spark else f"md5_number_upper({arg})"
        out.append(head + text)
        rest = after
    return "".join(out) + rest


# Tables that grow; the test files hold each in a single split.
FACT_TABLES = ("events", "orders", "lineitem", "documents", "pages", "conversations")

# name -> (tables or views it reads, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    # Every eleventh report reaches the hub after forty newer ones of the fleet.
    "fact_events": (("events",), """
        select 'k' || <K> || '.d' || cast(cast(ts as date) as <S>) as corroboration_key,
               'dev-' || cast(user_id as <S>) as device_id,
               case when event_type = 'purchase' then 'down' else 'up' end as value,
               case when event_type = 'error' then 'RETRACTED' else 'OBSERVED' end as event_type,
               2 * (event_id + 1) as seq,
               event_id + 1 - case when event_id % 11 = 0 then 40 else 0 end as client_sequence,
               case when event_id % 3 = 0 then 'vision' else 'text' end as modality,
               <US:ts> * 1000 as received_at_ns,
               <US:ts> * 1000 - event_id % 7 as client_timestamp_ns,
               cast(0.31 as double) + cast(0.097 as double) * (user_id % 7) as device_trust_at_report,
               cast(null as <S>) as value_cluster, cast(null as <S>) as resolver_id,
               case when event_id % 5 = 0 then 'thumb_' || cast(event_id as <S>) || '.jpg' end as thumbnail_url
        from events"""),
    # The same log with an operator's decision on the keys of every 97th event.
    "decided_events": (("fact_events",), """
        select * from fact_events
        union all
        select corroboration_key, 'op' as device_id, value, 'RESOLVED' as event_type, seq + 1 as seq,
               client_sequence, modality, received_at_ns, client_timestamp_ns, device_trust_at_report,
               value_cluster, 'operator-' || cast(seq % 3 as <S>) as resolver_id, thumbnail_url
        from fact_events where (seq / 2 - 1) % 97 = 0"""),
    # The decided log in other words: three wordings of a value share a cluster, and every fifth event has none.
    "clustered_events": (("decided_events",), """
        select corroboration_key, device_id, value || ' ' || cast(seq % 3 as <S>) as value, event_type, seq, client_sequence, modality,
               received_at_ns, client_timestamp_ns, device_trust_at_report,
               case when seq % 5 <> 0 then 'c-' || value end as value_cluster, resolver_id, thumbnail_url
        from decided_events"""),
    "point_events": (("fact_events",), """
        select *, <ID:corroboration_key || ':' || value> as point_id from fact_events"""),
    # Vectors and mixtures of neighbours, so that every similarity band is reached.
    "vectors": (("embeddings",), """
        select vec_id as id, label, 0 as copy, <DOUBLES:embedding> as v from embeddings
        union all
        select vec_id + 100000 * copy as id, label, copy, <MIX> as v
        from (select x.vec_id, x.label, <DOUBLES:x.embedding> as a, <DOUBLES:y.embedding> as b, m.w, m.copy
              from embeddings x join embeddings y on y.vec_id = x.vec_id + 1
              cross join (select 1 as copy, cast(0.9 as double) as w union all
                          select 2, cast(0.7 as double) union all
                          select 3, cast(0.5 as double)) m) t"""),
    "captures": (("vectors",), """
        select *, <ID:corroboration_key || ':' || value> as point_id from (
        select id as capture_id, copy, 'dev-' || cast(id % 5 as <S>) as device_id, 'text' as slot, v as vec,
               'reading ' || cast(label as <S>) || case when id % 7 = 0 then ' bar, gas leak' when id % 31 = 0
                   then ' bar, write to crew@example.org' else ' bar' end as value,
               'z' || cast(label % 4 as <S>) as zone, 'k' || cast((id + copy) % 20 as <S>) as corroboration_key,
               id as client_sequence, case when id % 4 = 0 then 'vision' else 'text' end as modality,
               1700000000000000000 + id * 1000000 as client_timestamp_ns,
               case when id % 9 <> 0 then 'new' end as status, 'dev-' || cast(id % 5 as <S>) as reporter_device_id
        from vectors) t"""),
    "queue": (("orders",), """
        select o_orderkey as id, o_orderkey as point_id, 'dev-' || cast(o_custkey % 50 as <S>) as device_id,
               o_orderkey as client_sequence, o_orderpriority = '1-URGENT' as urgent,
               case when o_orderpriority = '1-URGENT' then 'URGENT' when o_orderpriority = '5-LOW' then 'HELD'
                    else 'ROUTINE' end as sync_priority,
               case when o_orderstatus = 'F' then 1 else 0 end as synced,
               case when o_orderstatus <> 'P' then 1 else 0 end as syncable,
               cast(floor(o_totalprice / 100) as bigint) + 1 as bytes, (o_custkey % 100) / cast(100 as double) as value,
               cast(o_orderkey % 3600 as double) as age_s,
               case when o_orderkey % 3 = 0 then 'vision' else 'text' end as modality,
               case when o_orderkey % 6 = 0 then '/thumbnails/thumb_' || cast(o_orderkey as <S>) || '.jpg' end
                   as thumbnail_url,
               case when o_orderkey % 6 = 0 then cast(floor(o_totalprice / 1000) as bigint) end as thumbnail_bytes,
               case when o_orderkey % 8 = 0 then 'CONFIRMED' when o_orderkey % 8 = 1 then 'DISPUTED' end
                   as consensus_state,
               case when o_orderkey % 12 = 0 then 'embedding_only' else 'full' end as tier,
               case when o_orderkey % 2 = 0 then 'mutable' else 'immutable' end as shard,
               case when o_orderkey % 13 = 0 then 1 else 0 end as tombstoned,
               case when o_orderkey % 17 = 0 then 1 end as superseded,
               'z' || cast(o_custkey % 6 as <S>) as zone, case when o_custkey % 19 = 0 then 1 end as demo,
               <US:o_orderdate> * 1000 as client_timestamp_ns
        from orders"""),
    # Each order as a report of its customer on a fact of the order's day.
    "reports": (("orders",), """
        select *, <ID:corroboration_key || ':' || value> as point_id from (
        select 'dev-' || cast(o_custkey % 50 as <S>) as device_id,
               'fact-' || cast(o_orderkey % 1000 as <S>) as corroboration_key,
               'total ' || cast(o_orderkey % 7 as <S>) as value, 'text' as modality,
               case when o_orderkey % 20 = 0 then o_orderkey - 1 else o_orderkey end as client_sequence,
               <US:o_orderdate> * 1000 + o_orderkey as received_at_ns,
               <US:o_orderdate> * 1000 as client_timestamp_ns,
               'zone-' || cast(o_custkey % 6 as <S>) as zone,
               o_orderkey
        from orders) t"""),
    "places": (("customer",), """
        select c_custkey, c_name, case when c_custkey % 10 <> 0 then cast(40 as double) + (c_custkey % 100) / cast(1000 as double) end as lat,
               case when c_custkey % 10 <> 0 then cast(-74 as double) - (c_custkey % 37) / cast(1000 as double) end as lon,
               'z' || cast(c_nationkey as <S>) as zone
        from customer"""),
    "answers": (("conversations",), """
        select conv_id, turn, text || ' [' || cast(turn % 7 as <S>) || ']' as text
        from conversations where role = 'assistant'"""),
    "metrics": (("events",), """
        select 'dev-' || cast(user_id as <S>) as device_id, event_id as id, ts, event_type, value,
               <US:ts> / cast(1000000 as double) as t
        from events"""),
    "pushes": (("orders",), """
        select 'dev-' || cast(o_custkey % 50 as <S>) as device_id, o_orderkey as push_id, o_orderdate as ts,
               cast(floor(o_totalprice) as bigint) as bytes, cast(o_orderkey % 900 as double) as duration_ms,
               o_custkey % 9 + 1 as attempted, o_custkey % 4 as accepted, o_custkey % 9 + 1 - o_custkey % 4 as failed,
               o_orderkey % 3 as urgent, o_orderkey % 5 as routine, o_orderstatus <> 'P' as ok,
               case when o_orderstatus = 'O' then 'degraded' else 'full' end as mode
        from orders"""),
    # A labelled dispute per order: shape, the true and the wrong value.
    "scenarios": (("orders",), """
        select 's' || cast(o_orderkey as <S>) as scenario_id,
               case o_orderkey % 4 when 0 then 'minority_late_wrong' when 1 then 'contested'
                    when 2 then 'late_correction' else 'corroboration_foiled' end as shape,
               'order.' || cast(o_orderkey as <S>) as corroboration_key,
               'total is ' || o_orderstatus as correct_value, 'total is not ' || o_orderstatus as decoy_value
        from orders"""),
}


def _closure(name: str) -> list[str]:
    found: list[str] = []

    def add(n: str) -> None:
        if n in VIEWS and n not in found:
            for need in VIEWS[n][0]:
                add(need)
            found.append(n)

    add(name)
    return found


def ctes(*names: str) -> list[str]:
    """CTE definitions of the views and of what they read, for the reference dialect."""
    order: list[str] = []
    for name in names:
        order += [n for n in _closure(name) if n not in order]
    return [f"{n} as ({_render(VIEWS[n][1], spark=False)})" for n in order]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table or a view over them."""
    if name not in VIEWS:
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return spread(rows) if name in FACT_TABLES else rows
    needs, sql = VIEWS[name]
    inputs = {n: table(spark, sf_dir, n) for n in needs}
    text = _render(sql, spark=True)
    for n in needs:
        text = _bind(text, n)
    return spark.sql(text, **inputs)


def _bind(sql: str, name: str) -> str:
    """Point ``from name`` and ``join name`` at the DataFrame passed under that name."""
    return re.sub(rf"\b(from|join)\s+{name}\b", rf"\1 {{{name}}}", sql)
