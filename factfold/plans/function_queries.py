"""Queries that apply each scalar function to a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from factfold.functions.embedding import HashEmbedder, embed
from factfold.functions import geo, ids, labels, redaction, text, vectors
from factfold.operators import capture, stamps
from factfold.operators.fold import KEY
from factfold.params import EMAIL_PATTERN, SSN_PATTERN, URGENCY_KEYWORDS, BackoffParams
from factfold.plans.registry import query, with_ctes
from factfold.plans.views import ctes, table

PII = (SSN_PATTERN, EMAIL_PATTERN)
_PII_SQL = f"(?i)(?:{SSN_PATTERN})|(?:{EMAIL_PATTERN})"
_NEGATED_SQL = "(?i)(?:^|[^\\p{L}\\p{N}_])(?:" + "|".join(m.replace("'", "''") for m in text.NEGATION_MARKERS) + \
    ")(?:$|[^\\p{L}\\p{N}_])"
_NUMBERS_SQL = "list_sort(list_transform(regexp_extract_all({0}, '\\d+(?:\\.\\d+)?'), lambda x: x::double))"


def _string(column: str):
    return F.col(column).cast("string").alias(column)


@query("fact_point_ids", """select o_orderkey, md5_number_upper(o_orderpriority || ':' || o_orderkey)::varchar as point_id
    from orders""")
def fact_point_ids(spark, sf):
    rows = table(spark, sf, "orders")
    point = ids.fact_point_id(F.col("o_orderpriority"), F.col("o_orderkey").cast("string"))
    return rows.select("o_orderkey", point.cast("string").alias("point_id"))


@query("image_point_ids", "select page_id, md5_number_upper(url || ':' || sha256(html))::varchar as point_id from pages")
def image_point_ids(spark, sf):
    point = ids.image_point_id(F.col("url"), F.col("html").cast("binary"))
    return table(spark, sf, "pages").select("page_id", point.cast("string").alias("point_id"))


@query("event_ids", with_ctes(ctes("point_events"), """
    select seq, md5(device_id || ':' || point_id || ':' || client_sequence) as event_id,
           md5('RESOLVED:' || corroboration_key || ':' || device_id || ':' || seq) as resolve_id,
           md5_number_upper('retract_marker:' || point_id)::varchar as marker_id,
           md5_number_upper(point_id || ':' || event_type || ':' || seq)::varchar as log_id,
           md5(corroboration_key || chr(0) || coalesce(nullif(value, 'down'), 'None')) as cluster_id
    from point_events"""))
def event_ids(spark, sf):
    c = F.col
    return table(spark, sf, "point_events").select(
        "seq", ids.event_id(c("device_id"), c("point_id"), c("client_sequence")).alias("event_id"),
        ids.resolve_event_id(c(KEY), c("device_id"), c("seq")).alias("resolve_id"),
        ids.retraction_marker_id(c("point_id")).cast("string").alias("marker_id"),
        ids.device_log_event_id(c("point_id"), c("event_type"), c("seq")).cast("string").alias("log_id"),
        ids.cluster_id(c(KEY), F.nullif(c("value"), F.lit("down"))).alias("cluster_id"))


@query("extract_numbers", f"""select doc_id, unnest(range(len(n))) as pos, unnest(n) as number
    from (select doc_id, {_NUMBERS_SQL.format('text')} as n from documents) t""")
def extract_numbers(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.posexplode(text.extract_numbers(F.col("text"))).alias("pos", "number"))


@query("negated_values", f"select doc_id, regexp_matches(text, '{_NEGATED_SQL}') as negated from documents")
def negated_values(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.is_negated(F.col("text")).alias("negated"))


@query("contradicting_turns", f"""
    select a.conv_id, a.turn, ({_NUMBERS_SQL.format('a.text')} is distinct from {_NUMBERS_SQL.format('b.text')}
        or regexp_matches(a.text, '{_NEGATED_SQL}') <> regexp_matches(b.text, '{_NEGATED_SQL}')) as contradicts
    from conversations a join conversations b on b.conv_id = a.conv_id and b.turn = a.turn + 1""")
def contradicting_turns(spark, sf):
    a = table(spark, sf, "conversations")
    b = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return a.join(b, ["conv_id", "turn"]).select(
        "conv_id", "turn", text.contradicts(F.col("text"), F.col("next")).alias("contradicts"))


@query("cosine_neighbours", """
    select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as cosine
    from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def cosine_neighbours(spark, sf):
    a = table(spark, sf, "embeddings")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return a.join(b, "vec_id").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("next")), 6).alias("cosine"))


def _scaled(spark, sf):
    return table(spark, sf, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x * F.col("label")).alias("vec"))


@query("unit_vectors", """
    with scaled as (select vec_id, list_transform(embedding, lambda x: x::double * label) as v from embeddings where label <> 0),
         normed as (select vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as n from scaled)
    select vec_id, unnest(range(64)) as pos, round(unnest(list_transform(v, lambda x: (x / n)::float::double)), 4) as x from normed""")
def unit_vectors(spark, sf):
    good, _ = vectors.split_valid(_scaled(spark, sf), "vec")
    return good.select("vec_id", F.posexplode("vec").alias("pos", "x")).withColumn("x", F.round(F.col("x").cast("double"), 4))


@query("quarantined_vectors", "select vec_id from embeddings where label = 0")
def quarantined_vectors(spark, sf):
    _, bad = vectors.split_valid(_scaled(spark, sf), "vec")
    return bad.select("vec_id")


@query("hash_embedding", """
    with hexed as (select doc_id, sha256(encode(text) || '\\x00\\x00\\x00\\x00'::blob) || sha256(encode(text) || '\\x00\\x00\\x00\\x01'::blob) as h
                   from documents),
         raw as (select doc_id, list_transform(range(64), lambda i: ('0x' || substr(h, 1 + 2 * i::int, 2))::int / 255.0::double - 0.5::double) as v from hexed),
         normed as (select doc_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as n from raw)
    select doc_id, unnest(range(64)) as pos, round(unnest(list_transform(v, lambda x: (x / n)::float::double)), 4) as x from normed""")
def hash_embedding(spark, sf):
    rows = embed(table(spark, sf, "documents").select("doc_id", "text"), "text", HashEmbedder())
    return rows.select("doc_id", F.posexplode("vec").alias("pos", "x")).withColumn("x", F.round(F.col("x").cast("double"), 4))


@query("vector_slots", """
    select vec_id, case when label % 3 = 0 then 'image' when len(embedding) = 384 then 'text' when len(embedding) = 512 then 'image'
           when len(embedding) = 64 then 'small' end as slot from embeddings""")
def vector_slots(spark, sf):
    model = F.when(F.col("label") % 3 == 0, "image").otherwise("unnamed")
    slots = {**vectors.SLOT_DIMS, "small": 64}
    return table(spark, sf, "embeddings").select("vec_id", vectors.slot_for(model, F.col("embedding"), slots).alias("slot"))


@query("redact_text", f"""
    select doc_id, regexp_replace(text, '{_PII_SQL}', '[REDACTED]', 'g') as text,
           len(regexp_extract_all(text, '{_PII_SQL}')) as n_spans from documents""")
def redact_text(spark, sf):
    cut = table(spark, sf, "documents").withColumn("r", redaction.redact(F.col("text"), PII))
    return cut.select("doc_id", F.col("r.text").alias("text"), F.coalesce(F.size("r.spans"), F.lit(0)).alias("n_spans"))


@query("redact_outbound", f"""
    select doc_id, regexp_replace(text, '{_PII_SQL}', '[REDACTED]', 'g') as value,
           regexp_matches(text, '{_PII_SQL}')::int as redacted from documents""")
def redact_outbound(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("value"), F.lit("text").alias("modality"))
    return redaction.redact_outbound(docs, PII).select("doc_id", "value", "redacted")


@query("first_pii_pattern", f"""
    select doc_id, case when regexp_matches(text, '(?i){SSN_PATTERN}') then '{SSN_PATTERN}'
                        when regexp_matches(text, '(?i){EMAIL_PATTERN}') then '{EMAIL_PATTERN}' end as pattern
    from documents""")
def first_pii_pattern(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.first_pii_pattern(F.col("text"), PII).alias("pattern"))


_WORDS = ("the", "le", "que", "and the", *URGENCY_KEYWORDS)


@query("urgency_keywords", f"""
    select doc_id, case when len(k) > 0 then 1.0 else 0.0 end as urgency, array_to_string(k, '|') as keywords
    from (select doc_id, list_filter({sorted(_WORDS)}, lambda w: contains(lower(text), w)) as k from documents) t""")
def urgency_keywords(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", text.urgency(F.col("text"), _WORDS).alias("urgency"),
        F.array_join(text.matched_keywords(F.col("text"), _WORDS), "|").alias("keywords"))


@query("missing_fields", with_ctes(ctes("captures"), """
    select capture_id, array_to_string(list_filter([case when status is null then 'status' end, 'temperature'],
           lambda x: x is not null), '|') as missing from captures"""))
def missing_fields(spark, sf):
    rows = table(spark, sf, "captures")
    need = ("status", "client_timestamp_ns", "temperature")
    return rows.select("capture_id", F.array_join(F.array_sort(text.missing_fields(need, rows.columns)), "|").alias("missing"))


@query("sanitize_fact", """
    select doc_id, regexp_replace(regexp_replace(translate(text, chr(13) || chr(10), '  '),
        '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '^\\s+|\\s+$', '', 'g') as clean from documents""")
def sanitize_fact(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.sanitize_fact(F.col("text")).alias("clean"))


@query("value_preview", "select doc_id, substring(text, 1, 100) as preview from documents")
def value_preview(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.value_preview(F.col("text")).alias("preview"))


@query("record_labels", with_ctes(ctes("queue"), """
    select id, case when synced = 1 then 'synced' when syncable = 0 then 'local_only' else 'pending' end as sync_state,
           case consensus_state when 'DISPUTED' then 'DISPUTED' when 'CONFIRMED' then 'CONFIRMED' end as shown,
           value * (1 + 0.01::double * greatest(0, age_s)) / greatest(1, bytes) as score,
           (case when id % 12 <= 0 then 0 else least(60000, 1000 * pow(2, id % 12 - 1)) end)::bigint as retry_ms from queue"""))
def record_labels(spark, sf):
    c = F.col
    return table(spark, sf, "queue").select(
        "id", labels.sync_state(c("synced"), c("syncable")).alias("sync_state"),
        labels.display_state(c("consensus_state")).alias("shown"),
        labels.fact_score(c("value"), c("age_s"), c("bytes")).alias("score"),
        labels.backoff_ms(c("id") % 12, BackoffParams()).alias("retry_ms"))


@query("record_bytes", """
    select doc_id, strlen(to_json({'doc_id': doc_id, 'lang': lang, 'source': source})) as bytes from documents""")
def record_bytes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", labels.record_bytes("doc_id", "lang", "source").alias("bytes"))


@query("hash_routing", """
    select doc_id, (('0x' || substr(h, 57, 8))::ubigint % 4)::bigint as device_no,
           (('0x' || substr(h, 57, 8))::ubigint // 4 % 4)::bigint as zone_no,
           (list_reduce(list_transform(range(8), lambda i: ('0x' || substr(h, 1 + 8 * i::int, 8))::hugeint),
               lambda a, x: (a * 4294967296 + x) % 176) % 176 // 16)::int as category_no
    from (select doc_id, sha256(text) as h from documents) t""")
def hash_routing(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", ids.hash_bits(t, 0, 2).alias("device_no"), ids.hash_bits(t, 2, 2).alias("zone_no"),
        ids.hash_mod(t, 4, 11).alias("category_no"))


_GAS = "select event_id, value * 12 as m, (user_id % 80) * cast(0.93 as double) as e from events"


@query("classify_gas", f"""
    select event_id, case when m >= 1000 and e >= 50 then 'combined_hazard' when m >= 1000 then 'methane_high'
        when e >= 50 then 'ethylene_high' when m >= 250 then 'methane_low' when e >= 5 then 'ethylene_low' else 'safe' end as label
    from ({_GAS}) t""")
def classify_gas(spark, sf):
    rows = table(spark, sf, "events").selectExpr("event_id", "value * 12 as m", "(user_id % 80) * double(0.93) as e")
    return rows.select("event_id", labels.classify_gas(F.col("m"), F.col("e")).alias("label"))


PLACES_SQL = """select c_custkey, 2 * 6371000.0 * asin(least(1, sqrt(pow(sin(radians(lat - 40.05) / 2), 2)
    + cos(radians(40.05)) * cos(radians(lat)) * pow(sin(radians(lon + 74.01) / 2), 2)))) as d from places"""


@query("within_radius", with_ctes(ctes("places"), f"""
    select c_custkey, round(d, 1) as distance_m from ({PLACES_SQL}) t where d <= 2500"""))
def within_radius(spark, sf):
    return geo.within_radius(table(spark, sf, "places"), 40.05, -74.01, 2500.0).select("c_custkey", "distance_m")


@query("resolve_location", with_ctes(ctes("places"), """
    select c_custkey, coalesce(lat, case when n_nationkey % 5 <> 0 then n_nationkey * 1.5::double end) as lat,
           coalesce(lon, case when n_nationkey % 5 <> 0 then n_nationkey * -2.5::double end) as lon
    from places left join nation on zone = 'z' || n_nationkey"""))
def resolve_location(spark, sf):
    known = F.col("n_nationkey") % 5 != 0
    zones = table(spark, sf, "nation").select(
        F.concat(F.lit("z"), F.col("n_nationkey").cast("string")).alias("zone"),
        F.when(known, F.col("n_nationkey") * 1.5).alias("zone_lat"),
        F.when(known, F.col("n_nationkey") * -2.5).alias("zone_lon"))
    rows = geo.resolve_location(table(spark, sf, "places"), zones)
    return rows.select("c_custkey", F.col("location.lat").alias("lat"), F.col("location.lon").alias("lon"))


PROMPTS_CTE = "prompts as (select label as p, arg_min(embedding::double[], vec_id) as pv from embeddings group by all)"
_LADDER_SQL = """round(greatest(0.05, least(0.95, (list_dot_product(embedding::double[], pv) - 0.10) / 0.25)), 2)"""


def _ladders(spark, sf):
    """Every vector against one prompt per label, the label's first vector."""
    rows = table(spark, sf, "embeddings")
    prompts = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("prompt_vec")).withColumn(
        "prompt", F.concat(F.lit("prompt "), F.col("label").cast("string")))
    return capture.severity_ladder(rows.select("vec_id", F.col("embedding").alias("vec")), prompts)


@query("severity_ladder", with_ctes([PROMPTS_CTE], f"""
    select vec_id, 'prompt ' || p as prompt, {_LADDER_SQL} as score from embeddings, prompts"""))
def severity_ladder(spark, sf):
    return _ladders(spark, sf).select("vec_id", F.explode("ladder").alias("s")).select("vec_id", "s.*")


@query("top_severity", with_ctes([PROMPTS_CTE], f"""
    select vec_id, max({_LADDER_SQL}) as confidence from embeddings, prompts group by all"""))
def top_severity(spark, sf):
    return _ladders(spark, sf).select("vec_id", "confidence")


@query("image_labels", """
    select page_id, case when page_id % 4 = 0 then 'given' when regexp_matches(lower(url), 'fire|flame') then 'fire'
        when contains(lower(url), 'smoke') then 'smoke' else 'none' end as label from pages""")
def image_labels(spark, sf):
    given = F.when(F.col("page_id") % 4 == 0, "given")
    return table(spark, sf, "pages").select("page_id", labels.image_label(given, F.col("url")).alias("label"))


def _stamp_tables(spark, sf):
    v = table(spark, sf, "vectors")
    own = v.filter("copy = 0").groupBy("label").agg(F.min_by("v", "id").alias("probe"))
    mixed = v.filter("copy = 1").groupBy("label").agg(F.min_by("v", "id").alias("mixed"))
    slot = F.concat(F.lit("slot-"), F.col("label").cast("string"))
    local = stamps.with_space_id(own.filter("label <> 1").select(
        slot.alias("slot"), F.lit("model").alias("name"), F.lit("text").alias("modality"), F.lit(64).alias("dim"), "probe"))
    incoming = stamps.with_space_id(own.join(mixed, "label").select(
        slot.alias("slot"), F.lit("model").alias("name"), F.lit("text").alias("modality"),
        F.when(F.col("label") == 3, 65).otherwise(64).alias("dim"),
        F.when(F.col("label") % 2 == 0, F.col("mixed")).otherwise(F.col("probe")).alias("probe")))
    return local, incoming


STAMPS_SQL = ctes("vectors") + [
    "own as (select label, arg_min(v, id) as probe from vectors where copy = 0 group by all)",
    "mixed as (select label, arg_min(v, id) as mixed from vectors where copy = 1 group by all)"]


@query("stamp_problems", with_ctes(STAMPS_SQL, """
    select 'slot-' || label as slot, case when label = 3 then 'model differs' else 'space differs' end as problem
    from own join mixed using (label)
    where label <> 1 and (label = 3 or (label % 2 = 0 and list_cosine_similarity(probe, mixed) < 0.999))"""))
def stamp_problems(spark, sf):
    return stamps.stamp_problems(*_stamp_tables(spark, sf)).select("slot", "problem")


@query("new_slots", with_ctes(STAMPS_SQL, "select 'slot-' || label as slot from own join mixed using (label) where label = 1"))
def new_slots(spark, sf):
    return stamps.new_slots(*_stamp_tables(spark, sf)).select("slot")
