"""Queries over vectors and texts: capture decisions, conflicts, retrieval, answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factfold.functions.geo import within_radius
from factfold.functions.text import TOKEN_REGEX
from factfold.operators import answers, capture, clustering, evaluation, retrieval
from factfold.operators.fold import KEY
from factfold.params import KnnParams, RetrievalParams
from factfold.plans import pipelines
from factfold.plans.function_queries import _NEGATED_SQL, _NUMBERS_SQL
from factfold.plans.registry import ORACLES, query, with_ctes
from factfold.plans.views import ctes, table
from factfold.session import keep

RETRIEVAL = RetrievalParams()


def contradicts_sql(a: str, b: str) -> str:
    a, b = f"coalesce({a}, '')", f"coalesce({b}, '')"
    return (f"({_NUMBERS_SQL.format(a)} is distinct from {_NUMBERS_SQL.format(b)} or "
            f"regexp_matches({a}, '{_NEGATED_SQL}') <> regexp_matches({b}, '{_NEGATED_SQL}'))")


NOVELTY_SQL = ctes("captures") + [
    """near as (select q.capture_id, d.point_id as near_point, d.value as near_value,
            round(list_cosine_similarity(q.vec, d.vec), 6) as score
        from captures q join captures d on d.device_id = q.device_id and d.slot = q.slot
            and d.client_sequence < q.client_sequence
        qualify row_number() over (partition by q.capture_id order by round(list_cosine_similarity(q.vec, d.vec), 6) desc,
                                   d.capture_id) = 1)""",
    """novel as (select c.*, near_point is not null and near_point <> point_id as usable,
            near_point is not null as any_near,
            case when near_point is not null and near_point <> point_id then score else 0.75 end as similarity,
            case when near_point is not null and near_point <> point_id then near_value end as neighbour_value
        from captures c left join near using (capture_id))""",
]


@query("novelty", with_ctes(NOVELTY_SQL, """
    select capture_id, similarity, neighbour_value, round(greatest(0, least(1, 1 - similarity)), 6) as novelty from novel"""))
def novelty(spark, sf):
    return capture.novelty(table(spark, sf, "captures")).select(
        "capture_id", "similarity", "neighbour_value", F.round("novelty", 6).alias("novelty"))


_PII_EMAIL = "\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,}\\b"

DECIDE_SQL = NOVELTY_SQL + [
    f"""facets as (select *, regexp_matches(value, '(?i){_PII_EMAIL}') as pii, contains(lower(value), 'gas') as urgent,
            {contradicts_sql('value', 'neighbour_value')} as contra, status is null as incomplete,
            case when usable then 'similarity-based novelty ' || printf('%.3f', similarity)
                 when any_near then 'only its own copy is stored, novelty assumed'
                 else 'nothing stored yet, novelty assumed' end as novelty_text,
            case when contains(lower(value), 'gas') then 'urgency 1.00 (keywords: gas)'
                 else 'urgency 0.00' end as urgency_text,
            'personal data by pattern {_PII_EMAIL}' as pii_text from novel)""",
    """raw as (select *, case
            when pii and similarity >= 0.98 - 1e-9 and not contra then 'REJECT'
            when pii and urgent then 'REDACT_AND_QUEUE' when pii then 'KEEP_LOCAL'
            when similarity >= 0.98 - 0.02 and not contra then 'REJECT'
            when urgent or similarity < 0.70 then 'QUEUE_HIGH' when similarity < 0.98 then 'QUEUE_LOW'
            else 'KEEP_LOCAL' end as raw_verdict from facets)""",
    """decided as (select *, case when raw_verdict = 'QUEUE_LOW' and incomplete then 'KEEP_LOCAL' else raw_verdict end as verdict,
            case when pii and raw_verdict = 'REJECT' then pii_text || '; ' || novelty_text
                 when pii and urgent then pii_text || '; ' || urgency_text when pii then pii_text
                 when raw_verdict = 'REJECT' then 'already known: ' || novelty_text
                 when urgent then urgency_text else novelty_text end
            || case when raw_verdict = 'QUEUE_LOW' and incomplete
                    then '; kept back, lacking: status' else '' end as reason from raw)""",
]


@query("capture_decisions", with_ctes(DECIDE_SQL, """
    select capture_id, verdict, reason, case when verdict = 'QUEUE_HIGH' then 'URGENT'
               when verdict in ('QUEUE_LOW', 'REDACT_AND_QUEUE') then 'ROUTINE' else 'HELD' end as sync_priority,
           (verdict in ('QUEUE_HIGH', 'QUEUE_LOW', 'REDACT_AND_QUEUE'))::int as syncable from decided"""))
def capture_decisions(spark, sf):
    decided = capture.decide(capture.novelty(table(spark, sf, "captures")))
    return decided.select("capture_id", "verdict", "reason", "sync_priority", "syncable")


@query("stream_decisions", ORACLES["capture_decisions"])
def stream_decisions(spark, sf):
    """The captures in two parts, oldest first, the second one sent again as a retry."""
    from factfold.session import scratch_folder
    from factfold.sources.tables import Store
    from factfold.streaming import feeds

    store = Store(spark, scratch_folder(spark, "feed"))
    rows = table(spark, sf, "captures").withColumn("capture_id", F.lpad(F.col("capture_id").cast("string"), 12, "0"))
    half = rows.agg(F.percentile_approx("client_sequence", 0.5)).first()[0]
    for name, part in (("old", F.col("client_sequence") <= half), ("new", F.col("client_sequence") > half), ("again", F.col("client_sequence") > half)):
        source = scratch_folder(spark, f"feed-{name}")
        rows.filter(part).write.parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        feeds.run(stream, feeds.decision_step(store), scratch_folder(spark, f"feed-{name}-cp")).awaitTermination()
    fed = store.read("decision_feed", "capture_id string, verdict string, reason string, sync_priority string")
    return fed.select(F.col("capture_id").cast("bigint").alias("capture_id"), "verdict", "reason", "sync_priority",
                      F.col("sync_priority").isin("URGENT", "ROUTINE").cast("int").alias("syncable"))


CONFLICTS_SQL = ctes("captures") + [
    f"""near10 as (select q.capture_id, d.capture_id as other_id, round(list_cosine_similarity(q.vec, d.vec), 6) as score
        from captures q join captures d on d.device_id = q.device_id and d.client_sequence < q.client_sequence
            and lower(trim(q.zone)) = lower(trim(d.zone)) and q.point_id <> d.point_id
            and (q.corroboration_key is distinct from d.corroboration_key or {contradicts_sql('q.value', 'd.value')})
        qualify row_number() over (partition by q.capture_id order by round(list_cosine_similarity(q.vec, d.vec), 6) desc,
                                   d.capture_id) <= 10)""",
    """conflicts as (select n.capture_id, q.point_id::varchar as new_point_id, d.point_id::varchar as existing_point_id,
            max(score) as score, q.device_id, q.zone, q.value as new_value, d.value as existing_value, q.corroboration_key as new_key,
            d.corroboration_key as existing_key
        from near10 n join captures q on q.capture_id = n.capture_id join captures d on d.capture_id = n.other_id
        where score >= 0.6 group by all)"""]


def _conflicts(spark, sf):
    rows = table(spark, sf, "captures")
    return rows, capture.possible_conflicts(rows, rows.withColumn("shard", F.lit("mutable")), threshold=0.6,
                                            earlier_only=True)


@query("possible_conflicts", with_ctes(CONFLICTS_SQL, "select *, 'POSSIBLE_CONFLICT' as status from conflicts"))
def possible_conflicts(spark, sf):
    _, found = _conflicts(spark, sf)
    return found.withColumns({c: F.col(c).cast("string") for c in ("new_point_id", "existing_point_id")})


@query("flag_conflicts", with_ctes(CONFLICTS_SQL, """
    select c.capture_id, (n.capture_id is not null)::int as has_conflict, coalesce(n.ids, '') as conflict_with
    from captures c left join (select capture_id, string_agg(distinct existing_point_id, ',' order by existing_point_id) as ids
                               from conflicts group by all) n using (capture_id)"""))
def flag_conflicts(spark, sf):
    rows, found = _conflicts(spark, sf)
    return capture.flag_conflicts(rows, found).select(
        "capture_id", "has_conflict", F.array_join("conflict_with", ",").alias("conflict_with"))


# The sequential rule as a fold over a key's reports: ``f`` are the founders, ``a`` the answers.
_SAME = """f.nums = x.nums and f.neg = x.neg and round(list_cosine_similarity(f.vec, x.vec), 6) >= 0.86"""


@query("value_clusters", with_ctes(ctes("captures") + [
    f"""reports as (select corroboration_key as k, list({{'id': capture_id, 'value': value, 'vec': vec,
            'nums': {_NUMBERS_SQL.format('value')}, 'neg': regexp_matches(value, '{_NEGATED_SQL}')}} order by capture_id) as r
        from captures group by all)""",
    f"""walked as (select k, list_reduce(list_transform(r, lambda x: {{'f': [x], 'a': [{{'id': x.id, 'v': x.value}}]}}),
        lambda s, y: case when len(list_filter(s.f, lambda f: {_SAME.replace('x.', 'y.f[1].')})) > 0
            then {{'f': s.f, 'a': list_append(s.a, {{'id': y.a[1].id, 'v': list_filter(s.f, lambda f: {_SAME.replace('x.', 'y.f[1].')})[1].value}})}}
            else {{'f': list_append(s.f, y.f[1]), 'a': list_append(s.a, y.a[1])}} end) as w from reports)"""], """
    select a.id as capture_id, k as corroboration_key, md5(k || chr(0) || a.v) as value_cluster
    from (select k, unnest(w.a) as a from walked) t"""))
def value_clusters(spark, sf):
    rows = table(spark, sf, "captures").withColumn("seq", F.col("capture_id") + 1)
    return clustering.assign_value_cluster(rows.select(KEY, "capture_id", "value", "vec", "seq")).select(
        "capture_id", KEY, "value_cluster")


@query("device_trend", with_ctes(ctes("captures") + [
    """frames as (select *, case when capture_id % 6 <> 0 then vec end as v from captures where modality = 'vision')""",
    """lagged as (select *, last_value(v ignore nulls) over (partition by device_id, corroboration_key
            order by client_timestamp_ns, point_id rows between unbounded preceding and 1 preceding) as prev from frames)""",
    """drifts as (select *, case when v is not null and prev is not null
            then round(greatest(0, 1 - list_dot_product(prev, v)), 4) end as d from lagged)""",
    """latest as (select device_id, corroboration_key, coalesce(arg_max(d, client_timestamp_ns) filter (d is not null), 0)
            as latest_drift from drifts group by all)"""], """
    select device_id, corroboration_key, capture_id, client_timestamp_ns, coalesce(d, 0.0) as drift, latest_drift,
           case when latest_drift >= 0.15 then 'EVOLVING' else 'STABLE' end as status
    from drifts join latest using (device_id, corroboration_key)
    qualify row_number() over (partition by device_id, corroboration_key order by client_timestamp_ns desc) <= 6"""))
def device_trend(spark, sf):
    frames = table(spark, sf, "captures").filter("modality = 'vision'")
    seen = frames.select("device_id", KEY, F.col("capture_id").alias("point_id"), "client_timestamp_ns",
                         F.when(F.col("capture_id") % 6 != 0, F.col("vec")).alias("vec"))
    return capture.trend(seen).withColumnRenamed("point_id", "capture_id")


@query("stored_after_capture", with_ctes(NOVELTY_SQL[:-2] + [
    """stored as (select device_id, point_id, max(client_sequence) as client_sequence from captures group by all)"""], """
    select device_id, point_id::varchar as point_id, client_sequence from stored"""))
def stored_after_capture(spark, sf):
    got = pipelines.capture_pipeline(table(spark, sf, "captures").drop("point_id"))
    return got.facts.select("device_id", F.col("point_id").cast("string").alias("point_id"), "client_sequence")


# The branches for large tables, with blocks so small that the supplied tables reach them.
SMALL = KnnParams(block_rows=64, pivots=8, broadcast_rows=0)


@query("novelty_pruned", ORACLES["novelty"])
def novelty_pruned(spark, sf):
    return capture.novelty(table(spark, sf, "captures"), knn=SMALL).select(
        "capture_id", "similarity", "neighbour_value", F.round("novelty", 6).alias("novelty"))


@query("conflicts_pruned", ORACLES["possible_conflicts"])
def conflicts_pruned(spark, sf):
    rows = table(spark, sf, "captures")
    found = capture.possible_conflicts(rows, rows.withColumn("shard", F.lit("mutable")), threshold=0.6, earlier_only=True, knn=SMALL)
    return found.withColumns({c: F.col(c).cast("string") for c in ("new_point_id", "existing_point_id")})


@query("value_clusters_rounds", ORACLES["value_clusters"])
def value_clusters_rounds(spark, sf):
    rows = table(spark, sf, "captures").withColumn("seq", F.col("capture_id") + 1)
    return clustering.assign_value_cluster(rows.select(KEY, "capture_id", "value", "vec", "seq"), block_rows=64).select(
        "capture_id", KEY, "value_cluster")


# --- retrieval ------------------------------------------------------------------------------

def _corpus(spark, sf):
    """Documents and benchmark passages, each with a vector of the supplied table."""
    vecs = table(spark, sf, "embeddings")
    n = vecs.count()
    docs = table(spark, sf, "documents").select("doc_id", "text", (F.col("doc_id") % n).alias("vec_id"))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text",
                                                 ((F.col("item_id") * 7) % n).alias("vec_id"))
    shard = F.when(F.col("doc_id") % 11 == 0, None).when(F.col("doc_id") % 7 == 0, "archive").when(
        F.col("doc_id") % 2 == 0, "mutable").otherwise("immutable")
    named = vecs.select("vec_id", F.col("embedding").alias("vec"))
    return (asked.join(named, "vec_id").drop("vec_id"),
            docs.join(named, "vec_id").drop("vec_id").withColumn("shard", shard))


#: Ids of vectors that are sent to every task; more are joined by a shuffle.
_SENT_IDS = 1 << 20


def _texts_and_vectors(spark, sf):
    """The documents of ``_corpus`` in three parts: all texts, the vectors, and what narrows rows with a ``doc_id`` to those with a vector.

    The last is a join that is shuffled once the ids are too many to send, so it is for rows without texts.
    """
    vecs = table(spark, sf, "embeddings")
    n = vecs.count()
    vec_id = F.col("doc_id") % n
    docs = table(spark, sf, "documents").select("doc_id", "text")
    ids = vecs.select("vec_id")
    ids = F.broadcast(ids) if n <= _SENT_IDS else ids

    def members(rows):
        return rows.withColumn("vec_id", vec_id).join(ids, "vec_id").drop("vec_id")

    named = vecs.select("vec_id", F.col("embedding").alias("vec"))
    return docs, docs.select("doc_id", vec_id.alias("vec_id")).join(named, "vec_id").drop("vec_id"), members


CORPUS_SQL = [
    "n as (select count(*) as n from embeddings)",
    """docs as (select doc_id, text, embedding::double[] as vec, case when doc_id % 11 = 0 then null when doc_id % 7 = 0 then 'archive'
            when doc_id % 2 = 0 then 'mutable' else 'immutable' end as shard
        from documents, n join embeddings on vec_id = doc_id % n)""",
    """asked as (select item_id as query_id, text, embedding::double[] as vec
        from benchmark, n join embeddings on vec_id = item_id * 7 % n)""",
    "q_terms as (select distinct query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) as term from asked)",
    "d_terms as (select doc_id, shard, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) as term from docs)",
]


def legs_sql(p: str, shard: str | None) -> list[str]:
    """CTEs dense and lexical legs of one shard, or of all."""
    where = {None: "", "null": "where shard is null"}.get(shard, f"where shard = '{shard}'")
    return [
        f"""{p}len as (select doc_id, len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) as l from docs {where})""",
        f"{p}size as (select count(*) as n, avg(l) as avg_l from {p}len)",
        f"{p}tf as (select doc_id, term, count(*) as tf from d_terms {where} group by all)",
        f"{p}df as (select term, count(*) as df from {p}tf group by all)",
        f"""{p}lex as (select query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
                / (tf + 1.2 * (0.25 + 0.75 * l / avg_l))), 6) as score
            from q_terms join {p}tf using (term) join {p}df using (term) join {p}len using (doc_id), {p}size group by all)""",
        f"""{p}lexical as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from {p}lex
            qualify rank <= 25)""",
        f"""{p}dense as (select query_id, doc_id, round(list_cosine_similarity(a.vec, d.vec), 6) as score,
                row_number() over (partition by query_id order by round(list_cosine_similarity(a.vec, d.vec), 6) desc, doc_id) as rank
            from asked a, docs d {where} qualify rank <= 25)""",
        f"""{p}rrf as (select query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) as score
            from (select query_id, doc_id, rank from {p}dense union all select query_id, doc_id, rank from {p}lexical) group by all)""",
        f"""{p}fused as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from {p}rrf
            qualify rank <= 5)""",
    ]


@query("bm25_topk", with_ctes(CORPUS_SQL + legs_sql("", None), "select query_id, doc_id, score, rank from lexical"))
def bm25_topk(spark, sf):
    asked, docs = _corpus(spark, sf)
    return retrieval.bm25_topk(asked, docs, 25)


@query("dense_topk", with_ctes(ctes("vectors"), """
    select vec_id as query_id, v.id as doc_id, round(list_cosine_similarity(e.embedding::double[], v.v), 6) as score,
           row_number() over (partition by vec_id order by round(list_cosine_similarity(e.embedding::double[], v.v), 6) desc, v.id) as rank
    from embeddings e, vectors v qualify rank <= 10"""))
def dense_topk(spark, sf):
    asked = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    return retrieval.dense_topk(asked, table(spark, sf, "vectors").select(F.col("id").alias("doc_id"), F.col("v").alias("vec")), 10)


@query("bm25_by_join", ORACLES["bm25_topk"])
def bm25_by_join(spark, sf):
    asked, docs = _corpus(spark, sf)
    return retrieval.bm25_topk(asked, docs, 25, max_query_terms=0)


@query("dense_topk_blocks", ORACLES["dense_topk"])
def dense_topk_blocks(spark, sf):
    asked = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    docs = table(spark, sf, "vectors").select(F.col("id").alias("doc_id"), F.col("v").alias("vec"))
    return retrieval.dense_topk(asked, docs, 10, KnnParams(block_rows=512, pivots=8, broadcast_rows=0))


# Documents get a place each; only those within five kilometres take part in any leg.
NEAR_SQL = [c if not c.startswith("docs as") else c[:-1] + """
        where 2 * 6371000.0 * asin(least(1, sqrt(pow(sin(radians(40.0 + (doc_id % 100) / 1000.0 - 40.03) / 2), 2)
            + cos(radians(40.03)) * cos(radians(40.0 + (doc_id % 100) / 1000.0))
              * pow(sin(radians(-74.0 - (doc_id % 37) / 1000.0 + 74.01) / 2), 2)))) <= 5000)""" for c in CORPUS_SQL]


@query("hybrid_nearby", with_ctes(NEAR_SQL + legs_sql("", None), "select query_id, doc_id, score, rank from fused"))
def hybrid_nearby(spark, sf):
    asked, docs = _corpus(spark, sf)
    placed = docs.withColumns({"lat": 40.0 + F.col("doc_id") % 100 / 1000.0, "lon": -74.0 - F.col("doc_id") % 37 / 1000.0})
    return retrieval.hybrid_query(asked, within_radius(placed, 40.03, -74.01, 5000.0), RETRIEVAL, mode="global")


@query("hybrid_global", with_ctes(CORPUS_SQL + legs_sql("", None), "select query_id, doc_id, score, rank from fused"))
def hybrid_global(spark, sf):
    asked, docs = _corpus(spark, sf)
    return retrieval.hybrid_query(asked, docs, RETRIEVAL, mode="global")


@query("hybrid_per_shard", with_ctes(CORPUS_SQL + legs_sql("m_", "mutable") + legs_sql("i_", "immutable") + legs_sql("a_", "archive")
                                     + legs_sql("n_", "null"), """
    select *, row_number() over (partition by query_id order by score desc, doc_id) as rank
    from (select query_id, doc_id, max(score) as score from (select query_id, doc_id, score from m_fused
          union all select query_id, doc_id, score from i_fused union all select query_id, doc_id, score from a_fused
          union all select query_id, doc_id, score from n_fused) u group by all) t"""))
def hybrid_per_shard(spark, sf):
    asked, docs = _corpus(spark, sf)
    return retrieval.hybrid_query(asked, docs, RETRIEVAL)


@query("hybrid_with_image_leg", with_ctes(ctes("vectors") + CORPUS_SQL + legs_sql("", None) + [
    """pictures as (select query_id, id - 100000 as doc_id, row_number() over (partition by query_id
            order by round(list_cosine_similarity(vec, v), 6) desc, id) as rank
        from asked, vectors where copy = 1 qualify rank <= 25)""",
    """three as (select query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) as score
        from (select query_id, doc_id, rank from dense union all select query_id, doc_id, rank from lexical
              union all select query_id, doc_id, rank from pictures) u group by all)"""], """
    select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from three qualify rank <= 5"""))
def hybrid_with_image_leg(spark, sf):
    asked, docs = _corpus(spark, sf)
    pictures = table(spark, sf, "vectors").filter("copy = 1").select(
        (F.col("id") - 100000).alias("doc_id"), F.col("v").alias("vec"))
    return retrieval.hybrid_query(asked, docs, RETRIEVAL, mode="global", image_queries=asked, image_docs=pictures)


#: Characters of passages that are sent to every task at once.
_PASSAGE_CHARS = 4 << 20


def passages_in_documents(asked, docs, members=lambda pairs: pairs):
    """``query_id, doc_id`` where a passage occurs whole in a document; ``members`` narrows the pairs to the documents that take part.

    A passage's inner words (all but the first and the last, which may be parts of words) must stand in the document.
    The longest of them is an equi-join and the passage itself decides, both where the text lies: passages are
    sent to the texts in counted blocks, and texts are never shuffled. Passages without inner words are compared as they are.
    """
    words = F.regexp_extract_all("text", F.lit(TOKEN_REGEX), F.lit(1))
    inner = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))
    longest = F.reduce(inner, F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    passages = keep(asked.filter(F.col("text").isNotNull()).select("query_id", F.col("text").alias("passage"), longest.alias("word")), "passages")
    blocks = -(-(passages.agg(F.sum(F.length("passage"))).first()[0] or 1) // _PASSAGE_CHARS)
    seen = docs.select("doc_id", "text", F.explode(F.array_distinct(words)).alias("word"))
    found = []
    for block in range(blocks):
        mine = passages.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        found.append(seen.join(F.broadcast(mine.filter("word <> ''")), "word").filter(F.contains("text", "passage")))
        found.append(docs.select("doc_id", "text").join(F.broadcast(mine.filter("word = ''")), F.contains("text", "passage")))
    pairs = reduce(DataFrame.unionByName, [f.select("query_id", "doc_id") for f in found])
    return keep(members(pairs).select("query_id", "doc_id"), "pairs")


# Some passages of one to four words besides the supplied ones.
SHORT_SQL = [c if not c.startswith("asked as") else """asked as (select item_id as query_id, text, embedding::double[] as vec
        from (select item_id, text from benchmark union all
              select 100000 + item_id, array_to_string(string_split(text, ' ')[2:2 + item_id % 4], ' ') from benchmark where item_id % 3 = 0) b,
             n join embeddings on vec_id = item_id * 7 % n)""" for c in CORPUS_SQL]


def _with_short(spark, sf):
    vecs = table(spark, sf, "embeddings")
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    short = asked.filter("query_id % 3 = 0").select((F.col("query_id") + 100000).alias("query_id"), F.array_join(
        F.slice(F.split("text", " "), F.lit(2), (F.col("query_id") % 4 + 1).cast("int")), " ").alias("text"))
    named = vecs.select("vec_id", F.col("embedding").alias("vec"))
    return asked.union(short).withColumn("vec_id", F.col("query_id") * 7 % vecs.count()).join(named, "vec_id").drop("vec_id")


@query("score_recall", with_ctes(SHORT_SQL + legs_sql("", None) + [
    "wanted as (select query_id, doc_id from asked a, docs d where contains(d.text, a.text))",
    "labelled as (select query_id, case when query_id % 3 = 0 then 'third' else 'other' end as shape from wanted group by all)",
    """hits as (select l.query_id, l.shape,
            exists (select 1 from dense d join wanted w using (query_id, doc_id) where d.query_id = l.query_id and rank <= 5) as d,
            exists (select 1 from fused d join wanted w using (query_id, doc_id) where d.query_id = l.query_id and rank <= 5) as h
        from labelled l)"""], """
    select coalesce(shape, 'all') as shape, count(*) as queries, count_if(d)::bigint as dense_hits, count_if(h)::bigint as hybrid_hits,
           round(count_if(d) / count(*), 4) as dense_recall, round(count_if(h) / count(*), 4) as hybrid_recall,
           count_if(h)::bigint - count_if(d)::bigint as hybrid_only_hits
    from hits group by rollup(shape)"""))
def score_recall(spark, sf):
    asked = keep(_with_short(spark, sf), "asked")
    texts, vectors, members = _texts_and_vectors(spark, sf)
    wanted = passages_in_documents(asked, texts, members)
    shape = F.when(F.col("query_id") % 3 == 0, "third").otherwise("other")
    dense = keep(retrieval.dense_topk(asked, vectors, RETRIEVAL.prefetch), "dense")
    lexical = keep(retrieval.bm25_topk(asked, texts, RETRIEVAL.prefetch, members=members), "lexical")
    return evaluation.score_recall(asked.select("query_id", shape.alias("shape")), wanted, dense, retrieval.rrf_fuse([dense, lexical]))


# --- answers --------------------------------------------------------------------------------

HITS_SQL = CORPUS_SQL + legs_sql("", None) + [
    """hits as (select l.query_id, l.doc_id, l.score, d.text as value, case when doc_id % 5 = 0 then 'CONFIRMED'
            when doc_id % 5 = 1 then 'DISPUTED' when doc_id % 5 = 2 then 'RESOLVED' when doc_id % 5 = 3 then 'UNKNOWN' end as consensus_state
        from lexical l join docs d using (doc_id))""",
    """clean as (select *, regexp_replace(regexp_replace(translate(value, chr(13) || chr(10), '  '),
            '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '^\\s+|\\s+$', '', 'g') as v,
            row_number() over (partition by query_id order by case when consensus_state in ('CONFIRMED', 'RESOLVED_LWW') then 0
                when consensus_state = 'DISPUTED' then 2 else 1 end, score desc, doc_id) as position
        from hits qualify position <= 5)""",
    "lines as (select *, case when consensus_state = 'DISPUTED' then '[DISPUTED] ' || v else v end as line from clean)",
]


def _context(spark, sf):
    asked, docs = _corpus(spark, sf)
    states = F.when(F.col("doc_id") % 5 == 0, "CONFIRMED").when(F.col("doc_id") % 5 == 1, "DISPUTED").when(
        F.col("doc_id") % 5 == 2, "RESOLVED").when(F.col("doc_id") % 5 == 3, "UNKNOWN")
    hits = retrieval.bm25_topk(asked, docs, 25).join(docs.select("doc_id", F.col("text").alias("value")), "doc_id")
    context = answers.select_context(hits.withColumn("consensus_state", states))
    return asked.select("query_id", "text"), context


@query("select_context", with_ctes(HITS_SQL, "select query_id, doc_id, position, line as context_line from lines"))
def select_context(spark, sf):
    _, context = _context(spark, sf)
    return context.select("query_id", "doc_id", "position", "context_line")


@query("extractive_answer", with_ctes(HITS_SQL, """
    select query_id, case when max(l.query_id) is null then 'No local records match that question.' else 'Based on local records: '
        || string_agg(line, ' | ' order by position) filter (position <= 3) end as answer
    from asked left join lines l using (query_id) group by query_id"""))
def extractive_answer(spark, sf):
    return answers.extractive_answer(answers.gather_context(*_context(spark, sf))).select("query_id", "answer")


@query("extractive_cited", with_ctes(HITS_SQL, """
    select query_id, case when max(l.query_id) is null then 'No local records match that question.' else 'Based on local records: '
        || string_agg(v || ' [' || position || ']', ' ' order by position) filter (v <> '') end as answer
    from asked left join lines l using (query_id) group by query_id"""))
def extractive_cited(spark, sf):
    return answers.extractive_cited(answers.gather_context(*_context(spark, sf))).select("query_id", "answer")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query("grounded_prompts", with_ctes(HITS_SQL, f"""
    select query_id, {_quoted(answers.INSTRUCTIONS)} || coalesce(string_agg('- ' || line, chr(10) order by position),
        {_quoted(answers.NO_CONTEXT)}) || {_quoted(answers.CONTEXT_END)} || text || chr(10) || 'Answer:' as prompt
    from asked left join lines using (query_id) group by query_id, text"""))
def grounded_prompts(spark, sf):
    return answers.grounded_prompts(answers.gather_context(*_context(spark, sf))).select("query_id", "prompt")


@query("cited_prompts", with_ctes(HITS_SQL, f"""
    select query_id, {_quoted(answers.INSTRUCTIONS)} || coalesce(string_agg('- [' || position || '] ' || line, chr(10) order by position),
        {_quoted(answers.NO_CONTEXT)}) || {_quoted(answers.CONTEXT_END)} || text || {_quoted(answers.CITE_INSTRUCTION)} || chr(10)
        || 'Answer:' as prompt
    from asked left join lines using (query_id) group by query_id, text"""))
def cited_prompts(spark, sf):
    return answers.grounded_prompts(answers.gather_context(*_context(spark, sf)), cited=True).select("query_id", "prompt")


def _unreachable(prompt: str) -> str:
    raise ConnectionError("no model here")


def _last_fact(prompt: str) -> str:
    """A stand-in model: it repeats the last fact it is shown and cites it."""
    facts = [line for line in prompt.split("\n") if line.startswith("- [")]
    if not facts:
        raise LookupError("nothing to say")
    number = facts[-1][3:facts[-1].index("]")]
    return f"The records mention this. [{number}] Nothing else is known."


@query("generator_chain")
def generator_chain(spark, sf):
    prompts = answers.grounded_prompts(answers.gather_context(*_context(spark, sf)), cited=True)
    chain = [("remote", "online", _unreachable), ("stand-in", "offline", _last_fact)]
    return answers.answer(prompts, chain, cited=True).select("query_id", "answer", "answer_path", "model", "sentences")


@query("cited_sentences", with_ctes(ctes("answers") + [
    """split as (select conv_id, turn, list_filter(string_split(regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),
            lambda s: trim(s) <> '') as s from answers)""",
    "sentences as (select conv_id, turn, unnest(s) as sentence, unnest(range(len(s))) as sentence_no from split)",
    """marked as (select *, list_transform(regexp_extract_all(sentence, '\\[(\\d+)\\]', 1), lambda m: m::bigint) as marks from sentences)"""], """
    select conv_id, turn, sentence_no, trim(regexp_replace(regexp_replace(sentence, '\\[(\\d+)\\]', '', 'g'), '\\s+', ' ', 'g')) as text,
           array_to_string(list_filter(marks, lambda m: m between 1 and 5), ',') as citations,
           len(marks) > 0 and len(list_filter(marks, lambda m: m not between 1 and 5)) = 0 as supported
    from marked"""))
def cited_sentences(spark, sf):
    rows = answers.cited_sentences(table(spark, sf, "answers"), F.lit(5))
    return rows.withColumn("citations", F.array_join(F.col("citations").cast("array<string>"), ","))
