"""Lexical, dense and fused retrieval for a table of queries."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from factfold.functions.text import tokens
from factfold.operators.knn import nearest
from factfold.params import DEFAULT_KNN, KnnParams, RetrievalParams
from factfold.session import keep

SCORE_PLACES = 6
#: Texts counted at once.
_TEXTS = 256
# The same words as ``tokens``: letters, digits and underscores.
_WORDS = re.compile(r"\w+")


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id"))
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def dense_topk(queries: DataFrame, docs: DataFrame, k: int, knn: KnnParams = DEFAULT_KNN) -> DataFrame:
    """``query_id, doc_id, score, rank`` by cosine. Rows without the vector are no candidates."""
    q = queries.select(F.col("query_id").alias("q_id"), F.col("vec").alias("q_vec"))
    d = docs.select(F.col("doc_id").alias("d_id"), F.col("vec").alias("d_vec"))
    return nearest(q, d, k, params=knn).select(
        F.col("q_id").alias("query_id"), F.col("d_id").alias("doc_id"), "score", "rank")


def slot_vectors(facts: DataFrame, slot: str) -> DataFrame:
    """``doc_id, vec`` of the facts that have the named vector."""
    return facts.select(F.col("point_id").alias("doc_id"), F.col("vectors")[slot].alias("vec")).filter(
        F.col("vec").isNotNull())


def query_terms(queries: DataFrame) -> DataFrame:
    """Distinct terms of each query."""
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))


def _count_terms(number: dict[str, int]):
    """Length of each text and how often it holds each asked term; one pass, no row per word."""
    def scan(batches):
        for batch in (b.slice(at, _TEXTS) for b in batches for at in range(0, b.num_rows, _TEXTS)):
            lengths, offsets, terms, counts = [], [0], [], []
            for text in batch.column(1).to_pylist():
                words = _WORDS.findall((text or "").lower())
                found = Counter(t for t in map(number.get, words) if t is not None)
                lengths.append(len(words))
                terms += found.keys()
                counts += found.values()
                offsets.append(len(terms))
            pairs = pa.StructArray.from_arrays([pa.array(terms, pa.int32()), pa.array(counts, pa.int32())], ["t", "n"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)],
                names=["doc_id", "length", "tf"])
    return scan


def _score_batches(terms_by_query: list[tuple[object, np.ndarray]], idf: np.ndarray, avg_length: float, k: int,
                   params: RetrievalParams, q_type: pa.DataType):
    """Best ``k`` documents per query within each batch, so that no (query, document) pair is shuffled."""
    def scan(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, lists, counts = part.column(0), part.column(2), part.column(3)
                length = part.column(1).to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                t, tf = lists.flatten().to_numpy(), counts.flatten().to_numpy().astype(np.float64)
                damp = params.k1 * (1 - params.b + params.b * length[owner] / avg_length)
                dense = np.zeros((len(idf), part.num_rows))
                dense[t, owner] = idf[t] * tf * (params.k1 + 1) / (tf + damp)
                keys = ids.to_numpy(zero_copy_only=False)
                q_out, d_out, s_out = [], [], []
                for query, idx in terms_by_query:
                    scores = np.round(dense[idx].sum(axis=0), SCORE_PLACES)
                    hit = np.flatnonzero(scores > 0)
                    best = hit[np.lexsort((keys[hit], -scores[hit]))][:k]
                    q_out += [query] * len(best)
                    d_out += best.tolist()
                    s_out += scores[best].tolist()
                if q_out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(q_out, q_type), ids.take(pa.array(d_out)), pa.array(s_out, pa.float64())],
                        names=["query_id", "doc_id", "score"])
    return scan


def _all_rows(rows: DataFrame) -> DataFrame:
    return rows


def _bm25_in_batches(asked: pa.Table, docs: DataFrame, k: int, params: RetrievalParams,
                     members: Callable[[DataFrame], DataFrame] = _all_rows) -> DataFrame:
    number = {t: i for i, t in enumerate(sorted(set(asked["term"].to_pylist())))}
    by_query: dict = {}
    for query, term in zip(asked["query_id"].to_pylist(), asked["term"].to_pylist()):
        by_query.setdefault(query, []).append(number[term])
    d_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(_count_terms(number), f"doc_id {d_type}, length int, tf array<struct<t:int,n:int>>")
    # Two plain arrays from here on: a row holds an array of structs in four times the bytes, and ``members`` may shuffle it.
    flat = rows.select("doc_id", "length", F.col("tf.t").alias("t"), F.col("tf.n").alias("n"))
    counted = keep(members(flat).select("doc_id", "length", "t", "n"), "terms")
    n, avg_length = counted.agg(F.count(F.lit(1)), F.avg("length")).first()
    df = np.zeros(len(number))
    # At most one row per asked term.
    for t, count in counted.select(F.explode("t").alias("t")).groupBy("t").count().collect():
        df[t] = count
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    q_type = asked["query_id"].type
    scan = _score_batches([(q, np.array(sorted(i))) for q, i in by_query.items()], idf, avg_length or 1.0, k, params, q_type)
    return counted.mapInArrow(scan, f"query_id {_spark_type(q_type)}, doc_id {d_type}, score double")


def _spark_type(arrow: pa.DataType) -> str:
    from pyspark.sql.pandas.types import from_arrow_type

    return from_arrow_type(arrow).simpleString()


def _count_words(batches):
    """Length of each text and how often it holds each of its words; one pass, no row per word."""
    for batch in (b.slice(at, _TEXTS) for b in batches for at in range(0, b.num_rows, _TEXTS)):
        lengths, offsets, terms, counts = [], [0], [], []
        for text in batch.column(1).to_pylist():
            found = Counter(_WORDS.findall((text or "").lower()))
            lengths.append(found.total())
            terms += found.keys()
            counts += found.values()
            offsets.append(len(terms))
        pairs = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(counts, pa.int32())], ["term", "tf"])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(lengths, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)],
            names=["doc_id", "length", "words"])


#: Postings, and terms of queries, that one task scores against each other.
_POSTINGS, _ASKED = 1 << 21, 1 << 20


def _score_blocks(k: int, schema: pa.Schema):
    """Best ``k`` documents of a block for each query of a block, so that no (query, document) pair is shuffled."""
    def score(postings: pa.Table, asked: pa.Table) -> pa.Table:
        if not postings.num_rows or not asked.num_rows:
            return schema.empty_table()
        docs = postings["doc_id"].combine_chunks().dictionary_encode()
        keys, owner = docs.dictionary.to_numpy(zero_copy_only=False), docs.indices.to_numpy()
        terms = postings["term"].combine_chunks().dictionary_encode()
        order = np.argsort(terms.indices.to_numpy(), kind="stable")
        ends = np.searchsorted(terms.indices.to_numpy()[order], np.arange(len(terms.dictionary) + 1))
        owner, weight = owner[order], postings["w"].to_numpy()[order]
        found = pc.index_in(asked["term"].combine_chunks(), terms.dictionary)
        held = np.flatnonzero(np.asarray(found.is_valid()))
        number = found.take(pa.array(held)).to_numpy(zero_copy_only=False)
        asks = asked["query_id"].combine_chunks().take(pa.array(held)).dictionary_encode()
        by_query = np.argsort(asks.indices.to_numpy(), kind="stable")
        starts = np.searchsorted(asks.indices.to_numpy()[by_query], np.arange(len(asks.dictionary) + 1))
        q_out, d_out, s_out = [], [], []
        for query in range(len(asks.dictionary)):
            parts = [slice(ends[t], ends[t + 1]) for t in np.sort(number[by_query[starts[query]:starts[query + 1]]])]
            scores = np.round(np.bincount(np.concatenate([owner[p] for p in parts]),
                                          np.concatenate([weight[p] for p in parts]), len(keys)), SCORE_PLACES)
            hit = np.flatnonzero(scores > 0)
            if len(hit) > k:
                hit = hit[scores[hit] >= np.partition(scores[hit], -k)[-k]]
            best = hit[np.lexsort((keys[hit], -scores[hit]))][:k]
            q_out.append(np.full(len(best), query))
            d_out.append(best)
            s_out.append(scores[best])
        if not q_out:
            return schema.empty_table()
        at = [pa.array(np.concatenate(x)) for x in (q_out, d_out, s_out)]
        return pa.Table.from_arrays([asks.dictionary.take(at[0]), docs.dictionary.take(at[1]), at[2]], schema=schema)
    return score


def _bm25_by_join(asked: DataFrame, docs: DataFrame, k: int, params: RetrievalParams,
                  members: Callable[[DataFrame], DataFrame] = _all_rows) -> DataFrame:
    """Best ``k`` per query and block of documents; postings and queries are cut into blocks, each pair of which is one task."""
    wanted = keep(asked.select("term").distinct(), "terms")
    d_type, q_type = docs.schema["doc_id"].dataType.simpleString(), asked.schema["query_id"].dataType.simpleString()
    counted = docs.select("doc_id", "text").mapInArrow(
        _count_words, f"doc_id {d_type}, length int, words array<struct<term:string,tf:int>>")
    # A row without a term stands for the document itself, so that the texts are read once.
    rows = counted.select("doc_id", "length", F.explode(F.concat(
        "words", F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).alias("tf"))))).alias("p")).select("doc_id", "length", "p.*")
    asked_rows = rows.join(wanted.withColumn("_asked", F.lit(True)), "term", "left").filter("term is null or _asked").drop("_asked")
    kept = keep(members(asked_rows), "postings")
    n, avg_length = kept.filter("term is null").agg(F.count(F.lit(1)), F.avg("length")).first()
    postings = kept.filter("term is not null")
    frequency = keep(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "frequency")
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    damp = params.k1 * (1 - params.b + params.b * F.col("length") / F.lit(avg_length or 1.0))
    weight = idf * F.col("tf") * (params.k1 + 1) / (F.col("tf") + damp)
    cores = docs.sparkSession.sparkContext.defaultParallelism
    doc_blocks = max(cores, -(-postings.count() // _POSTINGS))
    query_blocks = max(1, -(-asked.count() // _ASKED))
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    mine = lambda name, blocks: F.pmod(F.xxhash64(name), F.lit(blocks)).cast("int")
    left = postings.join(frequency, "term").select("doc_id", "term", weight.alias("w")).withColumn(
        "_ld", mine("doc_id", doc_blocks)).withColumn("_lq", every(query_blocks))
    right = asked.withColumn("_rq", mine("query_id", query_blocks)).withColumn("_rd", every(doc_blocks))
    schema = f"query_id {q_type}, doc_id {d_type}, score double"
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return left.groupBy("_ld", "_lq").cogroup(right.groupBy("_rd", "_rq")).applyInArrow(_score_blocks(k, arrow), schema)


def bm25_topk(queries: DataFrame, docs: DataFrame, k: int, params: RetrievalParams = RetrievalParams(),
              max_query_terms: int = 50_000, members: Callable[[DataFrame], DataFrame] = _all_rows) -> DataFrame:
    """``query_id, doc_id, score, rank`` by BM25 over whole texts.

    With a checked, small set of query terms the texts are read once where they lie, and each batch
    of documents is scored without a shuffle. A larger set is joined to the postings in blocks of both.

    ``members`` narrows rows with a ``doc_id`` to the documents that take part. It is given the counted words and never
    the texts, so that a join in it shuffles no text, however large its other side is.
    """
    asked = query_terms(queries)
    held = asked.limit(max_query_terms + 1).toArrow()
    if held.num_rows == 0:
        return _ranked(queries.limit(0).crossJoin(docs.limit(0)).select(
            "query_id", "doc_id", F.lit(0.0).alias("score")), k)
    if held.num_rows <= max_query_terms:
        return _ranked(_bm25_in_batches(held, docs, k, params, members), k)
    return _ranked(_bm25_by_join(asked, docs, k, params, members), k)


def rrf_fuse(legs: Sequence[DataFrame], params: RetrievalParams = RetrievalParams(),
             limit: int | None = None) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists, each cut to the prefetch depth first."""
    parts = [leg.filter(F.col("rank") <= params.prefetch).select(
        "query_id", "doc_id",
        (F.lit(1.0) / (params.rrf_k + F.col("rank") - 1 + params.rank_base)).alias("part")) for leg in legs]
    fused = reduce(DataFrame.unionByName, parts).groupBy("query_id", "doc_id").agg(
        F.round(F.sum("part"), 9).alias("score"))
    return _ranked(fused, params.limit if limit is None else limit)


def best_of_shards(results: Sequence[DataFrame]) -> DataFrame:
    """Union of per-shard results; a document keeps its best score. The merged list is not cut again."""
    merged = reduce(DataFrame.unionByName, [r.select("query_id", "doc_id", "score") for r in results])
    best = merged.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id"))
    return best.withColumn("rank", F.row_number().over(order))


def hybrid_query(queries: DataFrame, docs: DataFrame, params: RetrievalParams = RetrievalParams(),
                 mode: str = "per_shard", image_queries: DataFrame | None = None,
                 image_docs: DataFrame | None = None, knn: KnnParams = DEFAULT_KNN) -> DataFrame:
    """Dense and lexical legs (and an optional image leg), fused.

    ``queries``: query_id, text, vec. ``docs``: doc_id, text, vec and ``shard``; filter them
    (for instance with ``within_radius``) beforehand and the filter holds in every leg.
    ``per_shard`` fuses inside each shard and keeps the best score; ``global`` fuses once.
    """
    def fuse(part: DataFrame, images: DataFrame | None) -> DataFrame:
        legs = [dense_topk(queries, part, params.prefetch, knn), bm25_topk(queries, part, params.prefetch, params)]
        if image_queries is not None and images is not None:
            legs.append(dense_topk(image_queries, images, params.prefetch, knn))
        return rrf_fuse(legs, params)

    if mode == "global":
        return fuse(docs, image_docs)
    if mode != "per_shard":
        raise ValueError(f"unknown mode: {mode}")
    shards = [r[0] for r in docs.select("shard").distinct().toLocalIterator()]  # a few names; null is one of them
    return best_of_shards([fuse(docs.filter(F.col("shard").eqNullSafe(F.lit(s))),
                                None if image_docs is None else image_docs.filter(F.col("shard").eqNullSafe(F.lit(s))))
                           for s in sorted(shards, key=str)] or [fuse(docs, image_docs)])
