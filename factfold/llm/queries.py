"""Registered queries of this subpackage: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factfold.llm import merkle, phrases, repeats, urls
from factfold.llm.common import crc_fold, keep, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


@query("op1_byte_bpe")
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factfold.llm.bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), ids=False, decoded=False)


@query("op7_decontamination")
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factfold.llm.decontam import find_passages, judge

    return judge(find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))).drop("spans", "items")


@query("op10_language_id")
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factfold.llm.langid import identify, train

    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc_fold("doc_id", 4) == 2)
    labelled = identify(docs, train(docs.filter("not held_out")), spans=False)
    return labelled.withColumn("held_out", crc_fold("doc_id", 4) == 2).select("doc_id", "held_out", "lang_pred", "score")


@query("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factfold.llm.quality import THRESHOLD, score_documents, train

    docs = table(spark, sf_dir, "documents")
    held_out = crc_fold("doc_id", 5) == 0
    model = train(docs.filter(~held_out), spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out))
    return score_documents(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


@query("op3_ngram_jaccard")
def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factfold.llm.jaccard import link_documents

    return link_documents(table(spark, sf_dir, "documents")).drop("text_hash", "component")


@query("op6_token_id_files")
def op6_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factfold.llm.idfile import new_folder, read_shards, write_shards

    return read_shards(write_shards(table(spark, sf_dir, "documents"), new_folder(spark)))


@query("op8_fingerprints")
def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factfold.llm.minhash import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


@query("op9_warc")
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as its archive gives it back, with its place in the merged order of captures."""
    from factfold.llm.warc import merge_indexes, new_folder, read_archives, write_archives

    manifest = write_archives(table(spark, sf_dir, "pages"), new_folder(spark))
    order = merge_indexes(manifest).select("path", "offset", "url_key", F.col("part").alias("key_range"), F.col("rank").alias("key_rank"))
    return read_archives(manifest).drop("url").join(order, ["path", "offset"], "left").drop("path", "offset")


@query("op4_url_filter", urls.ORACLE)
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factfold.llm.lengths import histogram, with_suffix_sums

    return with_suffix_sums(keep(histogram(table(spark, sf_dir, "documents")), "lengths"))


@query("op11_merkle_manifest", merkle.ORACLE)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factfold.llm.merkle import manifest_proofs

    return manifest_proofs(table(spark, sf_dir, "documents"))


@query("op12_collocations", phrases.ORACLE)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factfold.llm.phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


@query("op13_repeats", repeats.ORACLE)
def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factfold.llm.repeats import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))
