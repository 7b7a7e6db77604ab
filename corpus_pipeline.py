"""A corpus, stage by stage: quality, language, near duplicates, benchmark passages, token ids.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of the documents,
rows unchanged. Each result is written as Parquet and read again as the next stage's input, so a lost executor costs the
tasks of one stage only.

Cases: an empty table passes through all stages; null texts are judged as empty ones (see each operator); when no document
has both a language and letters, no language is learned and the language stage keeps every document with letters.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from factfold.llm import bpe, decontam, jaccard, langid, quality
from factfold.llm.common import keep

#: Near duplicates of a corpus; operator 3's own query has other values.
NEAR_WORDS, NEAR = 5, Fraction(8, 10)
#: Pieces that a worker of the last stage remembers: fewer than operator 1's own, as earlier stages leave a grown heap beside it.
REMEMBERED = 300_000


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, scores at least ``THRESHOLD``."""
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that covers at least half of their letters; ``lang`` stays as it was.

    Without a learned language all documents that have letters are kept.
    """
    return langid.keep_identified(docs, langid.train(docs))


def first_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every component of documents linked by five-word shingles at 0.8 or more."""
    return jaccard.keep_first(docs, words=NEAR_WORDS, threshold=NEAR)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages make up less than a twentieth."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every kept document, with the digests of the ids and of the text decoded from them."""
    return bpe.encode_documents(docs, ids=True, decoded=False, remembered=REMEMBERED)


STAGES = [("quality", good_quality), ("language", known_language), ("near_duplicates", first_of_near_duplicates),
          ("decontamination", without_benchmark), ("byte_bpe", token_ids)]
#: Training, Viterbi paths and token merges are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
