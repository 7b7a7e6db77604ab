"""Exact histogram of encoded lengths, with suffix sums that answer for every context limit.

Tasks count their documents by length before anything is shuffled, so the exchange holds lengths and not documents.
Suffix sums are taken inside blocks of lengths and over the blocks' totals.

Cases: null and empty texts have length 0; repeated rows count each; other columns are ignored; an empty
table has an empty histogram and no answers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factfold.llm.common import in_arrow, slices
from factfold.llm.idfile import CHARS, VOCABULARY, word_coder

BLOCK = 1024


def histogram(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``length, n_docs``: documents by their number of ids, without special ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, counts = word_coder(vocabulary), Counter()
        for _, texts in slices(batches, chars=CHARS):
            counts.update(len(c) // coder.kind.itemsize for c in coder.encode(texts))
        yield pa.RecordBatch.from_arrays([pa.array([*counts], pa.int64()), pa.array([*counts.values()], pa.int64())], ["length", "n_docs"])

    rows = docs.select(F.col("text").cast("string").alias("text"))
    return in_arrow(rows, run, "length bigint, n_docs bigint").groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def with_suffix_sums(counts: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per length: documents and ids of at least this length, all ids when texts are cut to it, and the share of documents
    of at most this length."""
    counts = counts.withColumn("block", F.floor(F.col("length") / block))
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("length")).alias("t"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t"),
                           F.sum("d").over(whole).alias("all_docs"), F.sum("t").over(whole).alias("all_tokens"))
    within = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    rows = counts.withColumn("d0", F.sum("n_docs").over(within)).withColumn("t0", F.sum(F.col("n_docs") * F.col("length")).over(within))
    rows = rows.join(blocks, "block").withColumn("docs_at_least", F.col("d0") + F.col("d")).withColumn("tokens_at_least", F.col("t0") + F.col("t"))
    return rows.select("length", "n_docs", "docs_at_least", "tokens_at_least",
                       (F.col("all_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("truncated_tokens"),
                       ((F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("all_docs")).alias("share_at_most"))


def for_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """``limit, truncated_tokens, docs_over``: ids left when every text is cut to a limit, and how many texts are cut."""
    total = sums.agg(F.min(F.struct("length", "tokens_at_least")).alias("m")).select(F.col("m.tokens_at_least").alias("all_tokens"))
    wanted = sums.sparkSession.createDataFrame([(x,) for x in limits], "limit bigint")
    above = wanted.join(sums, F.col("length") > F.col("limit"), "left").groupBy("limit").agg(
        F.min(F.struct("length", "docs_at_least", "tokens_at_least")).alias("m"))
    return above.crossJoin(total).select("limit", F.coalesce(
        F.col("all_tokens") - F.col("m.tokens_at_least") + F.col("limit") * F.col("m.docs_at_least"), F.col("all_tokens")).alias("truncated_tokens"),
        F.coalesce("m.docs_at_least", F.lit(0)).alias("docs_over")).filter("truncated_tokens is not null")


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """``share, length``: the smallest length that at least a share of the documents does not exceed."""
    wanted = sums.sparkSession.createDataFrame([(x,) for x in shares], "share double")
    return wanted.join(sums, F.col("share_at_most") >= F.col("share")).groupBy("share").agg(F.min("length").alias("length"))
