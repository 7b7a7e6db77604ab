"""Labelled sets: resolver against last-write-wins, and recall of retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factfold.operators.fold import KEY, OBSERVED, fold_consensus
from factfold.params import FoldParams
from factfold.session import keep

# Who reports what, in order, with which trust, for each dispute shape.
SCENARIO_PLANS = {
    "minority_late_wrong": (("truth", 0.8), ("truth", 0.8), ("truth", 0.8), ("decoy", 0.3)),
    "contested": (("truth", 0.6), ("decoy", 0.6), ("truth", 0.6), ("decoy", 0.6)),
    "late_correction": (("decoy", 0.3), ("decoy", 0.3), ("truth", 0.8)),
    "corroboration_foiled": (("truth", 0.4), ("decoy", 0.9), ("decoy", 0.9)),
}


def expand_scenarios(facts: DataFrame) -> DataFrame:
    """Labelled facts to event logs, one log per scenario. An unknown shape fails the job."""
    plan = F.lit(None).cast("array<struct<truthful:boolean,trust:double>>")
    for shape, steps in SCENARIO_PLANS.items():
        listed = F.array(*[F.struct(F.lit(w == "truth").alias("truthful"), F.lit(t).alias("trust")) for w, t in steps])
        plan = F.when(F.col("shape") == shape, listed).otherwise(plan)
    checked = F.coalesce(plan, F.raise_error(F.concat(F.lit("unknown scenario shape: "), F.coalesce(
        "shape", F.lit("null")))).cast("array<struct<truthful:boolean,trust:double>>"))
    rows = facts.select("scenario_id", "shape", KEY, "correct_value", "decoy_value",
                        F.posexplode(checked).alias("pos", "step"))
    seq = (F.col("pos") + 1).cast("bigint")
    return rows.select(
        "scenario_id", "shape", F.col(KEY).alias("fact_key"), F.col("scenario_id").alias(KEY),
        F.concat_ws("-", F.lit("dev"), "scenario_id", seq.cast("string")).alias("device_id"),
        F.when(F.col("step.truthful"), F.col("correct_value")).otherwise(F.col("decoy_value")).alias("value"),
        F.lit(OBSERVED).alias("event_type"), seq.alias("seq"),
        (seq * 1_000_000_000).alias("client_timestamp_ns"), F.col("step.trust").alias("device_trust_at_report"))


def lww_resolve(events: DataFrame) -> DataFrame:
    """Value of the newest observation per key; withdrawals are not looked at."""
    return events.filter(F.col("event_type") == OBSERVED).groupBy(KEY).agg(
        F.max_by("value", "seq").alias("lww_value"))


def resolver_resolve(events: DataFrame, fold: FoldParams = FoldParams()) -> DataFrame:
    """The fold's value where it settles on one, else null (an abstention)."""
    settled = F.col("status").isin("CONFIRMED", "LWW")
    return fold_consensus(events, fold).select(KEY, F.when(settled, F.col("value")).alias("resolver_value"))


def score_resolver_vs_lww(facts: DataFrame, fold: FoldParams = FoldParams()) -> DataFrame:
    """Counts and accuracies per shape, and in total (``shape`` = ``all``). Exact equality decides."""
    labelled = facts.filter(F.col("correct_value").isNotNull())
    if labelled.isEmpty():
        raise ValueError("no scorable scenarios")
    events = expand_scenarios(labelled)
    truth = labelled.select(F.col("scenario_id").alias(KEY), "shape", "correct_value")
    picks = (truth.join(resolver_resolve(events, fold), KEY, "left").join(lww_resolve(events), KEY, "left")
             .withColumns({
                 "r": (F.coalesce(F.col("resolver_value") == F.col("correct_value"), F.lit(False))).cast("int"),
                 "l": (F.coalesce(F.col("lww_value") == F.col("correct_value"), F.lit(False))).cast("int"),
                 "a": F.col("resolver_value").isNull().cast("int")}))
    counted = picks.rollup("shape").agg(
        F.count(F.lit(1)).alias("scenarios"), F.sum("r").alias("resolver_correct"),
        F.sum("l").alias("lww_correct"), F.sum("a").alias("resolver_abstained"))
    n = F.col("scenarios")
    return counted.withColumn("shape", F.coalesce("shape", F.lit("all"))).withColumns({
        "resolver_accuracy": F.round(F.col("resolver_correct") / n, 4),
        "lww_accuracy": F.round(F.col("lww_correct") / n, 4),
        "accuracy_delta": F.round((F.col("resolver_correct") - F.col("lww_correct")) / n, 4)})


def score_recall(queries: DataFrame, relevant: DataFrame, dense: DataFrame, hybrid: DataFrame,
                 k: int = 5) -> DataFrame:
    """Share of labelled queries with a relevant document in the top ``k``, per shape and in total.

    ``queries``: query_id, shape; ``relevant``: query_id, doc_id; queries without a relevant document
    are left out. ``hybrid_only_hits`` is a difference of totals and may be negative.
    """
    wanted = relevant.select("query_id", "doc_id")
    scored = queries.join(wanted.select("query_id").distinct(), "query_id", "left_semi")

    if scored.isEmpty():
        raise ValueError("no labelled queries")

    def hits(results: DataFrame, name: str) -> DataFrame:
        # Kept, so that Spark knows how few they are and does not shuffle what is relevant for them.
        top = keep(results.filter(F.col("rank") <= k).select("query_id", "doc_id"), "top")
        return wanted.join(top, ["query_id", "doc_id"]).select("query_id").distinct().withColumn(name, F.lit(1))

    both = (scored.select("query_id", "shape").join(hits(dense, "d"), "query_id", "left")
            .join(hits(hybrid, "h"), "query_id", "left"))
    counted = both.rollup("shape").agg(
        F.count(F.lit(1)).alias("queries"), F.count("d").alias("dense_hits"), F.count("h").alias("hybrid_hits"))
    n = F.col("queries")
    return counted.withColumn("shape", F.coalesce("shape", F.lit("all"))).withColumns({
        "dense_recall": F.round(F.col("dense_hits") / n, 4), "hybrid_recall": F.round(F.col("hybrid_hits") / n, 4),
        "hybrid_only_hits": F.col("hybrid_hits") - F.col("dense_hits")})


def compare_with_truth(verdicts: DataFrame, truths: DataFrame) -> DataFrame:
    """Scenario verdicts against ``ground_truth`` (KEY, scenario_id, ground_truth); no verdict is no match."""
    return truths.join(verdicts.select(KEY, "status", "value", "confidence"), KEY, "left").withColumn(
        "match", F.coalesce(F.col("value") == F.col("ground_truth"), F.lit(False)))
