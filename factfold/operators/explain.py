"""Plain-language reasons, every number read from the verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factfold.operators.fold import KEY


def _text(parts: list) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("None")) for p in parts])


def competing_values(values: DataFrame) -> DataFrame:
    """One phrase per competing value of a key, from the ranked values."""
    return values.withColumn("phrase", _text(["'", F.col("value"), "' (support ", F.col("support"), ")"]))


def explain(verdicts: DataFrame, votes_by_modality: DataFrame) -> DataFrame:
    """Reason sentences per verdict: ``reason``, ``cross_modal_reason`` and ``summary``.

    A dispute quotes its leading value and the number of values; ``competing_values`` has a row for every one.
    """
    c = F.col
    agreement = F.when(c("total_support") != 0, F.round(c("winner_support") / c("total_support"), 6)).otherwise(0.0)
    resolved = _text(["Decided by '", c("resolved_by"), "' at sequence ", c("resolved_seq"), ": '", c("value"), "' for '", c(KEY),
                      "'. Later reports that differ: ", c("post_resolution_conflicts"), "."])
    absent = _text(["All reports on '", c(KEY), "' were withdrawn."])
    single = _text(["Only '", c("winner_first_device"), "' reports '", c("value"), "'; confidence ", c("confidence"),
                    " of the ", c("threshold"), " needed."])
    confirmed = _text([c("winner_devices"), " of ", c("live_device_count"), " devices report '", c("value"), "' with support ",
                       c("winner_support"), " of ", c("total_support"), " (share ", agreement, "); confidence ", c("confidence"),
                       " reaches ", c("threshold"), "."])
    disputed = _text([c("live_device_count"), " devices report ", c("value_count"), " values; '", c("value"), "' leads with support ",
                      c("winner_support"), " of ", c("total_support"), " (share ", agreement, "), but confidence ", c("confidence"),
                      " is below ", c("threshold"), "."])
    reason = (F.when(c("status") == "RESOLVED", resolved).when(c("status") == "ABSENT", absent)
              .when(c("status") == "LWW", single).when(c("status") == "CONFIRMED", confirmed).otherwise(disputed))
    modal = F.when(c("cross_modal"), _text(["The value is backed by ", c("n_modalities"), " modalities (", c("modalities"),
                                            "), which counts as one more vote."]))
    names = votes_by_modality.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n_modalities"),
        F.array_join(F.array_sort(F.collect_list("modality")), ", ").alias("modalities"))
    return verdicts.join(names, KEY, "left").select(
        KEY, "status", reason.alias("reason"), modal.alias("cross_modal_reason"),
        F.concat_ws(" ", reason, modal).alias("summary"))
