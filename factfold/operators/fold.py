"""The consensus fold: an append-only log becomes one verdict per fact key.

Every step is an algebraic aggregate (max_by, sum, product, min), so Spark combines on the
map side and a key that holds a large share of the log is spread over all tasks. Lists that
grow with a key (votes, ranked values, backers) are rows of their own tables.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factfold.params import FoldParams
from factfold.session import keep

KEY = "corroboration_key"
OBSERVED, RETRACTED, RESOLVED = "OBSERVED", "RETRACTED", "RESOLVED"
_CARRIED = ("event_type", "value", "value_cluster", "modality", "seq", "received_at_ns", "device_trust_at_report")
_OPTIONAL = {"value_cluster": "string", "modality": "string", "received_at_ns": "bigint",
             "device_trust_at_report": "double", "client_sequence": "bigint", "resolver_id": "string"}


def with_optional_columns(events: DataFrame) -> DataFrame:
    """Add the columns a caller may leave out, as nulls."""
    missing = {n: F.lit(None).cast(t) for n, t in _OPTIONAL.items() if n not in events.columns}
    return events.withColumns(missing) if missing else events


def _order():
    return F.struct(F.coalesce("client_sequence", "seq"), F.col("seq"))


def latest_by_device(events: DataFrame, decisions_compete: bool = False) -> DataFrame:
    """Each device's newest event per key, by device order first and hub order second.

    An event that arrives late, or a retry logged again, therefore never displaces a newer one.
    """
    log = with_optional_columns(events)
    if not decisions_compete:
        log = log.filter(F.col("event_type") != RESOLVED)
    newest = F.max_by(F.struct(*_CARRIED), _order()).alias("e")
    return log.groupBy(KEY, "device_id").agg(newest).select(KEY, "device_id", "e.*")


def _shape_decisions(newest: DataFrame) -> DataFrame:
    return newest.filter(F.col("r").isNotNull()).select(
        KEY,
        F.col("r.value").alias("resolved_value"),
        F.coalesce(F.when(F.col("r.value_cluster") != "", F.col("r.value_cluster")),
                   F.col("r.value")).alias("resolved_cluster"),
        F.coalesce(F.col("r.value_cluster"), F.lit("")).eqNullSafe("").alias("resolved_unclustered"),
        F.col("r.resolver_id").alias("resolved_by"),
        F.col("r.seq").alias("resolved_seq"),
    )


def latest_resolutions(events: DataFrame) -> DataFrame:
    """The newest operator decision of each key."""
    log = with_optional_columns(events).filter(F.col("event_type") == RESOLVED)
    newest = F.max_by(F.struct("value", "value_cluster", "resolver_id", "seq"), F.col("seq"))
    return _shape_decisions(log.groupBy(KEY).agg(newest.alias("r")))


@dataclass
class Ballots:
    """What every fold of a log starts from.

    ``latest``: each device's newest event per key. ``resolutions``: the newest decision per key.
    ``seen``: the newest event of any kind per key, where it was asked for. ``decided`` is false
    only when it is known that no key has a decision.
    """

    latest: DataFrame
    resolutions: DataFrame
    seen: DataFrame | None = None
    decided: bool = True


def read_ballots(events: "DataFrame | Ballots", params: FoldParams = FoldParams()) -> Ballots:
    """Ballots of a log, not yet computed."""
    if isinstance(events, Ballots):
        return events
    return Ballots(latest_by_device(events, params.decisions_compete), latest_resolutions(events))


def keep_ballots(events: "DataFrame | Ballots", params: FoldParams = FoldParams()) -> Ballots:
    """Ballots written out after one pass over the log, for work that folds it more than once."""
    if isinstance(events, Ballots):
        return events
    log = with_optional_columns(events)
    extra = {n: F.lit(None).cast(t) for n, t in {"client_timestamp_ns": "bigint", "thumbnail_url": "string"}.items()
             if n not in log.columns}
    decision = F.col("event_type") == RESOLVED
    voting = F.lit(True) if params.decisions_compete else ~decision
    digest = keep(log.withColumns(extra).groupBy(KEY, "device_id").agg(
        F.max_by(F.struct(*_CARRIED), F.when(voting, _order())).alias("e"),
        F.max_by(F.struct("value", "value_cluster", "resolver_id", "seq"),
                 F.when(decision, F.col("seq"))).alias("r"),
        F.max_by(F.struct("client_timestamp_ns", "modality", "thumbnail_url", "seq"), "seq").alias("s")), "ballots")
    made = digest.filter(F.col("r").isNotNull()).groupBy(KEY).agg(F.max_by("r", "r.seq").alias("r"))
    resolutions = keep(_shape_decisions(made), "decisions")
    return Ballots(
        latest=digest.filter(F.col("e").isNotNull()).select(KEY, "device_id", "e.*"),
        resolutions=resolutions,
        seen=digest.groupBy(KEY).agg(F.max_by("s", "s.seq").alias("e")),
        decided=not resolutions.isEmpty(),
    )


def _recency(votes: DataFrame, params: FoldParams) -> DataFrame:
    if params.uses_clock:
        age = F.greatest(F.lit(0.0), F.lit(float(params.now_ns)) - F.col("received_at_ns").cast("double"))
        decayed = F.pow(F.lit(0.5), age / F.lit(float(params.half_life_ns)))
        return votes.withColumn("recency", F.coalesce(decayed, F.lit(1.0)))
    if params.decay == 0.0:
        return votes.withColumn("recency", F.lit(1.0))
    newest = votes.filter("live").groupBy(KEY).agg(F.max("seq").alias("_newest"))
    gap = F.lit(-params.decay) * (F.col("_newest") - F.col("seq"))
    return votes.join(newest, KEY, "left").withColumn("recency", F.exp(gap)).drop("_newest")


def weigh(latest: DataFrame, params: FoldParams, trust: DataFrame | None = None) -> DataFrame:
    """Votes with trust, recency and weight; ``live`` is false for a withdrawn report.

    With a ``trust`` table (device_id, trust, optionally per key) a device it does not name gets
    the default.
    """
    votes = (latest.withColumn("live", F.col("event_type") == OBSERVED)
             .withColumn("cluster", F.coalesce(F.when(F.col("value_cluster") != "", F.col("value_cluster")),
                                               F.col("value"))))
    default = F.lit(params.default_trust)
    if trust is None:
        votes = votes.withColumn("trust", F.coalesce("device_trust_at_report", default))
    else:
        scope = [KEY, "device_id"] if KEY in trust.columns else ["device_id"]
        named = trust.select(*scope, F.col("trust").cast("double").alias("trust"))
        votes = votes.join(named, scope, "left").withColumn("trust", F.coalesce("trust", default))
    return _recency(votes, params).withColumn("weight", F.col("trust") * F.col("recency"))


def clamp01(w: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), w))


def noisy_or(w: Column) -> Column:
    """Aggregate: chance that at least one of several independent votes is right."""
    return F.lit(1.0) - F.product(F.lit(1.0) - clamp01(w))


def value_support(votes: DataFrame) -> DataFrame:
    """One row per key and live value cluster (plus one row holding a key's withdrawn reports)."""
    modality = F.coalesce("modality", F.lit("text"))
    return votes.groupBy(KEY, "live", F.when(F.col("live"), F.col("cluster")).alias("cluster")).agg(
        F.sum("weight").alias("raw_support"),
        F.min("value").alias("value"),
        F.min("device_id").alias("first_device"),
        F.count(F.lit(1)).alias("devices"),
        F.product(F.lit(1.0) - clamp01(F.col("weight"))).alias("doubt"),
        (F.min(modality) != F.max(modality)).alias("mixed"),
    ).withColumn("support", F.round("raw_support", 6))


def _rank_key() -> Column:
    return F.struct(-F.col("support"), F.col("value"), F.col("first_device"))


def judge(support: DataFrame, params: FoldParams) -> DataFrame:
    """Verdict per key from its value clusters, before any operator decision."""
    best = F.min_by(F.struct("cluster", "value", "support", "devices", "doubt", "mixed", "first_device"),
                    F.when(F.col("live"), _rank_key()))
    live_devices = F.sum(F.when(F.col("live"), F.col("devices")).otherwise(0))
    per_key = support.groupBy(KEY).agg(
        best.alias("w"),
        F.coalesce(F.sum(F.when(F.col("live"), F.col("raw_support"))), F.lit(0.0)).alias("total"),
        live_devices.cast("bigint").alias("live_device_count"),
        F.count(F.when(F.col("live"), 1)).alias("value_count"),
        F.round(F.sum(F.when(F.col("live"), F.col("support"))), 6).alias("total_support"),
    )
    extra = F.when(F.col("w.mixed"), F.lit(1.0 - max(0.0, min(1.0, params.cross_modal_weight)))).otherwise(F.lit(1.0))
    share = F.when(F.col("total") != 0, F.col("w.support") / F.col("total")).otherwise(F.lit(0.0))
    agreed = F.round((F.lit(1.0) - F.col("w.doubt") * extra) * share, 6)
    none_live = F.col("live_device_count") == 0
    confidence = F.when(none_live, F.lit(0.0)).otherwise(agreed)
    status = (F.when(none_live, "ABSENT").when(F.col("live_device_count") == 1, "LWW")
              .when(confidence >= params.threshold, "CONFIRMED").otherwise("DISPUTED"))
    return per_key.select(
        KEY, status.alias("status"), F.col("w.value").alias("value"), F.col("w.cluster").alias("winner_cluster"),
        confidence.alias("confidence"), F.lit(params.threshold).alias("threshold"), "live_device_count",
        F.coalesce(F.col("w.mixed"), F.lit(False)).alias("cross_modal"),
        F.col("w.value").alias("winner_value"), F.col("w.support").alias("winner_support"),
        F.coalesce(F.col("w.devices"), F.lit(0)).cast("bigint").alias("winner_devices"),
        F.col("w.first_device").alias("winner_first_device"),
        F.coalesce("total_support", F.lit(0.0)).alias("total_support"), "value_count",
    )


def disagreements(votes: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Live reports made after a key's decision that do not share its cluster.

    A decision that named no stored fact has no cluster; it is compared by value instead.
    """
    same = F.when(F.col("resolved_unclustered"), F.col("value").eqNullSafe(F.col("resolved_value"))).otherwise(
        F.col("cluster").eqNullSafe(F.col("resolved_cluster")))
    later = votes.filter("live").join(resolutions, KEY).filter(F.col("seq") > F.col("resolved_seq"))
    return later.filter(~same).select(KEY, "device_id", "value", "seq", "resolved_seq")


def apply_resolutions(verdicts: DataFrame, resolutions: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Let each key's newest decision override the fold, also where nothing is live."""
    counted = conflicts.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_conflicts"))
    decided = resolutions.join(counted, KEY, "left").select(
        KEY, F.lit(True).alias("decided"), "resolved_value", "resolved_by", "resolved_seq",
        F.coalesce("n_conflicts", F.lit(0)).alias("post_resolution_conflicts"))
    out = verdicts.join(decided, KEY, "full_outer")
    hit = F.coalesce("decided", F.lit(False))
    return out.withColumns({
        "status": F.when(hit, F.lit(RESOLVED)).otherwise(F.col("status")),
        "value": F.when(hit, F.col("resolved_value")).otherwise(F.col("value")),
        "confidence": F.when(hit, F.lit(1.0)).otherwise(F.col("confidence")),
        "live_device_count": F.coalesce("live_device_count", F.lit(0)),
        "cross_modal": F.coalesce("cross_modal", F.lit(False)),
        "winner_devices": F.coalesce("winner_devices", F.lit(0)),
        "value_count": F.coalesce("value_count", F.lit(0)),
    }).drop("decided", "resolved_value")


def _votes(ballots: Ballots, params: FoldParams, trust: DataFrame | None) -> DataFrame:
    return weigh(ballots.latest, params, trust)


def fold_consensus(events: DataFrame | Ballots, params: FoldParams = FoldParams(),
                   trust: DataFrame | None = None) -> DataFrame:
    """One verdict per key. The log is read once: a raw log is reduced to kept ballots first."""
    ballots = keep_ballots(events, params)
    verdicts = judge(value_support(_votes(ballots, params, trust)), params)
    if not ballots.decided:
        none = {"resolved_by": F.lit(None).cast("string"), "resolved_seq": F.lit(None).cast("bigint"),
                "post_resolution_conflicts": F.lit(None).cast("bigint")}
        return verdicts.withColumns(none)
    # Decided keys are few; only their votes are looked at again.
    theirs = replace(ballots, latest=ballots.latest.join(ballots.resolutions.select(KEY), KEY, "left_semi"))
    conflicts = disagreements(weigh(theirs.latest, params), ballots.resolutions)
    return apply_resolutions(verdicts, ballots.resolutions, conflicts).withColumn(
        "threshold", F.lit(params.threshold))


def ranked_values(events: DataFrame | Ballots, params: FoldParams = FoldParams(),
                  trust: DataFrame | None = None) -> DataFrame:
    """Competing values of each key with support and backers; the winner of a key sorts first.

    Rows come without a rank number: ``order by support desc, value, first_device`` gives it, and
    numbering a key with very many values would put all of them in one task.
    """
    votes = _votes(read_ballots(events, params), params, trust)
    return value_support(votes).filter("live").select(KEY, "cluster", "value", "support", "devices", "first_device")


def contributions(events: DataFrame | Ballots, params: FoldParams = FoldParams(),
                  trust: DataFrame | None = None) -> DataFrame:
    """What each live device put into its key's verdict."""
    votes = _votes(read_ballots(events, params), params, trust).filter("live")
    return votes.select(KEY, F.col("device_id").alias("device"), "value", "cluster",
                        *[F.round(c, 6).alias(c) for c in ("trust", "recency", "weight")])


def backers(events: DataFrame | Ballots, params: FoldParams = FoldParams(),
            trust: DataFrame | None = None) -> DataFrame:
    """Live votes for the leading value of each key."""
    votes = _votes(read_ballots(events, params), params, trust)
    winners = judge(value_support(votes), params).select(KEY, F.col("winner_cluster").alias("cluster"))
    return votes.filter("live").join(winners, [KEY, "cluster"]).select(
        KEY, "device_id", "value", F.coalesce("modality", F.lit("text")).alias("modality"), "weight")


def modal_votes(events: DataFrame | Ballots, params: FoldParams = FoldParams(),
                trust: DataFrame | None = None) -> DataFrame:
    """Backers of the leading value per modality."""
    return backers(events, params, trust).groupBy(KEY, "modality").agg(
        F.count(F.lit(1)).alias("devices"), F.round(F.sum("weight"), 6).alias("weight"))


def post_resolution_conflicts(events: DataFrame | Ballots, params: FoldParams = FoldParams()) -> DataFrame:
    """Reports that disagree with a decision made before them."""
    ballots = keep_ballots(events, params)
    return disagreements(weigh(ballots.latest, params), ballots.resolutions)
