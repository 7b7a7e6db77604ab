"""Sealed evidence: one hash per key over its verdict, its trust and every one of its events.

The events of a key may be very many, so they are hashed as a tree: each event, then runs of
events by hub sequence, then runs of runs. No task ever holds more than one run.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factfold.functions.sealing import hmac_sha256, rounded, seal
from factfold.operators import fold as fold_module
from factfold.operators import trust as trust_module
from factfold.operators.fold import KEY, fold_consensus, keep_ballots, with_optional_columns
from factfold.operators.trust import derive_device_trust
from factfold.params import FoldParams, TrustParams
from factfold.session import keep

#: Packets of one check may come from so many parameter sets; each is a fold of its own keys.
MOST_PARAMETER_SETS = 64
SCHEMA_VERSION = "1"
FANOUT_BITS = 12
EVENT_FIELDS = ("device_id", "event_type", "value", "value_cluster", "seq", "client_sequence",
                "device_trust_at_report", "modality", "resolver_id")
VERDICT_FIELDS = ("status", "value", "confidence", "live_device_count", "cross_modal", "winner_support",
                  "winner_devices", "value_count", "resolved_by", "resolved_seq", "post_resolution_conflicts")
CHECKS = ("SEAL", "FOLD", "TRUST", "MODULE", "SIGN")


def fold_code_sha256() -> str:
    """Hash of the code that produces verdicts: the fold and the trust it uses."""
    return hashlib.sha256(b"".join(Path(m.__file__).read_bytes() for m in (fold_module, trust_module))).hexdigest()


def packet_events(events: DataFrame) -> DataFrame:
    """The fields of an event that enter a seal; order by (seq, device_id) within a key."""
    return with_optional_columns(events).select(KEY, *EVENT_FIELDS)


def _run_digest(order: list[str]) -> Column:
    listed = F.array_sort(F.collect_list(F.struct(*order, "digest")))
    return F.sha2(F.array_join(F.transform(listed, lambda x: x["digest"]), ""), 256)


def events_digest(events: DataFrame) -> DataFrame:
    """``events_digest`` and ``event_count`` per key."""
    fields = {n: (rounded(F.col(n)) if n == "device_trust_at_report" else F.col(n)) for n in EVENT_FIELDS}
    level = packet_events(events).select(
        KEY, F.col("seq").alias("run"), "device_id", seal(fields).alias("digest"), F.lit(1).cast("bigint").alias("n"))
    order = ["run", "device_id"]
    for _ in range(3):
        level = level.groupBy(KEY, F.shiftright("run", FANOUT_BITS).alias("up")).agg(
            _run_digest(order).alias("digest"), F.sum("n").alias("n")).withColumnRenamed("up", "run")
        order = ["run"]
    return level.groupBy(KEY).agg(_run_digest(order).alias("events_digest"), F.sum("n").alias("event_count"))


def trust_digest(trust: DataFrame) -> DataFrame:
    """``trust_digest`` per key over (device, trust), hashed in buckets first."""
    leaf = trust.select(KEY, "device_id", F.substring(F.md5("device_id"), 1, 3).alias("run"),
                        seal({"device_id": F.col("device_id"), "trust": rounded(F.col("trust"))}).alias("digest"))
    runs = leaf.groupBy(KEY, "run").agg(_run_digest(["device_id"]).alias("digest"))
    return runs.groupBy(KEY).agg(_run_digest(["run"]).alias("trust_digest"))


def _core() -> dict[str, Column]:
    core = {n: F.col(n) for n in VERDICT_FIELDS}
    core.update({n: rounded(F.col(n)) for n in ("confidence", "winner_support")})
    core.update({n: F.col(n) for n in (KEY, "schema_version", "fold_params", "trust_digest", "events_digest",
                                       "event_count", "fold_code_sha256")})
    return core


def parameter_text(fold: FoldParams, trust: TrustParams) -> str:
    """The parameters of a packet, as they are sealed."""
    return (f"threshold={fold.threshold};decay={fold.decay};cross_modal_weight={fold.cross_modal_weight}"
            f";alpha={trust.alpha};beta={trust.beta};floor={trust.floor};ceiling={trust.ceiling}")


def read_parameters(text: str | None) -> tuple[FoldParams, TrustParams] | None:
    """The parameters that ``parameter_text`` wrote; None for anything else."""
    try:
        found = {name: float(value) for name, value in (part.split("=") for part in (text or "").split(";"))}
        fold = FoldParams(found.pop("threshold"), found.pop("decay"), cross_modal_weight=found.pop("cross_modal_weight"))
        trust = TrustParams(**{name: found.pop(name) for name in ("alpha", "beta", "floor", "ceiling")})
    except (KeyError, ValueError):
        return None
    return None if found else (fold, trust)


def _unsealed(events: DataFrame, fold: FoldParams, trust: TrustParams) -> DataFrame:
    plain = fold.without_clock()
    ballots = keep_ballots(events, plain)
    scores = keep(derive_device_trust(ballots, trust, plain, per_key=True), "trust")
    verdicts = fold_consensus(ballots, plain, scores).select(KEY, *VERDICT_FIELDS)
    digests = trust_digest(scores)
    return (verdicts.join(events_digest(events), KEY).join(digests, KEY, "left")
            .withColumns({"schema_version": F.lit(SCHEMA_VERSION), "fold_params": F.lit(parameter_text(plain, trust)),
                          "fold_code_sha256": F.lit(fold_code_sha256())}))


def evidence_packets(events: DataFrame, fold: FoldParams = FoldParams(), trust: TrustParams = TrustParams(),
                     secret: str | None = None) -> DataFrame:
    """One sealed row per key; its events are ``packet_events``. The clock never enters."""
    packets = _unsealed(events, fold, trust).withColumn("hash", seal(_core()))
    return packets if secret is None else packets.withColumn("signature", hmac_sha256(F.col("hash"), secret))


def _folded_again(packets: DataFrame, events: DataFrame) -> DataFrame:
    """The packets' keys folded from the events, each with the parameters that its packet names."""
    texts = [r.fold_params for r in packets.select("fold_params").distinct().limit(MOST_PARAMETER_SETS + 1).collect()]
    if len(texts) > MOST_PARAMETER_SETS:
        raise ValueError(f"packets of more than {MOST_PARAMETER_SETS} parameter sets; check them in parts")
    sets = {text: found for text in texts if (found := read_parameters(text))}
    # Written once: every set reads its events several times.
    named = keep(events.join(packets.select(KEY, "fold_params").distinct(), KEY), "named") if sets else None
    parts = []
    for text, (fold, trust) in sets.items():
        theirs = named.filter(F.col("fold_params") == text).drop("fold_params")
        parts.append(_unsealed(theirs, fold, trust).withColumn("fold_params", F.lit(text)))
    return reduce(DataFrame.unionByName, parts) if parts else _unsealed(events.limit(0), FoldParams(), TrustParams())


def verify_packets(packets: DataFrame, events: DataFrame, secret: str | None = None) -> DataFrame:
    """Recompute every packet from its events and its own parameters: one pass/fail column per check.

    Parameters that cannot be read fail FOLD and TRUST. A packet without events fails SEAL and FOLD.
    """
    fresh = _folded_again(packets, events)
    names = [*VERDICT_FIELDS, "fold_params", "trust_digest", "events_digest", "event_count"]
    again = fresh.select(KEY, *[F.col(n).alias(f"_{n}") for n in names])
    both = packets.join(again.withColumn("_again", F.lit(True)), KEY, "left")
    core = _core()
    core["events_digest"], core["event_count"] = F.col("_events_digest"), F.col("_event_count")

    def same(name: str) -> Column:
        if name in ("confidence", "winner_support"):
            return rounded(F.col(name)).eqNullSafe(rounded(F.col(f"_{name}")))
        return F.col(name).eqNullSafe(F.col(f"_{name}"))

    refolded = F.col("_again").isNotNull()
    for n in VERDICT_FIELDS:
        refolded = refolded & same(n)
    signed = F.lit(True)
    if secret is not None:
        signed = hmac_sha256(F.col("hash"), secret).eqNullSafe(
            F.col("signature") if "signature" in packets.columns else F.lit(None).cast("string"))
    checks = {"SEAL": seal(core).eqNullSafe(F.col("hash")), "FOLD": refolded,
              "TRUST": F.col("_again").isNotNull() & same("trust_digest"),
              "MODULE": F.col("fold_code_sha256").eqNullSafe(F.lit(fold_code_sha256())), "SIGN": signed}
    verified = both.withColumns({c.lower(): v for c, v in checks.items()})
    ok = F.lit(True)
    for c in CHECKS:
        ok = ok & F.col(c.lower())
    return verified.select(KEY, *[c.lower() for c in CHECKS], ok.alias("verified"))
