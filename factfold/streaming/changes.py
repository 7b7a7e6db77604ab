"""Verdict changes from state: every key's ballots live in the state store, and a batch touches only the keys it names.

The state of a key is a map from device to that device's newest report, the newest decision, and the verdict last
given out. A batch updates the reports that are newer than the ones held, judges the key again from its ballots, and
gives out a row only when status, value or confidence differ. The log is never read back, events may come in any order or
repeatedly, and after a failure the state returns to the last committed batch together with the source.

The map is read entry by entry from the state store, so a key may have more devices than fit the memory of a task; what
is held while judging is one sum per competing value. Rows that a micro-batch brings for one device and key are reduced to the
newest in the same pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from factfold.operators.fold import KEY, OBSERVED, RESOLVED, with_optional_columns
from factfold.params import FoldParams
from factfold.session import ship

CHANGES = f"{KEY} string, version bigint, status string, value string, confidence double, live_device_count bigint, seq bigint"
_BALLOT = "live boolean, value string, cluster string, modality string, weight double, client_sequence bigint, seq bigint"
_DECISION = "value string, seq bigint"
_GIVEN = "version bigint, status string, value string, confidence double, seq bigint"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_READ = ("device_id", "event_type", "value", "value_cluster", "modality", "device_trust_at_report", "client_sequence", "seq")


def _half_up(x: float, places: int = 6) -> float:
    """Rounding as the fold rounds: half away from zero, on the decimal digits of the number."""
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)) if math.isfinite(x) else x


def judge_ballots(ballots: Iterable[tuple[str, bool, str | None, str | None, str, float]], params: FoldParams,
                  ) -> tuple[str, str | None, float, int]:
    """Status, value, confidence and live devices of one key.

    ``ballots``: device, live, value, cluster, modality, weight. The verdict does not depend on their order, but for
    the last digits of a sum.
    """
    groups: dict[str | None, list] = {}
    live = 0
    for device, is_live, value, cluster, modality, weight in ballots:
        if not is_live:
            continue
        live += 1
        g = groups.get(cluster)
        if g is None:
            g = groups[cluster] = [0.0, value, device, 1.0, modality, False]
        g[0] += weight
        g[1] = min((v for v in (g[1], value) if v is not None), default=None)
        g[2] = min(g[2], device)
        g[3] *= 1.0 - min(1.0, max(0.0, weight))
        g[5] = g[5] or modality != g[4]
    if not live:
        return "ABSENT", None, 0.0, 0
    total = sum(g[0] for g in groups.values())
    support, value, _, doubt, _, mixed = min(
        groups.values(), key=lambda g: (-_half_up(g[0]), g[1] is not None, g[1] or "", g[2]))
    extra = 1.0 - max(0.0, min(1.0, params.cross_modal_weight)) if mixed else 1.0
    confidence = _half_up((1.0 - doubt * extra) * (_half_up(support) / total if total else 0.0))
    status = "LWW" if live == 1 else "CONFIRMED" if confidence >= params.threshold else "DISPUTED"
    return status, value, confidence, live


class _Judge(StatefulProcessor):
    def __init__(self, params: FoldParams):
        self.params = params

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ballots = handle.getMapState("ballots", "device_id string", _BALLOT)
        self.decision = handle.getValueState("decision", _DECISION)
        self.given = handle.getValueState("given", _GIVEN)

    def _take(self, rows: Iterator[pd.DataFrame]) -> tuple[dict[str, tuple], tuple | None, int]:
        """The newest report of every device, the newest decision, and the highest hub number of a batch."""
        newest: dict[str, tuple] = {}
        decision, last = None, -1
        for chunk in rows:
            for device, kind, value, cluster, modality, trust, client, seq in zip(
                    *(chunk[c].tolist() for c in _READ), strict=True):
                client, seq = (int(seq) if pd.isna(client) else int(client)), int(seq)
                last = max(last, seq)
                value = None if pd.isna(value) else value
                if kind == RESOLVED and (decision is None or seq > decision[1]):
                    decision = (value, seq)
                if kind == RESOLVED and not self.params.decisions_compete:
                    continue
                held = newest.get(device)
                if held is None or (client, seq) > held[-2:]:
                    weight = self.params.default_trust if pd.isna(trust) else float(trust)
                    newest[device] = (kind == OBSERVED, value, cluster if isinstance(cluster, str) and cluster else value,
                                      modality if isinstance(modality, str) else "text", weight, client, seq)
        return newest, decision, last

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest, decision, last = self._take(rows)
        for device, ballot in newest.items():
            held = self.ballots.getValue((device,)) if self.ballots.containsKey((device,)) else None
            if held is None or ballot[-2:] > tuple(held)[-2:]:
                self.ballots.updateValue((device,), ballot)
        held = self.decision.get()
        if decision is not None and (held is None or decision[1] > held[1]):
            self.decision.update(decision)
            held = decision
        found = judge_ballots(((device[0], *ballot[:5]) for device, ballot in self.ballots.iterator()), self.params)
        status, value, confidence, live = found
        if held is not None:
            status, value, confidence = RESOLVED, held[0], 1.0
        before = self.given.get()
        if before is None or tuple(before)[1:4] != (status, value, confidence):
            version = 1 if before is None else before[0] + 1
            seq = last if before is None else max(last, before[4])
            self.given.update((version, status, value, confidence, seq))
            yield pd.DataFrame({KEY: [key[0]], "version": [version], "status": [status], "value": pd.Series([value], dtype=object),
                                "confidence": [confidence], "live_device_count": [live], "seq": [seq]})

    def close(self) -> None:
        pass


def verdict_changes(events: DataFrame, params: FoldParams = FoldParams()) -> DataFrame:
    """Stream of the changes of every key's verdict, numbered by ``version`` within the key; ``events`` is a stream of log rows.

    Weights are the trust at the report (or the default) and do not decay, as in the fold without a clock. Needs a state store that keeps maps
    (``state_maps``).
    """
    if params.uses_clock or params.decay:
        raise ValueError("decaying weights change without events; fold the log instead")
    ship(events.sparkSession)
    rows = with_optional_columns(events).filter(F.col(KEY).isNotNull() & F.col("device_id").isNotNull()).select(KEY, *_READ)
    return rows.groupBy(KEY).transformWithStateInPandas(
        statefulProcessor=_Judge(params), outputStructType=CHANGES, outputMode="Update", timeMode="None")


@contextmanager
def state_maps(spark: SparkSession) -> Iterator[None]:
    """While a stream is started, choose the state store that keeps maps entry by entry."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def current_verdicts(changes: DataFrame) -> DataFrame:
    """The newest change of every key."""
    row = F.struct("status", "value", "confidence", "live_device_count", "version", "seq")
    return changes.groupBy(KEY).agg(F.max_by(row, "version").alias("v")).select(KEY, "v.*")
