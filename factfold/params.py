"""Operator parameters. Every default is a fixed value that results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field

# The shipped policy patterns, keywords and required fields.
SSN_PATTERN = r"\b\d{3}-\d{2}-\d{4}\b"
EMAIL_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
URGENCY_KEYWORDS = ("structural collapse", "gas", "no pulse", "bleeding", "unconscious")
REQUIRED_FIELDS = ("status", "client_timestamp_ns", "reporter_device_id")

DEFAULT_TRUST = 0.7
HUB_HALF_LIFE_NS = 6 * 3600 * 1_000_000_000


@dataclass(frozen=True)
class FoldParams:
    """How a fact's log is folded into a verdict."""

    threshold: float = 0.66
    decay: float = 0.0
    now_ns: int | None = None
    half_life_ns: float | None = None
    cross_modal_weight: float = 0.3
    default_trust: float = DEFAULT_TRUST
    # When true an operator's decision competes with the device of the same name.
    decisions_compete: bool = False

    @property
    def uses_clock(self) -> bool:
        return self.now_ns is not None and bool(self.half_life_ns)

    def without_clock(self) -> "FoldParams":
        return FoldParams(self.threshold, self.decay, None, None, self.cross_modal_weight,
                          self.default_trust, self.decisions_compete)


@dataclass(frozen=True)
class TrustParams:
    """Beta smoothing and clamp for reporter trust."""

    alpha: float = 0.0
    beta: float = 0.0
    floor: float = 0.0
    ceiling: float = 1.0


@dataclass(frozen=True)
class PolicyParams:
    """The decision ladder applied to incoming captures."""

    novelty_high: float = 0.98
    novelty_low: float = 0.70
    novelty_baseline: float = 0.75
    reject_margin: float = 0.02
    float_epsilon: float = 1e-9
    urgency_threshold: float = 0.8
    urgency_keywords: tuple[str, ...] = URGENCY_KEYWORDS
    pii_patterns: tuple[str, ...] = (SSN_PATTERN, EMAIL_PATTERN)
    required_fields: tuple[str, ...] = REQUIRED_FIELDS


@dataclass(frozen=True)
class GateParams:
    """Byte budget and ageing of the outbound batch."""

    budget_bytes: int | None = None
    aging_factor: float = 0.01


@dataclass(frozen=True)
class SeverityParams:
    """Linear map from a similarity to a severity score."""

    offset: float = 0.10
    scale: float = 0.25
    low: float = 0.05
    high: float = 0.95


@dataclass(frozen=True)
class RetrievalParams:
    """Prefetch depth, fusion constant and BM25 constants."""

    prefetch: int = 25
    limit: int = 5
    rrf_k: int = 60
    rank_base: int = 1
    k1: float = 1.2
    b: float = 0.75


@dataclass(frozen=True)
class KnnParams:
    """Work division of the exact nearest-neighbour joins.

    A group above ``block_rows`` is cut into several blocks; ``pivots`` sets how finely a task
    divides the documents of a block before parts that cannot hold a better match are ruled out.
    """

    block_rows: int = 4096
    pivots: int = 32
    broadcast_rows: int = 2048


DEFAULT_KNN = KnnParams()


@dataclass(frozen=True)
class RetentionParams:
    """Per-device storage caps."""

    max_points: int = 500
    max_thumbnail_bytes: int = 0


@dataclass(frozen=True)
class BackoffParams:
    """Retry delay in milliseconds."""

    base_ms: int = 1000
    cap_ms: int = 60000


@dataclass(frozen=True)
class Settings:
    """All operator parameters in one place."""

    fold: FoldParams = field(default_factory=FoldParams)
    trust: TrustParams = field(default_factory=TrustParams)
    policy: PolicyParams = field(default_factory=PolicyParams)
    gate: GateParams = field(default_factory=GateParams)
    severity: SeverityParams = field(default_factory=SeverityParams)
    retrieval: RetrievalParams = field(default_factory=RetrievalParams)
    knn: KnnParams = field(default_factory=KnnParams)
    retention: RetentionParams = field(default_factory=RetentionParams)
    backoff: BackoffParams = field(default_factory=BackoffParams)
