"""Deterministic ids, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _unsigned_le64(hex_digest: Column) -> Column:
    # The first eight digest bytes read little-endian; unsigned, so it needs decimal(20,0).
    pairs = [F.substring(hex_digest, start, 2) for start in range(15, 0, -2)]
    return F.conv(F.concat(*pairs), 16, 10).cast("decimal(20,0)")


def fact_point_id(key: Column, value: Column) -> Column:
    """Id of the fact ``key = value``, whoever reports it."""
    return _unsigned_le64(F.md5(F.concat(key, F.lit(":"), value)))


def image_point_id(key: Column, content: Column) -> Column:
    """Id of an image fact; the same bytes give the same id."""
    return fact_point_id(key, F.sha2(content, 256))


def event_id(device: Column, point: Column, client_sequence: Column) -> Column:
    """Id of one report, equal for every retry of it."""
    parts = [c.cast("string") for c in (device, point, client_sequence)]
    return F.md5(F.concat_ws(":", *parts))


def resolve_event_id(key: Column, resolver: Column, seq: Column) -> Column:
    """Id of an operator decision."""
    return F.md5(F.concat_ws(":", F.lit("RESOLVED"), key, resolver, seq.cast("string")))


def retraction_marker_id(point: Column) -> Column:
    """Id of the queued marker that withdraws a point."""
    return _unsigned_le64(F.md5(F.concat(F.lit("retract_marker:"), point.cast("string"))))


def device_log_event_id(point: Column, event_type: Column, seq: Column) -> Column:
    """Id of an entry in a device's own log."""
    return _unsigned_le64(F.md5(F.concat_ws(":", point.cast("string"), event_type, seq.cast("string"))))


def cluster_id(key: Column, founder_value: Column) -> Column:
    """Id of the value cluster founded by ``founder_value``; a null prints as ``None``."""
    return F.md5(F.concat(key, F.chr(F.lit(0)), F.coalesce(founder_value, F.lit("None"))))


def hash_bits(text: Column, shift: int, modulus_bits: int) -> Column:
    """``(sha256(text) >> shift) mod 2**modulus_bits`` for small shifts."""
    low = F.conv(F.substring(F.sha2(text, 256), 57, 8), 16, 10).cast("bigint")
    return F.shiftright(low, shift).bitwiseAND(F.lit((1 << modulus_bits) - 1))


def hash_mod(text: Column, shift: int, modulus: int) -> Column:
    """``(sha256(text) >> shift) mod modulus``, exact, by Horner's rule over 32-bit limbs."""
    digest = F.sha2(text, 256)
    limbs = F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(8)])
    # (h >> s) mod m = ((h mod m*2**s) - (h mod 2**s)) / 2**s
    wide = modulus << shift
    rem = F.aggregate(limbs, F.lit(0).cast("bigint"),
                      lambda acc, limb: (acc * F.lit(1 << 32) + limb) % F.lit(wide))
    return F.shiftright(rem, shift).cast("int")
