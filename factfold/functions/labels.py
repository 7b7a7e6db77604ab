"""Small label and score rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factfold.params import BackoffParams, SeverityParams

# Gas thresholds in ppm, methane then ethylene.
METHANE_LOW, METHANE_HIGH = 250.0, 1000.0
ETHYLENE_LOW, ETHYLENE_HIGH = 5.0, 50.0


def classify_gas(methane: Column, ethylene: Column) -> Column:
    """Hazard label; the strongest condition wins."""
    return (F.when((methane >= METHANE_HIGH) & (ethylene >= ETHYLENE_HIGH), "combined_hazard")
            .when(methane >= METHANE_HIGH, "methane_high")
            .when(ethylene >= ETHYLENE_HIGH, "ethylene_high")
            .when(methane >= METHANE_LOW, "methane_low")
            .when(ethylene >= ETHYLENE_LOW, "ethylene_low")
            .otherwise("safe"))


def gas_text(methane: Column, ethylene: Column, label: Column) -> Column:
    """The sentence a reading is stored as."""
    # The sentence of each label.
    return (F.when(label == "safe", F.format_string(
                "Gas sensors nominal: methane %.0fppm, ethylene %.2fppm — atmosphere clear", methane, ethylene))
            .when(label == "methane_high", F.format_string(
                "ALERT: high methane concentration %.0fppm detected — evacuation recommended", methane))
            .when(label == "methane_low", F.format_string(
                "WARNING: methane trace %.0fppm — monitor ventilation", methane))
            .when(label == "ethylene_high", F.format_string(
                "ALERT: high ethylene concentration %.2fppm — flammable gas risk", ethylene))
            .when(label == "ethylene_low", F.format_string(
                "WARNING: ethylene trace %.2fppm — investigate source", ethylene))
            .otherwise(F.format_string(
                "CRITICAL: combined hazard methane %.0fppm + ethylene %.2fppm — evacuate immediately",
                methane, ethylene)))


def severity_score(similarity: Column, params: SeverityParams = SeverityParams()) -> Column:
    """Similarity mapped to the severity range, two decimals."""
    scaled = (similarity - F.lit(params.offset)) / F.lit(params.scale)
    return F.round(F.greatest(F.lit(params.low), F.least(F.lit(params.high), scaled)), 2)


def image_label(given: Column, caption: Column) -> Column:
    """The given label, else one read from the caption."""
    low = F.lower(F.coalesce(caption, F.lit("")))
    return F.coalesce(given, F.when(low.rlike("fire|flame"), "fire")
                      .when(F.contains(low, F.lit("smoke")), "smoke").otherwise("none"))


def fact_score(value: Column, age_s: Column, size: Column, aging_factor: float = 0.01) -> Column:
    """Value per byte, raised with age."""
    boost = F.lit(1.0) + F.lit(float(aging_factor)) * F.greatest(F.lit(0.0), age_s.cast("double"))
    return value * boost / F.greatest(F.lit(1), size.cast("bigint"))


def backoff_ms(failures: Column, params: BackoffParams = BackoffParams()) -> Column:
    """Retry delay after that many failures in a row."""
    delay = F.least(F.lit(float(params.cap_ms)), F.lit(float(params.base_ms)) * F.pow(F.lit(2.0), failures - 1))
    return F.when(failures <= 0, F.lit(0)).otherwise(delay).cast("bigint")


def sync_state(synced: Column, syncable: Column) -> Column:
    """Where a record stands on its way to the hub."""
    return (F.when(synced == 1, "synced")
            .when(F.coalesce(syncable, F.lit(1)) == 0, "local_only").otherwise("pending"))


def display_state(status: Column) -> Column:
    """Status as shown: one uncorroborated report is never shown as settled."""
    return F.when(status == "LWW", "UNCORROBORATED").otherwise(status)


def iso_time(ns: Column, now: Column) -> Column:
    """UTC ISO time of a nanosecond stamp, or of ``now`` where there is none."""
    stamp = F.when(ns > 0, F.timestamp_micros(F.call_function("div", ns, F.lit(1000)))).otherwise(now)
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), stamp.cast("timestamp_ntz"))
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def record_bytes(*columns: str) -> Column:
    """UTF-8 size of the record as JSON."""
    return F.octet_length(F.to_json(F.struct(*columns))).cast("bigint")
