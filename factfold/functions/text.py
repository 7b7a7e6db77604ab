"""Text predicates and clean-up, all JVM-side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The markers that turn a statement round. "clear" is one of them,
# so "clear" and "not clear" have the same polarity.
NEGATION_MARKERS = (
    "not", "no", "never", "without", "cannot", "can't", "won't", "don't", "didn't",
    "isn't", "aren't", "unsafe", "absent", "clear", "negative",
)
NEGATION_REGEX = r"(?iU)\b(?:" + "|".join(NEGATION_MARKERS) + r")\b"
NUMBER_REGEX = r"(\d+(?:\.\d+)?)"
CITATION_REGEX = r"\[(\d+)\]"
TOKEN_REGEX = r"([\p{L}\p{N}_]+)"
EMPTY_ANSWER = "No local records match that question."


def extract_numbers(text: Column) -> Column:
    """All unsigned decimals in ``text``, sorted, duplicates kept."""
    found = F.regexp_extract_all(text, F.lit(NUMBER_REGEX), F.lit(1))
    return F.array_sort(F.transform(found, lambda x: x.cast("double")))


def is_negated(text: Column) -> Column:
    """Whether ``text`` holds a negation marker as a word."""
    return text.rlike(NEGATION_REGEX)


def claim_signature(text: Column) -> Column:
    """What two values must share in order not to contradict each other."""
    safe = F.coalesce(text, F.lit(""))
    return F.struct(extract_numbers(safe).alias("numbers"), is_negated(safe).alias("negated"))


def contradicts(a: Column, b: Column) -> Column:
    """Different numbers or different polarity."""
    return claim_signature(a) != claim_signature(b)


def sanitize_fact(text: Column) -> Column:
    """One safe line: breaks become spaces, control characters go, ends are trimmed."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\r\n", "  ")
    visible = F.regexp_replace(flat, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return F.regexp_replace(visible, r"^\s+|\s+$", "")


def split_sentences(text: Column) -> Column:
    """Sentences, split after closing punctuation, blanks dropped."""
    body = F.trim(F.coalesce(text, F.lit("")))
    return F.filter(F.split(body, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def parse_citations(sentence: Column, n_sources: Column) -> Column:
    """``text``, ``citations`` in range, and whether the sentence is ``supported``."""
    marks = F.transform(F.regexp_extract_all(sentence, F.lit(CITATION_REGEX), F.lit(1)),
                        lambda m: m.cast("bigint"))

    def in_range(m: Column) -> Column:
        return (m >= 1) & (m <= n_sources)

    clean = F.trim(F.regexp_replace(F.regexp_replace(sentence, CITATION_REGEX, ""), r"\s+", " "))
    return F.struct(
        clean.alias("text"),
        F.filter(marks, in_range).alias("citations"),
        ((F.size(marks) > 0) & F.forall(marks, in_range)).alias("supported"),
    )


def value_preview(text: Column) -> Column:
    """The first hundred characters."""
    return F.substring(text, 1, 100)


def first_pii_pattern(text: Column, patterns: Sequence[str]) -> Column:
    """The first pattern, in the given order, found in ``text``; else null."""
    if not patterns:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.when(text.rlike("(?iU)" + p), F.lit(p)) for p in patterns])


def matched_keywords(text: Column, keywords: Sequence[str]) -> Column:
    """Sorted keywords contained in the lower-cased text."""
    if not keywords:
        return F.array().cast("array<string>")
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(k)), F.lit(k)) for k in sorted(keywords)]))


def urgency(text: Column, keywords: Sequence[str]) -> Column:
    """1.0 when any keyword occurs, else 0.0."""
    return F.when(F.size(matched_keywords(text, keywords)) > 0, F.lit(1.0)).otherwise(F.lit(0.0))


def missing_fields(required: Sequence[str], present: Sequence[str]) -> Column:
    """Sorted names of the required fields that are null or not columns at all."""
    if not required:
        return F.array().cast("array<string>")
    names = [F.when(F.col(n).isNull(), F.lit(n)) if n in present else F.lit(n) for n in sorted(required)]
    return F.array_compact(F.array(*names))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_REGEX), F.lit(1))
