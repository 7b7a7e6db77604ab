"""Removal of sensitive spans."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factfold.functions.vectors import hash_embed

PLACEHOLDER = "[REDACTED]"
SPANS_TYPE = "struct<text:string,spans:array<struct<start:int,end:int,original:string,placeholder:string>>>"


def _accepted_spans(text: str, patterns: list[re.Pattern]) -> list[tuple[int, int]]:
    found = {m.span() for p in patterns for m in p.finditer(text) if m.end() > m.start()}
    kept: list[tuple[int, int]] = []
    for start, end in sorted(found, key=lambda s: (s[0], -s[1])):
        if not kept or start >= kept[-1][1]:
            kept.append((start, end))
    return kept


def redact(text: Column, patterns: Sequence[str], placeholder: str = PLACEHOLDER) -> Column:
    """``struct(text, spans)``; spans are offsets into the original text.

    Texts that match no pattern stay in the JVM: the Python side receives null for them.
    """
    if not patterns:
        return F.struct(text.alias("text"), F.array().cast("array<struct<start:int,end:int,original:string,"
                                                           "placeholder:string>>").alias("spans"))
    compiled = [re.compile(p, re.IGNORECASE) for p in patterns]

    @F.pandas_udf(SPANS_TYPE)
    def spans_of(texts: pd.Series) -> pd.DataFrame:
        out_text, out_spans = [], []
        for t in texts:
            if t is None:
                out_text.append(None)
                out_spans.append([])
                continue
            pieces, spans, at = [], [], 0
            for start, end in _accepted_spans(t, compiled):
                pieces += [t[at:start], placeholder]
                spans.append({"start": start, "end": end, "original": t[start:end], "placeholder": placeholder})
                at = end
            out_text.append("".join(pieces) + t[at:])
            out_spans.append(spans)
        return pd.DataFrame({"text": out_text, "spans": out_spans})

    hit = text.rlike("(?iU)" + "|".join(f"(?:{p})" for p in patterns))
    cut = spans_of(F.when(hit, text))
    return F.struct(F.coalesce(cut["text"], text).alias("text"), cut["spans"].alias("spans"))


def redact_text(text: Column, patterns: Sequence[str], placeholder: str = PLACEHOLDER) -> Column:
    """Redacted text alone, JVM-side; for patterns that cannot match at the same place."""
    if not patterns:
        return text
    quoted = placeholder.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(text, "(?iU)" + "|".join(f"(?:{p})" for p in patterns), quoted)


def redact_outbound(records: DataFrame, patterns: Sequence[str], dim: int = 64, salt: str = "") -> DataFrame:
    """Outbound copies: redacted value, flag set, text vectors recomputed from the redacted value.

    Applied to every record whatever its verdict. The removed spans never leave.
    """
    clean = records.withColumn("_clean", redact(F.col("value"), patterns)["text"])
    changed = ~F.col("_clean").eqNullSafe(F.col("value"))
    is_text = F.coalesce(F.col("modality"), F.lit("text")) == "text"
    out = clean.withColumn("redacted", changed.cast("int"))
    if "vec" in records.columns:
        fresh = hash_embed(F.when(changed & is_text, F.col("_clean")), dim, salt)
        out = out.withColumn("vec", F.coalesce(fresh, F.col("vec")))
    return out.withColumn("value", F.col("_clean")).drop("_clean")
