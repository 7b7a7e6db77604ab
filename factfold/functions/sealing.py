"""Canonical JSON, hashes and signatures."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FLOAT_PLACES = 6


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON with sorted keys and no spaces; floats must already be rounded."""
    ordered = [fields[name].alias(name) for name in sorted(fields)]
    return F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"})


def rounded(value: Column) -> Column:
    """A float as it enters a seal."""
    return F.round(value, FLOAT_PLACES)


def seal(fields: dict[str, Column]) -> Column:
    """sha256 of the canonical JSON."""
    return F.sha2(canonical_json(fields), 256)


def hmac_sha256(message: Column, secret: str) -> Column:
    """Hex HMAC-SHA256 of ``message``; the key never enters the plan as a literal column."""
    key = secret.encode()

    @F.pandas_udf("string")
    def sign(messages: pd.Series) -> pd.Series:
        return messages.map(lambda m: None if m is None else hmac.new(key, m.encode(), hashlib.sha256).hexdigest())

    return sign(message)
