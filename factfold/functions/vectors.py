"""Dense-vector columns."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Width of each named vector slot.
SLOT_DIMS = {"text": 384, "image": 512}


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0.0 when a side is null, empty or all zero."""
    scale = norm(a) * norm(b)
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(b) > 0) & (scale > 0)
    return F.when(usable, dot(a, b) / scale).otherwise(F.lit(0.0))


def stamp_cosine(a: Column, b: Column) -> Column:
    """Cosine of two probe vectors; -1.0 when they cannot be compared."""
    scale = norm(a) * norm(b)
    usable = (F.size(a) == F.size(b)) & (scale > 0)
    return F.when(usable, dot(a, b) / scale).otherwise(F.lit(-1.0))


def is_valid_vector(a: Column) -> Column:
    """Finite everywhere and not all zero."""
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return a.isNotNull() & finite & (norm(a) > 0)


def as_unit_vector(a: Column) -> Column:
    """Unit-length copy; null where the vector is not valid."""
    length = norm(a)
    return F.when(is_valid_vector(a), F.transform(a, lambda x: (x.cast("double") / length).cast("float")))


def split_valid(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a normalised vector, and the quarantined rest."""
    valid = F.coalesce(is_valid_vector(F.col(column)), F.lit(False))
    good = df.filter(valid).withColumn(column, as_unit_vector(F.col(column)))
    return good, df.filter(~valid)


def slot_for(model: Column, vector: Column, slots: Mapping[str, int] = SLOT_DIMS) -> Column:
    """Slot named by the model, else the slot of that width, else null."""
    by_width = F.lit(None).cast("string")
    for name, dim in slots.items():
        by_width = F.when(F.size(vector) == dim, F.lit(name)).otherwise(by_width)
    return F.when(model.isin(*slots), model).otherwise(by_width)


def _hash_vector(payload: bytes, dim: int, salt: bytes) -> np.ndarray:
    blocks = -(-dim // 32)
    stream = b"".join(hashlib.sha256(salt + payload + struct.pack(">I", i)).digest() for i in range(blocks))
    raw = np.frombuffer(stream, dtype=np.uint8, count=dim) / 255.0 - 0.5
    return (raw / np.linalg.norm(raw)).astype(np.float32)


def hash_embed(payload: Column, dim: int = 64, salt: str = "") -> Column:
    """A unit vector that depends on nothing but the payload's bytes."""
    salt_bytes = salt.encode()

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _hash_vector(
            t if isinstance(t, bytes) else t.encode(), dim, salt_bytes))

    return embed(payload)
