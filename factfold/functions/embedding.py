"""Embedders: anything that turns a batch of payloads into unit vectors of one width."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factfold.functions.vectors import _hash_vector

_PAYLOADS = {"text": T.StringType(), "vision": T.BinaryType()}


class Embedder(Protocol):
    """What ``embed`` needs of a model. It is sent to the executors, so it should load its weights lazily."""

    name: str
    dim: int
    modality: str
    version: str

    def embed_batch(self, payloads: Sequence) -> Sequence[Sequence[float]]: ...


@dataclass(frozen=True)
class HashEmbedder:
    """The built-in embedder; needs no model."""

    name: str = "hash"
    dim: int = 64
    modality: str = "text"
    version: str = "1"
    salt: str = ""

    def embed_batch(self, payloads: Sequence) -> list[np.ndarray]:
        return [_hash_vector(p if isinstance(p, bytes) else p.encode(), self.dim, self.salt.encode()) for p in payloads]


def _checked(vectors: Sequence[Sequence[float]], dim: int) -> list[np.ndarray]:
    out = []
    for v in vectors:
        a = np.asarray(v, dtype=np.float64)
        length = np.linalg.norm(a)
        if a.shape != (dim,) or not np.isfinite(length) or length == 0:
            raise ValueError(f"embedder returned an unusable vector of shape {a.shape}")
        out.append((a / length).astype(np.float32))
    return out


def embed(df: DataFrame, column: str, embedder: Embedder, out: str = "vec") -> DataFrame:
    """Add the vector, model name and version of a payload column. Nulls stay null; a payload of
    another modality, or a vector that is zero, not finite or of the wrong width, fails the job."""
    if df.schema[column].dataType != _PAYLOADS[embedder.modality]:
        raise TypeError(f"{embedder.name} embeds {embedder.modality}, but {column} is {df.schema[column].dataType.simpleString()}")

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            made = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            there = batch[batch.notna()]
            for i, v in zip(there.index, _checked(embedder.embed_batch(there.tolist()), embedder.dim)):
                made.at[i] = v
            yield made

    return df.withColumns({out: run(F.col(column)), "model": F.lit(embedder.name),
                           "model_version": F.lit(embedder.version)})
