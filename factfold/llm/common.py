"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factfold.session import keep, scratch_folder, ship, spread

__all__ = ["below", "crc_fold", "in_arrow", "keep", "mix64", "only", "range_cuts", "release", "scratch_folder", "slices", "spread", "table",
           "tokenizer_file"]

#: Texts are worked on in slices of about so many characters, whatever the size of an Arrow batch.
SLICE_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def crc_fold(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def in_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with this package on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def range_cuts(rows: DataFrame, column: str, parts: int) -> list[int]:
    """Up to ``parts - 1`` values that divide the column's numbers into about equal shares."""
    if parts < 2:
        return []
    steps = [i / parts for i in range(1, parts)]
    return sorted({int(c) for c in rows.select(F.col(column).cast("bigint").alias("x")).approxQuantile("x", steps, 0.1 / parts)})


def below(cuts: list[int], value: Column) -> Column:
    """How many of the sorted cuts are at most ``value``, by binary search; 0 for null."""
    n = len(cuts)
    if not n:
        return F.lit(0)
    edges, steps = F.lit(cuts), F.lit([1 << k for k in reversed(range(n.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda found, step: F.when(
        (found + step <= n) & (F.get(edges, F.least(found + step, F.lit(n)) - 1) <= value), found + step).otherwise(found)).cast("int")


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", chars: int = SLICE_CHARS,
           ) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Runs of rows with their texts (null: empty), each of about ``chars`` characters or a single longer text."""
    for batch in batches:
        texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
        low = size = 0
        for at, t in enumerate(texts):
            if size and size + len(t) > chars:
                yield batch.slice(low, at - low), texts[low:at]
                low, size = at, 0
            size += len(t)
        if low < len(texts):
            yield batch.slice(low), texts[low:]


def mix64(x):
    """A bijective mix of unsigned 64-bit numbers (numpy), the finalizer of splitmix64."""
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_HOLDERS: dict[str, Callable[[], None]] = {}


def only(name: str, clear: Callable[[], None]) -> None:
    """Say that this Python worker now works for operator ``name``: what other operators remember here is let go."""
    others = [n for n in _HOLDERS if n != name]
    for other in others:
        _HOLDERS.pop(other)()
    if others:
        release()
    _HOLDERS[name] = clear


def release() -> None:
    """Give memory that this Python worker has freed back to the system, so that idle workers stay small."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


class WordHashes(dict):
    """64-bit hash of a word's bytes, remembered; emptied when it holds ``limit`` words."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def crc_text(value) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode())
