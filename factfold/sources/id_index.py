"""Every id ever seen, so that a record is taken once however late it is sent again.

Ids lie in buckets by their hash. A batch adds one generation: a file of ids per bucket and, beside it, a Bloom filter per
bucket. A lookup asks the filters first and opens only the files that may hold one of its ids. Generations are merged by size: when
``merge_at`` of one level have come together they become one of the next, so a bucket has at most ``merge_at`` files for each
power of ``merge_at``. The list of generations is append-only, and a row of it is written after what it names: readers see
a generation whole or not at all, and a replayed batch, which does not ask its own generation, finds what it found before.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factfold.session import ship
from factfold.sources.tables import Store

_GENERATIONS = "generation string, level int, replaces array<string>"
_FILTERS = "bucket int, bits binary, generation string"
#: Bits and hashes for each id; a filter of more ids than ``MOST_BITS`` allow only lets more files be opened.
BITS_PER_ID, HASHES, MOST_BITS = 16, 5, 1 << 27


def _places(hashes: np.ndarray, size: int) -> list[np.ndarray]:
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return [(hashes + np.uint64(k) * step) & np.uint64(size - 1) for k in range(HASHES)]


def _build(table: pa.Table) -> pa.Table:
    """The filter of one bucket."""
    hashes = table["hash"].to_numpy().view(np.uint64)
    size = min(MOST_BITS, max(64, 1 << (BITS_PER_ID * len(hashes) - 1).bit_length()))
    words = np.zeros(size // 64, np.uint64)
    for places in _places(hashes, size):
        np.bitwise_or.at(words, places >> np.uint64(6), np.uint64(1) << (places & np.uint64(63)))
    return pa.table({"bucket": table["bucket"].slice(0, 1), "bits": pa.array([words.tobytes()], pa.binary())})


def _ask(key: tuple, ids: pa.Table, filters: pa.Table) -> pa.Table:
    """Generations whose filter of this bucket holds one of the ids."""
    hashes = ids["hash"].to_numpy().view(np.uint64)
    found = []
    for bits, generation in zip(filters["bits"], filters["generation"].to_pylist(), strict=True):
        words = np.frombuffer(bits.as_buffer(), np.uint64)
        may = np.ones(len(hashes), bool)
        for places in _places(hashes, len(words) * 64):
            may &= (words[places >> np.uint64(6)] >> (places & np.uint64(63))) & np.uint64(1) == 1
        if may.any():
            found.append(generation)
    return pa.table({"bucket": pa.array([key[0].as_py()] * len(found), pa.int32()), "generation": pa.array(found, pa.string())})


@dataclass
class IdIndex:
    """The ids in folder ``name`` of a store; ``opened`` tells which files the last lookup read."""

    store: Store
    name: str = "ids"
    buckets: int = 16
    merge_at: int = 8
    opened: tuple[tuple[str, int], ...] = ()

    def _placed(self, ids: DataFrame) -> DataFrame:
        hashed = F.xxhash64("id")
        return ids.select("id", hashed.alias("hash"), F.pmod(hashed, F.lit(self.buckets)).cast("int").alias("bucket"))

    def generations(self) -> list[tuple[str, int]]:
        """Live generations with their levels; their number grows with the logarithm of the batches."""
        rows = self.store.read(f"{self.name}_generations", _GENERATIONS)
        gone = rows.select(F.explode("replaces").alias("generation"))
        return sorted((r.generation, r.level) for r in rows.join(gone, "generation", "left_anti").select(
            "generation", "level").distinct().collect())

    def _folder(self, generation: str) -> str:
        return f"{self.store.path(self.name)}/generation={generation}"

    def _read(self, folders: list[str]) -> DataFrame:
        rows = self.store.spark.read.schema("id string, generation string, bucket int").option("basePath", self.store.path(self.name))
        return rows.parquet(*folders).select("id")

    def _write(self, ids: DataFrame, generation: str, level: int, replaces: list[str]) -> None:
        ship(self.store.spark)
        placed = self._placed(ids)
        placed.repartition(self.buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(self._folder(generation))
        kept = self.store.spark.read.schema("id string, hash bigint, bucket int").parquet(self._folder(generation))
        kept.groupBy("bucket").applyInArrow(_build, "bucket int, bits binary").write.mode("overwrite").parquet(
            f"{self.store.path(self.name)}_filters/generation={generation}")
        self.store.append(f"{self.name}_generations", self.store.spark.createDataFrame([(generation, level, replaces)], _GENERATIONS).coalesce(1))

    def unknown(self, ids: DataFrame, but: str | None = None) -> DataFrame:
        """Rows of ``ids`` (with a non-null string ``id``) whose id is in no generation other than ``but``."""
        ship(self.store.spark)
        live = [g for g, _ in self.generations() if g != but]
        if not live:
            self.opened = ()
            return ids
        filters = self.store.read(f"{self.name}_filters", _FILTERS).filter(F.col("generation").isin(live))
        asked = self._placed(ids).select("hash", "bucket")
        hits = asked.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(_ask, "bucket int, generation string")
        self.opened = tuple(sorted((r.generation, r.bucket) for r in hits.collect()))  # at most live generations x buckets
        if not self.opened:
            return ids
        return ids.join(self._read([f"{self._folder(g)}/bucket={b}" for g, b in self.opened]), "id", "left_anti")

    def add(self, ids: DataFrame, batch_id: int) -> None:
        """Record the new ids of a batch as its generation."""
        self._write(ids.select("id").distinct(), f"b{batch_id}", 0, [])

    def merge(self, batch_id: int) -> None:
        """Merge full levels of generations of earlier batches; called before a batch is added."""
        level = 0
        while True:
            full = [g for g, at in self.generations() if at == level and g != f"b{batch_id}"]
            if len(full) < self.merge_at:
                break
            self._write(self._read([*map(self._folder, full)]), f"m{batch_id}-{level}", level + 1, full)
            level += 1


def dedupe_step(index: IdIndex, sink: str):
    """Micro-batch step: records (with ``id``) never seen before go to table ``sink``, each once; null ids are left out."""
    def step(batch: DataFrame, batch_id: int) -> None:
        index.merge(batch_id)
        known = batch.filter(F.col("id").isNotNull()).dropDuplicates(["id"])
        fresh = index.unknown(known, but=f"b{batch_id}")
        target = f"{index.store.path(sink)}/batch_id={batch_id}"
        fresh.write.mode("overwrite").parquet(target)
        index.add(index.store.spark.read.schema(batch.schema).parquet(target), batch_id)
    return step
