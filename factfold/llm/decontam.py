"""Benchmark passages in documents, found with an FM-index per shard.

A shard is a run of documents inside a task. Words that no benchmark phrase has cannot be part of an
occurrence, so only runs of known words that are long enough for the shortest phrase are indexed. The index is
built from the suffix array of these runs: the Burrows-Wheeler transform in a wavelet matrix for rank, and
every eighth suffix position for locating. All phrases are searched backwards at once, each occurrence walks
to a sampled position, and the spans of a document are merged.

Documents are never shuffled. The phrases travel in blocks of at most ``BLOCK_WORDS`` words, so that neither
the driver nor a task ever holds more than one, whatever the size of the benchmark.

Cases: null and empty texts have no words and no hits; an item without words is left out; items with the same
window all count; items without an id hit like others, count together as one item, stand last in ``items`` and
are left out of the digest; repeated rows and ids are judged each for itself; an empty benchmark hits nothing; other
columns pass through or are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factfold.llm.common import SLICE_CHARS, in_arrow, slices

WINDOW = 13
#: A block of so many words is a few hundred MB of Python objects while it is built, and less where it is read.
BLOCK_WORDS = 500_000
SAMPLE = 8
#: Every byte that is no word byte becomes a blank; A-Z are lower-cased.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def id_order(item: int | None) -> tuple[bool, int]:
    """Null ids last."""
    return item is None, item or 0


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


class Phrases:
    """Distinct windows of a block of items as word numbers, by length, with the items that have them."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int = WINDOW):
        import numpy as np

        owners: dict[tuple[bytes, ...], set[int | None]] = {}
        for item, words in items:
            for at in range(max(1, len(words) - window + 1) if words else 0):
                owners.setdefault(tuple(words[at : at + window]), set()).add(item)
        self.numbers = {w: n for n, w in enumerate(sorted({w for p in owners for w in p}), 1)}
        self.shortest = min(map(len, owners), default=0)
        by_length: dict[int, list[tuple[bytes, ...]]] = {}
        for p in owners:
            by_length.setdefault(len(p), []).append(p)
        self.groups = [(np.array([[self.numbers[w] for w in p] for p in ps], np.int64), [sorted(owners[p], key=id_order) for p in ps])
                       for ps in by_length.values()]


class FmIndex:
    """Count and locate sequences of numbers from 1 to ``largest`` in an array of such; 0 is reserved for the end."""

    def __init__(self, text, largest: int):
        import numpy as np

        text = np.append(text, 0).astype(np.int64)
        n = len(text)
        rank = np.unique(text, return_inverse=True)[1]
        width = 1
        while True:
            second = np.zeros(n, np.int64)
            second[:-width or None] = rank[width:] + 1
            key = rank * (n + 1) + second
            order = np.argsort(key, kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
            if rank[order[-1]] == n - 1 or width >= n:
                break
            width *= 2
        last = text[order - 1]
        self.levels = max(1, largest.bit_length())
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=1 << self.levels))))
        self.ones, self.zeros = [], []
        counter = np.int32 if n < 1 << 31 else np.int64
        row = last
        for level in range(self.levels - 1, -1, -1):
            bit = (row >> level) & 1
            self.ones.append(np.concatenate((np.zeros(1, counter), np.cumsum(bit, dtype=counter))))
            self.zeros.append(n - int(bit.sum()))
            row = np.concatenate((row[bit == 0], row[bit == 1]))
        sampled = order % SAMPLE == 0
        self.sampled = np.concatenate((np.zeros(1, counter), np.cumsum(sampled, dtype=counter)))
        self.places = order[sampled]
        self.size = n

    def rank(self, symbol, at):
        """How often each symbol stands before each place of the transform."""
        import numpy as np

        start, at = np.zeros_like(at), at.copy()
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            high = (symbol >> (self.levels - 1 - level)) & 1 == 1
            start = np.where(high, zeros + ones[start], start - ones[start])
            at = np.where(high, zeros + ones[at], at - ones[at])
        return at - start

    def back(self, at):
        """The row of the suffix that is one longer than each row's suffix."""
        import numpy as np

        symbol, start, place = np.zeros_like(at), np.zeros_like(at), at.copy()
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            high = ones[place + 1] - ones[place] == 1
            symbol = symbol * 2 + high
            start = np.where(high, zeros + ones[start], start - ones[start])
            place = np.where(high, zeros + ones[place], place - ones[place])
        return self.first[symbol] + place - start

    def search(self, patterns):
        """Row ranges of the suffixes that begin with each pattern (a row of the matrix)."""
        import numpy as np

        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.size, np.int64)
        for column in patterns.T[::-1]:
            low = self.first[column] + self.rank(column, low)
            high = self.first[column] + self.rank(column, high)
            high = np.maximum(low, high)
        return low, high

    def locate(self, rows):
        import numpy as np

        found = np.full(len(rows), -1, np.int64)
        open_ = np.arange(len(rows))
        steps = 0
        while len(open_):
            here = rows[open_]
            done = self.sampled[here + 1] > self.sampled[here]
            found[open_[done]] = self.places[self.sampled[here[done]]] + steps
            open_ = open_[~done]
            rows = rows.copy()
            rows[open_] = self.back(rows[open_])
            steps += 1
        return found


def _runs(numbers, shortest: int):
    """Where runs of known words (numbers over 0) of at least ``shortest`` words begin and end."""
    import numpy as np

    edge = np.diff(np.concatenate(([0], (numbers > 0).astype(np.int8), [0])))
    low, high = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = high - low >= shortest
    return low[long], high[long]


def _shard(texts: list[str], blocks: list) -> list[tuple[int, list[tuple[int, int]], list[int | None]]]:
    """Number of words, merged hit spans (from, until) and items of every text."""
    import numpy as np

    words = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1  # a gap after every document
    total = int(sizes.sum()) + len(texts)
    cover = np.zeros(total + 1, np.int64)
    items: list[set[int | None]] = [set() for _ in texts]
    for block in blocks:
        phrases = block.value
        if phrases.groups:
            numbers = _numbers(words, phrases.numbers.get, total)
            low, high = _runs(numbers, phrases.shortest)
            if len(low):
                keep = np.concatenate([np.arange(a, b + 1) for a, b in zip(low, high, strict=True)])
                index = FmIndex(numbers[keep] + 1, len(phrases.numbers) + 1)  # 1: the gap after a run
                for patterns, owners in phrases.groups:
                    first, until = index.search(patterns + 1)
                    hits = until - first
                    which = np.repeat(np.arange(len(hits)), hits)
                    if len(which):
                        rows = np.arange(len(which)) - np.repeat(np.cumsum(hits) - hits, hits) + np.repeat(first, hits)
                        at = keep[index.locate(rows)]
                        np.add.at(cover, at, 1)
                        np.add.at(cover, at + patterns.shape[1], -1)
                        of = np.searchsorted(starts, at, "right") - 1
                        for doc, p in {*zip(of.tolist(), which.tolist(), strict=True)}:
                            items[doc].update(owners[p])
        if len(blocks) > 1:
            block.__dict__.pop("_value", None)
    edge = np.diff(np.concatenate(([0], (np.cumsum(cover) > 0).astype(np.int8), [0])))
    low, high = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    of = np.searchsorted(starts, low, "right") - 1
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    for doc, a, b in zip(of.tolist(), low.tolist(), high.tolist(), strict=True):
        spans[doc].append((a - int(starts[doc]), b - int(starts[doc])))
    return [(int(n), s, sorted(i, key=id_order)) for n, s, i in zip(sizes, spans, items, strict=True)]


def _numbers(words: list[list[bytes]], get, total: int):
    import itertools

    import numpy as np

    flat = itertools.chain.from_iterable((*w, b"") for w in words)
    return np.fromiter(map(get, flat, itertools.repeat(0)), np.int64, total)


def phrase_blocks(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> list:
    """Broadcasts of at most ``block_words`` words (or one longer item), read item by item."""
    context = benchmark.sparkSession.sparkContext
    blocks, items, size = [], [], 0
    for item, text in benchmark.selectExpr("cast(item_id as bigint)", "cast(text as string)").toLocalIterator():
        words = words_of(text)
        if items and size + len(words) > block_words:
            blocks.append(context.broadcast(Phrases(items, window)))
            items, size = [], 0
        items.append((item, words))
        size += len(words)
    return [*blocks, context.broadcast(Phrases(items, window))]


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, spans`` (word positions from, until) and the ``items`` found in each document."""
    blocks = phrase_blocks(benchmark, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, chars=4 * SLICE_CHARS):
            found = _shard(texts, blocks)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _, _ in found], pa.int64()),
                 pa.array([[{"from": a, "until": b} for a, b in s] for _, s, _ in found],
                          pa.list_(pa.struct([("from", pa.int64()), ("until", pa.int64())]))),
                 pa.array([i for _, _, i in found], pa.list_(pa.int64()))], ["doc_id", "n_words", "spans", "items"])

    rows = docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text")
    return in_arrow(rows, run, "doc_id bigint, n_words bigint, spans array<struct<from: bigint, until: bigint>>, items array<bigint>")


def judge(found: DataFrame) -> DataFrame:
    """Hit words, items and the verdict: contaminated when at least a twentieth of the words is hit."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["until"] - s["from"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort(F.col("items").cast("array<string>"))), 256).alias("items_sha256"),
        "spans", "items").withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, with all their columns and unchanged."""
    blocks = phrase_blocks(benchmark, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, chars=4 * SLICE_CHARS):
            hits = [(n, sum(b - a for a, b in s)) for n, s, _ in _shard(texts, blocks)]
            yield batch.filter(pa.array([not (h > 0 and 20 * h >= n) for n, h in hits]))

    return in_arrow(docs, run, docs.schema)
