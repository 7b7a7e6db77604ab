"""Token ids in binary shards: one array of ids and Elias-Fano coded document boundaries per shard.

Shard file, little-endian: the magic ``EFID0001``; eight unsigned 64-bit numbers: documents, ids, width of an id
in bytes, low bits per boundary, bytes of the ids, of the low bits, of the high bits and of the samples; then the
ids, the packed low bits of the boundary after each document, the unary high bits, and the place of every 64th
set high bit (64 bits each); then the document ids (64 bits each). ``Boundaries.select`` finds the boundary after
any document from one sample and the high bits behind it, in about ``2 + log2(ids / documents)`` bits a document.

Documents are dealt to shards by ranges of their id, sorted there and written by the task that holds the shard, to a
name of its own for each attempt; the manifest names the file of the attempt that counted. Reading opens the
files of the manifest, so unfinished or repeated files are never seen.

Cases: null and empty texts hold only the end id; repeated ids stay, in the order of their texts' hash; null ids come
first; an empty table gives no shard and no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factfold.llm.common import below, in_arrow, keep, only, range_cuts, scratch_folder, slices, tokenizer_file

VOCABULARY, END = "word_bpe_49k.json", 1
MAGIC, EVERY = b"EFID0001", 64
SHARD_CHARS = 24_000_000
#: Stretches remembered per Python worker, and half of the remembered parts; marks that end a stretch.
REMEMBERED, MARKS = 600_000, b".,;:!?*&$%#|"
#: Words that are encoded as one text; characters of a slice of texts.
TOGETHER, CHARS = 1000, 6_000_000


class WordCoder:
    """Ids by the tokenizers library, stretch by stretch.

    Neither the normalizer nor the pattern of the vocabulary looks across white space, so a stretch without ASCII white
    space is encoded once and remembered. A stretch of ASCII is lower-cased first, as the normalizer would, and ASCII
    marks behind a final letter are encoded apart, as the pattern ends a match at a letter's end. The library looks for added
    tokens before it lower-cases, so a stretch that would have one only when lower-cased goes to it as it is.
    """

    def __init__(self, name: str):
        import numpy as np
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        self.tokenizer = Tokenizer.from_file(tokenizer_file(name))
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}
        self.cores: dict[bytes, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text; each distinct stretch of a slice is looked up once, and Arrow lays the ids out in order."""
        import numpy as np
        import pyarrow.compute as pc

        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        coded = split.flatten().cast(pa.large_binary()).dictionary_encode()
        names = coded.dictionary
        data, places = names.buffers()[2], np.frombuffer(names.buffers()[1], np.int64, len(names) + 1).tolist()
        data = data.to_pybytes() if data else b""
        parts = [data[low:high] for low, high in zip(places, places[1:], strict=False)]
        found = list(map(self.known.get, parts))
        if None in found:
            if len(self.known) > REMEMBERED:
                self.known = {}
            self.learn([p for p in parts if p not in self.known])
            found = list(map(self.known.__getitem__, parts))
        ids = pa.array(found, pa.large_binary()).take(coded.indices)
        data = memoryview(ids.buffers()[2]) if ids.buffers()[2] else memoryview(b"")
        places = np.frombuffer(ids.buffers()[1], np.int64)[split.offsets.to_numpy()].tolist()
        return [bytes(data[low:high]) for low, high in zip(places, places[1:], strict=False)]

    def learn(self, parts: list[bytes]) -> None:
        import numpy as np

        split = []
        for p in parts:
            low = p.lower() if p.isascii() else p
            if low != p and any(a in low for a in self.added):
                split.append((p, b""))
                continue
            core = low.rstrip(MARKS)
            split.append((core, low[len(core):]) if core and core != low and core[-12:].decode(errors="ignore")[-1:].lower()[-1:].isalpha() else (low, b""))
        if len(self.cores) > 2 * REMEMBERED:
            self.cores = {}
        fresh = [c for c in dict.fromkeys(c for s in split for c in s) if c and c not in self.cores]
        words = [c.decode() for c in fresh]
        whole = [self.single(w) for w in words]
        self.together([w for w, one in zip(words, whole, strict=True) if one])
        self.apart([w for w, one in zip(words, whole, strict=True) if not one])
        self.cores[b""] = b""
        self.known.update((p, self.cores[core] + self.cores[tail]) for p, (core, tail) in zip(parts, split, strict=True))

    @staticmethod
    def single(word: str) -> bool:
        """Whether the pattern certainly matches ``word`` as a whole: letters that the normalizer leaves as they are."""
        return word.isalpha() and word == word.lower() and unicodedata.is_normalized("NFC", word)

    def together(self, words: list[str]) -> None:
        """Encode many single words as one text; the id that ends a word tells them apart."""
        import numpy as np

        for low in range(0, len(words), TOGETHER):
            some = words[low : low + TOGETHER]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.kind)
            ends = (np.flatnonzero(self.ends[ids]) + 1) * self.kind.itemsize
            if len(ends) != len(some):
                self.apart(some)
                continue
            data, places = ids.tobytes(), [0, *ends.tolist()]
            self.cores.update(zip(map(str.encode, some), (data[a:b] for a, b in zip(places, places[1:], strict=False)), strict=True))

    def apart(self, words: list[str]) -> None:
        import numpy as np

        for low in range(0, len(words), 50_000):
            some = words[low : low + 50_000]
            coded = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
            self.cores.update((w.encode(), np.array(e.ids, self.kind).tobytes()) for w, e in zip(some, coded, strict=True))


CODERS: dict[str, WordCoder] = {}


def word_coder(name: str = VOCABULARY) -> WordCoder:
    only("idfile", CODERS.clear)
    if name not in CODERS:
        CODERS[name] = WordCoder(name)
    return CODERS[name]


@dataclass
class Boundaries:
    """A non-decreasing sequence of numbers in Elias-Fano form."""

    count: int
    low_bits: int
    low: bytes
    high: bytes
    samples: bytes

    @classmethod
    def of(cls, values, largest: int) -> Boundaries:
        import numpy as np

        values = np.asarray(values, np.int64)
        n = len(values)
        low_bits = max(0, (largest // n).bit_length() - 1) if n else 0
        shifts = np.arange(low_bits)
        low = np.packbits(((values[:, None] >> shifts) & 1).astype(np.uint8).reshape(-1), bitorder="little")
        places = (values >> low_bits) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        bits[places] = 1
        return cls(n, low_bits, low.tobytes(), np.packbits(bits, bitorder="little").tobytes(), places[::EVERY].astype("<u8").tobytes())

    def select(self, at: int) -> int:
        """Number ``at`` of the sequence."""
        import numpy as np

        place = int(np.frombuffer(self.samples, "<u8", 1, at // EVERY * 8)[0])
        left = at % EVERY
        high = np.frombuffer(self.high, np.uint8)
        byte = place // 8
        bits = np.unpackbits(high[byte : byte + 1], bitorder="little")
        bits[: place % 8] = 0
        while (ones := int(bits.sum())) <= left:
            left -= ones
            byte += 1
            bits = np.unpackbits(high[byte : byte + 1], bitorder="little")
        place = byte * 8 + int(np.flatnonzero(bits)[left])
        first = at * self.low_bits
        window = np.unpackbits(np.frombuffer(self.low, np.uint8)[first // 8 : (first + self.low_bits + 7) // 8], bitorder="little")
        window = window[first % 8 : first % 8 + self.low_bits]
        return (place - at) << self.low_bits | int((window.astype(np.int64) << np.arange(self.low_bits)).sum())

    def all(self):
        import numpy as np

        places = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.count]
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.count * self.low_bits]
        low = (bits.reshape(self.count, self.low_bits).astype(np.int64) << np.arange(self.low_bits)).sum(1)
        return (places - np.arange(self.count)) << self.low_bits | low


def shard_bytes(doc_ids: list[int], ids: list[bytes], width: int) -> bytes:
    import numpy as np

    ends = np.cumsum([len(i) // width for i in ids])
    b = Boundaries.of(ends, int(ends[-1]))
    data = b"".join(ids)
    head = struct.pack("<8Q", b.count, len(data) // width, width, b.low_bits, len(data), len(b.low), len(b.high), len(b.samples))
    return b"".join((MAGIC, head, data, b.low, b.high, b.samples, np.array(doc_ids, "<i8").tobytes()))


class Shard:
    """A shard file read back: the ids of any document by its place."""

    def __init__(self, data: bytes):
        import numpy as np

        if data[:8] != MAGIC:
            raise ValueError("not an id shard")
        n, _, width, low_bits, *sizes = struct.unpack_from("<8Q", data, 8)
        places = np.cumsum([72, *sizes]).tolist()
        parts = [data[a:b] for a, b in zip(places, places[1:], strict=False)]
        self.ids = np.frombuffer(parts[0], f"<u{width}")
        self.boundaries = Boundaries(n, low_bits, *parts[1:])
        self.doc_ids = np.frombuffer(data, "<i8", n, places[-1])

    def document(self, at: int):
        return self.ids[self.boundaries.select(at - 1) if at else 0 : self.boundaries.select(at)]


def write_shards(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end: int = END, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """Write the shards under ``folder``; the manifest ``shard, path, n_docs, n_ids`` comes back, kept."""


    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.length("text").cast("bigint") + 8)).first()[0] or 0
    cuts = range_cuts(rows, "doc_id", max(-(-total // shard_chars), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = rows.withColumn("shard", below(cuts, F.col("doc_id"))).repartition(len(cuts) + 1, "shard").sortWithinPartitions(
        "shard", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_coder(vocabulary)
        tail = coder.kind.type(end).tobytes()
        shard, doc_ids, ids = None, [], []

        def done() -> pa.RecordBatch:
            data = shard_bytes([-(1 << 63) if d is None else d for d in doc_ids], ids, coder.kind.itemsize)
            path = f"{folder}/shard-{shard:08d}-{uuid.uuid4().hex}.efid"
            system, place = pa.fs.FileSystem.from_uri(path)
            with system.open_output_stream(place) as out:
                out.write(data)
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [path], "n_docs": [len(doc_ids)],
                                               "n_ids": [sum(map(len, ids)) // coder.kind.itemsize]})

        for batch, texts in slices(batches, chars=CHARS):
            coded = coder.encode(texts)
            for d, s, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), coded, strict=True):
                if s != shard and doc_ids:
                    yield done()
                    doc_ids, ids = [], []
                shard = s
                doc_ids.append(d)
                ids.append(data + tail)
        if doc_ids:
            yield done()


    _make(folder)
    return keep(in_arrow(rows, run, "shard int, path string, n_docs bigint, n_ids bigint"), "manifest")


def _make(folder: str) -> None:


    system, place = pa.fs.FileSystem.from_uri(folder)
    system.create_dir(place)


def read_shards(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files of a manifest."""
    from pyspark.sql import Window

    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    placed = manifest.select("path", F.coalesce(before, F.lit(0)).cast("bigint").alias("base"))
    placed = placed.repartition(max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, place = pa.fs.FileSystem.from_uri(path)
                with system.open_input_stream(place) as source:
                    shard = Shard(source.read())
                until = shard.boundaries.all()
                start = np.concatenate(([0], until[:-1]))
                ids = shard.ids.astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids, mask=shard.doc_ids == -(1 << 63)), pa.array(start + base), pa.array(until - start),
                     pa.array([zlib.crc32(ids[a:b].data) for a, b in zip(start, until, strict=True)], pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    return in_arrow(placed, run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def new_folder(spark: SparkSession) -> str:
    folder = scratch_folder(spark, "ids")
    return folder if "://" in folder else "file://" + folder.removeprefix("file:")
