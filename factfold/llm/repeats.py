"""Removal of byte strings of a given length that already stand earlier in the corpus.

1. Anchors. Every window of ``length`` bytes has one anchor, its leftmost ``GRAM``-byte string of least hash, which its
   content alone decides. Consecutive windows with one anchor form a fragment, so equal windows always lie in fragments of
   equal anchors. Anchors that occur once are left out: their windows occur once.
2. Equal fragments are reduced to the earliest one (a map-side combined minimum); all windows of the others stand earlier too.
3. Different fragments of one anchor meet in buckets of about ``BUCKET_BYTES``. A bucket is one text with its suffixes
   ordered, its Burrows-Wheeler transform in a wavelet matrix, and intervals extended backwards breadth-first: strings of
   length 1, 2, ... yield the common prefixes 0, 1, ... in this order, and the expansion stops at ``length``. (The packed symbols that
   the first sort compares give the first few values at once.) Between the
   boundaries found so far, suffixes share at least ``length`` bytes, and of their windows only the earliest stays.
4. An anchor with more than ``MOST_FRAGMENTS`` different fragments (a frequent passage) is taken apart into single windows
   first, which are spread by their own hashes and reduced as in step 2, so no group outgrows a task.
5. The removed spans meet their texts in one join.

Windows are ordered by (doc_id, text hash, start). Anchors, fragments and windows are told apart by 64 and 128 bits of hashes.

Cases: a null text is empty; texts below ``length`` bytes stay whole; a null doc_id counts as the smallest; rows of one doc_id
with different texts are ordered by the hash of the text; rows equal in doc_id and text are one document, and each has that
document's result; an empty table gives no rows; other columns are ignored. A text of any length is worked on in pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factfold.llm.common import in_arrow, keep, mix64

LENGTH = 100
GRAM = 32
PIECE_BYTES = 250_000  # what the arrays of a piece take fits a core's cache
BUCKET_BYTES = 1_000_000
MOST_FRAGMENTS = 4096
#: An anchor with more than this share of all anchors (of which there can only be as many as its inverse) is dealt to several tasks.
HOT_SHARE, SALTS = 1 / 1000, 64
LOWEST = -(1 << 63)
_PLACE = ["did", "tie"]
_ANCHORS = "gram bigint, salt int, content bigint, did bigint, tie bigint, at bigint, windows int"
_CUT = "did bigint, tie bigint, gram bigint, content bigint, at bigint, windows int, bytes binary"
_SPANS = "did bigint, tie bigint, low bigint, high bigint"


def _grams(data):
    """Hash of the ``GRAM`` bytes from every place on."""
    import numpy as np

    h = mix64(np.arange(256, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))[data]
    step = 1
    while step < GRAM:
        h = h[:-step] * np.uint64(0xBF58476D1CE4E5B9 + 2 * step) + (h[step:] ^ (h[step:] >> np.uint64(31)))
        step *= 2
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def _anchors(data, ends, length: int):
    """Fragments of texts that lie one after another: anchor hash, content hash, first window, number of windows."""
    import numpy as np

    if len(data) < length:
        empty = np.zeros(0, np.int64)
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty
    h = _grams(data)
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    have, wide = 1, length - GRAM + 1
    while have < wide:
        step = min(have, wide - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    crossing = np.zeros(len(at) + 1, np.int32)
    np.add.at(crossing, np.clip(np.maximum(ends - length + 1, np.concatenate(([0], ends[:-1]))), 0, len(at)), 1)
    np.add.at(crossing, np.clip(ends, 0, len(at)), -1)
    at[np.cumsum(crossing[:-1]) > 0] = -1
    low = np.flatnonzero(np.diff(at, prepend=-2))
    high = np.append(low[1:], len(at))
    whole = at[low] >= 0
    low, high = low[whole], high[whole]
    content = (high - low).astype(np.uint64)
    for first in (low, high - 1):
        for place in (*range(0, length - GRAM, GRAM), length - GRAM):
            content = mix64(content * np.uint64(0x9E3779B97F4A7C15) + h[first + place])
    return h[at[low]], content, low, high - low


def _pieces(batch: pa.RecordBatch, length: int, size: int):
    """Runs of whole texts, or overlapping parts of a longer one: (first row, bytes, ends of texts, offset in the first text)."""
    import numpy as np

    column = batch.column(batch.schema.get_field_index("data"))
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        if offsets[row + 1] - offsets[row] > size:
            for part in range(0, int(offsets[row + 1] - offsets[row]) - length + 1, size):
                piece = data[offsets[row] + part : min(offsets[row + 1], offsets[row] + part + size + length - 1)]
                yield row, piece, np.array([len(piece)]), part
            row += 1
            continue
        until = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, data[offsets[row] : offsets[until]], offsets[row + 1 : until + 1] - offsets[row], 0
        row = until


def _read_anchors(length: int, contents: bool, hot: list[int] = ()):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        crowds = np.array(sorted(hot), np.int64)
        for batch in batches:
            for row, data, ends, part in _pieces(batch, length, PIECE_BYTES):
                gram, content, low, windows = _anchors(data, ends, length)
                if not contents:
                    gram, times = np.unique(gram, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(times, pa.int64())], ["gram", "times"])
                    continue
                text = np.searchsorted(ends, low, "right")
                rows = pa.array(row + text)
                starts = np.concatenate(([0], ends))[text]
                salt = np.where(np.isin(gram.view(np.int64), crowds), low % SALTS, 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram.view(np.int64)), pa.array(salt, pa.int32()), pa.array(content.view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows),
                     pa.array(low - starts + part, pa.int64()), pa.array(windows, pa.int32())],
                    ["gram", "salt", "content", "did", "tie", "at", "windows"])
    return run


class Transform:
    """Burrows-Wheeler transform of fragments, each followed by 0, in a wavelet matrix; suffixes are ordered by ``depth`` symbols."""

    def __init__(self, fragments: list[bytes], depth: int):
        import numpy as np

        data = np.frombuffer(b"".join(fragments), np.uint8)
        used = np.flatnonzero(np.bincount(data, minlength=256))
        symbols = np.searchsorted(used, np.arange(256))[data]
        sizes = np.array([len(f) for f in fragments], np.int64)
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        n = len(data) + len(fragments)
        text = np.zeros(n, np.int64)
        text[np.arange(len(data)) + np.repeat(np.arange(len(fragments)), sizes)] = symbols + 1
        self.size, self.bits = n, max(1, int(len(used)).bit_length())
        width = max(1, 62 // self.bits)
        padded = np.concatenate((text, np.zeros(width, np.int64)))
        key = np.zeros(n, np.int64)
        for k in range(width):
            key = key << self.bits | padded[k : k + n]
        self.width, packed = width, key
        order = np.argsort(key)
        while True:
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
            if width >= depth or rank[order[-1]] == n - 1:
                break
            key = rank * (n + 1)
            key[: n - width] += rank[width:] + 1
            order = np.argsort(key)
            width *= 2
        self.order, self.key = order, packed[order]
        row = text[order - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=1 << self.bits))))
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (row >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))).astype(np.int32))
            self.zeros.append(n - int(bit.sum()))
            row = np.concatenate((row[bit == 0], row[bit == 1]))
        present, low, _ = self._split(np.array([0]), np.array([n]))
        self.base = np.zeros(1 << self.bits, np.int64)
        self.base[present] = low

    def _split(self, low, high):
        """All symbols of every interval with their places in the last level."""
        import numpy as np

        symbol = np.zeros(len(low), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            a, b = ones[low].astype(np.int64), ones[high].astype(np.int64)
            symbol = np.concatenate((symbol * 2, symbol * 2 + 1))
            low, high = np.concatenate((low - a, zeros + a)), np.concatenate((high - b, zeros + b))
            some = low < high
            symbol, low, high = symbol[some], low[some], high[some]
        return symbol, low, high

    def extend(self, low, high):
        """Intervals of every string that is one symbol longer to the left, the end of a fragment left out."""
        symbol, low, high = self._split(low, high)
        low, high, symbol = low[symbol > 0], high[symbol > 0], symbol[symbol > 0]
        shift = self.first[symbol] - self.base[symbol]
        return low + shift, high + shift

    def _begin(self, edge, depth: int):
        """Marks the common prefixes below ``depth``, which the first sort compared, and gives the intervals of the last of them."""
        import numpy as np

        key = self.key >> self.bits * (self.width - depth)
        new = np.append(key[1:] != key[:-1], True)
        last = np.append(key[1:] >> self.bits == key[:-1] >> self.bits, depth == 1)
        edge[1:] = new
        high = np.flatnonzero(new) + 1
        low = np.concatenate(([0], high))[:-1]
        some = last[high - 1]
        for k in range(depth):  # strings without the end of a fragment
            some &= (key[high - 1] >> self.bits * k) & ((1 << self.bits) - 1) > 0
        return low[some], high[some]

    def boundaries(self, length: int):
        """For every row of the order, whether it shares fewer than ``length`` symbols with the row before.

        Rows that reach the end of their fragment within ``length`` symbols may be joined to the rows after them.
        """
        import numpy as np

        edge = np.zeros(self.size + 1, bool)
        begun = min(length, self.width)
        low, high = self._begin(edge, begun)
        for _ in range(begun, length):
            low, high = self.extend(low, high)
            new = ~edge[high]
            low, high = low[new], high[new]
            if not len(low):
                break
            edge[high] = True
        edge[0] = True
        return edge[:-1]


def _later_windows(fragments: list[bytes], doc, start, length: int):
    """Fragment, first and last offset of every run of windows that equal a window of a smaller place.

    A place is a document number and the ``start`` of the fragment in it, advanced by the offset of the window.
    """
    import numpy as np

    transform = Transform(fragments, length)
    group = np.cumsum(transform.boundaries(length)) - 1
    sizes = np.array([len(f) for f in fragments], np.int64)
    fragment = np.repeat(np.arange(len(fragments)), sizes + 1)
    offset = np.arange(transform.size) - transform.starts[fragment]
    order = transform.order[(offset + length <= sizes[fragment])[transform.order]]
    group = group[(offset + length <= sizes[fragment])[transform.order]]
    wide = int(start.max(initial=0)) + int(sizes.max(initial=0)) + 1
    place = doc.astype(np.int64) * wide + start
    here = place[fragment[order]] + offset[order]
    first = np.flatnonzero(np.diff(group, prepend=-1))
    least = np.minimum.reduceat(here, first) if len(here) else here
    again = here != np.repeat(least, np.diff(np.append(first, len(here))))
    mark = np.zeros(transform.size + 1, np.int8)
    mark[order[again]] = 1
    edge = np.diff(mark, prepend=0)
    low, high = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return fragment[low], offset[low], offset[high - 1]


def _compare(length: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        import numpy as np

        did, tie, at = (rows[c].to_numpy() for c in ("did", "tie", "at"))
        doc = np.unique(np.stack((did, tie)), axis=1, return_inverse=True)[1].reshape(-1)
        of, first, last = _later_windows(rows["bytes"].to_pylist(), doc, at, length)
        return pa.table({"did": did[of], "tie": tie[of], "low": at[of] + first, "high": at[of] + last + length},
                        schema=pa.schema([(c, pa.int64()) for c in ("did", "tie", "low", "high")]))
    return run


def _cut(length: int):
    """Bytes of the wanted fragments of every text; those of crowded anchors as single windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        names = ["did", "tie", "gram", "content", "at", "windows", "bytes"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

        def packed(out):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

        for batch in batches:
            out, held = [], 0
            for row in range(batch.num_rows):
                did, tie = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                data, wanted = batch.column(2)[row].as_buffer().to_pybytes(), batch.column(3)[row].as_py()
                for w in wanted:
                    at, windows = w["at"], w["windows"]
                    if w["crowded"]:
                        for place in range(at, at + windows):
                            window = data[place : place + length]
                            full = xxhash.xxh3_128_intdigest(window)
                            out.append((did, tie, (full >> 64) - (1 << 63), (full & (1 << 64) - 1) - (1 << 63), place, 1, None))
                    else:
                        out.append((did, tie, w["gram"], None, at, windows, data[at : at + windows + length - 1]))
                    held += windows
                    if held > 500_000:
                        yield packed(out)
                        out, held = [], 0
            if out:
                yield packed(out)
    return run


def _first(anchors: DataFrame) -> DataFrame:
    return anchors.groupBy("gram", "content").agg(F.min(F.struct("did", "tie", "at")).alias("first"), F.first("windows").alias("windows"))


def _salted(rows: DataFrame, hot: list[int]) -> DataFrame:
    """Rows with every ``salt`` that their anchor may have."""
    last = F.when(F.col("gram").isin(hot), SALTS - 1).otherwise(0)
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), last)))


def _later(anchors: DataFrame, first: DataFrame, length: int, hot: list[int]) -> DataFrame:
    """Whole spans of the fragments that repeat an earlier one."""
    return (anchors.join(_salted(first.select("gram", "content", "first"), hot), ["gram", "content", "salt"])
            .filter((F.col("first.did") != F.col("did")) | (F.col("first.tie") != F.col("tie")) | (F.col("first.at") != F.col("at")))
            .select("did", "tie", F.col("at").alias("low"), (F.col("at") + F.col("windows") + (length - 1)).alias("high")))


def removed_spans(docs: DataFrame, length: int = LENGTH, bucket_bytes: int = BUCKET_BYTES, most: int = MOST_FRAGMENTS) -> DataFrame:
    """``did, tie, low, high``: byte ranges, possibly overlapping, that stand earlier; ``docs`` from ``keyed``."""
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    texts = docs.select(*_PLACE, "data")
    grams = in_arrow(texts, _read_anchors(length, False), "gram bigint, times bigint")
    often = keep(grams.groupBy("gram").agg(F.sum("times").alias("times")).filter("times > 1"), "anchor-counts")
    every = often.agg(F.sum("times")).first()[0] or 0
    hot = [r.gram for r in often.filter(F.col("times") > every * HOT_SHARE).select("gram").collect()]  # fewer than 1 / HOT_SHARE
    anchors = keep(in_arrow(texts, _read_anchors(length, True, hot), _ANCHORS).join(
        _salted(often.select("gram"), hot).hint("shuffle_hash"), ["gram", "salt"], "left_semi"), "anchors")
    first = keep(_first(anchors), "first-fragments")
    several = first.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram", (F.col("n") > most).alias("crowded"))
    wanted = first.join(several, "gram").select(
        F.col("first.did").alias("did"), F.col("first.tie").alias("tie"),
        F.struct("gram", F.col("first.at").alias("at"), "windows", "crowded").alias("w")).groupBy(*_PLACE).agg(F.collect_list("w").alias("w"))
    cut = keep(in_arrow(texts.join(wanted.hint("shuffle_hash"), _PLACE), _cut(length), _CUT), "fragments")
    fragments, windows = cut.filter("bytes is not null"), cut.filter("bytes is null").drop("bytes")
    total = fragments.agg(F.sum(F.length("bytes"))).first()[0] or 0
    buckets = 1 + total // bucket_bytes
    met = fragments.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets))).select("bucket", "did", "tie", "at", "bytes")
    compared = met.groupBy("bucket").applyInArrow(_compare(length), _SPANS)
    alone = windows.withColumn("salt", F.lit(0))
    return _later(anchors, first, length, hot).unionByName(compared).unionByName(_later(alone, _first(windows), length, []))


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id`` with the key that orders documents and the bytes of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    number = F.col("doc_id").cast("bigint")
    return docs.select(number.alias("doc_id"), F.coalesce(number, F.lit(LOWEST)).alias("did"), F.xxhash64(text).alias("tie"),
                       text.cast("binary").alias("data"))


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for batch in batches:
        out = []
        for row in range(batch.num_rows):
            data, spans = batch.column(1)[row].as_buffer(), batch.column(2)[row].as_py() or []
            view, sha, at, removed, runs = memoryview(data), hashlib.sha256(), 0, 0, 0
            for low, high in sorted((s["low"], s["high"]) for s in spans):
                if low > at or not runs:
                    sha.update(view[at:low])
                    runs += 1
                    removed += high - low
                    at = high
                elif high > at:
                    removed += high - at
                    at = high
            sha.update(view[at:])
            out.append((len(view), removed, runs, sha.hexdigest()))
        columns = zip(*out, strict=True) if out else [[]] * 4
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)


def remove_repeats(docs: DataFrame, length: int = LENGTH, bucket_bytes: int = BUCKET_BYTES, most: int = MOST_FRAGMENTS) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``docs``."""
    rows = keyed(docs)
    spans = removed_spans(rows, length, bucket_bytes, most).distinct().groupBy(*_PLACE).agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    joined = rows.join(spans.hint("shuffle_hash"), _PLACE, "left").select("doc_id", "data", "spans")
    return in_arrow(joined, _strip, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


#: Bytes are two hexadecimal digits here; documents have an id each.
ORACLE = f"""
with bytes as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n_bytes from documents),
windows as (select doc_id, s, md5(substr(h, 2 * s + 1, {2 * LENGTH})) as w from (select doc_id, h, unnest(range(0, n_bytes - {LENGTH - 1})) as s from bytes) t),
again as (select doc_id, s from windows qualify row_number() over (partition by w order by doc_id nulls first, s) > 1),
marked as (select doc_id, s, case when s <= lag(s) over (partition by doc_id order by s) + {LENGTH} then 0 else 1 end as new from again),
numbered as (select doc_id, s, sum(new) over (partition by doc_id order by s) as run from marked),
spans as (select doc_id, run, min(s) as low, max(s) + {LENGTH} as high from numbered group by doc_id, run),
gaps as (select doc_id, low, high, coalesce(lag(high) over (partition by doc_id order by low), 0) as before from spans),
removed as (
    select g.doc_id, sum(high - low) as n_removed, count(*) as n_spans,
        string_agg(substr(b.h, 2 * before + 1, 2 * (low - before)), '' order by low) || substr(any_value(b.h), 2 * max(high) + 1) as kept
    from gaps g join bytes b on g.doc_id = b.doc_id group by g.doc_id)
select b.doc_id, b.n_bytes, coalesce(r.n_removed, 0)::bigint as n_removed, coalesce(r.n_spans, 0) as n_spans,
    sha256(unhex(coalesce(r.kept, b.h))) as kept_sha256
from bytes b left join removed r on b.doc_id = r.doc_id"""
