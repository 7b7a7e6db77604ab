"""Collocations by Toivonen's method: exact counts of frequent phrases, proposed by a sample.

1. The sample: about one document in ``SAMPLE`` (by hash). Its phrases, counted in steps of length, that reach a lowered
   threshold are the proposal; a phrase is only counted when all its parts reach it.
2. The full pass counts, exactly and in all documents, the proposal and its negative border: all single words, and every
   phrase whose first and last words but one are both proposed. It is closed when no frequent phrase of the border was unproposed.
3. Otherwise such phrases join the proposal and another pass counts what they add to the border, and at once what those new
   phrases would add if they were frequent as well. All words were counted in the full pass, so this pass always closes the border.

Tasks test proposals in a bit set of bounded size (``MOST_BITS``) that holds hashes; a false hit only means that a phrase is
counted that need not be, and what an earlier bit set let through is never counted again. Every slice of documents is
counted with numpy before its phrases are shuffled, as text, and summed; word hashes of 64 bits tell phrases apart inside a
slice of ``SLICE_BYTES`` only. No phrase set is held by the driver.

Cases: a null text has no words; a null language counts as ``und``, together with one of that name; pieces without words are
skipped; repeated rows all count; words are kept as they are but for A-Z; ties end with the phrase's bytes; a language without
candidates has no rows; an empty table gives none; doc_id and other columns are not read; a text longer than a slice is read in
parts, each with the words behind it that its last phrases need.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factfold.llm.common import in_arrow, keep, mix64
from factfold.operators.ranking import first_rows

LEAST = 30
LONGEST = 4
FIRST = 2000
ABSORB = (80, 100)
SCALE = 2_000_000
#: One document in so many is sampled, and a phrase is proposed from so many occurrences there (half of what ``LEAST`` implies).
SAMPLE = 8
SLICE_BYTES = 1_000_000
#: Phrases are turned into text in runs of so many.
RUN_PHRASES = 50_000
MOST_BITS = 1 << 29
_COUNTS = "lang string, phrase string, times bigint"
#: Bytes: A-Z in lower case, separators of pieces as newline, tab as blank.
_BYTES = bytes(10 if chr(b) in ".,;:!?\n\v\f\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


class Bits:
    """A set of hashes with two bits for each."""

    def __init__(self, words):
        self.words = words
        self.mask = len(words) * 64 - 1

    def has(self, hashes):
        import numpy as np

        found = np.ones(len(hashes), bool)
        for slot in slots(hashes, self.mask):
            found &= (self.words[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
        return found


def slots(hashes, mask: int):
    """The two places of every hash in a bit set of ``mask`` + 1 bits."""
    import numpy as np

    return hashes & np.uint64(mask), (hashes >> np.uint64(32)) & np.uint64(mask)


def _chain(before, word):
    """Hash of a phrase from that of the phrase without its last word and that of the word."""
    import numpy as np

    return mix64(before * np.uint64(0x9E3779B97F4A7C15) + word)


def _language(name: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(name.encode())


def _words(data):
    """First and end byte of every word, and the number of its piece, in translated bytes."""
    import numpy as np

    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = (data != 32) & (data != 10)
    step = np.diff(inside)
    low, high = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    ends = np.flatnonzero(data == 10)
    return low, high, np.searchsorted(ends, low)


def _word_hashes(data, low, high):
    """A hash of every word's bytes and their places in it."""
    import numpy as np

    if not len(low):
        return np.zeros(0, np.uint64)
    sizes = high - low
    total = np.concatenate(([0], np.cumsum(sizes)))
    place = np.arange(total[-1]) - np.repeat(total[:-1], sizes)
    letters = data[place + np.repeat(low, sizes)].astype(np.uint64)
    mixed = mix64(letters * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64) + np.uint64(1))
    return mix64(np.add.reduceat(mixed, total[:-1]) + sizes.astype(np.uint64))


def _texts_of(data, low, high, first, last):
    """The phrases from word ``first`` to word ``last`` as an Arrow array, words joined by one blank."""
    import numpy as np

    words = last - first + 1
    total = np.concatenate(([0], np.cumsum(words)))
    word = np.arange(total[-1]) - np.repeat(total[:-1], words) + np.repeat(first, words)
    sizes = high[word] - low[word] + 1  # with the blank behind it
    ends = np.concatenate(([0], np.cumsum(sizes)))
    source = np.arange(ends[-1]) - np.repeat(ends[:-1], sizes) + np.repeat(low[word], sizes)
    out = data[np.minimum(source, len(data) - 1)]
    out[ends[1:] - 1] = 32
    out = np.delete(out, ends[total[1:]] - 1)
    offsets = ends[total] - np.arange(len(total))
    return pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(out)))


def _count_slice(data, seeds, texts_end, limit, lengths, wanted, counted, totals: bool):
    """Counts of a slice in arrays: row of a first word's text, phrase, times.

    ``seeds`` has a hash of the language and ``texts_end`` the end of every text; phrases that begin at byte ``limit`` or behind
    it are left to the next slice. A phrase of two or more words counts when its parts are in ``wanted`` (None: always). With
    ``counted``, the set that an earlier pass wanted, it counts when that pass did not count it and each part is in ``wanted`` or
    counts now itself.
    """
    import numpy as np

    low, high, piece = _words(data)
    text = np.searchsorted(texts_end, low, "right")
    seed = seeds[text]
    word = _word_hashes(data, low, high)
    n = len(low)
    own = int(np.searchsorted(low, limit))
    if totals and own:
        order, first, times = np.unique(seed[:own], return_index=True, return_counts=True)
        yield text[first], pa.array([""] * len(order), pa.string()), times
    phrase = mix64(word ^ seed)  # hash of the phrase that begins at each word
    may = wanted.has(phrase) if wanted is not None else None
    for length in range(1, max(lengths) + 1):
        m = n - length + 1
        if m <= 0:
            break
        counts = np.ones(m, bool) if length == 1 else piece[:m] == piece[length - 1 :]
        phrase_now = phrase if length == 1 else _chain(phrase[:m], word[length - 1 :])
        if length > 1 and wanted is not None:
            counts &= may[:m] & may[1 : m + 1]
            if counted is not None:
                before = counted.has(phrase)
                counts &= ~(before[:m] & before[1 : m + 1])
            may = wanted.has(phrase_now)
            if counted is not None:
                may |= counts
        if length in lengths:
            at = np.flatnonzero(counts[:own])
            _, first, times = np.unique(phrase_now[at], return_index=True, return_counts=True)
            first = at[first]
            for run in range(0, len(first), RUN_PHRASES):
                some = first[run : run + RUN_PHRASES]
                yield text[some], _texts_of(data, low, high, some, some + length - 1), times[run : run + RUN_PHRASES]
        phrase = phrase_now


def _counter(lengths: tuple[int, ...], wanted, counted, totals: bool, size: int):
    """Arrow function over ``lang, data``: partial counts of phrases; ``wanted`` and ``counted`` are broadcasts or None."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        old = counted and counted.value
        new = wanted and wanted.value
        for batch in batches:
            column = batch.column(1)
            for low, high in _runs(column, size):
                langs = batch.column(0).slice(low, high - low).to_pylist()
                known = {name: _language(name) for name in {*langs}}
                seeds = np.array([known[name] for name in langs], np.uint64)
                for data, ends, limit in _translated(column, low, high, size):
                    for text, phrases, times in _count_slice(data, seeds, ends, limit, lengths, new, old, totals):
                        names = pa.array(langs, pa.string()).take(pa.array(text))
                        yield pa.RecordBatch.from_arrays([names, phrases, pa.array(times, pa.int64())], ["lang", "phrase", "times"])
    return run


def _runs(column, size: int):
    """Row ranges of about ``size`` bytes."""
    import numpy as np

    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    row = 0
    while row < len(column):
        until = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, until
        row = until


def _translated(column, low: int, high: int, size: int):
    """Bytes of the rows with a newline behind each text, the ends of the texts, and where the next part of a long text begins."""
    import numpy as np

    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = bytes(memoryview(column.buffers()[2] or b"")[offsets[low] : offsets[high]]).translate(_BYTES)
    if high - low == 1 and len(data) > size:
        for part, limit in _parts(data, size):
            yield np.frombuffer(part, np.uint8), np.array([len(part)]), limit
        return
    ends = np.cumsum(np.diff(offsets[low : high + 1]) + 1)
    out = np.full(int(ends[-1]), 10, np.uint8)
    inner = np.ones(len(out), bool)
    inner[ends - 1] = False
    out[inner] = np.frombuffer(data, np.uint8)
    yield out, ends, len(out)


def _parts(data: bytes, size: int) -> Iterator[tuple[bytes, int]]:
    """Parts of a text that begin behind a word, with the next words, and the length without these."""
    gap, at = re.compile(rb"[ \n]"), 0
    following = re.compile(rb"(?:[ \n]*[^ \n]+){0,%d}" % (LONGEST - 1))
    while at < len(data):
        found = gap.search(data, at + size)
        cut = found.start() if found else len(data)
        yield data[at : following.match(data, cut).end()] + b"\n", cut - at
        at = cut


def _hash_phrases(bits_mask: int):
    """Bit set words of every phrase: ``slot, bit``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            if not batch.num_rows:
                continue
            hashes = phrase_hashes(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            places = np.concatenate(slots(hashes, bits_mask))
            bits = np.left_shift(np.uint64(1), places & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array((places >> np.uint64(6)).astype(np.int64)), pa.array(bits.view(np.int64))], ["slot", "bit"])
    return run


def phrase_hashes(langs: list[str], phrases: list[str]):
    """The hashes that ``_count_slice`` gives to the phrases."""
    import numpy as np

    data = np.frombuffer("\n".join([*phrases, ""]).encode(), np.uint8)
    low, high, piece = _words(data)
    word = _word_hashes(data, low, high)
    first = np.searchsorted(piece, np.arange(len(phrases)))
    size = np.bincount(piece, minlength=len(phrases))
    known = {name: _language(name) for name in {*langs}}
    out = mix64(word[first] ^ np.array([known[name] for name in langs], np.uint64))
    for k in range(1, LONGEST):
        more = size > k
        out[more] = _chain(out[more], word[first[more] + k])
    return out


def bit_set(phrases: DataFrame, count: int, old: Bits | None = None) -> Bits:
    """The phrases as a bit set of 16 to 32 bits each, at most ``MOST_BITS`` in all, together with what ``old`` holds."""
    import numpy as np

    size = len(old.words) * 64 if old else min(MOST_BITS, max(1 << 16, 1 << (16 * count).bit_length()))
    rows = in_arrow(phrases.select("lang", "phrase"), _hash_phrases(size - 1), "slot bigint, bit bigint")
    held = rows.groupBy("slot").agg(F.bit_or("bit").alias("bit"))
    words = old.words.copy() if old else np.zeros(size // 64, np.uint64)
    got = held.toArrow()  # at most MOST_BITS / 64 rows
    words[got["slot"].to_numpy()] |= got["bit"].to_numpy().view(np.uint64)
    return Bits(words)


def _length() -> F.Column:
    return F.size(F.split("phrase", " "))


def _summed(parts: DataFrame, least: int) -> DataFrame:
    return parts.groupBy("lang", "phrase").agg(F.sum("times").alias("times")).filter((F.col("times") >= least) | (F.col("phrase") == ""))


class Miner:
    """Exact counts of the frequent phrases of a table; ``passes`` tells how many passes over it were needed."""

    def __init__(self, docs: DataFrame, least: int = LEAST, longest: int = LONGEST, sample: int = SAMPLE):
        self.least, self.longest, self.sample = least, longest, sample
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        self.context = docs.sparkSession.sparkContext
        self.texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text.cast("binary").alias("data"))
        self.passes = 0

    def _count(self, texts: DataFrame, lengths: tuple[int, ...], wanted: Bits | None, counted: Bits | None, totals: bool,
               least: int) -> DataFrame:
        new = self.context.broadcast(wanted) if wanted else None
        old = self.context.broadcast(counted) if counted else None
        parts = in_arrow(texts, _counter(lengths, new, old, totals, SLICE_BYTES), _COUNTS)
        return keep(_summed(parts, least), "phrases")

    def propose(self) -> tuple[DataFrame, int]:
        """Phrases of fewer than ``longest`` words that are frequent enough in the sample, and their number."""
        few = max(1, self.least // (2 * self.sample) + (self.sample > 1))
        chosen = self.texts.filter(F.pmod(F.xxhash64("data", "lang"), F.lit(self.sample)) == 0)
        found = self._count(chosen, (1, 2), None, None, False, few)
        count = found.count()
        if self.longest > 3:
            longer = self._count(chosen, tuple(range(3, self.longest)), bit_set(found, count), None, False, few)
            found, count = found.unionByName(longer), count + longer.count()
        return found.filter(_length() < self.longest), count

    def run(self) -> DataFrame:
        """``lang, phrase, times`` of every phrase with at least ``least`` occurrences, and of the empty phrase: all words."""
        proposed, count = self.propose()
        bits = bit_set(proposed, count)
        found = [self._count(self.texts, tuple(range(1, self.longest + 1)), bits, None, True, self.least)]
        self.passes = 1
        if self.longest > 1:
            candidates = found[-1].filter((F.col("phrase") != "") & (_length() < self.longest))
            failed = keep(in_arrow(candidates.select("lang", "phrase"), _outside(self.context.broadcast(bits)), "lang string, phrase string"), "failed")
            if not failed.isEmpty():
                found.append(self._count(self.texts, tuple(range(2, self.longest + 1)), bit_set(failed, 0, bits), bits, False, self.least))
                self.passes += 1
        return reduce(DataFrame.unionByName, found)


def _outside(bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                hashes = phrase_hashes(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                yield batch.filter(pa.array(~bits.value.has(hashes)))
    return run


def _big(column: str):
    return F.col(column).cast("decimal(38,0)")


def collocations(docs: DataFrame, first: int = FIRST, least: int = LEAST, longest: int = LONGEST, sample: int = SAMPLE) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best-scored phrases of each language."""
    counts = keep(Miner(docs, least, longest, sample).run(), "counts")
    totals = counts.filter("phrase = ''").select("lang", F.col("times").alias("n"))
    frequent = counts.filter("phrase <> ''").withColumn("words", F.split("phrase", " "))
    candidates = frequent.filter(F.size("words") > 1)

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda size: F.transform(
        F.sequence(F.lit(1), F.size("words") - size + 1), lambda at: F.array_join(F.slice("words", at, size), " "))))
    longer = candidates.filter(F.size("words") > 2).select("lang", F.explode(inner).alias("phrase"), "times").groupBy("lang", "phrase").agg(
        F.max("times").alias("longer"))
    kept = candidates.join(longer, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (_big("longer") * ABSORB[1] < _big("times") * ABSORB[0]))

    cuts = kept.select("lang", "phrase", F.col("times").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("head"),
        F.array_join(F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")), " ").alias("rest"))
    parts = frequent.select("lang", F.col("phrase").alias("part"), "times")
    scored = (cuts.join(parts.select("lang", F.col("part").alias("head"), F.col("times").alias("l")), ["lang", "head"])
              .join(parts.select("lang", F.col("part").alias("rest"), F.col("times").alias("r")), ["lang", "rest"])
              .withColumn("score", F.expr(f"(cast({SCALE} as decimal(10,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + r)")))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("b")).select(
        "lang", "phrase", "b.a", "b.l", "b.r", "b.score")
    ranked = first_rows(best, ["lang"], [F.col("score").desc(), F.col("a").desc(), F.col("phrase")], first, "phrase", out="rank")
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = f"""
with pieces as (
    select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
words as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as ws from pieces),
grams as (
    select lang, size, array_to_string(ws[i : i + size - 1], ' ') as phrase
    from (select lang, ws, size, unnest(range(1, len(ws) - size + 2)) as i from words, (values (1), (2), (3), (4)) v(size)) t),
totals as (select lang, count(*) as n from grams where size = 1 group by lang),
frequent as (select lang, size, phrase, string_split(phrase, ' ') as ws, count(*) as a from grams group by all having count(*) >= {LEAST}),
inside as (
    select lang, array_to_string(ws[i : i + small - 1], ' ') as phrase, max(a) as longer
    from (select lang, ws, a, small, unnest(range(1, size - small + 2)) as i from frequent, (values (2), (3)) v(small) where size > small) t
    group by all),
kept as (select f.* from frequent f left join inside i on f.lang = i.lang and f.phrase = i.phrase
    where f.size > 1 and (i.longer is null or {ABSORB[1]} * i.longer::hugeint < {ABSORB[0]} * f.a::hugeint)),
cuts as (select lang, phrase, a, k, array_to_string(ws[1 : k], ' ') as head, array_to_string(ws[k + 1 :], ' ') as rest
    from (select *, unnest(range(1, size)) as k from kept) t),
scored as (
    select c.lang, c.phrase, c.a, c.k, h.a as l, r.a as r, ({SCALE} * c.a::hugeint) // (h.a + r.a) as score
    from cuts c join frequent h on c.lang = h.lang and c.head = h.phrase join frequent r on c.lang = r.lang and c.rest = r.phrase
    qualify row_number() over (partition by c.lang, c.phrase order by score, c.k) = 1)
select s.lang, row_number() over (partition by s.lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, t.n, score::bigint as score
from scored s join totals t on s.lang = t.lang
qualify rank <= {FIRST}"""
