"""Language of texts and of their spans: script ranges, scores per word, a Viterbi path over the words.

Training counts hashed letter pairs, letter triples and words per language. A word's script narrows the
languages to those that were seen in this script, its features give a clipped log-likelihood per language, and
the path through the words of a text pays ``SWITCH`` whenever it changes language. Runs of one language on the
path are the spans; the language with the most letters labels the text, and its share of the letters is the
score.

Paths of many texts advance together, one word a step. Word scores are remembered per Python worker, up to
``WORDS`` words. Texts are not shuffled.

Cases: null or empty texts and texts without letters are ``und`` with score 0, as is everything when nothing
could be learned; equal scores go to the first language by name; rows with a null language are not learned
from; repeated rows are labelled each for itself; other columns pass through or are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factfold.llm.common import SLICE_CHARS, in_arrow, only, slices

UNKNOWN = "und"
BUCKETS = 1 << 15
SWITCH, CLIP, FOREIGN = 8.0, 6.0, 30.0
WORDS = 400_000
#: Distinct words and languages that a training task counts before it turns words into features, or sends what it has.
FRESH_WORDS, HELD_LANGUAGES = 100_000, 64
SEED = 17
LETTER_RUNS = re.compile(r"[^\W\d_]+").findall
# First code points of Unicode script blocks.
SCRIPT_STARTS = (0x0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0x980, 0xE00, 0xE80, 0x10A0, 0x1100, 0x1200,
                 0x1E00, 0x1F00, 0x2000, 0x2C80, 0x2E80, 0x3040, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00)
SCRIPT_NAMES = ("latin", "greek", "cyrillic", "other", "hebrew", "arabic", "other", "devanagari", "indic", "thai", "other",
                "georgian", "hangul", "other", "latin", "greek", "other", "other", "han", "kana", "other", "han",
                "other", "hangul", "other", "han", "other")
SCRIPTS = sorted({*SCRIPT_NAMES})


@dataclass
class Model:
    """Languages by name, log-probabilities (bucket, language), and which scripts each language was seen in."""

    languages: list[str]
    scores: object
    scripts: object


def features(words: list[str]):
    """Feature buckets and the word each belongs to, in the order of the words; and each word's script."""
    import numpy as np

    text = np.frombuffer((" " + " ".join(words) + "  ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    blank = text == 32
    owner = np.cumsum(blank) - 1
    a, b, c = text[:-2], text[1:-1], text[2:]
    pair = (a * np.uint64(0x9E3779B1) + b * np.uint64(0x85EBCA77)) * np.uint64(0xC2B2AE3D27D4EB4F)
    triple = (a * np.uint64(0x9E3779B97F4A7C15) ^ b * np.uint64(0xC2B2AE3D27D4EB4F) ^ c * np.uint64(0x165667B19E3779F9)) \
        * np.uint64(0xD6E8FEB86659FD93)
    inside = ~blank[1:-1]
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    # every pair that ends in a letter, every triple with a letter in its middle
    which = owner[1:-1][inside]
    hashes = np.stack((pair[inside] >> shift, triple[inside] >> shift), 1).astype(np.int64)
    heads = text[1:][blank[:-1]][: len(words)]
    script = np.array([SCRIPTS.index(n) for n in SCRIPT_NAMES])[np.searchsorted(SCRIPT_STARTS, heads.astype(np.int64), "right") - 1]
    return hashes, which, script


def word_buckets(words: list[str]):
    import numpy as np
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(w, SEED) % BUCKETS for w in words], np.int64)


def train(docs: DataFrame) -> Model:
    """Counts over all rows with a language and a text, on the executors."""
    import numpy as np

    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        held: dict[str, np.ndarray] = {}

        def turn() -> None:
            """Words so far become feature counts of their language."""
            for lang, counts in seen.items():
                words = list(counts)
                if not words:
                    continue
                weight = np.array([counts[w] for w in words], float)
                hashes, which, script = features(words)
                total = np.bincount(word_buckets(words), weight, BUCKETS)
                for column in hashes.T:
                    total += np.bincount(column, weight[which], BUCKETS)
                both = np.concatenate((total, np.bincount(script, weight, len(SCRIPTS))))
                held[lang] = held[lang] + both if lang in held else both
            seen.clear()

        def send() -> Iterator[pa.RecordBatch]:
            for lang, both in held.items():
                at = np.flatnonzero(both)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(both[at])], ["lang", "at", "n"])
            held.clear()

        for batch, texts in slices(batches):
            for lang, text in zip(batch.column(1).to_pylist(), texts, strict=True):
                seen.setdefault(lang, Counter()).update(LETTER_RUNS(text.lower()))
            if sum(map(len, seen.values())) > FRESH_WORDS or len(seen) > HELD_LANGUAGES:
                turn()
                if len(held) > HELD_LANGUAGES:
                    yield from send()
        turn()
        yield from send()

    counted = in_arrow(rows, count, "lang string, at int, n double").groupBy("lang", "at").agg(F.sum("n").alias("n"))
    found = counted.toArrow()
    languages = sorted(set(found["lang"].to_pylist()))
    table = np.zeros((BUCKETS + len(SCRIPTS), len(languages)))
    if languages:
        lang = np.searchsorted(np.array(languages), np.array(found["lang"].to_pylist()))
        table[found["at"].to_numpy(), lang] = found["n"].to_numpy()
    counts = table[:BUCKETS] + 0.5
    scripts = table[BUCKETS:] > 0.001 * table[BUCKETS:].sum(0, keepdims=True)
    return Model(languages, np.log(counts / counts.sum(0, keepdims=True)).astype(np.float32), scripts)


@dataclass
class Scorer:
    """Word scores by language, remembered."""

    model: Model
    known: dict[str, int] = field(default_factory=dict)
    matrix: object = None

    def numbers(self, words: list[str]):
        """Rows of ``matrix`` for the words; -1 for runs without a letter."""
        import numpy as np

        found = list(map(self.known.get, words))
        if None in found:
            if len(self.known) > WORDS:
                self.known, self.matrix = {}, None
            fresh = [w for w in dict.fromkeys(words) if w not in self.known]
            letters = [w for w in fresh if any(map(str.isalpha, w))]
            self.known.update(dict.fromkeys(fresh, -1))
            base = 0 if self.matrix is None else len(self.matrix)
            self.known.update(zip(letters, range(base, base + len(letters)), strict=True))
            if letters:
                made = self.score(letters)
                self.matrix = made if self.matrix is None else np.concatenate((self.matrix, made))
            found = list(map(self.known.__getitem__, words))
        return np.array(found, np.int64)

    def score(self, words: list[str]):
        import numpy as np

        m = self.model
        hashes, which, script = features(words)
        ends = np.searchsorted(which, np.arange(len(words)))
        made = np.add.reduceat(m.scores[hashes[:, 0]] + m.scores[hashes[:, 1]], ends, axis=0) + m.scores[word_buckets(words)]
        fits = m.scripts[script]
        fits |= ~fits.any(1, keepdims=True)
        made = np.where(fits, made, -np.inf)
        made = np.maximum(made - made.max(1, keepdims=True), -CLIP)
        return np.where(fits, made, -FOREIGN).astype(np.float32)


def best_paths(scores, starts, sizes, switch: float = SWITCH):
    """Most likely language of every row of ``scores``; paths of the runs (starts, sizes) advance together."""
    import numpy as np

    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), "left")  # runs longer than each step
    stay = np.zeros(scores.shape, bool)
    leader = np.zeros(len(scores), np.int16)
    path = np.zeros(len(scores), np.int16)
    value = np.zeros((len(sizes), scores.shape[1]), np.float32)
    for t in range(longest):
        n = active[t]
        at, v = starts[:n] + t, value[:n]
        if t:
            top = v.argmax(1)
            leader[at] = top
            jump = v[np.arange(n), top][:, None] - switch
            stay[at] = v >= jump
            np.maximum(v, jump, out=v)
        v += scores[at]
    now = value.argmax(1).astype(np.int16)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        own = now[:n]
        path[at] = own
        if t:
            now[:n] = np.where(stay[at, own], own, leader[at])
    return path


def label(scorer: Scorer, texts: list[str], spans: bool) -> list[tuple[str, float, list | None]]:
    """Language, score and, on request, (from word, until word, language) spans of every text."""
    import numpy as np

    languages = scorer.model.languages
    if not languages:
        return [(UNKNOWN, 0.0, [] if spans else None) for _ in texts]
    words = [LETTER_RUNS(t.lower()) for t in texts]
    flat = [w for ws in words for w in ws]
    rows = scorer.numbers(flat)
    lettered = rows >= 0
    of = np.repeat(np.arange(len(texts)), [len(w) for w in words])[lettered]
    rows = rows[lettered]
    sizes = np.bincount(of, minlength=len(texts))
    starts = np.cumsum(sizes) - sizes
    path = best_paths(scorer.matrix[rows] if len(rows) else np.zeros((0, len(languages)), np.float32), starts, sizes)
    weight = np.fromiter(map(len, flat), np.int64, len(flat))[lettered]
    letters = np.zeros((len(texts), len(languages)))
    np.add.at(letters, (of, path), weight)
    top = letters.argmax(1)
    total = letters.sum(1)
    share = letters[np.arange(len(texts)), top] / np.maximum(total, 1)
    out = []
    for doc in range(len(texts)):
        runs = None
        if spans:
            own = path[starts[doc] : starts[doc] + sizes[doc]]
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)] if len(own) else [0]
            runs = [(a, b, languages[own[a]]) for a, b in zip(cuts, cuts[1:], strict=False)]
        out.append((languages[top[doc]], float(share[doc]), runs) if total[doc] else (UNKNOWN, 0.0, runs))
    return out


SCORERS: dict[str, Scorer] = {}


def scorer_of(shared, key: str) -> Scorer:
    """The worker's scorer for a model; only the latest model's is kept."""
    only("langid", SCORERS.clear)
    if key not in SCORERS:
        SCORERS.clear()
        SCORERS[key] = Scorer(shared.value)
    return SCORERS[key]


def _share(docs: DataFrame, model: Model):
    import uuid

    return docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex


def identify(docs: DataFrame, model: Model, spans: bool = True) -> DataFrame:
    """``doc_id, lang_pred, score`` and, on request, ``spans`` over the words with letters."""
    shared, key = _share(docs, model)
    kind = pa.list_(pa.struct([("from", pa.int32()), ("until", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer_of(shared, key)
        for batch, texts in slices(batches, chars=2 * SLICE_CHARS):
            found = label(own, texts, spans)
            columns = [batch.column(0), pa.array([f[0] for f in found]), pa.array([f[1] for f in found])]
            if spans:
                columns.append(pa.array([[dict(zip(("from", "until", "lang"), r, strict=True)) for r in f[2]] for f in found], kind))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"] + ["spans"] * spans)

    schema = "doc_id bigint, lang_pred string, score double"
    schema += ", spans array<struct<from: int, until: int, lang: string>>" * spans
    rows = docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text")
    return in_arrow(rows, run, schema)


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents, whole rows, that have a language with at least the share ``least`` of the letters.

    When no language was learned, those that have letters.
    """
    if not model.languages:
        def lettered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in slices(batches, chars=2 * SLICE_CHARS):
                yield batch.filter(pa.array([any(map(str.isalpha, t)) for t in texts], pa.bool_()))

        return in_arrow(docs, lettered, docs.schema)
    shared, key = _share(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer_of(shared, key)
        for batch, texts in slices(batches, chars=2 * SLICE_CHARS):
            yield batch.filter(pa.array([f[0] != UNKNOWN and f[1] >= least for f in label(own, texts, False)]))

    return in_arrow(docs, run, docs.schema)
