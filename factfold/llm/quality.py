"""Quality of documents by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. A passage is encoded from hashed counts of word shapes,
shape pairs, repetitions, words and a few rates, by one hidden layer. Gated attention weighs the passages, and
the weighted representation is scored. Only document labels are used. The network is fitted with numpy on
the driver, on all passages of a sample of about ``SAMPLE_DOCS`` labelled documents at most; they lie in a file of the driver,
and memory holds those of one mini-batch. Scoring reads every passage of every document in tasks, without a shuffle.

Cases: null and empty texts are one empty passage; rows with a null label are not learned from, an id with
several labels takes their majority (a tie counts as good); with no or only one label every score is the
smoothed share of good labels; other columns pass through or are ignored.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factfold.llm.common import SLICE_CHARS, in_arrow, keep, only, slices

PASSAGE = 48
BUCKETS, HIDDEN, ATTENTION = 384, 32, 16
SAMPLE_DOCS = 4_000
EPOCHS, RATE, SEED = 14, 0.004, 5
THRESHOLD = 0.3
REMEMBERED = 400_000
#: Letters become x, capitals X, digits 9, other ASCII stays, other bytes are x.
SHAPE = bytes(ord("x") if 97 <= b <= 122 or b >= 128 else ord("X") if 65 <= b <= 90 else ord("9") if 48 <= b <= 57 else b
              for b in range(256))


class Words(dict):
    """Shape bucket, word bucket and length of a word packed into one number, remembered up to a limit."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > REMEMBERED:
            self.clear()
        shape = word.translate(SHAPE)
        for c in (b"x", b"X", b"9"):
            while c + c in shape:
                shape = shape.replace(c + c, c)
        found = self[word] = ((xxhash.xxh3_64_intdigest(shape) & 0xFFFFF) << 32 | (xxhash.xxh3_64_intdigest(word) & 0xFFFFF) << 12
                              | min(len(word), 4095))
        return found


WORDS = Words()


def encode(texts: list[str], most: int | None = None):
    """Passage features of all texts (float32 rows) and the number of passages of each text.

    ``most`` keeps evenly spaced passages.
    """
    import numpy as np

    only("quality", WORDS.clear)
    words = [t.encode().split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter(map(WORDS.__getitem__, (w for ws in words for w in ws)), np.int64, int(sizes.sum()))
    bags = np.maximum(1, -(-sizes // PASSAGE))
    first = np.cumsum(bags) - bags
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    passage = np.repeat(first, sizes) + place // PASSAGE
    shape, word, length = flat >> 32, (flat >> 12) & 0xFFFFF, flat & 4095
    total = int(bags.sum())
    before = np.concatenate(([-1], flat[:-1])) if len(flat) else flat
    again = (flat == before) & (place > 0)
    both = np.where(place > 0, np.concatenate(([0], shape[:-1])) * 31 + shape, shape) if len(flat) else shape
    half = BUCKETS // 4
    counts = np.zeros(total * BUCKETS)
    for low, bucket in ((0, shape % (2 * half)), (2 * half, both % half), (3 * half, word % (half - 8))):
        counts += np.bincount(passage * BUCKETS + low + bucket, minlength=total * BUCKETS)
    counts = counts.reshape(total, BUCKETS)
    n = np.bincount(passage, minlength=total)
    order = np.lexsort((flat, passage))
    fresh = np.ones(len(flat), bool)
    fresh[1:] = (flat[order][1:] != flat[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    safe = np.maximum(n, 1)
    rates = np.stack((np.bincount(passage, again, total) / safe, np.bincount(passage[order], fresh, total) / safe,
                      np.bincount(passage, length, total) / safe / 8, n / PASSAGE, n == 0), 1)
    x = np.sqrt(counts / safe[:, None])
    x[:, -8:-3] = rates
    if most is not None and len(bags):
        kept = [f + np.unique(np.linspace(0, b - 1, min(b, most)).astype(int)) for f, b in zip(first, bags, strict=True)]
        x, bags = x[np.concatenate(kept)], np.array([len(k) for k in kept])
    return x.astype(np.float32), bags


@dataclass
class Network:
    """Weights of the passage encoder (w, b), the gated attention (v, u, a) and the output (o, c)."""

    weights: dict

    def forward(self, x, bags):
        import numpy as np

        w = self.weights
        starts = np.cumsum(bags) - bags
        hidden = np.maximum(x @ w["w"] + w["b"], 0)
        tanh, gate = np.tanh(hidden @ w["v"]), 1 / (1 + np.exp(-(hidden @ w["u"])))
        score = ((tanh * gate) @ w["a"])[:, 0]
        of = np.repeat(np.arange(len(bags)), bags)
        score = np.exp(score - np.maximum.reduceat(score, starts)[of])
        weight = score / np.add.reduceat(score, starts)[of]
        pooled = np.add.reduceat(hidden * weight[:, None], starts)
        logit = (pooled @ w["o"] + w["c"])[:, 0]
        return {"hidden": hidden, "tanh": tanh, "gate": gate, "weight": weight, "pooled": pooled, "of": of,
                "p": 1 / (1 + np.exp(-np.clip(logit, -30, 30)))}

    def gradients(self, x, bags, target):
        import numpy as np

        w, f = self.weights, self.forward(x, bags)
        starts = np.cumsum(bags) - bags
        d_logit = ((f["p"] - target) / len(bags))[:, None]
        d_pooled = d_logit @ w["o"].T
        spread = d_pooled[f["of"]]
        d_weight = (spread * f["hidden"]).sum(1)
        mean = np.add.reduceat(d_weight * f["weight"], starts)
        d_score = (f["weight"] * (d_weight - mean[f["of"]]))[:, None]
        d_both = d_score @ w["a"].T
        d_tanh = d_both * f["gate"] * (1 - f["tanh"] ** 2)
        d_gate = d_both * f["tanh"] * f["gate"] * (1 - f["gate"])
        d_hidden = (spread * f["weight"][:, None] + d_tanh @ w["v"].T + d_gate @ w["u"].T) * (f["hidden"] > 0)
        return {"w": x.T @ d_hidden, "b": d_hidden.sum(0), "v": f["hidden"].T @ d_tanh, "u": f["hidden"].T @ d_gate,
                "a": (f["tanh"] * f["gate"]).T @ d_score, "o": f["pooled"].T @ d_logit, "c": d_logit.sum(0)}


class Passages:
    """Encoded passages in a temporary file; indexing by row numbers reads those rows as float32."""

    def __init__(self):
        self.file = tempfile.TemporaryFile()

    def append(self, data: bytes) -> int:
        """Number of passages added."""
        self.file.write(data)
        return len(data) // (2 * BUCKETS)

    def __getitem__(self, rows):
        import numpy as np

        self.file.flush()
        width = 2 * BUCKETS
        runs = np.split(rows, np.flatnonzero(np.diff(rows) != 1) + 1)
        data = b"".join(os.pread(self.file.fileno(), len(r) * width, int(r[0]) * width) for r in runs)
        return np.frombuffer(data, np.uint16).reshape(-1, BUCKETS).astype(np.float32) / 4096


def fit(x, bags, target, epochs: int = EPOCHS, rate: float = RATE, starts=None) -> Network:
    """``starts`` has the first row of each document in ``x``, when they do not follow each other."""
    import numpy as np

    random = np.random.default_rng(SEED)
    made = lambda *shape: (random.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    net = Network({"w": made(BUCKETS, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "v": made(HIDDEN, ATTENTION),
                   "u": made(HIDDEN, ATTENTION), "a": made(ATTENTION, 1), "o": made(HIDDEN, 1), "c": np.zeros(1, np.float32)})
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    starts = np.cumsum(bags) - bags if starts is None else starts
    step = 0
    for _ in range(epochs):
        order = random.permutation(len(bags))
        for low in range(0, len(order), 64):
            chosen = order[low : low + 64]
            rows = np.concatenate([np.arange(starts[d], starts[d] + bags[d]) for d in chosen])
            step += 1
            for k, g in net.gradients(x[rows], bags[chosen], target[chosen]).items():
                g = g + 1e-4 * net.weights[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                net.weights[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


@dataclass
class Model:
    network: Network | None
    share: float

    def score(self, texts: list[str]):
        import numpy as np

        if self.network is None:
            return np.full(len(texts), self.share)
        x, bags = encode(texts)
        return self.network.forward(x, bags)["p"].astype(float)


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on documents with a label; a hash of the id picks about ``sample_docs`` when there are more."""
    import numpy as np

    marked = labels.filter("quality is not null").groupBy(F.col("doc_id").cast("string").alias("id")).agg(
        F.avg((F.col("quality") > 0).cast("double")).alias("good"))
    known = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"))
    n = known.select("id").join(marked, "id").count()
    if n > sample_docs:
        mark = F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(1 << 30)) < F.lit(int(sample_docs / n * (1 << 30)))
        marked, known = marked.filter(mark), known.filter(mark)
    rows = known.join(marked.withColumn("good", (F.col("good") >= 0.5).cast("double")), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            x, bags = encode(texts)
            ends = np.cumsum(bags)
            data = np.round(x * 4096).clip(0, 65535).astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2),
                 pa.array([data[e - b : e].tobytes() for b, e in zip(bags, ends, strict=True)], pa.binary())], ["id", "good", "x"])

    found = keep(in_arrow(rows, run, "id string, good double, x binary"), "bags")
    x, ids, target, bags = Passages(), [], [], []
    for row in found.toLocalIterator():
        ids.append(row["id"])
        target.append(row["good"])
        bags.append(x.append(row["x"]))
    order = np.array(sorted(range(len(ids)), key=ids.__getitem__), np.int64)
    bags, target = np.array(bags, np.int64), np.array(target, np.float32)[order]
    starts, bags = (np.cumsum(bags) - bags)[order], bags[order]
    share = (float(target.sum()) + 1) / (len(target) + 2)
    if not len(target) or target.min() == target.max():
        return Model(None, share)
    return Model(fit(x, bags, target, starts=starts), share)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every document: 0 to 1, higher is better."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, chars=SLICE_CHARS // 2):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(texts), pa.float64())],
                                             ["doc_id", "score"])

    rows = docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text")
    return in_arrow(rows, run, "doc_id bigint, score double")


def keep_good(docs: DataFrame, model: Model, least: float = THRESHOLD) -> DataFrame:
    """The documents, whole rows, with a score of at least ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, chars=SLICE_CHARS // 2):
            yield batch.filter(pa.array(shared.value.score(texts) >= least))

    return in_arrow(docs, run, docs.schema)
