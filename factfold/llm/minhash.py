"""One-permutation MinHash fingerprints of texts, in DataFrame functions only.

The shingles (five words) are hashed once; the upper bits of a hash name one of ``BINS`` bins, which keeps its smallest
hash. An empty bin takes the value of the first filled bin on its own fixed walk through all bins. The lowest
``BITS`` bits of every bin are packed into a hex string. Likeness is the share of equal bins, corrected for equality by
chance.

A text's neighbour is the document with the next smaller id (after the smallest: the largest); rows of one id
are ordered by the hash of their text. Neighbours are found on ids alone, in ranges; then every document's text is
joined with the head of its neighbour's. Texts are shuffled by id once and the heads once.

Cases: null is the empty text; texts without words have the empty fingerprint, like each other (1) and unlike all others
(0); fewer words than a shingle are one shingle; repeated rows have the same neighbour; rows with a null
id have no neighbour, so their edited text ends early and ``near_next`` is null; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from factfold.llm.common import below, keep, range_cuts

WORDS, BINS, BITS = 5, 256, 4
#: Ids in a range, about.
RANGE = 200_000


def _walk(salt: int) -> list[int]:
    """A number per bin, from a linear congruence."""
    x, out = salt, []
    for _ in range(BINS):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append((x >> 33) % BINS)
    return out


STARTS, STEPS = _walk(11), [s | 1 for s in _walk(29)]


def _bin(x: Column) -> Column:
    return F.shiftright(x, 64 - (BINS.bit_length() - 1)).cast("int") + BINS // 2


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the fingerprint of a text column. Each step is a column of its own, as a lambda would evaluate an
    expression from outside once per element."""
    bared, words, hashes, firsts, filled = (f"__{out}_{s}" for s in ("bared", "words", "hashes", "firsts", "filled"))
    bare = F.regexp_replace(F.col(text), "^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$", "")
    df = df.withColumn(bared, bare)
    df = df.withColumn(words, F.when(F.col(bared) == "", F.array().cast("array<string>")).otherwise(F.split(F.col(bared), "[ \\t\\n\\x0B\\f\\r]+")))
    w = F.col(words)
    shingle = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WORDS)])
    df = df.withColumn(hashes, F.when(F.size(w) >= WORDS, F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - WORDS), shingle)))
                       .when(F.size(w) > 0, F.array(F.xxhash64(F.concat_ws(" ", w)))))
    h = F.col(hashes)
    df = df.withColumn(firsts, F.filter(h, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(h, i - 1)))))
    f = F.col(firsts)
    gap = lambda x, i: F.array_repeat(F.lit(None).cast("bigint"), _bin(x) - F.coalesce(_bin(F.get(f, i - 1)) + 1, F.lit(0)))
    df = df.withColumn(filled, F.flatten(F.transform(f, lambda x, i: F.concat(gap(x, i), F.array(x)))))
    v = F.col(filled)
    starts, steps = F.lit(STARTS), F.lit(STEPS)

    def value(b: Column) -> Column:
        walk = F.aggregate(F.sequence(F.lit(0), F.lit(BINS - 1)), F.lit(None).cast("bigint"), lambda found, a: F.coalesce(
            found, F.get(v, (F.get(starts, b) + a * F.get(steps, b)) % BINS)))
        return F.lower(F.hex(F.coalesce(F.get(v, b), walk).bitwiseAND((1 << BITS) - 1)))

    packed = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), value), "")
    return df.withColumn(out, F.when(F.size(w) > 0, packed).otherwise("")).drop(bared, words, hashes, firsts, filled)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, from two fingerprints; null with a null."""
    same = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when((x == y) & (x != ""), 1).otherwise(0)),
                       F.lit(0), lambda n, x: n + x)
    chance = 1 / (1 << BITS)
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when((a == "") | (b == ""), (a == b).cast("double")).otherwise(
        F.greatest(F.lit(0.0), (same / BINS - chance) / (1 - chance)))


def neighbours(texts: DataFrame, ids_per_range: int = RANGE) -> DataFrame:
    """``doc_id, hash, next_id, next_hash, n_chars`` of every distinct id and text hash with an id."""
    ids = keep(texts.filter("doc_id is not null").select("doc_id", "hash", F.length("text").alias("n_chars")).distinct(), "ids")
    parts = max(int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-ids.count() // ids_per_range))
    # Kept, so that no join below can infer a filter from how the range was computed.
    ranged = keep(ids.withColumn("part", below(range_cuts(ids, "doc_id", parts), F.col("doc_id"))), "ranges")
    heads = ranged.groupBy("part").agg(F.max(F.struct("doc_id", "hash")).alias("head"))
    top = heads.agg(F.max("head").alias("top"))
    after = heads.withColumn("after", F.lag("head").over(Window.orderBy("part"))).crossJoin(top).select(
        "part", F.coalesce("after", "top").alias("after"))
    order = Window.partitionBy("part").orderBy(F.desc("doc_id"), F.desc("hash"))
    placed = ranged.withColumn("next", F.lead(F.struct("doc_id", "hash")).over(order)).join(after, "part")
    following = F.coalesce("next", "after")
    return placed.select("doc_id", "hash", following["doc_id"].alias("next_id"), following["hash"].alias("next_hash"), "n_chars")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that to the next document's."""
    # A cast that does nothing would leave an alias on one side only, and the exchange below would not be shared.
    own = F.col("doc_id") if docs.schema["doc_id"].dataType == LongType() else F.col("doc_id").cast("bigint").alias("doc_id")
    texts = docs.select(own, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("hash", F.xxhash64("text"))
    links = keep(neighbours(texts), "neighbours")
    nameless = texts.filter("doc_id is null").withColumn("head", F.lit(None).cast("string"))
    # One exchange for both uses below: the same filter and the same columns on either side make it one.
    texts = texts.filter("doc_id is not null").repartition("doc_id", "hash")
    once = texts.groupBy("doc_id", "hash").agg(F.first("text").alias("text"))
    heads = links.select(F.col("next_id").alias("doc_id"), F.col("next_hash").alias("hash"), F.col("doc_id").alias("to_id"),
                         F.col("hash").alias("to_hash"), F.floor(F.col("n_chars") / 3).cast("int").alias("k"))
    heads = heads.join(once, ["doc_id", "hash"]).select(
        F.col("to_id").alias("doc_id"), F.col("to_hash").alias("hash"), F.expr("substring(text, 1, k)").alias("head"))
    edited = F.expr("concat(substring(text, 1, length(text) - cast(floor(length(text) / 3) as int)), coalesce(head, ''))")
    rows = texts.join(heads, ["doc_id", "hash"], "left").select("doc_id", "hash", "text", "head").unionByName(nameless)
    rows = rows.select("doc_id", "hash", "text", edited.alias("edited"))
    made = with_fingerprint(with_fingerprint(rows, "text", "fingerprint"), "edited", "edited_fingerprint")
    made = keep(made.select("doc_id", "hash", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                            "fingerprint", "edited_fingerprint"), "fingerprints")
    own = made.groupBy(F.col("doc_id").alias("next_id"), F.col("hash").alias("next_hash")).agg(F.first("fingerprint").alias("next_fingerprint"))
    following = links.join(own, ["next_id", "next_hash"]).select("doc_id", "hash", "next_fingerprint")
    return made.join(following, ["doc_id", "hash"], "left").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
