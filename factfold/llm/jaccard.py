"""Documents linked by the Jaccard similarity of their word shingles, with several token orders as filters.

1. Every text becomes a set of shingle hashes; equal sets are one class. Classes are told apart by 64 bits of a
   hash of the whole set, tokens by 48 bits of their hash.
2. Tokens go to buckets in packed, sorted runs. A bucket learns in how many documents each of its tokens stands
   and answers every class with its shared tokens and their frequency level. Tokens that many documents of one
   run share are answered on the spot and travel once per run, so a token of a third of all documents
   costs its bucket one entry per run.
3. Three global orders put unshared tokens first. Then the first goes by frequency level and hash, the other two
   by other hashes. A class whose prefix has no shared token cannot link to anything and is dropped.
4. Prefix tokens of the first order are joined on token and length band, with the length and position bounds in the
   join. Pairs must also share prefix tokens under both other orders. Survivors are verified on
   their shared tokens.
5. First each class meets only a pivot of its buckets and bands, a text with few unshared tokens; components are
   contracted, and further pivots follow while many pairs are open. Then the pairs that still lie in different
   components are joined in full. So a group of copies costs its size and not its square, and no link between
   components is lost.

Cases: null and empty texts and texts without words have the empty set and link to nothing; fewer words than a
shingle make one shingle of the whole; repeated rows and ids are members like all others; other columns are ignored;
an empty table gives an empty result. Similarity equal to the threshold links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factfold.llm.common import SLICE_CHARS, WordHashes, in_arrow, keep, mix64, only, release, slices

WORDS, THRESHOLD = 4, Fraction(85, 100)
#: Tokens of a bucket, about; documents of a run that make a token common there.
BUCKET_TOKENS, COMMON = 1_200_000, 32
COMMON_LEVEL = 255
BAND = math.log(1.04)
#: Pivots of a bucket and band that have been met after each round; a round is left out when few pairs are open.
TURNS = (1, 4, 16)
HASHES = WordHashes()


def shingle_sets(texts: list[str], words: int = WORDS) -> list:
    """Sorted distinct shingle hashes (uint64) of every text."""
    import numpy as np

    only("jaccard", HASHES.clear)
    out = []
    factors = mix64(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    for text in texts:
        split = text.encode().lower().split()
        codes = np.fromiter(map(HASHES.__getitem__, split), np.uint64, len(split))
        if not len(codes):
            out.append(codes)
            continue
        size = min(words, len(codes))
        mixed = np.full(len(codes) - size + 1, size, np.uint64)
        for k in range(size):
            mixed = mix64(mixed ^ (codes[k : len(codes) - size + 1 + k] * factors[k]))
        out.append(np.unique(mixed))
    return out


def forget() -> None:
    """End of a task: other stages of the job need the memory more than the next task needs the words."""
    HASHES.clear()
    release()


def set_key(tokens) -> int:
    """64 bits that stand for the whole set, as a signed number."""
    import xxhash

    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def pack(numbers) -> bytes:
    """Unsigned numbers as compressed byte planes."""
    import numpy as np

    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return len(numbers).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes):
    import numpy as np

    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u8").astype(np.uint64)


def sets_of(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, text_hash, n, class`` of every document."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            sets = shingle_sets(texts, words)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(np.array([set_key(s) for s in sets], np.int64))], ["doc_id", "text_hash", "n", "class"])
        forget()

    rows = docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text", "xxhash64(text) as text_hash")
    return in_arrow(rows, run, "doc_id bigint, text_hash bigint, n bigint, class bigint")


def _prefix(n, threshold: Fraction):
    """Length of the prefix in which two sets of at least the threshold must meet, if one has ``n`` tokens."""
    a, b = threshold.numerator, threshold.denominator
    return n - (a * n + b - 1) // b + 1


def shared_tokens(docs: DataFrame, buckets: int, words: int = WORDS, threshold: Fraction = THRESHOLD) -> DataFrame:
    """``class, n, unshared, tokens``: shared tokens, in the first order, of classes that may link to another."""
    import numpy as np

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, texts in slices(batches, chars=2 * SLICE_CHARS):
            sets, classes = [], []
            for s in shingle_sets(texts, words):
                key = set_key(s)
                if len(s) and key not in seen:
                    seen.add(key)
                    sets.append(s)
                    classes.append(key)
            if not sets:
                continue
            sizes = np.array([len(s) for s in sets], np.int64)
            keys = np.array(classes, np.int64)
            tokens = np.concatenate(sets) >> np.uint64(16)
            refs = np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(tokens, kind="stable")
            tokens, refs = tokens[order], refs[order]
            head = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
            count = np.diff(np.append(head, len(tokens)))
            common = np.repeat(count >= max(COMMON, len(sets) // 16), count)
            out: list[tuple] = []
            if common.any():  # answered here, and made known to the bucket by one entry without a class
                for part in np.array_split(np.flatnonzero(common), min(buckets, 1 + int(common.sum()) // 100_000)):
                    out.append((int(keys[refs[part[0]]] % buckets), True, *_columns(tokens[part], refs[part], keys, sizes)))
                first = common[head]
                tokens = np.concatenate((tokens[~common], tokens[head[first]]))
                refs = np.concatenate((refs[~common], np.full(int(first.sum()), -1)))
                order = np.argsort(tokens, kind="stable")
                tokens, refs = tokens[order], refs[order]
            bucket = (tokens >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)
            edges = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
            for b, low, high in zip(range(buckets), edges, edges[1:], strict=False):
                if high > low:
                    out.append((b, False, *_columns(tokens[low:high], refs[low:high], keys, sizes)))
            for at in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out[at : at + 64], strict=True),
                                                    (pa.int32(), pa.bool_(), *[pa.binary()] * 4), strict=True)],
                    ["bucket", "common", "tokens", "refs", "classes", "sizes"])
        forget()

    def answers(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        parts = [(unpack(r["tokens"]), unpack(r["refs"]).astype(np.int32) - 1, r["common"]) for r in rows]
        asked = [t for t, _, c in parts if not c]
        names, count = np.unique(np.concatenate(asked), return_counts=True) if asked else (np.zeros(0, np.uint64), None)
        level = np.minimum(COMMON_LEVEL - 1, count).astype(np.uint8) if asked else np.zeros(0, np.uint8)
        del asked
        for t, ref, c in parts:
            if not c:
                level[np.searchsorted(names, t[ref < 0])] = COMMON_LEVEL
        found = []
        for (t, ref, c), r in zip(parts, rows, strict=True):
            own = np.full(len(t), COMMON_LEVEL, np.uint8) if c else level[np.searchsorted(names, t)]
            kept = (own > 1) & (ref >= 0)
            classes, sizes = unpack(r["classes"]).view(np.int64), unpack(r["sizes"]).astype(np.int64)
            found.append((classes[ref[kept]], sizes[ref[kept]], own[kept], t[kept]))
        del parts
        classes, sizes, levels, tokens = (np.concatenate(c) for c in zip(*found, strict=True))
        del found
        to = (classes.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        order = np.lexsort((classes, to))
        edges = np.searchsorted(to[order], np.arange(buckets + 1, dtype=np.uint64))
        out = [(b, pack(classes[o].view(np.uint64)), pack(sizes[o]), pack(levels[o]), pack(tokens[o]))
               for b, low, high in zip(range(buckets), edges, edges[1:], strict=False) if high > low
               for o in (order[low:high],)]
        release()
        return pa.table({k: pa.array([r[i] for r in out], pa.int32() if i == 0 else pa.binary())
                         for i, k in enumerate(("home", "classes", "sizes", "levels", "tokens"))})

    def gather(key: tuple, table: pa.Table) -> pa.Table:
        classes, sizes, levels, tokens = (
            np.concatenate([unpack(d) for d in table[c].to_pylist()]) for c in ("classes", "sizes", "levels", "tokens"))
        classes, sizes = classes.view(np.int64), sizes.astype(np.int64)
        order = np.lexsort((tokens, levels, classes))
        classes, sizes, tokens = classes[order], sizes[order], tokens[order]
        same = np.concatenate(([False], (classes[1:] == classes[:-1]) & (tokens[1:] == tokens[:-1])))  # copies in other tasks
        classes, sizes, tokens = classes[~same], sizes[~same], tokens[~same]
        head = np.flatnonzero(np.concatenate(([True], classes[1:] != classes[:-1])))
        shared = np.diff(np.append(head, len(classes)))
        n = sizes[head]
        alone = n - shared
        linked = _prefix(n, threshold) > alone
        head, shared, n, alone = head[linked], shared[linked], n[linked], alone[linked]
        values = np.concatenate([tokens[h : h + s] for h, s in zip(head, shared, strict=True)] or [tokens[:0]]).astype(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(shared))), pa.int32()), pa.array(values))
        return pa.table({"class": classes[head], "n": n, "unshared": alone, "tokens": lists})

    rows = docs.select(F.col("text").cast("string").alias("text"))
    packed = in_arrow(rows, runs, "bucket int, common boolean, tokens binary, refs binary, classes binary, sizes binary")
    replies = packed.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(
        answers, "home int, classes binary, sizes binary, levels binary, tokens binary")
    return replies.repartition(buckets, "home").groupBy("home").applyInArrow(
        gather, "class bigint, n bigint, unshared bigint, tokens array<bigint>")


def _columns(tokens, refs, keys, sizes) -> tuple[bytes, bytes, bytes, bytes]:
    """A packed run: tokens, references (0: none) into the classes that occur, these and their set sizes."""
    import numpy as np

    used, local = np.unique(refs, return_inverse=True)
    if len(used) and used[0] < 0:
        used = used[1:]
    else:
        local = local + 1
    return pack(tokens), pack(local), pack(keys[used].view(np.uint64)), pack(sizes[used])


def _other_orders(shared: DataFrame, threshold: Fraction) -> DataFrame:
    """``class, second, third``: prefix tokens under the two other orders, as their mixed values."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, alone = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            columns = [batch.column(0)]
            for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
                columns.append(pa.array([
                    np.sort(mix64(t.values.to_numpy().astype(np.uint64) ^ np.uint64(salt)))[: int(_prefix(int(a), threshold)) - int(b)].view(np.int64)
                    for a, b, t in zip(n, alone, batch.column(3), strict=True)], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, ["class", "second", "third"])

    return in_arrow(shared, run, "class bigint, second array<bigint>, third array<bigint>")


def verified(pairs: DataFrame, shared: DataFrame, orders: DataFrame, threshold: Fraction) -> DataFrame:
    """The pairs ``a, b`` that pass the other orders and reach the threshold."""
    import numpy as np

    low, high = threshold.numerator, threshold.denominator
    first = orders.select(F.col("class").alias("a"), F.col("second").alias("a2"), F.col("third").alias("a3"))
    second = orders.select(F.col("class").alias("b"), F.col("second").alias("b2"), F.col("third").alias("b3"))
    passed = pairs.join(first, "a").join(second, "b").filter(
        F.arrays_overlap("a2", "b2") & F.arrays_overlap("a3", "b3")).select("a", "b")
    left = shared.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = shared.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            both = np.array([len(np.intersect1d(x.values.to_numpy(), y.values.to_numpy(), assume_unique=True))
                             for x, y in zip(batch.column(3), batch.column(5), strict=True)], np.int64)
            yield batch.select([0, 1]).filter(pa.array(high * both >= low * (na + nb - both)))

    rows = passed.join(left, "a").join(right, "b").select("a", "b", "na", "ta", "nb", "tb")
    return in_arrow(rows, run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node) by alternating large and small stars until nothing changes."""
    edges = keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(
                    F.min("component").alias("component"))
        state = now
        both = edges.union(edges.select("v", "u"))
        smallest = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(smallest, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = keep(small.union(smallest).distinct(), "edges")


def link_classes(shared: DataFrame, threshold: Fraction = THRESHOLD) -> DataFrame:
    """``class, component`` of every class that links to another."""
    a, b = threshold.numerator, threshold.denominator
    orders = keep(_other_orders(shared, threshold), "orders")
    prefix = F.expr(f"n - (({a} * n + {b - 1}) div {b}) + 1 - unshared").cast("int")
    tokens = keep(shared.select("class", "n", F.posexplode(F.slice("tokens", F.lit(1), prefix)).alias("at", "token"), "unshared").select(
        "class", "n", "unshared", "token", (F.col("unshared") + F.col("at") + 1).alias("at"),
        F.floor(F.log("n") / BAND).cast("int").alias("band")), "prefixes")
    # The longer text probes: what it can still share from this position bounds the length of its partner.
    ratio = a / (a + b)
    most = F.least(F.col("n").cast("double"), (F.col("n") - F.col("at") + 1) / ratio - F.col("n") + 1e-6)
    least = F.col("n") * (a / b) - 1e-6
    probe = tokens.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("at").alias("ia"), "token",
                          most.alias("most"), least.alias("least")).filter("most >= least and most >= 1").withColumn(
        "band", F.explode(F.sequence(F.floor(F.log(F.greatest("least", F.lit(1.0))) / BAND).cast("int"),
                                     F.floor(F.log("most") / BAND).cast("int"))))
    index = tokens.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("at").alias("ib"), "token", "band")
    fits = F.expr(f"nb <= most and nb >= least and (nb < na or b < a) and b <> a and "
                  f"{a + b} * (1 + least(na - ia, nb - ib)) >= {a} * (na + nb)")

    # Texts with few unshared tokens are likely hubs of their group; the best few of each bucket and band are pivots.
    by_share = Window.partitionBy("token", "band").orderBy((F.col("ib0") / F.col("nb")), "b")
    hubs = tokens.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("at").alias("ib"), "token", "band", F.col("unshared").alias("ib0"))
    pivots = keep(hubs.withColumn("turn", F.row_number().over(by_share)).filter(F.col("turn") <= TURNS[-1]).drop("ib0"), "pivots")
    near = F.expr(f"nb <= most and nb >= least and b <> a and {a + b} * (1 + least(na - ia, nb - ib)) >= {a} * (na + nb)")
    rows = tokens.count()
    group = lambda side, found: found.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    links, found = None, None
    for low, high in zip((0, *TURNS), TURNS, strict=False):
        asking, asked = probe, pivots.filter((F.col("turn") > low) & (F.col("turn") <= high))
        if found is not None:
            asking = asking.join(group("a", found), "a", "left").withColumn("ca", F.coalesce("ca", "a"))
            asked = asked.join(group("b", found), "b", "left").withColumn("cb", F.coalesce("cb", "b"))
        pairs = asking.join(asked, ["token", "band"]).filter(near if found is None else near & F.expr("ca <> cb"))
        more = verified(keep(pairs.select("a", "b").distinct(), "pairs"), shared, orders, threshold)
        links = keep(more if links is None else links.union(more), "links")
        found = keep(components(links), "components")
        marked = keep(index.join(group("b", found), "b", "left").withColumn("cb", F.coalesce("cb", "b")), "marked")
        sizes = marked.groupBy("token", "band", "cb").agg(F.count("*").cast("double").alias("c")).groupBy("token", "band").agg(
            F.min("cb").alias("low"), F.max("cb").alias("high"), (F.pow(F.sum("c"), F.lit(2.0)) - F.sum(F.col("c") * F.col("c"))).alias("left"))
        if (sizes.agg(F.sum("left")).first()[0] or 0) <= rows:
            break

    asking = probe.join(group("a", found), "a", "left").withColumn("ca", F.coalesce("ca", "a"))
    asking = asking.join(sizes.select("token", "band", "low", "high"), ["token", "band"]).filter("low <> high or low <> ca").drop("low", "high")
    second = asking.join(marked, ["token", "band"]).filter(fits & F.expr("ca <> cb"))
    more = verified(keep(second.select("a", "b").distinct(), "pairs"), shared, orders, threshold)
    return components(links.union(more)).select(F.col("node").alias("class"), "component")


def link_documents(docs: DataFrame, words: int = WORDS, threshold: Fraction = THRESHOLD) -> DataFrame:
    """``doc_id, text_hash, component, n_shingles, component_id`` (the smallest document reachable by links) of every
    document; ``component`` tells groups apart even where ids repeat."""
    spark = docs.sparkSession
    sets = keep(sets_of(docs, words), "sets")
    total = sets.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_TOKENS))
    shared = keep(shared_tokens(docs, buckets, words, threshold), "shared")
    linked = keep(link_classes(shared, threshold), "linked")
    least = sets.filter("n > 0").groupBy("class").agg(F.min("doc_id").alias("smallest"))
    named = least.join(linked, "class", "left").withColumn("component", F.coalesce("component", "class"))
    ids = named.join(named.groupBy("component").agg(F.min("smallest").alias("component_id")), "component").select("class", "component", "component_id")
    columns = ["doc_id", "text_hash", "component", F.col("n").alias("n_shingles"), "component_id"]
    return sets.filter("n > 0").join(ids, "class").select(columns).union(
        sets.filter("n = 0").withColumns({"component": F.lit(None).cast("bigint"), "component_id": F.col("doc_id")}).select(columns))


def keep_first(docs: DataFrame, words: int = WORDS, threshold: Fraction = THRESHOLD) -> DataFrame:
    """The documents, whole rows, that come first in their component, by id and then by a hash of the text.

    Documents without words all stay. Rows that agree in id and text count as one; a null id is the smallest.
    """
    own = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))), "__hash": F.xxhash64("text")})
    rows = keep(link_documents(own.select(F.col("__id").alias("doc_id"), "text"), words, threshold), "rows")
    first = rows.filter("n_shingles > 0").groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("f")).select("f.*").union(
        rows.filter("n_shingles = 0").select("doc_id", "text_hash"))
    first = first.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    return own.join(first, ["__id", "__hash"], "left_semi").dropDuplicates(["__id", "__hash"]).select(docs.columns)
