"""Exact nearest neighbours by cosine, without a cross join.

Few queries: their matrix is shipped to the documents (size checked first) and every batch
keeps its own best ``k``, so the documents are never shuffled.

Many queries: they are cut into blocks of bounded size. A task holds one block while a run of documents passes by in lots of bounded
size, and keeps ``k`` rows per query. The cores are shared out among the groups by their products, and each group is cut into that many
pairs of a block and a run, or a multiple, in the way that copies fewest rows. Inside a task the documents of a lot are divided among
pivots, and a query skips every part that, by the triangle inequality on angles, holds no better match. Products are taken in single
precision first, and a row of them is looked into only if its largest reaches what the query needs; what may be among the best is then
scored in double precision. Nothing is approximated.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factfold.params import DEFAULT_KNN, KnnParams
from factfold.session import keep

SCORE_PLACES = 6


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks)
    rows = len(array)
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    m = flat.reshape(rows, -1)
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _top(scores: np.ndarray, ids: np.ndarray, k: int, floor: float) -> list[tuple[int, float, object]]:
    """Best ``k`` (row, score, id) per row; ties go to the smaller id."""
    out = []
    if scores.shape[1] > 4 * k:
        cut = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
    else:
        cut = np.full(scores.shape[0], -np.inf)
    cut = np.maximum(cut, floor)
    for row in range(scores.shape[0]):
        near = np.flatnonzero((scores[row] >= cut[row]) & (scores[row] > -2.0))
        order = near[np.lexsort((ids[near], -scores[row][near]))][:k]
        out += [(row, scores[row][i], ids[i]) for i in order]
    return out


#: Queries and documents in one product, and pairs scored at once in double precision.
_ROWS, _COLUMNS, _PAIRS = 1024, 1024, 1 << 14


class _Best:
    """The best ``k`` documents of each query so far, and the score that a further one has to reach."""

    def __init__(self, queries: int, k: int, floor: float):
        self.k, self.floor = k, floor
        self.docs, self.scores = np.full((queries, k), -1, np.int64), np.full((queries, k), -np.inf)
        self.needed = np.full(queries, floor)

    def add(self, rows: np.ndarray, docs: np.ndarray, scores: np.ndarray, place_of: np.ndarray) -> None:
        """Take new candidates of the queries ``rows``; ties go to the earlier place. Only the rows of these queries are touched."""
        keep = scores >= self.needed[rows]
        if not keep.any():
            return
        asked, rows = np.unique(rows[keep], return_inverse=True)
        old, place = np.nonzero(self.docs[asked] >= 0)
        rows, docs, scores = (np.concatenate(ab) for ab in ((old, rows), (self.docs[asked[old], place], docs[keep]),
                                                            (self.scores[asked[old], place], scores[keep])))
        order = np.lexsort((place_of[docs], -scores, rows))
        rows, docs, scores = rows[order], docs[order], scores[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, np.arange(len(asked)))[rows]
        best = place < self.k
        at = asked[rows[best]], place[best]
        self.docs[at], self.scores[at] = docs[best], scores[best]
        self.needed[asked] = np.maximum(self.scores[asked, -1], self.floor)


def _kth_at_least(near: np.ndarray, k: int) -> np.ndarray:
    """For each row a value that at least ``k`` of its columns reach: the ``k``-th largest, or that of the maxima of many groups of columns."""
    groups = 8 * k
    if near.shape[1] >= 4 * groups:
        near = near[:, :near.shape[1] // groups * groups].reshape(len(near), -1, groups).max(axis=1)
    return -np.partition(-near, k - 1, axis=1)[:, k - 1]


def _set_cells(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the few cells that are set, looked for eight at a time."""
    flat = np.zeros(-(-hit.size // 8) * 8, bool)
    flat[:hit.size] = hit.ravel()
    cells = (np.flatnonzero(flat.view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.divmod(cells[flat[cells]], hit.shape[1])


def _parts(dv: np.ndarray, d_pos: np.ndarray | None, pivots: int) -> tuple[np.ndarray, list[tuple[int, int, float]], np.ndarray]:
    """Order of the documents by nearest pivot (then position), the parts as (start, end, radius), and the pivots."""
    at = np.linspace(0, len(dv) - 1, min(pivots, len(dv))).astype(np.int64)
    centres = dv[at]
    own, angle = np.zeros(len(dv), np.int64), np.zeros(len(dv))
    for low in range(0, len(dv), 8192):
        near = dv[low:low + 8192] @ centres.T
        own[low:low + 8192] = near.argmax(axis=1)
        angle[low:low + 8192] = np.arccos(np.clip(near.max(axis=1), -1.0, 1.0))
    order = np.lexsort((d_pos, own)) if d_pos is not None else np.argsort(own, kind="stable")
    ends = np.searchsorted(own[order], np.arange(len(centres) + 1))
    return order, [(a, b, angle[order[a:b]].max() if b > a else 0.0) for a, b in zip(ends[:-1], ends[1:])], centres


class _Search:
    """The best ``k`` documents of a block of queries; the documents come in one lot after the other."""

    def __init__(self, q: pa.Table, k: int, ordered: bool, floor: float, pivots: int):
        self.k, self.ordered, self.pivots = k, ordered, pivots
        self.q_ids, self.qv = q["q_id"].combine_chunks(), _matrix(q["q_vec"])
        self.q_pos = q["q_pos"].to_numpy() if ordered else None
        self.q_tag = q["q_tag"].to_numpy() if "q_tag" in q.column_names else None
        self.by_pos = np.argsort(self.q_pos, kind="stable") if ordered else np.arange(len(self.qv))
        self.q32 = self.qv.astype(np.float32)
        self.best, self.ids = _Best(len(self.qv), k, floor), None
        self.room = np.empty(_ROWS * _COLUMNS, np.float32)

    def _held_and(self, new: pa.Array) -> tuple[int, np.ndarray]:
        """Number the held documents anew, followed by the new ones; the count of the held, and the place of each in the order of ids."""
        docs = self.best.docs
        held = np.unique(docs[docs >= 0])
        self.best.docs = np.where(docs >= 0, np.searchsorted(held, docs), -1)
        self.ids = new if self.ids is None else pa.concat_arrays([self.ids.take(pa.array(held)), new])
        place = np.empty(len(self.ids), np.int64)
        place[pc.array_sort_indices(self.ids).to_numpy()] = np.arange(len(self.ids))
        return len(held), place

    def add(self, d: pa.Table) -> None:
        """Compare every query with these documents."""
        k, ordered, best, qv, q_pos, q_tag = self.k, self.ordered, self.best, self.qv, self.q_pos, self.q_tag
        held, place = self._held_and(d["d_id"].combine_chunks())
        dv = _matrix(d["d_vec"])
        d_pos, d_tag = d["d_pos"].to_numpy() if ordered else None, d["d_tag"].to_numpy() if q_tag is not None else None
        order, parts, centres = _parts(dv, d_pos, self.pivots if len(dv) > 512 else 1)
        dv = dv[order]
        d_pos, d_tag = (None if a is None else a[order] for a in (d_pos, d_tag))
        d32 = dv.astype(np.float32)
        # Twice what single precision may be off, and the rounding of scores.
        slack = 4e-7 * (dv.shape[1] + 8) + 2e-6
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def settle() -> None:
            """Score the waiting pairs in double precision."""
            rows, cols = (np.concatenate(side) for side in zip(*waiting)) if waiting else (np.zeros(0, np.int64),) * 2
            waiting.clear()
            for at in range(0, len(rows), 1 << 17):
                r, c = rows[at:at + (1 << 17)], cols[at:at + (1 << 17)]
                scores = [np.einsum("ij,ij->i", qv[r[i:i + _PAIRS]], dv[c[i:i + _PAIRS]]) for i in range(0, len(r), _PAIRS)]
                best.add(r, order[c] + held, np.round(np.concatenate(scores), SCORE_PLACES), place)

        def compare(mine: np.ndarray, asked: np.ndarray, low: int, high: int) -> None:
            """Queries ``mine``, whose vectors are ``asked``, with the documents from ``low`` to ``high``."""
            near = np.matmul(asked, d32[low:high].T, out=self.room[:len(mine) * (high - low)].reshape(len(mine), -1))
            needed = (best.needed[mine] - slack).astype(np.float32)
            # Once a query has its first documents, few further ones are near enough: most rows end here. Not a number is not below.
            some = np.flatnonzero(~(near.max(axis=1) < needed))
            if not len(some):
                return
            if len(some) < len(mine):
                mine, near, needed = mine[some], near[some], needed[some]
            hit = near >= needed[:, None]
            if ordered and d_pos[low:high].max() >= q_pos[mine].min():
                hit &= d_pos[None, low:high] < q_pos[mine, None]
            if q_tag is not None:
                hit &= d_tag[None, low:high] != q_tag[mine, None]
            if np.count_nonzero(hit) > 4 * k * len(mine) and high - low > k:
                near[~hit] = -np.inf
                hit = (near >= (_kth_at_least(near, k) - slack)[:, None]) & (near > -np.inf)
            row, col = _set_cells(hit)
            waiting.append((mine[row], col + low))

        for at in range(0, len(qv), _ROWS):
            chunk = self.by_pos[at:at + _ROWS]
            to_centre = qv[chunk] @ centres.T
            own, angle = to_centre.argmax(axis=1), np.arccos(np.clip(to_centre, -1.0, 1.0))
            for turn in ("own part", "the others"):
                for n, (low, high, radius) in enumerate(parts):
                    if ordered:
                        high = low + int(np.searchsorted(d_pos[low:high], q_pos[chunk[-1]]))
                    if high == low:
                        continue
                    reach = np.cos(np.maximum(0.0, angle[:, n] - radius)) >= best.needed[chunk] - 2e-6
                    mine = chunk[((own == n) if turn == "own part" else (own != n)) & reach]
                    if not len(mine):
                        continue
                    asked = self.q32[mine]
                    for d_at in range(low, high, _COLUMNS):
                        compare(mine, asked, d_at, min(high, d_at + _COLUMNS))
                        # Pairs wait until they are as many as those that are held: sorting costs less, and the bar is seldom much too low.
                        if sum(len(rows) for rows, _ in waiting) >= k * len(mine):
                            settle()
                settle()

    def found(self) -> tuple[pa.Array, pa.Array, np.ndarray]:
        rows, place = np.nonzero(self.best.docs >= 0)
        return self.q_ids.take(pa.array(rows)), self.ids.take(pa.array(self.best.docs[rows, place])), self.best.scores[rows, place]


def _rank(pairs: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    best = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("d_id"))
    return pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


#: Blocks a group is cut into on each side, and the bytes of the vectors of a block, beyond which there are more blocks.
_BLOCKS, _BLOCK_BYTES = 6, 64 << 20


def fanout(rows: Column, width: Column, block_rows: int) -> Column:
    """Number of blocks: one while all fit into ``block_rows``, then few and large ones."""
    least = F.ceil(rows.cast("bigint") * F.coalesce(width, F.lit(1)) * 8 / F.lit(_BLOCK_BYTES))
    return F.greatest(F.lit(1), least, F.least(F.lit(_BLOCKS), F.ceil(rows / F.lit(block_rows)))).cast("int")


def block_counts(docs: Column, queries: Column, width: Column, tasks: Column, block_rows: int) -> tuple[Column, Column]:
    """Blocks of documents and of queries of a group that ``tasks`` tasks share; a document is sent once per block of queries."""
    def bounds(rows: Column) -> tuple[Column, Column]:
        least = F.ceil(rows.cast("bigint") * F.coalesce(width, F.lit(1)) * 8 / F.lit(_BLOCK_BYTES))
        return F.greatest(F.lit(1), least), F.greatest(F.lit(1), F.ceil(rows / F.lit(block_rows)))

    (least_d, most_d), (least_q, most_q) = bounds(docs), bounds(queries)
    by_ratio = F.round(F.sqrt(tasks * queries / docs))
    query_blocks = F.greatest(least_q, F.least(most_q, F.greatest(F.lit(1), by_ratio)))
    doc_blocks = F.greatest(least_d, F.least(most_d, F.ceil(tasks / query_blocks)))
    return doc_blocks.cast("int"), query_blocks.cast("int")


def task_grid(docs: Column, queries: Column, width: Column, tasks: Column, block_rows: int) -> tuple[Column, Column]:
    """Runs of documents and blocks of queries of a group, a task for each pair.

    A task holds one block of queries while its documents pass, so only these blocks are bounded. Of the grids that keep nine tenths of
    ``tasks`` busy to the end it is the one that copies fewest rows.
    """
    most = F.greatest(F.lit(1), F.ceil(docs / F.lit(block_rows))).cast("int")
    least = block_counts(docs, queries, width, tasks, block_rows)[1]

    def run_counts(blocks: Column) -> Column:
        fewest = F.ceil(tasks / blocks).cast("int")
        counts = F.sequence(F.least(most, fewest), F.least(most, F.greatest(fewest, tasks.cast("int"))))
        grids = F.transform(counts, lambda runs: F.struct(
            (blocks * runs < 0.9 * tasks * F.ceil(blocks * runs / tasks)).alias("uneven"), (docs * blocks + queries * runs).alias("copies"),
            runs.alias("runs"), blocks.alias("blocks")))
        return F.array_min(grids)

    best = F.array_min(F.transform(F.sequence(least, 2 * least), run_counts))
    return best["runs"], best["blocks"]


def _multiply_blocks(queries: DataFrame, docs: DataFrame, cells: Sequence[str], k: int, ordered: bool,
                     floor: float, params: KnnParams) -> DataFrame:
    """Best ``k`` per query and run of documents, for queries and documents that share ``cells``."""
    spark = docs.sparkSession
    cores = spark.sparkContext.defaultParallelism
    sizes = keep(docs.groupBy(*cells).agg(F.count(F.lit(1)).alias("_nd"), F.max(F.size("d_vec")).alias("_w"))
                 .join(queries.groupBy(*cells).agg(F.count(F.lit(1)).alias("_nq")), list(cells)), "groups")
    products = F.col("_nd").cast("double") * F.col("_nq")
    share = products / F.lit(sizes.agg(F.sum(products)).first()[0] or 1.0)
    runs, blocks = task_grid(F.col("_nd"), F.col("_nq"), F.col("_w"), F.ceil(share * F.lit(cores)), params.block_rows)
    # Kept, so that Spark knows how small it is and does not shuffle the vectors for it.
    plan = keep(sizes.select(*cells, runs.alias("_runs"), blocks.alias("_blocks")), "grid")
    groups, pairs = plan.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("_runs").cast("bigint") * F.col("_blocks")), F.lit(1))).first()
    # The pairs of a group go to partitions in a row, so that none waits behind another of its group.
    partitions = pairs if groups == 1 else min(8 * pairs, max(4 * cores, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    used = ["id", "vec", *(["pos"] if ordered else []), *(["tag"] if "q_tag" in queries.columns else [])]
    q_names, d_names = ([f"{side}_{c}" for c in used] for side in ("q", "d"))

    def mine(name: str, n: str) -> Column:
        return F.pmod(F.xxhash64(name), F.col(n)).cast("int")

    def all_of(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    q = (queries.select(*cells, *q_names).join(plan, list(cells)).withColumn("_block", mine("q_id", "_blocks")).withColumn("_run", all_of("_runs"))
         .withColumn("_doc", F.lit(False)))
    d = (docs.select(*cells, *d_names).join(plan, list(cells)).withColumn("_run", mine("d_id", "_runs")).withColumn("_block", all_of("_blocks"))
         .withColumn("_doc", F.lit(True)))
    both = (q.unionByName(d, allowMissingColumns=True).withColumn("_pair", F.col("_block") * F.col("_runs") + F.col("_run"))
            .withColumn("_part", ((F.pmod(F.xxhash64(*cells), F.lit(partitions)) + F.col("_pair")) % partitions).cast("int"))
            .drop("_block", "_run", "_blocks", "_runs"))
    keys = ["_part", *cells, "_pair"]
    types = {f.name: f.dataType for f in both.schema.fields}
    schema = ", ".join(f"`{c}` {types[c].simpleString()}" for c in (*cells, "q_id", "d_id")) + ", score double"

    def multiply(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, lot, search, rows, full = [], [], None, 0, 0
        for batch in batches:
            first = batch.num_rows - (pc.sum(batch.column("_doc")).as_py() or 0)  # queries come first
            if first:
                asked.append(batch.slice(0, first).select(q_names))
            if first == batch.num_rows or not asked and search is None:
                continue
            lot.append(batch.slice(first).select(d_names))
            rows += lot[-1].num_rows
            full = full or _BLOCK_BYTES // (8 * max(1, len(lot[0].column("d_vec")[0])))
            if search is None:
                search = _Search(pa.Table.from_batches(asked), k, ordered, floor, params.pivots)
                asked.clear()
            if rows >= full:
                search.add(pa.Table.from_batches(lot))
                lot, rows = [], 0
        if lot:
            search.add(pa.Table.from_batches(lot))
        if search is not None:
            q_ids, d_ids, scores = search.found()
            columns = [pa.array([key[1 + i].as_py()] * len(q_ids), key[1 + i].type) for i in range(len(cells))]
            yield pa.RecordBatch.from_arrays([*columns, q_ids, d_ids, pa.array(scores, pa.float64())], names=[*cells, "q_id", "d_id", "score"])

    return (both.repartitionById(partitions, "_part").sortWithinPartitions(*keys, "_doc")
            .groupBy(*keys).applyInArrow(multiply, schema))


def _broadcast_queries(queries: DataFrame, docs: DataFrame, k: int, floor: float) -> DataFrame:
    held = queries.select("q_id", "q_vec").toArrow()
    qv, q_ids = _matrix(held["q_vec"]), held["q_id"]
    schema = (f"q_id {queries.schema['q_id'].dataType.simpleString()}, "
              f"d_id {docs.schema['d_id'].dataType.simpleString()}, score double")

    def scan(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            dv = _matrix(batch.column(batch.schema.get_field_index("d_vec")))
            ids = batch.column(batch.schema.get_field_index("d_id"))
            found = _top(np.round(qv @ dv.T, SCORE_PLACES), ids.to_numpy(zero_copy_only=False), k, floor)
            if found:
                rows, scores, docs_found = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [q_ids.take(pa.array(rows)).combine_chunks(), pa.array(docs_found, ids.type),
                     pa.array(scores, pa.float64())], names=["q_id", "d_id", "score"])

    return docs.select("d_id", "d_vec").mapInArrow(scan, schema)


def nearest(queries: DataFrame, docs: DataFrame, k: int, by: Sequence[str] = (), earlier_only: bool = False,
            min_score: float = -1.0, params: KnnParams = DEFAULT_KNN) -> DataFrame:
    """The ``k`` nearest documents of each query: ``q_id, [by], d_id, score, rank``.

    ``queries``: q_id, q_vec, [by], and q_pos when ``earlier_only``; ``docs``: d_id, d_vec, [by],
    d_pos. Ids are unique non-null numbers or strings. Scores are cosines rounded to six places,
    ties go to the smaller id, and ``earlier_only`` keeps documents with ``d_pos < q_pos``. With the numbers
    ``q_tag`` and ``d_tag``, only documents of another tag count.
    """
    q, d = queries.filter(F.col("q_vec").isNotNull()), docs.filter(F.col("d_vec").isNotNull())
    if not by and not earlier_only and "q_tag" not in q.columns:
        held = q.limit(params.broadcast_rows + 1).count()
        if held == 0:
            return q.join(d.limit(0), F.lit(False)).select(
                "q_id", "d_id", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
        if held <= params.broadcast_rows:
            return _rank(_broadcast_queries(q, d, k, min_score), ["q_id"], k)
    keys = list(by)
    if not keys:
        keys = ["_all"]
        q, d = q.withColumn("_all", F.lit(0)), d.withColumn("_all", F.lit(0))
    pairs = _multiply_blocks(q, d, keys, k, earlier_only, min_score, params)
    return _rank(pairs.select(*keys, "q_id", "d_id", "score"), [*keys, "q_id"], k).select(
        *by, "q_id", "d_id", "score", "rank")
