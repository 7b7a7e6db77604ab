"""Value clusters: reports of one key that say the same thing in other words.

A report joins the first founder, in hub order, that it does not contradict and whose vector is
near enough; else it founds a cluster. Two values that contradict each other never share a
cluster, so each (key, numbers, polarity) is a problem of its own, and equal reports always get
equal answers, so only distinct (value, vector) pairs are worked on. What is left of a large
group is handled in rounds: founders are found among the earliest undecided pairs (a bounded
number), then every undecided pair is compared with the new founders in parallel.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factfold.functions.ids import cluster_id
from factfold.functions.text import claim_signature
from factfold.operators.fold import KEY
from factfold.operators.knn import fanout
from factfold.session import keep

NEAR = 0.86
_GROUP = [KEY, "_sig"]
_STATE = "_pid string, _first bigint, value string, vec array<double>"


def _matcher(rows: pa.Table, founders: pa.Table, near: float):
    """Function of a run of rows: matrix of whether each row and founder say the same.

    Vectors of one length are compared by one matrix product; a row or founder without a vector is compared by value.
    """
    def columns(table: pa.Table):
        values = table["value"].to_numpy(zero_copy_only=False)
        codes = pc.list_value_length(table["vec"]).fill_null(0).to_numpy()
        flat = table["vec"].combine_chunks()
        return values, codes.astype(np.int64), flat

    r_values, r_size, r_vec = columns(rows)
    f_values, f_size, f_vec = columns(founders)

    def unit(vec, picked):
        m = vec.take(pa.array(picked)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(picked), -1)
        length = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, length, out=np.zeros_like(m), where=length > 0)

    held = {size: (np.flatnonzero(f_size == size), unit(f_vec, np.flatnonzero(f_size == size))) for size in set(f_size.tolist()) - {0}}

    def same(low: int, high: int) -> np.ndarray:
        out = np.zeros((high - low, len(f_values)), bool)
        size = r_size[low:high]
        for width, (places, matrix) in held.items():
            mine = np.flatnonzero(size == width)
            if len(mine):
                out[np.ix_(mine, places)] = np.round(unit(r_vec, mine + low) @ matrix.T, 6) >= near
        by_value = (size == 0)[:, None] | (f_size == 0)[None, :]
        if by_value.any():
            equal = r_values[low:high, None] == f_values[None, :]
            out |= by_value & equal
        return out
    return same


#: Rows compared at once, so that a matrix of similarities stays small, and rows of a group looked through for founders in a round.
_STEP, _FOUNDERS = 512, 1000


def _found(near: float):
    """Founders among the rows of one group, in order of first report."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_first", "ascending"), ("_pid", "ascending")])
        same = _matcher(table, table, near)
        founder = np.zeros(table.num_rows, bool)
        for low in range(0, table.num_rows, _STEP):
            block = same(low, min(low + _STEP, table.num_rows))
            taken = (block & founder).any(axis=1)
            for i in np.flatnonzero(~taken):
                founder[low + i] = not (block[i, low : low + i] & founder[low : low + i]).any()
        return table.filter(pa.array(founder))
    return run


def _join_founders(near: float):
    """First matching founder, if any, for every row of one block; the rows keep their columns."""
    def run(key: tuple, rows: pa.Table, founders: pa.Table) -> pa.Table:
        founders = founders.sort_by([("_first", "ascending"), ("_pid", "ascending")])
        same, first = _matcher(rows, founders, near), []
        for low in range(0, rows.num_rows, _STEP):
            block = same(low, min(low + _STEP, rows.num_rows))
            first.append(np.where(block.any(axis=1), block.argmax(axis=1), -1) if founders.num_rows else np.full(len(block), -1))
        at = np.concatenate(first) if first else np.zeros(0, np.int64)
        hit = pa.array(at, pa.int64(), mask=at < 0)
        cols = [*_GROUP, "_pid", "_first", "value", "vec"]
        return pa.Table.from_arrays([*[rows[c] for c in cols], founders["_pid"].take(hit), founders["value"].take(hit)],
                                    names=[*cols, "_founder", "_founder_value"])
    return run


def _against(pending: DataFrame, founders: DataFrame, near: float, block_rows: int) -> DataFrame:
    """Compare undecided pairs with the founders of their group, one block of pairs per task.

    The founders of a round are few and go to every block; a pair is in one block, so its row comes back once.
    """
    sizes = pending.groupBy(*_GROUP).agg(fanout(F.count(F.lit(1)), F.max(F.size("vec")), block_rows).alias("_pn"))
    left = pending.join(sizes, _GROUP).withColumn("_pb", F.pmod(F.xxhash64("_pid"), "_pn").cast("int"))
    right = founders.join(sizes, _GROUP).withColumn("_pb", F.explode(F.sequence(F.lit(0), F.col("_pn") - 1)))
    keys = [*_GROUP, "_pb"]
    cols = ["_pid", "_first", "value", "vec"]
    a = left.select(*[F.col(k).alias(f"l{k}") for k in keys], *[F.col(c).alias(c) for c in [*_GROUP, *cols]])
    b = right.select(*[F.col(k).alias(f"r{k}") for k in keys], *[F.col(c).alias(c) for c in cols])
    return a.groupBy(*[f"l{k}" for k in keys]).cogroup(b.groupBy(*[f"r{k}" for k in keys])).applyInArrow(
        _join_founders(near), f"{KEY} string, _sig string, {_STATE}, _founder string, _founder_value string")


def assign_value_cluster(events: DataFrame, near: float = NEAR, block_rows: int = 2048) -> DataFrame:
    """``events`` (corroboration_key, value, vec, seq, ...) with ``value_cluster`` filled in."""
    signature = F.to_json(claim_signature(F.col("value")))
    vec = (F.col("vec") if "vec" in events.columns else F.lit(None)).cast("array<double>")
    marked = events.withColumns({
        "_sig": signature,
        "_pid": F.sha2(F.to_json(F.struct(F.col(KEY), F.col("value"), vec.alias("v")), {"ignoreNullFields": "false"}), 256),
    })
    pending = keep(marked.filter(F.col(KEY).isNotNull()).groupBy(*_GROUP, "_pid").agg(
        F.min("seq").alias("_first"), F.first("value").alias("value"), F.first(vec).alias("vec")))
    decided: DataFrame | None = None
    # More founders from round to round, so that a large group takes few rounds even from small ones.
    most = min(block_rows, _FOUNDERS)
    while True:
        early = Window.partitionBy(*_GROUP).orderBy("_first", "_pid")
        head = pending.withColumn("_n", F.row_number().over(early)).filter(F.col("_n") <= most).drop("_n")
        founders = head.groupBy(*_GROUP).applyInArrow(
            _found(near), f"{KEY} string, _sig string, {_STATE}")
        round_result = keep(_against(pending, keep(founders), near, block_rows))
        done = round_result.filter(F.col("_founder").isNotNull()).select("_pid", "_founder_value")
        decided = done if decided is None else decided.unionByName(done)
        rest = round_result.filter(F.col("_founder").isNull()).drop("_founder", "_founder_value")
        if rest.isEmpty():
            break
        pending, most = rest, min(2 * most, _FOUNDERS)
    return marked.join(decided, "_pid", "left").withColumn(
        "value_cluster", cluster_id(F.col(KEY), F.col("_founder_value"))).drop("_pid", "_sig", "_founder_value")
