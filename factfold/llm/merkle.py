"""Merkle manifest of a table: a content-addressed graph of digests, proofs by descent, and their verification.

A leaf is the digest of a row. The leaves of a language, by ``doc_id``, are hashed in pairs (a last one alone) level by level
until one is left, the subroot; the subroots, by language, are hashed likewise to the root.

The store keeps one record for each ``PAGE_LEVELS`` levels of a tree: the digest of its top node and, as children, the up to
2**``PAGE_LEVELS`` digests at its bottom. A tree is built page level by page level, so the work is linear and no group holds more
than a page, however many rows a language has.

Proofs come from the store alone. All leaves are requested, so requests that share the first digits of their rank travel
together: a descent starts at the root, looks its digest up in the store, reads the next digit of the rank as the child to enter,
and collects on every level of the page the sibling that it does not enter. One row per page, not per leaf, is looked up, so the
root is no hot key. At the leaves the segments of the path are put into reverse order, from the leaf to the root, hashed to the
proof, and folded with the digest of the row as it is now, which must give the root again.

Cases: null columns are hashed as ``-``; null languages come first; a null doc_id comes first in its language, and its decimal
text is taken as empty; rows of one doc_id are ordered by their digests, so equal rows are leaves of their own with equal
digests; a language of one row has its leaf as subroot; one language alone has its subroot as root; an empty table has no rows and
an empty store; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factfold.llm.common import in_arrow, keep
from factfold.operators.ranking import distributed_rank

PAGE_LEVELS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree over the subroots; trees of languages have the language's digest as name.
TOP = "top"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(row: dict[str, Column] | None = None) -> Column:
    """Digest of a row's fields, each ``-`` or its length in bytes, a colon and its value."""
    return F.sha2(F.concat(*[_field((row or {}).get(f, F.col(f))) for f in FIELDS]), 256)


def _up(nodes: list[str]) -> list[str]:
    return [hashlib.sha256("".join(nodes[i : i + 2]).encode()).hexdigest() for i in range(0, len(nodes), 2)]


def _levels(children: list[str], levels: int) -> list[list[str]]:
    """The nodes of a page, from its children up to its top."""
    out = [children]
    for _ in range(levels):
        out.append(_up(out[-1]))
    return out


def _page_tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        levels, children = batch.column("levels").to_pylist(), batch.column("children").to_pylist()
        tops = [_levels(c, n)[-1][0] for c, n in zip(children, levels, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tops, pa.string())], [*batch.schema.names, "digest"])


def _height(n: Column) -> Column:
    """Levels above ``n`` leaves: the bits of n - 1."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1))).cast("int")


def build_pages(nodes: DataFrame) -> list[DataFrame]:
    """Pages of every tree, lowest first: ``tree, height, depth, number, children, levels, digest``.

    ``nodes``: tree, height, rank (from 0), digest. Trees of height 0 have no page.
    """
    out: list[DataFrame] = []
    level = nodes.filter("height > 0")
    depth = 0
    while not level.isEmpty():
        grouped = level.groupBy("tree", "height", F.shiftright("rank", PAGE_LEVELS).alias("number")).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "digest"))), lambda x: x["digest"]).alias("children"))
        sized = grouped.select("tree", "height", F.lit(depth).alias("depth"), "number", "children",
                               F.least(F.lit(PAGE_LEVELS), F.col("height") - depth * PAGE_LEVELS).alias("levels"))
        pages = keep(in_arrow(sized, _page_tops, "tree string, height int, depth int, number bigint, children array<string>, levels int, digest string"),
                     "pages")
        out.append(pages)
        depth += 1
        level = pages.filter(F.col("height") > depth * PAGE_LEVELS).select("tree", "height", F.col("number").alias("rank"), "digest")
    return out


def leaves(docs: DataFrame) -> DataFrame:
    """``tree, lang, doc_id, leaf, present`` (digest of the row as it is now), ``rank`` and ``height``."""
    number = F.col("doc_id").cast("bigint")
    tampered = F.crc32(F.coalesce(number.cast("string"), F.lit("")).cast("binary")) % 7 == 0
    now = F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    rows = docs.select(
        F.coalesce(F.sha2(F.col("lang").cast("string"), 256), F.lit("")).alias("tree"), F.col("lang").cast("string").alias("lang"),
        number.alias("doc_id"), row_digest().alias("leaf"),
        F.when(tampered & F.col("n_chars").isNotNull(), row_digest({"n_chars": now})).alias("present"))
    ranked = keep(distributed_rank(rows, ["tree"], ["doc_id", "leaf"]), "leaves")
    sizes = ranked.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
    return ranked.join(sizes, "tree").select("tree", "lang", "doc_id", "leaf", F.coalesce("present", "leaf").alias("present"),
                                             (F.col("rn") - 1).alias("rank"), _height(F.col("n")).alias("height"))


def _subroots(rows: DataFrame, pages: list[DataFrame]) -> DataFrame:
    """The top tree's nodes: ``tree, height, rank, digest, name, below`` (name and height of the language's tree)."""
    single = rows.filter("height = 0").select("lang", F.col("tree").alias("name"), F.col("height").alias("below"), F.col("leaf").alias("digest"))
    langs = rows.filter("height > 0 and rank = 0").select("lang", F.col("tree").alias("name"), F.col("height").alias("below"))
    tops = reduce(DataFrame.unionByName, (
        p.filter(f"height <= (depth + 1) * {PAGE_LEVELS}").select(F.col("tree").alias("name"), "digest") for p in pages)) if pages else None
    every = single if tops is None else single.unionByName(langs.join(tops, "name"))
    ranked = keep(distributed_rank(every, [], ["lang", "name"]), "subroots")
    n = ranked.count()
    return ranked.select(F.lit(TOP).alias("tree"), _height(F.lit(n)).alias("height"), (F.col("rn") - 1).alias("rank"), "digest", "name", "below")


def _enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every child of a page with the siblings on its way, top level first, behind the path so far."""
    for batch in batches:
        for row in batch.to_pylist():
            nodes = _levels(row["children"], row["levels"])
            ranks, digests, paths = [], [], []
            for digit in range(len(row["children"])):
                segment = []
                for level in range(row["levels"] - 1, -1, -1):
                    here = digit >> level
                    other = here ^ 1
                    segment.append(("L" if other < here else "R") + nodes[level][other] if other < len(nodes[level]) else "-")
                ranks.append((row["number"] << PAGE_LEVELS) + digit)
                digests.append(row["children"][digit])
                paths.append(row["path"] + segment)
            keep_ = [[row[c]] * len(ranks) for c in ("tree", "height", "subroot", "root")]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, t) for c, t in zip(keep_, (pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)),
                 pa.array(ranks, pa.int64()), pa.array(digests, pa.string()), pa.array(paths, pa.list_(pa.string()))],
                ["tree", "height", "subroot", "root", "number", "digest", "path"])


_FRONT = "tree string, height int, subroot string, root string, number bigint, digest string, path array<string>"


def _descend(front: DataFrame, store: DataFrame, depth: int) -> DataFrame:
    """One page further down for those whose node is a page at ``depth``; others wait."""
    here = F.col("height") > depth * PAGE_LEVELS
    found = front.filter(here).join(store.select("digest", "levels", "children"), "digest")
    return keep(in_arrow(found, _enter, _FRONT).unionByName(front.filter(~here)), "front")


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Proofs of the leaves that were requested from each page."""
    out_schema = pa.schema([("doc_id", pa.int64())] + [(c, pa.string()) for c in (
        "leaf", "subroot", "root", "proof_sha256", "folded_root")] + [("verified", pa.bool_())])
    for batch in batches:
        out: list[dict] = []
        for row in batch.to_pylist():
            nodes = _levels(row["children"], row["levels"]) if row["children"] else None
            for r in row["requests"]:
                path = list(row["path"])
                if nodes:
                    digit = r["rank"] & ((1 << PAGE_LEVELS) - 1)
                    if nodes[0][digit] != r["leaf"]:
                        raise ValueError("a leaf is not where its rank says")
                    for level in range(row["levels"] - 1, -1, -1):
                        here = digit >> level
                        other = here ^ 1
                        path.append(("L" if other < here else "R") + nodes[level][other] if other < len(nodes[level]) else "-")
                path.reverse()
                proof, folded = hashlib.sha256(), r["present"]
                for step in path:
                    side, other = step[0], step[1:]
                    proof.update(other.encode())
                    folded = hashlib.sha256((other + folded if side == "L" else folded + other).encode()).hexdigest()
                out.append({"doc_id": r["doc_id"], "leaf": r["leaf"], "subroot": row["subroot"], "root": row["root"],
                            "proof_sha256": proof.hexdigest(), "folded_root": folded, "verified": folded == row["root"]})
        yield pa.RecordBatch.from_pylist(out, out_schema)


class Manifest:
    """The store of a table's digests, and the leaves it was built from."""

    def __init__(self, docs: DataFrame):
        self.rows = keep(leaves(docs), "ranked")
        pages = build_pages(self.rows.select("tree", "height", "rank", F.col("leaf").alias("digest")))
        self.subroots = keep(_subroots(self.rows, pages), "top")
        top = build_pages(self.subroots.select("tree", "height", "rank", "digest"))
        self.depths, self.top_depths = len(pages), len(top)
        records = [p.select("digest", "levels", "children") for p in (*pages, *top)]
        #: Equal subtrees share a record.
        self.store = keep(reduce(DataFrame.unionByName, records).dropDuplicates(["digest"]), "store") if records else None
        roots = top[-1].select(F.col("digest").alias("root")) if top else self.subroots.select(F.col("digest").alias("root"))
        found = roots.first()
        self.root = found.root if found else None

    def proofs(self) -> DataFrame:
        """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every leaf."""
        root = F.lit(self.root).cast("string")
        nothing = F.array().cast("array<string>")
        height = self.subroots.select("height").limit(1)
        front = height.select(F.lit(TOP).alias("tree"), "height", F.lit(None).cast("string").alias("subroot"), root.alias("root"),
                              F.lit(0).cast("bigint").alias("number"), root.alias("digest"), nothing.alias("path"))
        for depth in reversed(range(self.top_depths)):
            front = _descend(front, self.store, depth)
        names = self.subroots.select(F.col("rank").alias("number"), F.col("name"), F.col("below"))
        front = front.join(names, "number").select(F.col("name").alias("tree"), F.col("below").alias("height"), F.col("digest").alias("subroot"),
                                                   "root", F.lit(0).cast("bigint").alias("number"), "digest", "path")
        for depth in reversed(range(1, self.depths)):
            front = _descend(front, self.store, depth)
        if self.store is not None:
            front = front.join(self.store, "digest", "left")
        else:
            front = front.withColumns({"levels": F.lit(0), "children": nothing})
        # A leaf that is its own subroot has no page, whatever its digest is in another place.
        alone = F.col("height") == 0
        front = front.select("tree", "number", "subroot", "root", "path", F.when(~alone, F.col("levels")).alias("levels"),
                             F.when(~alone, F.col("children")).alias("children"))
        requests = self.rows.groupBy("tree", F.shiftright("rank", PAGE_LEVELS).alias("number")).agg(
            F.collect_list(F.struct("doc_id", "rank", "leaf", "present")).alias("requests"))
        return in_arrow(front.join(requests, ["tree", "number"]), _answer,
                        "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def manifest_proofs(docs: DataFrame) -> DataFrame:
    return Manifest(docs).proofs()


_SQL_FIELDS = " || ".join(f"coalesce(octet_length(encode({{{f}}}::varchar))::varchar || ':' || {{{f}}}::varchar, '-')" for f in FIELDS)
#: crc32 of the decimal doc_id, bit by bit.
_SQL_CRC = """xor(list_reduce(list_transform(string_split(coalesce(doc_id::varchar, ''), ''), lambda ch: ascii(ch)::bigint),
    lambda c, b: list_reduce(range(1, 9), lambda v, i: xor(v >> 1, (v & 1) * 3988292384), xor(c, b)), 4294967295::bigint), 4294967295)"""
_SQL_UP = """select {keys} lvl + 1 as lvl, idx // 2 as idx, sha256(digest || coalesce(after, '')) as digest from (
    select *, lead(digest) over ({part} order by idx) as after, count(*) over ({part}) as c from {tree}) t where c > 1 and idx % 2 = 0"""
ORACLE = f"""
with recursive rows as (
    select row_number() over () as id, lang, doc_id, sha256({_SQL_FIELDS.format(**{f: f for f in FIELDS})}) as leaf,
        sha256({_SQL_FIELDS.format(**{f: f for f in FIELDS} | {'n_chars': f'(n_chars + ({_SQL_CRC} % 7 = 0)::int)'})}) as present
    from documents),
leaves as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as rank from rows),
tree as (
    select lang, 0 as lvl, rank as idx, leaf as digest from leaves
    union all {_SQL_UP.format(keys='lang,', part='partition by lang', tree='tree')}),
heights as (select lang, max(lvl) as height from tree group by lang),
subroots as (select h.lang, h.height, t.digest, row_number() over (order by h.lang nulls first) - 1 as rank
    from heights h join tree t on t.lang is not distinct from h.lang and t.lvl = h.height),
top as (
    select 0 as lvl, rank as idx, digest from subroots
    union all {_SQL_UP.format(keys='', part='', tree='top')}),
root as (select digest, lvl from top qualify row_number() over (order by lvl desc) = 1),
steps as (
    select l.id, v.lvl as step, s.digest as other, (l.rank >> v.lvl) % 2 = 1 as is_left
    from leaves l join subroots b on b.lang is not distinct from l.lang join (select unnest(range(64)) as lvl) v on v.lvl < b.height
    left join tree s on s.lang is not distinct from l.lang and s.lvl = v.lvl and s.idx = xor(l.rank >> v.lvl, 1)
    union all
    select l.id, b.height + v.lvl, s.digest, (b.rank >> v.lvl) % 2 = 1
    from leaves l join subroots b on b.lang is not distinct from l.lang join (select unnest(range(64)) as lvl) v on v.lvl < (select lvl from root)
    left join top s on s.lvl = v.lvl and s.idx = xor(b.rank >> v.lvl, 1)),
proofs as (select id, sha256(coalesce(string_agg(other, '' order by step), '')) as proof_sha256, max(step) + 1 as n from steps group by id),
fold as (
    select id, 0 as step, present as digest from leaves
    union all
    select f.id, f.step + 1, sha256(case when s.other is null then f.digest when s.is_left then s.other || f.digest else f.digest || s.other end)
    from fold f join steps s on s.id = f.id and s.step = f.step)
select l.doc_id, l.leaf, b.digest as subroot, r.digest as root, coalesce(p.proof_sha256, sha256('')) as proof_sha256,
    f.digest as folded_root, f.digest = r.digest as verified
from leaves l join subroots b on b.lang is not distinct from l.lang cross join root r left join proofs p on p.id = l.id
join fold f on f.id = l.id and f.step = coalesce(p.n, 0)"""
