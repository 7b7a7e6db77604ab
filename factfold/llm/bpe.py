"""Byte-level BPE as DuckDB recursive queries inside the tasks that hold the texts.

A text is split by the tokenizer's pattern. Every distinct piece that is not itself a vocabulary entry
becomes rows (word, position, token, next token). A recursive query joins them with the merge table and
contracts, per step and word, the leftmost pair of the smallest rank, until no word has a pair. Only the
two rows next to a contraction look their pair up again. Words of more than ``LONG`` bytes are contracted in a keyed
recursive query, whose memory is linear in the word (and whose time is quadratic, as every step scans it). Decoding joins
(document, position, id) rows with the vocabulary and concatenates the bytes in order.

Pieces are remembered per Python worker, in two generations of bounded size. Nothing is shuffled; a lost
task is simply run again.

Cases: null and empty texts give no ids; repeated rows and repeated ids are encoded each for itself; texts
of any length are taken whole; other columns are ignored; an empty table gives an empty table. Lone
surrogates cannot occur in Spark strings.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from factfold.llm.common import SLICE_CHARS, in_arrow, only, slices, tokenizer_file

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Words per recursive query, rows that it may make in all its steps, and pieces kept per generation of the memory.
WORDS, ROWS, PIECES = 16_000, 1_500_000, 600_000
#: Words of more bytes are contracted in place, about so many bytes at a time.
LONG, LONG_BYTES = 200, 20_000
#: White space as the Unicode property has it.
SPACE = "\\x09-\\x0d\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: White space other than the blank and the line feed, and the mark that the quick split uses.
RARE = re.compile("[\\x00\\x09\\x0b-\\x0d\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")

# A row's key orders the pairs of a word: rank, then position of the left token; its length finds the right one.
CONTRACT = """
with recursive step(w, p, n, tok, nxt, key, turn) as (
    select s.w, s.p, 1, s.tok, s.nxt, (m.id::bigint << 46) | (s.p::bigint << 8) | 1, 0
    from letters s left join merges m on m.pair = (s.tok::bigint << 20) + s.nxt
    union all
    select c.w, c.p, c.n, c.tok, c.nxt,
           case when c.fresh then (m.id::bigint << 46) | (c.p::bigint << 8) | c.n else c.key end, c.turn
    from (
        select x.w, x.p, case when x.p = x.at then x.n + gone.n else x.n end as n,
               case when x.p = x.at then x.id else x.tok end as tok,
               case when x.p = x.at then gone.nxt when x.p + x.n = x.at then x.id else x.nxt end as nxt,
               x.key, x.p = x.at or x.p + x.n = x.at as fresh, x.turn + 1 as turn
        from (select step.*, best.id, best.at, best.until from step join (
                  select w, (k >> 46)::int as id, (k >> 8) & 274877906943 as at,
                         ((k >> 8) & 274877906943) + (k & 255) as until
                  from (select w, min(key) as k from step group by w) where k is not null) best
              on best.w = step.w) x
        join step gone on gone.w = x.w and gone.p = x.until
        where x.p <> x.until) c
    left join merges m on m.pair = case when c.fresh then (c.tok::bigint << 20) + c.nxt end)
select w, string_agg(tok::varchar, ',' order by p) as ids
from step semi join (select w, turn from step group by w, turn having count(key) = 0) last
     on last.w = step.w and last.turn = step.turn
group by w
"""

# The same for long words, with one row for each (word, position) instead of one for each step: memory is linear in the word. A
# contracted token's row stays with n = 0. Only words that changed in the last step are looked at again.
CONTRACT_LONG = """
with recursive step(w, p, n, tok, nxt, key) using key (w, p) as (
    select s.w, s.p, 1, s.tok, s.nxt, (m.id::bigint << 46) | (s.p::bigint << 16) | 1
    from letters s left join merges m on m.pair = (s.tok::bigint << 20) + s.nxt
    union
    select c.w, c.p, c.n, c.tok, c.nxt, case when c.n > 0 then (m.id::bigint << 46) | (c.p::bigint << 16) | c.n end
    from (
        select x.w, x.p, case when x.p = b.at then x.n + gone.n when x.p = b.until then 0 else x.n end as n,
               case when x.p = b.at then b.id else x.tok end as tok,
               case when x.p = b.at then gone.nxt when x.p = b.until then -1 else b.id end as nxt
        from (select w, (k >> 46)::int as id, (k >> 16) & 1073741823 as at, ((k >> 16) & 1073741823) + (k & 65535) as until
              from (select w, min(key) as k from recurring.step where w in (select w from step) group by w) where k is not null) b
        join recurring.step gone on gone.w = b.w and gone.p = b.until
        join recurring.step x on x.w = b.w and x.n > 0 and (x.p = b.at or x.p = b.until or x.p + x.n = b.at)) c
    left join merges m on m.pair = case when c.nxt >= 0 then (c.tok::bigint << 20) + c.nxt end)
select w, string_agg(tok::varchar, ',' order by p) as ids from step where n > 0 group by w
"""

# One thread, so the aggregate takes the rows in the order in which the subquery gives them.
DECODE = """
select doc, unhex(string_agg(hex, '')) as bytes
from (select doc, pos, hex from tokens join vocabulary using (id) order by doc, pos) group by doc
"""


class Coder:
    """Vocabulary, merge table and memory of one Python worker."""

    def __init__(self, name: str = VOCABULARY, pattern: str | None = None):
        import duckdb
        import numpy as np
        import public_tokenizers
        import regex

        with open(tokenizer_file(name), "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        text = pattern or public_tokenizers.PATTERN
        text = text.replace("[^\\s", f"[^{SPACE}").replace("\\S", f"[^{SPACE}]").replace("\\s", f"[{SPACE}]")
        self.pieces = regex.compile(text).findall
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items()
                 for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        self.db = duckdb.connect(":memory:")
        self.db.execute("set threads = 1; set memory_limit = '250MB'; set temp_directory = ''")
        left, right, made = (np.array(c, np.int64) for c in zip(*pairs, strict=True))
        self._load("merges", {"pair": (left << 20) + right, "id": made.astype(np.int32)})
        self._load("vocabulary", {"id": np.array([*self.ranks.values()], np.int32), "hex": [t.hex() for t in self.ranks]})
        self.letters = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.limit = PIECES

    def _load(self, name: str, columns: dict) -> None:
        self.db.register("loaded", pa.table(columns))
        self.db.execute(f"create table {name} as select * from loaded")
        self.db.unregister("loaded")

    def split(self, text: str) -> list[str]:
        """Parts of ``text`` that the pattern treats each for itself, in order.

        A match never runs across a blank that something other than white space follows, nor across a single
        line feed inside other characters, so texts with no other white space are cut there; all others are cut
        by the pattern itself.
        """
        if not text:
            return []
        if ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n"
                or RARE.search(text)):
            return self.pieces(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def contract(self, words: list[bytes], how: str = CONTRACT) -> list[str]:
        """Ids of words as decimals joined by commas."""
        import numpy as np

        sizes = np.array([len(w) for w in words])
        ends = np.cumsum(sizes)
        tok = self.letters[np.frombuffer(b"".join(words), np.uint8)]
        nxt = np.append(tok[1:], np.int32(-1)).astype(np.int32)
        nxt[ends - 1] = -1
        place = np.arange(len(tok), dtype=np.int64) - np.repeat(ends - sizes, sizes)
        self.db.register("letters", pa.table({"w": np.repeat(np.arange(len(words), dtype=np.int32), sizes), "p": place,
                                              "tok": tok, "nxt": nxt}))
        found = self.db.sql(how).to_arrow_table()
        self.db.unregister("letters")
        out = [""] * len(words)
        for w, ids in zip(found["w"].to_pylist(), found["ids"].to_pylist(), strict=True):
            out[w] = ids
        return out

    def learn(self, parts: set[str]) -> None:
        """Put the ids of parts that are not remembered yet into the memory."""
        fresh = []
        for part in parts:
            if part not in self.young:
                if part in self.old:
                    self.young[part] = self.old[part]
                else:
                    fresh.append((part, [w.encode() for w in self.pieces(part)]))
        words = sorted({w for _, ws in fresh for w in ws if w not in self.ranks}, key=lambda w: len(w) > LONG)
        ids = {}
        low = 0
        while low < len(words):
            long = len(words[low]) > LONG
            high, size = low, 0
            while high < len(words) and high - low < WORDS and long == (len(words[high]) > LONG):
                size += len(words[high]) if long else len(words[high]) ** 2 // 2
                if high > low and size > (LONG_BYTES if long else ROWS):
                    break
                high += 1
            ids.update(zip(words[low:high], self.contract(words[low:high], CONTRACT_LONG if long else CONTRACT), strict=True))
            low = high
        for part, ws in fresh:
            self.young[part] = ",".join(ids[w] if w in ids else str(self.ranks[w]) for w in ws)

    def encode(self, texts: list[str]) -> list[str]:
        """Ids of every text as decimals joined by commas."""
        parts, ends = [], []
        for t in texts:
            parts += self.split(t)
            ends.append(len(parts))
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        found = list(map(self.young.get, parts))
        if None in found:
            self.learn({p for p, ids in zip(parts, found, strict=True) if ids is None})
            found = list(map(self.young.__getitem__, parts))
        return [",".join(found[low:high]) for low, high in zip([0, *ends], ends, strict=False)]

    def decode(self, ids: list) -> list[bytes]:
        """Bytes of every id array."""
        import numpy as np

        sizes = [len(i) for i in ids]
        total = sum(sizes)
        out = [b""] * len(ids)
        if total:
            self.db.register("tokens", pa.table({
                "doc": np.repeat(np.arange(len(ids), dtype=np.int32), sizes), "pos": np.arange(total, dtype=np.int32),
                "id": np.concatenate(ids)}))
            found = self.db.sql(DECODE).to_arrow_table()
            self.db.unregister("tokens")
            for doc, data in zip(found["doc"].to_pylist(), found["bytes"].to_pylist(), strict=True):
                out[doc] = data
        return out


def numbers_of(ids: str):
    """The ids of a text of decimals joined by commas."""
    import numpy as np

    return np.fromstring(ids, np.int32, sep=",")


CODERS: dict[tuple, Coder] = {}


def coder(name: str, pattern: str | None) -> Coder:
    only("bpe", CODERS.clear)
    if (name, pattern) not in CODERS:
        CODERS[name, pattern] = Coder(name, pattern)
    return CODERS[name, pattern]


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str | None = None,
                     ids: bool = True, decoded: bool = True, remembered: int = PIECES) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, on request, the ids and the text decoded from them.

    A worker remembers at most about twice ``remembered`` pieces, which costs memory and saves time and changes no
    result. Bytes that are no UTF-8 cannot arise from whole texts.
    """
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" * ids + ", decoded string" * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(vocabulary, pattern)
        own.limit = remembered
        for batch, texts in slices(batches, chars=SLICE_CHARS // 2):
            names = own.encode(texts)
            numbers = [*map(numbers_of, names)]
            data = own.decode(numbers)
            columns = [batch.column(0), pa.array([len(n) for n in numbers], pa.int64()),
                       pa.array([hashlib.sha256(n.encode()).hexdigest() for n in names]),
                       pa.array([hashlib.sha256(d).hexdigest() for d in data])]
            columns += [pa.array(numbers, pa.list_(pa.int32()))] * ids
            columns += [pa.array([d.decode() for d in data], pa.string())] * decoded
            fields = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids + ["decoded"] * decoded
            yield pa.RecordBatch.from_arrays(columns, fields)

    rows = docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text")
    return in_arrow(rows, run, schema)
