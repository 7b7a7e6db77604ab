"""WARC archives of pages, with capture indexes merged into one order.

Pages are dealt to archives by ranges of their id. A task writes its archive record by record, each a gzip member of its
own, and next to it the index of the archive: a run of lines sorted by URL key and time. Of equal payloads
of at least ``LEAST`` bytes the page with the smallest id is written as response, the others as revisits
that name it and hold only their HTTP head.

Index merge: samples of the sorted runs give ranges of URL keys; a task per range reads its slice of every run and
merges the slices with a loser tree, so captures come out in global order of URL key and time. A key range that
one host fills is divided by time and page id as well, as cuts are whole sort keys.

Archives and runs have a name of their own for each attempt; the manifest names those of the attempt that counted.

Cases: null html is an empty payload, a null url an empty one, pages without a time get the second of their id after
``EPOCH``; repeated ids, and recaptures of one id and URL, are records of their own and each is matched by its own
payload; the smallest id's record with the smallest hash of the URL is the response, and of rows that agree in id, URL and
payload there the one without a time or else with the earliest, while the others are revisits of it; a null id counts as the smallest and is read back as null; an empty table gives no archive and no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factfold.llm.common import below, in_arrow, keep, range_cuts, scratch_folder

LEAST = 100
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
#: Payload bytes of an archive, about; index lines between two samples of a run.
ARCHIVE_BYTES, SAMPLE_LINES = 64_000_000, 64
LOWEST = -(1 << 63)


def url_key(url: str) -> str:
    """Host labels reversed, then port, path and query, lower-cased: ``org,example)/path?x``."""
    match = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)(:\d+)?([^#]*)", url)
    host = ",".join(reversed(match[1].lower().removeprefix("www.").split("."))) if match else ""
    return f"{host}{(match[2] or '') if match else ''}){((match[3] or '/') if match else '/').lower()}"


def sort_key(url: str, time: str, page: int) -> tuple[str, str, int]:
    return url_key(url), time, page


def record_id(page: int, name: str) -> str:
    return f"<urn:page:{page}:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def response_id(page: int, digest: str) -> str:
    """Id of the one response that revisits with its payload refer to; they know no more of it than these two."""
    return record_id(page, f"sha256:{digest}")


def record(page: int, url: str, time: str, payload: bytes, digest: str, refers_to: int | None, own_id: str) -> bytes:
    """A WARC/1.1 record; a revisit holds only the HTTP head and names the id of its response.

    ``WARC-Target-URI`` is the URL with what may not stand in a URI escaped. Where that changes it, the URL itself
    follows in ``WARC-Page-URL``, escaped so that it comes back exactly.
    """
    target = quote(url, safe=":/?#[]@!$&'()*+,;=%~")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: {own_id}", f"WARC-Date: {time}",
             f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}",
             f"WARC-Page-ID: {page}", "Content-Type: application/http; msgtype=response"]
    if target != url:
        lines.append(f"WARC-Page-URL: {quote(url)}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: {response_id(refers_to, digest)}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


def read_records(source) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Place, headers and block of every record of an open archive, a member at a time."""
    pending, taken = b"", 0
    while True:
        press = zlib.decompressobj(31)
        parts, place = [], taken - len(pending)
        while not press.eof:
            chunk = pending or source.read(1 << 20)
            if not chunk:
                if parts or pending:
                    raise ValueError("the archive ends inside a record")
                return
            taken += 0 if chunk is pending else len(chunk)
            parts.append(press.decompress(chunk))
            pending = press.unused_data
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield place, headers, rest[: int(headers["Content-Length"])]


def loser_tree(runs: list[Iterator], key: Callable) -> Iterator:
    """Merge sorted iterators: inner nodes hold the loser of their match, so a new item plays one match per level."""
    size = 1
    while size < max(1, len(runs)):
        size *= 2
    last = (1,)  # above every (0, key)
    heads: list = [None] * size

    def advance(leaf: int) -> tuple:
        heads[leaf] = next(runs[leaf], None) if leaf < len(runs) else None
        return last if heads[leaf] is None else (0, key(heads[leaf]))

    keys = [advance(leaf) for leaf in range(size)]
    losers = [0] * size

    def play(node: int) -> int:
        if node >= size:
            return node - size
        left, right = play(2 * node), play(2 * node + 1)
        winner, losers[node] = (left, right) if keys[left] <= keys[right] else (right, left)
        return winner

    winner = play(1) if size > 1 else 0
    while keys[winner] != last:
        yield heads[winner]
        keys[winner] = advance(winner)
        node = (winner + size) // 2
        while node:
            if keys[losers[node]] < keys[winner]:
                winner, losers[node] = losers[node], winner
            node //= 2


def _open(path: str):
    system, place = pa.fs.FileSystem.from_uri(path)
    return system, place


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write archives and index runs; the kept manifest is ``archive, path, index, n_records, samples``."""
    columns = {c.lower() for c in pages.columns}
    time = F.col("time").cast("string") if "time" in columns else F.lit(None).cast("string")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), time.alias("time"))
    page, size, digest = F.coalesce("page_id", F.lit(LOWEST)), F.octet_length("html"), F.unhex(F.sha2("html", 256))
    seen = rows.select(page.alias("page_id"), F.xxhash64("url").alias("u"), digest.alias("digest"), size.alias("bytes"))
    first = seen.filter(F.col("bytes") >= least).groupBy("digest").agg(F.min(F.struct("page_id", "u")).alias("first"), F.count("*").alias("n"))
    refers = seen.filter(F.col("bytes") >= least).join(first.filter("n > 1"), "digest").filter(
        "page_id <> first.page_id or u <> first.u").select("page_id", "u", "digest", F.col("first.page_id").alias("refers_to")).distinct()
    total = rows.agg(F.sum(size.cast("bigint"))).first()[0] or 0
    cuts = range_cuts(rows, "page_id", max(-(-total // archive_bytes), int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    # The reference of a page and payload travels as a row that sorts just before it, so the payloads are shuffled once and joined with nothing.
    archive = below(cuts, F.col("page_id")).alias("archive")
    placed = rows.withColumn("page_id", page).select(
        archive, "page_id", F.xxhash64("url").alias("u"), digest.alias("digest"), F.lit(True).alias("payload"), "url", "html", "time",
        F.lit(None).cast("bigint").alias("refers_to"))
    placed = placed.unionByName(refers.select(archive, "page_id", "u", "digest", F.lit(False).alias("payload"), "refers_to"), allowMissingColumns=True)
    placed = placed.repartition(len(cuts) + 1, "archive").sortWithinPartitions("archive", "page_id", "u", "digest", "payload", "time")
    kind = pa.schema([("archive", pa.int32()), ("path", pa.string()), ("index", pa.string()), ("n_records", pa.int64()),
                      ("samples", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, out, name, lines, place, named = None, None, "", [], 0, (None, None)

        def done() -> pa.RecordBatch:
            out.close()
            lines.sort()
            system, target = _open(f"{name}.cdx")
            with system.open_output_stream(target) as index:
                index.write("".join(f"{k}\t{t}\t{p}\t{at}\n" for (k, t, p), at in lines).encode())
            return pa.RecordBatch.from_pylist([{
                "archive": archive, "path": f"{name}.warc.gz", "index": f"{name}.cdx", "n_records": len(lines),
                "samples": ["\t".join(map(str, k)) for k, _ in lines[::SAMPLE_LINES]]}], kind)

        for batch in batches:
            for to, page_id, u, digest, payload, url, html, when, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = page_id, u, digest
                if not payload:
                    named = own, refers_to
                    continue
                body = html.encode()
                refers_to = named[1] if named[0] == own else None
                if refers_to is None and len(body) >= least:
                    named = own, page_id  # exact repeats that follow are revisits of this response
                if to != archive:
                    if out:
                        yield done()
                    archive, lines, place = to, [], 0
                    name = f"{folder}/capture-{to:08d}-{uuid.uuid4().hex}"
                    system, target = _open(f"{name}.warc.gz")
                    out = system.open_output_stream(target)
                if when is None:
                    when = (EPOCH + timedelta(seconds=max(0, page_id) % (1 << 32))).strftime("%Y-%m-%dT%H:%M:%SZ")
                shared = refers_to is None and len(body) >= least
                own_id = response_id(page_id, digest.hex()) if shared else record_id(page_id, f"{name} {place}")
                data = gzip_member(record(page_id, url, when, body, digest.hex(), refers_to, own_id))
                out.write(data)
                clean = quote(url_key(url), safe=":/?#[]@!$&'()*+,;=%~")
                lines.append(((clean, when, page_id), place))
                place += len(data)
        if out:
            yield done()

    system, target = _open(folder)
    system.create_dir(target)
    return keep(in_arrow(placed, run, "archive int, path string, index string, n_records bigint, samples array<string>"), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to, record_id, refers_to_id`` and the place of
    every record, read from the archives.

    The digest of a response is taken from its payload and compared with the header; ``broken_revisits`` compares
    revisits with their response.
    """
    paths = manifest.select("path").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "refers_to_id", "path", "offset"]

    def rows(path: str) -> Iterator[tuple]:
        system, place = _open(path)
        with system.open_input_stream(place) as source:
            for at, headers, block in read_records(source):
                head, _, payload = block.partition(b"\r\n\r\n")
                size = int(re.search(rb"Content-Length: (\d+)", head)[1])
                digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                refers = headers.get("WARC-Refers-To")
                if refers is None and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"a record of {path} differs from its headers")
                page = int(headers["WARC-Page-ID"])
                url = unquote(headers["WARC-Page-URL"]) if "WARC-Page-URL" in headers else headers["WARC-Target-URI"]
                yield (None if page == LOWEST else page, url, size, digest, headers["WARC-Type"],
                       int(refers.split(":")[2]) if refers else None, headers["WARC-Record-ID"], refers, path, at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
        for batch in batches:
            for path in batch.column(0).to_pylist():
                found: list[tuple] = []
                for row in rows(path):
                    found.append(row)
                    if len(found) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)
                        found = []
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

    return in_arrow(paths, run, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, "
                                "refers_to bigint, record_id string, refers_to_id string, path string, offset bigint")


def broken_revisits(records: DataFrame) -> DataFrame:
    """Revisits of ``read_archives`` whose response is not there, or has another digest or length than they claim."""
    said = ["payload_digest", "payload_bytes"]
    held = records.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), *said)
    return records.filter("record_type = 'revisit'").join(held, ["refers_to_id", *said], "left_anti")


def merge_indexes(manifest: DataFrame, ranges: int | None = None) -> DataFrame:
    """``part, rank, url_key, time, page_id, path, offset``: all captures; (part, rank) is their global order."""
    spark = manifest.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    samples = manifest.select(F.explode("samples").alias("s"))
    n = samples.count()
    step = max(1, n // ranges)
    # Every step-th sample in order: at most about twice as many cuts as ranges.
    cuts = [r[0] for r in samples.repartitionByRange(ranges, "s").sortWithinPartitions("s").select(
        "s", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")).filter(F.col("at") % step == 0).select("s").collect()]
    cuts = sorted({(k, t, int(p)) for k, t, p in (c.split("\t") for c in cuts)})
    files = [(r["path"], r["index"]) for r in manifest.select("path", "index").toLocalIterator()]
    shared = spark.sparkContext.broadcast((cuts, files))
    parts = spark.range(0, len(cuts) + 1, 1, len(cuts) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, files = shared.value
        for batch in batches:
            for part in batch.column(0).to_pylist():
                low, high = cuts[part - 1] if part else None, cuts[part] if part < len(cuts) else None
                merged = loser_tree([_slice(path, index, low, high) for path, index in files], lambda line: line[:3])
                out: list[tuple] = []
                for rank, line in enumerate(merged):
                    out.append((part, rank, *line[:2], None if line[2] == LOWEST else line[2], *line[3:]))
                    if len(out) == 10_000:
                        yield _lines(out)
                        out = []
                if out:
                    yield _lines(out)

    return in_arrow(parts, run, "part bigint, rank bigint, url_key string, time string, page_id bigint, path string, offset bigint")


def _lines(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) if i not in (4,) else pa.array(c, pa.int64()) for i, c in enumerate(zip(*out, strict=True))],
                                      ["part", "rank", "url_key", "time", "page_id", "path", "offset"])


def _line(text: str) -> tuple[str, str, int, int]:
    key, time, page, at = text.rstrip("\n").split("\t")
    return key, time, int(page), int(at)


def _slice(path: str, index: str, low: tuple | None, high: tuple | None) -> Iterator[tuple]:
    """Lines of a sorted run from ``low`` to before ``high``: a binary search over its bytes, then a stream."""
    system, place = _open(index)
    size = system.get_file_info(place).size
    with system.open_input_file(place) as source:
        def line_after(at: int) -> tuple[int, tuple | None]:
            """The first line that starts at or behind ``at``, and where it starts."""
            start = at
            if at:
                source.seek(at - 1)
                data = b""
                while b"\n" not in data:
                    more = source.read(512)
                    if not more:
                        return size, None
                    data += more
                start = at - 1 + data.index(b"\n") + 1
            if start >= size:
                return size, None
            source.seek(start)
            data = b""
            while b"\n" not in data:
                data += source.read(512)
            return start, _line(data[: data.index(b"\n")].decode())

        begin = 0
        if low is not None:
            a, b = 0, size
            while a < b:
                middle = (a + b) // 2
                start, line = line_after(middle)
                if line is None or line[:3] >= low:
                    b = middle
                else:
                    a = start + 1
            begin = line_after(a)[0]
        source.seek(begin)
        rest = b""
        while True:
            data = source.read(1 << 16)
            if not data and not rest:
                return
            lines = (rest + data).split(b"\n")
            rest = lines.pop()
            for text in lines:
                line = _line(text.decode())
                if high is not None and line[:3] >= high:
                    return
                yield (*line[:3], path, line[3])
            if not data:
                return


def new_folder(spark: SparkSession) -> str:
    folder = scratch_folder(spark, "warc")
    return folder if "://" in folder else "file://" + folder.removeprefix("file:")
