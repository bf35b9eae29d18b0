"""WARC archives: writing, reading back, and a globally ordered capture index.

Writing.  Each page becomes one WARC/1.1 record, compressed as a gzip member of its
own, so that an index entry (file, offset, length) is enough to read it.  Of records
with equal payloads of at least ``least_bytes`` bytes the one with the smallest
page_id is a response; the others are revisits, which name it and carry the response's
HTTP headers (so the payload's length is known) but no payload.  Spark's own text
writer stores the members, with its commit protocol and on any file system it knows.
The separator it puts after each is an empty gzip member, which decompresses to
nothing.  A file is closed at FILE_BYTES.

Reading.  Each file is walked member by member; a response's payload is hashed again,
and a file's captures are sorted by URL key and time into a run, whose order is kept
as a number beside each capture.

Merging.  Ranges of (URL key, time, page_id) are cut so that each holds some
RANGE_ENTRIES captures.  A range receives its piece of every run, in the run's order,
and a loser tree merges the k pieces as they are; nothing is sorted by key again, and a
piece out of order is an error.  The ranges one after another, and the rows in each,
are the ordered capture history of all pages, which is also the order of ``op2_warc``.

Hot payloads.  Minima are combined before the shuffle; digests of more than HOT_ROWS
rows are few (rows / HOT_ROWS) and joined apart by a checked broadcast, so no task gets
more than HOT_ROWS rows of one digest.

Edge cases: a null html is an empty payload; payloads of any size, the empty one too,
can be revisited; rows that repeat the smallest page_id of a payload are all
responses; a null url is archived as an empty one; rows without page_id are responses
and never referred to; captures of equal key, time and page_id stand in the order of
their runs; very long pages are records of their own size; other columns, also of the
names used here, aren't archived; an empty table gives an empty archive and index.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import Stage, small_batches, table

# Fixed value: an empty gzip member.
EMPTY = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
#: Bytes at which a file, which one task reads whole, is closed; index entries of one range.
FILE_BYTES, RANGE_ENTRIES = 32 << 20, 50_000
#: Revisit entries or hot digests that a join may broadcast (some 50 bytes each), and rows that make a digest hot.
BROADCAST_ROWS, HOT_ROWS = 500_000, 100_000
START = datetime(2024, 1, 1, tzinfo=UTC)


def url_key(url: str) -> str:
    """The host's labels from the last to the first, then path and query, in lower case, without scheme, ``www`` or fragment."""
    rest = re.sub(r"^[a-z][a-z0-9+.-]*://", "", url.strip().lower()).split("#")[0]
    host, slash, path = rest.partition("/")
    host = re.sub(r"^www\d*\.", "", re.sub(r":(80|443)$", "", host.rpartition("@")[2]))
    path, mark, query = path.partition("?")
    return ",".join(reversed(host.split("."))) + ")/" + path.rstrip("/") + (mark and "?" + "&".join(sorted(query.split("&"))))


def capture_time(page_id: int | None) -> str:
    """Pages carry no time: one second for each page_id from a fixed start."""
    return (START + timedelta(seconds=(page_id or 0) % (1 << 31))).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers: int | None) -> bytes:
    """One gzip member."""
    urn = lambda i: f"<urn:x-page:{'' if i is None else i}>"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: {urn(page_id)}",
        f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url or '')}",
        f"WARC-Date: {capture_time(page_id)}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers is not None:
        head += [f"WARC-Refers-To: {urn(refers)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    body = http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + pack.flush()


def revisits(pages: DataFrame, stage: Stage, least_bytes: int = 0) -> DataFrame:
    """``page_id, sha1, refers_to``: the rows that repeat the payload of a smaller page_id; a page_id can stand in rows of several payloads."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    narrow = stage.put(pages.where("page_id is not null").where(F.octet_length(payload) >= least_bytes).select("page_id", F.sha1(payload).alias("sha1")), "digests")
    first = stage.put(narrow.groupBy("sha1").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("m")).where("m > 1"), "first")
    hot = first.where(F.col("m") > HOT_ROWS).select("sha1", "refers_to")
    met = narrow.join(first.where(F.col("m") <= HOT_ROWS).select("sha1", "refers_to"), "sha1")
    n = hot.count()
    if n > BROADCAST_ROWS:  # of at least BROADCAST_ROWS * HOT_ROWS rows
        met = narrow.join(first.select("sha1", "refers_to"), "sha1")
    elif n:
        met = narrow.join(F.broadcast(hot.select("sha1")), "sha1", "left_anti").join(first.where(F.col("m") <= HOT_ROWS).select("sha1", "refers_to"), "sha1").union(narrow.join(F.broadcast(hot), "sha1"))
    return met.where("page_id <> refers_to").select("page_id", "sha1", "refers_to").distinct()


def write(pages: DataFrame, path: str, stage: Stage, least_bytes: int = 0) -> None:
    """Archive ``page_id, url, html`` under ``path``, a folder of ``.gz``-compatible WARC files."""
    small_batches(pages.sparkSession)
    again = stage.put(revisits(pages, stage, least_bytes), "revisits")
    again = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
    named = rows.where("page_id is not null").join(again, ["page_id", "sha1"], "left").select("page_id", "url", "payload", "sha1", "refers_to")
    rows = named.union(rows.where("page_id is null").select("page_id", "url", "payload", "sha1", F.lit(None).cast("long")))
    full = FILE_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = size = 0
        for b in batches:
            made, parts = [], []
            for page_id, url, data, sha1, refers in zip(*(b.column(i).to_pylist() for i in range(5))):
                made.append(record(page_id, url, data, base64.b32encode(bytes.fromhex(sha1)).decode(), refers))
                if size and size + len(made[-1]) > full:
                    part, size = part + 1, 0
                size += len(made[-1])
                parts.append(part)
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), pa.array(parts, pa.int32())], names=["member", "part"])

    members = rows.mapInArrow(run, "member binary, part int").select(F.col("member").cast("string").alias("value"), "part")
    members.write.partitionBy("part").option("encoding", "ISO-8859-1").option("lineSep", EMPTY.decode("latin-1")).text(path)


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """``offset, length, headers, content`` of each record of a file."""
    view, at = memoryview(data), 0
    while at < len(data):
        if view[at : at + len(EMPTY)] == EMPTY:
            at += len(EMPTY)
            continue
        unpack = zlib.decompressobj(31)
        parts, end = [], at
        while not unpack.eof and end < len(data):
            piece = view[end : end + 65536]
            parts.append(unpack.decompress(piece))
            end += len(piece)
        end -= len(unpack.unused_data)
        if not unpack.eof:
            raise ValueError(f"the record at {at} is cut off")
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(fields["content-length"])
        if rest[n:] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} has a wrong length")
        yield at, end - at, fields, rest[:n]
        at = end


ENTRY = pa.schema([("run", pa.string()), ("nth", pa.int64()), ("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])
ENTRY_SQL = "run string, nth long, url_key string, captured string, page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, offset long, length long"


def _page(urn: str) -> int | None:
    digits = urn.strip("<>").rpartition(":")[2]
    return int(digits) if digits else None


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of each archive file, sorted by URL key, time and page_id within the file; ``nth`` is the place in that order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rows = []
                for offset, size, f, content in parse(b.column(1)[i].as_py()):
                    kind, (head, _, payload) = f["warc-type"], content.partition(b"\r\n\r\n")
                    seen, told = kind == "response", payload_length(head)
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if seen else f["warc-payload-digest"].partition(":")[2]
                    if seen and (f["warc-payload-digest"] != f"sha1:{digest}" or told != len(payload)):
                        raise ValueError(f"the payload at {offset} doesn't have its digest or length")
                    url = f["warc-target-uri"]
                    rows.append((url_key(url), f["warc-date"], _page(f["warc-record-id"]), url, kind, None if seen else _page(f["warc-refers-to"]), digest, told, offset, size))
                rows.sort(key=lambda r: sort_key(*r[:3]))
                run_id = b.column(0)[i].as_py()
                rows = [(run_id, n, *r) for n, r in enumerate(rows)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), ENTRY)] if rows else [pa.array([], t.type) for t in ENTRY], schema=ENTRY)

    return files.mapInArrow(run, ENTRY_SQL)


def payload_length(head: bytes) -> int | None:
    """The Content-Length of an HTTP header block."""
    told = re.search(rb"\r\ncontent-length:[ \t]*(\d+)", head, re.I)
    return int(told[1]) if told else None


def sort_key(key: str, captured: str, page_id: int | None) -> tuple:
    """URL keys in byte order as Spark sorts them; rows without page_id first."""
    return key.encode(), captured, page_id is not None, page_id or 0


class LoserTree:
    """K-way merge of sorted sequences: each inner node keeps the loser of its match, so a step replays one path."""

    def __init__(self, sequences: list[list], key) -> None:
        self.seqs, self.key, self.k = sequences, key, max(1, len(sequences))
        self.at = [0] * self.k
        self.heads = [self._head(i) for i in range(self.k)]
        self.losers = [-1] * self.k
        self.winner = self._play(1) if self.k > 1 else 0

    def _head(self, i: int):
        ended = i >= len(self.seqs) or self.at[i] >= len(self.seqs[i])
        return (1,) if ended else (0, self.key(self.seqs[i][self.at[i]]), i)

    def _play(self, node: int) -> int:
        """The winner below a node of the implicit tree; leaves are k to 2k - 1."""
        order, won = [], {}
        todo = [node]
        while todo:
            n = todo.pop()
            if n < self.k:
                order.append(n)
                todo += [2 * n, 2 * n + 1]
        for n in reversed(order):
            a, b = (c - self.k if c >= self.k else won[c] for c in (2 * n, 2 * n + 1))
            won[n], self.losers[n] = (a, b) if self.heads[a] <= self.heads[b] else (b, a)
        return won[node]

    def __iter__(self):
        while self.heads[self.winner][0] == 0:
            i = self.winner
            yield self.seqs[i][self.at[i]]
            self.at[i] += 1
            self.heads[i] = self._head(i)
            n = (i + self.k) // 2
            while n >= 1 and self.k > 1:
                rival = self.losers[n]
                if self.heads[rival] < self.heads[i]:
                    self.losers[n], i = i, rival
                n //= 2
            self.winner = i


def merge(entries: DataFrame, ranges: int) -> DataFrame:
    """All captures in order of URL key, time and page_id: partition by partition, and within each.

    A range holds some RANGE_ENTRIES entries of a few hundred bytes, whatever the input's size.
    """
    key = lambda r: (*sort_key(r[2], r[3], r[4]), r[0], r[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[list[tuple]] = []  # of each run its part of this range, in the run's order
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if not pieces or pieces[-1][-1][0] != r[0]:
                    pieces.append([])
                elif key(r) < key(pieces[-1][-1]):
                    raise ValueError(f"the run {r[0]} isn't in order at {r[1]}")
                pieces[-1].append(r)
        block = []
        for r in LoserTree(pieces, key):
            block.append(r)
            if len(block) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*block), ENTRY)], schema=ENTRY)
                block = []
        if block:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*block), ENTRY)], schema=ENTRY)

    dealt = entries.repartitionByRange(ranges, "url_key", "captured", "page_id", "run", "nth")
    return dealt.sortWithinPartitions("run", "nth").mapInArrow(run, ENTRY_SQL)


def archive(pages: DataFrame, path: str, stage: Stage, least_bytes: int = 0) -> DataFrame:
    """Write the archive, read it back and return the ordered capture index."""
    spark = pages.sparkSession
    write(pages, path, stage, least_bytes)
    entries = stage.put(runs(spark, path), "runs")
    return merge(entries, 1 + entries.count() // RANGE_ENTRIES)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Stage(spark, "warc")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long"), "url", "html")
    return archive(pages, f"{stage.path}/archive", stage).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")
