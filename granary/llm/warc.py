"""WARC archives: a writer with one gzip member per record and a salvage reader.

The archives are plain files written through Spark's text writer, so that they land in any store
that Spark can write, under its commit protocol. A record is a gzip member, and a file is a row of as
many members as fit into its size; the last byte of the row (the top byte of a member's length field, zero
below 16 MiB) is written as the writer's line separator. A larger last record is followed by an empty
member, which ends in a zero byte as well.

The salvage reader checks every member and record (gzip checksum, version line, header, length,
payload digest). After a failed check it looks for the next valid member or version line, goes on there
and reports the bytes in between as a quarantined gap. Inside a member it does the same with what could
be decompressed, so that sound records before and after a damaged one, and those before a cut, are kept.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import lean, new_path, slices, table

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
EMPTY = zlib.compressobj(6, zlib.DEFLATED, 31).flush()
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
SPACE = uuid.UUID("6f1f0f0e-53c4-5d0a-9a2b-0f7f4c0c9d11")
STEP, FINE = 1 << 16, 64  # bytes that are decompressed at once


def _uri(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def record(page_id, url: str | None, payload: bytes, refers_to, date: str, name: str | None = None, refers_url: str | None = None) -> bytes:
    """One WARC/1.1 record, not compressed; refers_to, refers_url: of the response whose payload it repeats; name: what its id is made of."""
    kind = "response" if refers_to is None else "revisit"
    block = HTTP + payload if refers_to is None else HTTP
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{uuid.uuid5(SPACE, name or str(page_id)).urn}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Target-URI: {_uri(refers_url)}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """data as a gzip member."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(data: bytes, at: int = 0) -> tuple[dict, bytes, int] | None:
    """Header, payload and end of the record at this place, or None if a check fails. The header is read line by line, up to the first one that is none."""
    if not data.startswith(VERSION, at):
        return None
    line = data.find(b"\r\n", at)
    head = {}
    while True:
        if line < 0:
            return None
        begin, line = line + 2, data.find(b"\r\n", line + 2)
        if line == begin:
            break
        k, colon, v = data[begin : max(line, begin)].partition(b":")
        if not colon:
            return None
        head[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"\d+", n := head.get("content-length", "")):
        return None
    begin, end = line + 2, line + 2 + int(n)
    if data[end : end + 4] != b"\r\n\r\n":
        return None
    payload = data[begin:end]
    if head.get("content-type", "").startswith("application/http"):
        payload = payload.partition(b"\r\n\r\n")[2]
    told = head.get("warc-payload-digest", "")
    if head.get("warc-type") != "revisit" and told.startswith("sha256:") and told[7:] != hashlib.sha256(payload).hexdigest():
        return None
    return head, payload, end + 4


def unzip(data: bytes, at: int) -> tuple[bytes, int, bool]:
    """What the gzip member at this place holds, where it ends, and whether it is sound; of a damaged one what comes before the damage."""
    z, out, fed = zlib.decompressobj(31), [], at
    try:
        while not z.eof and fed < len(data):
            out.append(z.decompress(data[fed : fed + STEP]))
            fed += STEP
    except zlib.error:
        # The rest of this step byte by byte, as an error drops what its step has given.
        z = zlib.decompressobj(31)
        out = []
        try:
            for k in range(at, fed, STEP):
                out.append(z.decompress(data[k : k + STEP]))
            for k in range(fed, min(fed + STEP, len(data)), FINE):
                out.append(z.decompress(data[k : k + FINE]))
        except zlib.error:
            pass
        return b"".join(out), min(fed, len(data)), False
    return b"".join(out), min(fed, len(data)) - len(z.unused_data), z.eof


class Ahead:
    """Places of marks in data, each found by one search that goes forward only."""

    def __init__(self, data: bytes, marks: tuple[bytes, ...]):
        self.data, self.next = data, {m: -1 for m in marks}

    def after(self, at: int) -> int:
        """The first mark behind this place, or the end."""
        for m, k in self.next.items():
            if k <= at:
                k = self.data.find(m, at + 1)
                self.next[m] = k if k >= 0 else len(self.data)
        return min(self.next.values())


def salvage(data: bytes, members: bool = True) -> Iterator[tuple]:
    """("record", begin, end, header, payload, inner) and ("gap", begin, end, None, None, inner), in order.

    begin and end are places in data, of a member for what is inside one; inner is then the place in
    what the member holds. Places cover all bytes but empty members and blank lines between records. A
    damaged member gives the records before the damage and a gap from its begin to the next sound place.
    members: whether there can be members.
    """
    ahead = Ahead(data, (MAGIC, VERSION) if members else (VERSION,))
    at, gap, kept = 0, None, None
    while at < len(data):
        found, inside, whole, end = None, [], False, at
        if members and data.startswith(MAGIC, at):
            content, end, whole = unzip(data, at)
            inside = list(salvage(content, False))
            sound = [x for x in inside if x[0] == "record"]
            if whole and (sound or not content):
                found = [(k, at, end, head, payload, (a, b)) for k, a, b, head, payload, _ in inside]
            elif sound:
                # Cut or damaged: its records, then a gap that begins with it.
                if gap is not None:
                    yield "gap", gap, at, None, None, kept
                for k, a, b, head, payload, _ in sound:
                    yield k, at, end, head, payload, (a, b)
                gap, kept = at, (sound[-1][2], len(content))
        elif data.startswith(VERSION, at) and (one := parse(data, at)):
            end = one[2]
            found = [("record", at, end, one[0], one[1], None)]
        elif gap is None and data[at : at + 2] == b"\r\n":
            at += 2
            continue
        if found is not None:
            if gap is not None:
                yield "gap", gap, at, None, None, kept
                gap = kept = None
            yield from found
            at = end
        else:
            gap = at if gap is None else gap
            # A sound member that holds no records is passed over whole.
            at = end if whole else ahead.after(at)
    if gap is not None:
        yield "gap", gap, len(data), None, None, kept


def write_warc(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", least: int = 100, bytes_per_file: int = 1 << 24) -> None:
    """Write a record per row of pages (page_id, url, html; other columns are ignored) into files under path.

    The payload is html in UTF-8, null as empty. Of rows with equal payloads of at least ``least``
    bytes those with the smallest page_id are responses, the others revisits of it. Repeated rows
    write repeated records, each with an id of its own; a null page_id is never referred to and its record is
    a response. An empty table writes no records. A file ends with the member that reaches
    bytes_per_file, so that only a larger record makes a larger file (1 GB of html at most).
    """
    lean(pages.sparkSession)
    p = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    first = p.filter(F.length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.min_by("url", "page_id").alias("first_url"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    p = p.join(first.select("digest", "first", "first_url"), "digest", "left").withColumn("refers_to", F.when(F.col("first") < F.col("page_id"), F.col("first")))
    run = uuid.uuid4().hex

    def pack(batches):
        task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def row():
            if held[-1][-1]:
                held.append(EMPTY)
            return pa.record_batch([pa.array([b"".join(held)[:-1]], pa.binary())], ["members"])

        for b in slices(batches, 2):
            for i, u, h, r, v in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                number += 1
                held.append(member(record(i, u, h, r, date, f"{run}/{task}/{number}", v)))
                size += len(held[-1])
                if size >= bytes_per_file:
                    yield row()
                    held, size = [], 0
        if held:
            yield row()

    made = p.select("page_id", "url", "payload", "refers_to", "first_url").mapInArrow(pack, "members binary")
    made.select(F.col("members").cast("string")).write.option("lineSep", "\x00").option("maxRecordsPerFile", 1).text(path)


READ = "file string, kind string, begin long, end long, inner_begin long, inner_end long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """All records and gaps of the archives under path (files are read whole; write_warc bounds their size).

    kind is record or gap; begin and end are byte offsets in the file, inner_begin and inner_end those in
    what a member holds. A gap has no other values. No files give no rows.
    """

    def rows(batches):
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                out, held = [], 0
                for kind, begin, end, head, body, inner in salvage(content.as_py()):
                    where = (file, kind, begin, end, *(inner or (None, None)))
                    if kind == "gap":
                        out.append((*where, None, None, None, None, None, None, None))
                    else:
                        revisit = head.get("warc-type") == "revisit"
                        number = lambda k: int(head[k]) if re.fullmatch(r"-?\d+", head.get(k, "")) else None  # noqa: B023, E731
                        digest = head["warc-payload-digest"][7:] if revisit and head.get("warc-payload-digest", "").startswith("sha256:") else hashlib.sha256(body).hexdigest()
                        n = number("x-payload-length") if revisit else len(body)
                        out.append((*where, number("x-page-id"), head.get("warc-target-uri"), n, digest, head.get("warc-type"), number("x-refers-to-page"), body if payload and not revisit else None))
                        held += len(body) if payload else 0
                    if held > 1 << 22 or len(out) >= 4096:
                        yield batch(out)
                        out, held = [], 0
                yield batch(out)

    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in READ.split(", ")]

    def batch(out):
        cols = list(zip(*out, strict=True)) or [()] * len(kinds)
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(rows, READ)


def op5_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path, payload=False).filter("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), h AS (
  SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM h
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first < page_id THEN first END AS refers_to
FROM f
"""
