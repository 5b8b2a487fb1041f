"""Converter from legacy ARC archives to WARC, a WARC reader, and a writer of ARC files.

An ARC file opens with a ``filedesc:`` record whose body names the format's version and the fields of the header lines
that follow, one before each record: version 1 has five fields, version 2 ten; the last is the body's declared length.
The converter reads records by those lengths and synthesises what WARC wants and ARC lacks: record ids (UUIDs of the
file's path and the record's place in it, so reruns agree), ISO timestamps, record types, SHA-1 digests of block and payload.
Of records with equal payloads one stays a response and the others become revisits of it. Each WARC file opens with a
``warcinfo`` record; ARC's address and content type are kept.

Both kinds of file are written by Spark's text writer as one gzip member a record, a file a task: a member's last byte is
the highest of its length's four, a zero below 16 MB, and this zero is the writer's line separator. A task writes what
it reads, so ``spark.sql.files.maxPartitionBytes`` bounds the files made here. An archive is read as a whole (up to
Spark's 2 GB for a file) and unpacked a record at a time. Between ARC and WARC only narrow rows and the archives'
compressed bytes are shuffled, never unpacked payloads.

A null payload is empty. A null or blank url becomes ``urn:page:<id>``; white space and control characters in a url are
percent-encoded. A null page_id ranks after all others. Of records with equal payloads the one of the smallest page_id
is the response, and of repeated rows that tie the first by file and place. A payload of any length is one record. Extra
columns are ignored. An empty table gives archives without pages.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixsieve.llm.common import CLEANUP, Scratch, small_batches

#: Fields of the header lines, by version: fixed values of the format.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Fixed values of the WARC format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CONFORMS = "http://iipc.github.io/warc-specifications/specifications/warc-format/warc-1.1/"
EPOCH = datetime(2001, 1, 1, tzinfo=UTC)
#: A record's columns, but for its block.
RECORD = "record_id string, uri string, address string, date string, content_type string, record_type string, page_id long, block_digest string, payload_at int, payload_bytes long, payload_digest string"
KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
#: Bytes of records that are handed on at a time.
BATCH = 8 << 20
#: A gzip header without name or time: fixed values of the format.
GZIP_HEAD = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff"


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    cols = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, KINDS[k]) for c, k in zip(cols, kinds, strict=True)], list(names))


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(data: bytes) -> bytes:
    """A gzip member of data without its last byte, which is zero; of much data an empty member follows."""
    z = zlib.compressobj(1, zlib.DEFLATED, -15)
    out = GZIP_HEAD + z.compress(data) + z.flush() + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    return out[:-1] if out[-1] == 0 else out + member(b"")


def _write_members(rows: DataFrame, path: str) -> None:
    """Write a column ``value`` of :func:`member`, a file a task. The shuffle files that it took go once it is written."""
    conf = rows.sparkSession.conf
    held = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        rows.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", 0).text(path)
    finally:
        conf.set(CLEANUP, held)


# ARC


def arc_begin(version: int, name: str) -> bytes:
    """The record that opens an ARC file."""
    body = f"{version} 0 helixsieve\n{ARC_FIELDS[version]}\n\n".encode()
    more = f" 200 - - 0 {name}" if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 20010101000000 text/plain{more} {len(body)}\n".encode() + body


def arc_record(version: int, name: str, at: int, url: str, date: str, kind: str, body: bytes) -> bytes:
    more = f" 200 {hashlib.md5(body).hexdigest()} - {at} {name}" if version == 2 else ""
    return f"\n{url} 0.0.0.0 {date} {kind}{more} {len(body)}\n".encode() + body


def _opened(data: bytes) -> io.BufferedIOBase:
    return gzip.open(io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)  # type: ignore[return-value]


def _exactly(f: io.BufferedIOBase, size: int, what: str) -> bytes:
    out = f.read(size)
    if len(out) < size:
        raise ValueError(f"{what} shorter than its declared length")
    return out


def arc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and body of each record of an ARC file, compressed or not, after the one that opens it."""
    fields = None
    with _opened(data) as f:
        while line := f.readline():
            if line in (b"\n", b"\r\n"):
                continue
            if not line.endswith(b"\n"):
                raise ValueError("an ARC header line without an end")
            head = line.decode().rstrip("\r\n")
            if fields is None:
                if not head.startswith("filedesc:"):
                    raise ValueError("an ARC file begins with a filedesc record")
                said = _exactly(f, int(head.rsplit(" ", 1)[1]), "an ARC file's first record").decode().splitlines()
                if int(said[0].split()[0]) not in ARC_FIELDS:
                    raise ValueError(f"ARC version {said[0]}")
                fields = said[1].split()
                continue
            values = head.rsplit(" ", len(fields) - 1)
            if len(values) != len(fields):
                raise ValueError(f"an ARC header line of {len(values)} fields instead of {len(fields)}")
            own = dict(zip(fields, values, strict=True))
            yield own, _exactly(f, int(own["Archive-length"]), "an ARC record")


def _http(page_id: int | None, body: bytes) -> bytes:
    own = "" if page_id is None else str(page_id)
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {own}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body


def _escape(url: str | None, page_id: int | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url and url.strip() else f"urn:page:{page_id}"


def write_arc(pages: DataFrame, path: str, *, version: int | None = None) -> None:
    """Pages as gzipped ARC files below path, of one version, or of both in turn. A page is dated by its id."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        own, name = version or 1 + part % 2, f"pages-{part:06d}.arc.gz"
        out = member(arc_begin(own, name))
        at = len(out) + 1
        yield _rows([(out,)], "value binary")
        for batch in batches:
            rows = []
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                date = (EPOCH + timedelta(seconds=abs(page_id or 0) % 10**9)).strftime("%Y%m%d%H%M%S")
                out = member(arc_record(own, name, at, _escape(url, page_id), date, "text/html", _http(page_id, html or b"")))
                at += len(out) + 1
                rows.append((out,))
            yield _rows(rows, "value binary")

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    _write_members(rows.mapInArrow(run, "value binary"), path)


# ARC to WARC


def _head(block: bytes) -> tuple[int, dict[str, str]]:
    """Where an HTTP message's payload begins, 0 if it is none, and its header fields."""
    at = block.find(b"\r\n\r\n") + 4 if block.startswith(b"HTTP/") else 0
    at = at if at >= 4 else 0
    return at, dict(x.split(": ", 1) for x in block[:at].decode("latin-1").split("\r\n")[1:] if ": " in x)


def to_warc(own: dict[str, str], body: bytes, key: str) -> tuple:
    """A record's row, see RECORD, and its block last; key tells it from all others."""
    at, head = _head(body)
    date = datetime.strptime(own["Archive-date"], "%Y%m%d%H%M%S").replace(tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    record_id = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key} {own['URL']}')}"
    page_id = int(x) if (x := head.get("X-Page-Id")) else None
    payload = body[at:]
    kind, content = ("response", "application/http; msgtype=response") if at else ("resource", own["Content-type"])
    return record_id, own["URL"], own["IP-address"], date, content, kind, page_id, digest(body), at, len(payload), digest(payload), body


def _archives(spark: SparkSession, path: str) -> DataFrame:
    """path and content of each file below path."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


NARROW = f"path string, n long, {RECORD}"


def _narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of ARC files, without their blocks."""
    for batch in batches:
        for file, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            yield _rows([(file, n, *to_warc(own, body, f"{file}#{n}")[:-1]) for n, (own, body) in enumerate(arc_records(data))], NARROW)


def _line(name: str, value: object) -> str:
    return f"{name}: {value}\r\n"


def warc_record(row: dict, best: dict | None) -> bytes:
    """A record's bytes; one that has another as best is a revisit of it and has no payload."""
    block = row["block"][: row["payload_at"]] if best else row["block"]
    head = "WARC/1.1\r\n" + _line("WARC-Type", "revisit" if best else row["record_type"]) + _line("WARC-Record-ID", f"<{row['record_id']}>")
    head += _line("WARC-Date", row["date"]) + _line("WARC-Target-URI", row["uri"])
    if row["address"] not in ("", "-", "0.0.0.0"):  # what ARC writers put for an unknown one
        head += _line("WARC-IP-Address", row["address"])
    if best:
        head += _line("WARC-Profile", PROFILE) + _line("WARC-Refers-To", f"<{best['record_id']}>") + _line("WARC-Refers-To-Target-URI", best["uri"]) + _line("WARC-Refers-To-Date", best["date"])
    else:
        head += _line("WARC-Block-Digest", f"sha1:{row['block_digest']}")
    head += _line("WARC-Payload-Digest", f"sha1:{row['payload_digest']}") + _line("Content-Type", row["content_type"]) + _line("Content-Length", len(block))
    return head.encode() + b"\r\n" + block + b"\r\n\r\n"


def warc_begin(name: str) -> bytes:
    """The record that opens what has been converted from the ARC file of this path."""
    body = _line("software", "helixsieve") + _line("format", "WARC File Format 1.1") + _line("conformsTo", CONFORMS) + _line("description", f"converted from {name}")
    head = "WARC/1.1\r\n" + _line("WARC-Type", "warcinfo") + _line("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>")
    head += _line("WARC-Date", "2001-01-01T00:00:00Z") + _line("WARC-Filename", name.rsplit("/", 1)[-1]) + _line("Content-Type", "application/warc-fields") + _line("Content-Length", len(body.encode()))
    return (head + "\r\n" + body + "\r\n\r\n").encode()


def _converted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of a WARC file for each ARC file (path, content, revisits), a few MB at a time."""
    names = [x.split()[0] for x in RECORD.split(", ")] + ["block"]
    for batch in batches:
        for file, data, revisits in zip(*(batch.column(c).to_pylist() for c in ("path", "content", "revisits")), strict=True):
            of = {r["n"]: r for r in revisits or []}
            rows, held = [(member(warc_begin(file)),)], 0
            for n, (own, body) in enumerate(arc_records(data)):
                rows.append((member(warc_record(dict(zip(names, to_warc(own, body, f"{file}#{n}"), strict=True)), of.get(n))),))
                held += len(rows[-1][0])
                if held >= BATCH:
                    yield _rows(rows, "value binary")
                    rows, held = [], 0
            yield _rows(rows, "value binary")


def convert_arc(spark: SparkSession, path_in: str, path_out: str, *, least: int = 0, scratch: Scratch | None = None) -> None:
    """Convert ARC files below path_in to WARC files below path_out. Payloads under ``least`` bytes are never revisits."""
    small_batches(spark)
    scratch = scratch or Scratch(spark, "warc")
    narrow = scratch.save(_archives(spark, path_in).mapInArrow(_narrow, NARROW), "narrow")
    narrow = narrow.where(F.col("payload_bytes") >= least).select("path", "n", "page_id", "record_id", "uri", "date", "payload_bytes", "payload_digest")
    best = F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "path", "n", "record_id", "uri", "date")).alias("best")
    equal = narrow.groupBy("payload_digest", "payload_bytes").agg(best, F.count("*").alias("many")).where("many > 1")
    equal = scratch.save(equal.select("payload_digest", "payload_bytes", "best"), "equal")
    revisits = narrow.join(equal, ["payload_digest", "payload_bytes"]).where("path != best.path or n != best.n")
    # One row an ARC file, with no more entries than the file has records.
    revisits = revisits.groupBy("path").agg(F.collect_list(F.struct("n", "best.record_id", "best.uri", "best.date")).alias("revisits"))
    revisits = scratch.save(revisits, "revisits")
    _write_members(_archives(spark, path_in).join(revisits, "path", "left").mapInArrow(_converted, "value binary"), path_out)


# Reading WARC


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a WARC file, compressed or not."""
    with _opened(data) as f:
        while line := f.readline():
            if line in (b"\r\n", b"\n"):
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"a WARC record begins with {line[:20]!r}")
            own = {}
            while (line := f.readline()) not in (b"\r\n", b"\n", b""):
                k, _, v = line.decode().rstrip("\r\n").partition(":")
                own[k] = v.strip()
            yield own, _exactly(f, int(own["Content-Length"]), "a WARC record")


READ = "record_id string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to_id string"


def _read(own: dict[str, str], block: bytes) -> tuple:
    said = own["WARC-Payload-Digest"].removeprefix("sha1:")
    at, head = _head(block)
    page_id = int(x) if (x := head.get("X-Page-Id")) else None
    if own["WARC-Type"] == "revisit":
        return own["WARC-Record-ID"], page_id, None, said, "revisit", own["WARC-Refers-To"]
    if digest(block[at:]) != said or digest(block) != own["WARC-Block-Digest"].removeprefix("sha1:"):
        raise ValueError(f"{own['WARC-Record-ID']}: the block isn't that of its digests")
    return own["WARC-Record-ID"], page_id, len(block) - at, said, own["WARC-Type"], None


def read_warc(spark: SparkSession, path: str, *, scratch: Scratch | None = None) -> DataFrame:
    """record_id, page_id, payload_bytes, payload_digest, record_type and refers_to, the page_id of what a revisit
    refers to, of each page's record; digests are made anew. A revisit's payload is as long as what it refers to."""
    small_batches(spark)
    scratch = scratch or Scratch(spark, "warc-read")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content").to_pylist():
                yield _rows([_read(own, block) for own, block in warc_records(data) if own["WARC-Type"] != "warcinfo"], READ)

    rows = scratch.save(_archives(spark, path).mapInArrow(run, READ), "read")
    named = rows.where("refers_to_id is null").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("first_bytes"))
    out = rows.join(named, "refers_to_id", "left").withColumn("payload_bytes", F.coalesce("payload_bytes", "first_bytes"))
    return out.select("record_id", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
