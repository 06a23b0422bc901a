"""Legacy ARC archives to WARC.

An ARC file begins with a version block, ``filedesc://``, which says whether the
record lines that follow have the 5 fields of version 1 or the 10 of version 2.
Each record is such a line and as many bytes as its last field declares.  The
converter parses by version and declared length only, never by looking for the
next record, and makes for each record what a WARC 1.1 record needs and ARC
lacks: a record id, an ISO 8601 date, a record type, block and payload digests.

Records with equal payloads (SHA-256 and length) of ``min_revisit`` bytes or
more are written once, as the response with the smallest source id; the others
are revisits that refer to it and carry no payload.  A record is known by its
source id and its place in the source's ARC file; its record id is made of the two,
so a revisit's ``WARC-Refers-To`` is the id of a record that is written.

Archives are written by Spark's own text writer, so they land in any file system
that Spark can write: each record is a whole gzip member, as the format wants, a
row is a run of members of about ``RUN_BYTES``, and the line separator is an empty
gzip member, which readers pass over.  A file holds ``FILE_RUNS`` rows at most, so
archives stay near ``FILE_RUNS * RUN_BYTES`` (and the longest record) at any input.
Only ids and digests are shuffled to find copies; payloads move once, to meet their
verdict.

A null payload counts as empty, a null URL as one without a host.  Records without
a source id (null) sort after all others: they are a copy's response only if all its
records lack one.  Rows that repeat an id share its record id; with the same payload
they are all the response.  Pages may have other columns of any name.  An empty table
gives an archive of warcinfo records, or none.  A damaged ARC file raises, or, if
``strict`` is off, gives the records before the damage.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from io import BytesIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .grouping import attach_groups
from .scratch import materialise, scratch_path

# Fixed values of the formats.
V1_FIELDS = "URL IP-address Archive-date Content-type Archive-length"
V2_FIELDS = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
WARC_VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Compression level of a record: fast, since pages compress well at any level.
LEVEL = 3
#: Bytes of gzip members in a row that is written, about, and rows in a file, at most.
RUN_BYTES, FILE_RUNS = 1 << 20, 32
#: A whole gzip member without content.
EMPTY_MEMBER = gzip.compress(b"", mtime=0)


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    mime: str
    block: bytes
    status: int | None = None
    version: int = 1

    @property
    def http(self) -> bool:
        return self.block.startswith(b"HTTP/")

    @property
    def payload(self) -> bytes:
        """The block without its HTTP head, if it has one."""
        if not self.http:
            return self.block
        head = re.match(rb"(?s).*?\r?\n\r?\n", self.block)
        return self.block[head.end() :] if head else b""


def arc_file(records: list[ArcRecord], version: int = 1, name: str = "made.arc") -> bytes:
    """An ARC file, version block first."""
    head = f"{version} 0 loomline\n{V1_FIELDS if version == 1 else V2_FIELDS}\n\n".encode()
    fields = " 200 - - 0 " + name if version == 2 else ""
    out = [f"filedesc://{name} 0.0.0.0 19960923142103 text/plain{fields} {len(head)}\n".encode(), head]
    for r in records:
        extra = f" {r.status or 200} - - 0 {name}" if version == 2 else ""
        out.append(f"{r.url} {r.ip} {r.date} {r.mime}{extra} {len(r.block)}\n".encode() + r.block + b"\n")
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file, without its version block."""
    at, version = 0, 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("a record line without an end")
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        last = line.rsplit(" ", 1)[-1]
        if not last.isdigit() or end + 1 + int(last) > len(data):
            raise ValueError(f"no length within the file in {line[:80]!r}")
        block, at = data[end + 1 : end + 1 + int(last)], end + 1 + int(last)
        if not version:
            if not line.startswith("filedesc://"):
                raise ValueError("no version block")
            version = int(block.split(b" ", 1)[0])
            if version not in (1, 2):
                raise ValueError(f"ARC version {version}")
            continue
        names = (V1_FIELDS if version == 1 else V2_FIELDS).split(" ")
        values = dict(zip(names, line.rsplit(" ", len(names) - 1), strict=True))  # a URL may hold spaces
        code = values.get("Result-code", "")
        yield ArcRecord(values["URL"], values["IP-address"], values["Archive-date"], values["Content-type"], block, int(code) if code.isdigit() else None, version)


def warc_date(date: str) -> str:
    """ISO 8601 from an ARC date of 14 digits, or of fewer."""
    digits = re.match(r"\d*", date)[0][:14]
    y, rest = digits[:4] or "1970", digits[4:]
    parts = [rest[i : i + 2] for i in range(0, 10, 2)]
    month, day, hour, minute, second = (p if len(p) == 2 else d for p, d in zip(parts, ("01", "01", "00", "00", "00"), strict=True))
    return f"{y:0>4}-{month}-{day}T{hour}:{minute}:{second}Z"


def warc_type(record: ArcRecord) -> str:
    return "response" if record.url.split(":", 1)[0].lower() in ("http", "https") or record.http else "resource"


def record_urn(source_id: int | None, nth: int, salt: bytes = b"record") -> str:
    """A version 8 UUID of record ``nth`` of a source: it holds the 64-bit source id and bits of a digest of place and ``salt``."""
    value = (source_id or 0) & (1 << 64) - 1
    # bits: 48 of the digest, 4 version (8), 1 whether there is no id, 9 zero, 2 top bits of the id, 2 variant, 62 of the id
    high = int.from_bytes(hashlib.sha256(b"%d " % nth + salt).digest()[:6], "big") << 16 | 8 << 12 | (source_id is None) << 11 | value >> 62
    low = 2 << 62 | value & (1 << 62) - 1
    return f"<urn:uuid:{uuid.UUID(int=high << 64 | low)}>"


def source_id(urn: str) -> int | None:
    """The source id that ``record_urn`` put in."""
    number = uuid.UUID(urn.strip("<>").removeprefix("urn:uuid:")).int
    high, low = number >> 64, number & (1 << 64) - 1
    if high >> 11 & 1:
        return None
    value = (high & 3) << 62 | low & (1 << 62) - 1
    return value - (1 << 64) if value >> 63 else value


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_record(record: ArcRecord, source: int | None, nth: int = 0, refers_to: str | None = None) -> bytes:
    """A record; ``refers_to``, the record id of another with the same payload, makes it a revisit."""
    revisits = refers_to is not None
    payload = record.payload
    kind = "revisit" if revisits else warc_type(record)
    block = record.block[: len(record.block) - len(payload)] if revisits else record.block
    mime = "application/http;msgtype=response" if record.http else record.mime
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_urn(source, nth)),
        ("WARC-Date", warc_date(record.date)),
        ("WARC-Target-URI", record.url),
        ("WARC-IP-Address", record.ip),
        ("WARC-Block-Digest", "sha1:" + digest32(block)),
        ("WARC-Payload-Digest", "sha1:" + digest32(payload)),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", mime),
        ("Content-Length", str(len(block))),
    ]
    if revisits:
        head[2:2] = [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", refers_to)]
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in head)
    return WARC_VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def warcinfo() -> bytes:
    block = b"software: loomline\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC-Type: warcinfo\r\nWARC-Record-ID: {record_urn(None, 0, block)}\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n"
    return WARC_VERSION + b"\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of each record of an uncompressed or gzipped WARC file."""
    stream = gzip.GzipFile(fileobj=BytesIO(data)) if data[:2] == b"\x1f\x8b" else BytesIO(data)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            head[name.strip()] = value.strip()
        size = int(head["Content-Length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record is cut off")
        yield head, block


# --- Spark ---


def frame_pages(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """(source_id, arc): one ARC file a row; even ids in version 1, odd ones in version 2."""
    columns = [F.col(id_col).cast("long").alias("source_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for i, url, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
                url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "http:///"
                made.append(arc_file([ArcRecord(url, "0.0.0.0", "19960923142103", "text/html", block)], 1 + (i or 0) % 2))
            yield pa.record_batch([batch.column(0), pa.array(made, pa.binary())], names=["source_id", "arc"])

    return pages.select(*columns).mapInArrow(run, "source_id long, arc binary")


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, arc) from ARC files, plain or gzipped, each read whole; the id is a hash of the file's place."""
    return spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("source_id"), F.col("content").alias("arc"))


def _records(arc: bytes, strict: bool = True) -> Iterator[ArcRecord]:
    try:
        yield from parse_arc(gzip.decompress(arc) if arc[:2] == b"\x1f\x8b" else arc)
    except (ValueError, EOFError, OSError):
        if strict:
            raise


def _digests(strict: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, nth, hashlib.sha256(r.payload).digest(), len(r.payload)) for i, arc in zip(*(c.to_pylist() for c in batch.columns), strict=True) for nth, r in enumerate(_records(arc, strict))]
            cols = zip(*rows, strict=True) if rows else ((), (), (), ())
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["source_id", "nth", "sha", "payload_bytes"])

    return run


def _split(strict: bool):
    """One ARC record a row, still as an ARC file, with its place and the digest that finds its verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places, keys, arcs = [], [], [], []
            for i, arc in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for nth, r in enumerate(_records(arc, strict)):
                    ids.append(i)
                    places.append(nth)
                    keys.append(hashlib.sha256(r.payload).digest())
                    arcs.append(arc_file([r], r.version))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(keys, pa.binary()), pa.array(arcs, pa.binary())], names=["source_id", "nth", "sha", "arc"])

    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of gzip members; each starts with a warcinfo record, so that every file does."""
    info = gzip.compress(warcinfo(), LEVEL, mtime=0)
    run, size = [info], len(info)
    for batch in batches:
        for i, nth, arc, again, first, place in zip(*(batch.column(c).to_pylist() for c in ("source_id", "nth", "arc", "again", "first_id", "first_nth")), strict=True):
            refers_to = record_urn(first, place) if again else None
            for r in _records(arc):
                run.append(gzip.compress(warc_record(r, i, nth, refers_to), LEVEL, mtime=0))
                size += len(run[-1])
            if size >= RUN_BYTES:
                yield pa.record_batch([pa.array([b"".join(run)], pa.binary())], names=["member"])
                run, size = [info], len(info)
    if len(run) > 1:
        yield pa.record_batch([pa.array([b"".join(run)], pa.binary())], names=["member"])


def revisits(arcs: DataFrame, min_revisit: int = 0, strict: bool = True) -> DataFrame:
    """(source_id, nth, sha, first_id, first_nth): the records that repeat an earlier payload, and which."""
    rows = materialise(arcs.mapInArrow(_digests(strict), "source_id long, nth int, sha binary, payload_bytes long"), "arc-digests")
    first = F.min(F.struct(F.col("source_id").isNull().alias("_null"), "source_id", "nth"))
    groups = rows.groupBy("sha", "payload_bytes").agg(first.alias("first"), F.count("*").alias("n"))
    groups = groups.filter(F.col("payload_bytes") >= min_revisit).filter("n > 1").select("sha", "n", F.col("first.source_id").alias("first_id"), F.col("first.nth").alias("first_nth"))
    found = attach_groups(rows, groups, "sha", "n", rows.count(), F.struct("source_id", "nth"))
    later = found.filter(F.col("n").isNotNull() & ~(F.col("source_id").eqNullSafe(F.col("first_id")) & (F.col("nth") == F.col("first_nth"))))
    return later.select("source_id", "nth", "sha", "first_id", "first_nth").distinct()


def convert(arcs: DataFrame, path: str, min_revisit: int = 0, strict: bool = True) -> None:
    """Write the records of (source_id, arc) rows as gzipped WARC archives to ``path``."""
    again = materialise(revisits(arcs, min_revisit, strict), "arc-revisits")
    again = again.select(F.col("source_id").alias("_id"), F.col("nth").alias("_nth"), F.col("sha").alias("_sha"), "first_id", "first_nth", F.lit(True).alias("again"))
    rows = arcs.mapInArrow(_split(strict), "source_id long, nth int, sha binary, arc binary")
    same: Column = F.col("source_id").eqNullSafe(F.col("_id")) & (F.col("nth") == F.col("_nth")) & (F.col("sha") == F.col("_sha"))
    known = rows.join(again, same, "left")
    members = known.select("source_id", "nth", "arc", "again", "first_id", "first_nth").mapInArrow(_members, "member binary")
    text = members.select(F.col("member").cast("string").alias("value"))  # bytes as they are
    text.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("maxRecordsPerFile", FILE_RUNS).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row a record, warcinfo left out: source_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's digest and length are computed anew and held against its header.
    """
    schema = "source_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        names = ["source_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for head, block in parse_warc(content.as_py()):
                    kind = head["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    size, digest = int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind != "revisit":
                        payload = ArcRecord("", "", "", "", block).payload
                        if (len(payload), digest32(payload)) != (size, digest):
                            raise ValueError(f"{head['WARC-Record-ID']}: payload and header differ")
                    of = head.get("WARC-Refers-To")
                    rows.append((source_id(head["WARC-Record-ID"]), size, digest, kind, source_id(of) if of else None))
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, schema)


def pages_to_warc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = 0) -> str:
    """Frame ``pages`` as ARC, convert, and return where the WARC archives are."""
    path = scratch_path(pages.sparkSession, "warc")
    convert(frame_pages(pages, id_col, url_col, payload_col), path, min_revisit)
    return path
