"""Tar and WARC shards as data sources: written with a commit, read by byte ranges.

``register`` makes five formats known to a session:

* ``tar_shards`` (write): a row is a sample, whose columns but the key are its parts.
* ``warc_shards`` (write): a row (url, html) is a response record, a gzip member of its own.
* ``token_shards`` (write): a row's token ids are a document, in a file of tokens with an index.
* ``array_shards`` (write): the numbers of a column's arrays as NumPy files, in one row or as tables of a fixed width.
* ``warc_records`` (read): (file, offset, length, type, url, content, error), a row a record.

Writers: each task writes shards of at most ``shardBytes`` under temporary names of its
own, so that attempts that are repeated or run twice don't meet.  The commit gives the
shards of the attempts that count their names, in the order of the partitions, then
writes ``_manifest.json`` (file, samples, bytes and SHA-256 of each shard) and last
``_SUCCESS``; whatever else lies under temporary names goes.  A failed job leaves
nothing.  Mode append goes on with the numbers, overwrite removes what was there once
all new shards are written.

Files are opened through Arrow, by path or by a URI that it knows (file, hdfs, s3, gs).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import tarfile
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .archives import read_index, token_index

#: Bytes of a shard, at most (unless one sample is larger), and of a range, about.
SHARD_BYTES, SPLIT_BYTES = 256 << 20, 64 << 20
#: Bytes that are read at a time.
CHUNK = 1 << 16

RECORDS = "file string, offset long, length long, type string, url string, content binary, error string"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]+:", path) else (fs.LocalFileSystem(), path)


def _files(files: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    """Shards in a folder, or the file itself; names that begin with _ or . are not shards."""
    info = files.get_file_info(folder)
    if info.type == fs.FileType.File:
        return [info]
    found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted((f for f in found if f.type == fs.FileType.File and f.base_name[0] not in "_."), key=lambda f: f.path)


# Writing
@dataclass
class Written(WriterCommitMessage):
    """A task's shards: samples, and (suffix, temporary path, bytes, SHA-256) of each of its files."""

    partition: int = 0
    shards: list[tuple[int, list[tuple[str, str, int, str]]]] = field(default_factory=list)


class _Shard:
    """One shard's file under its temporary name; what is written is counted and hashed on the way."""

    def __init__(self, files: fs.FileSystem, path: str, suffix: str):
        self.files, self.path, self.suffix, self.stream = files, path, suffix, files.open_output_stream(path)
        self.samples, self.bytes, self.hash = 0, 0, hashlib.sha256()

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.bytes += len(data)
        self.hash.update(data)

    def add(self, sample: bytes) -> None:
        self.write(sample)
        self.samples += 1

    def done(self, tail: bytes) -> tuple[int, list[tuple[str, str, int, str]]]:
        self.write(tail)
        self.stream.close()
        return self.samples, [(self.suffix, self.path, self.bytes, self.hash.hexdigest())]


class _IndexedShard(_Shard):
    """Tokens one after the other, and a second file that says where each document's are."""

    def __init__(self, files: fs.FileSystem, path: str, suffix: str):
        super().__init__(files, path, suffix)
        self.sizes: list[int] = []

    def add(self, sample: bytes) -> None:
        super().add(sample)
        self.sizes.append(len(sample))

    def done(self, tail: bytes) -> tuple[int, list[tuple[str, str, int, str]]]:
        samples, parts = super().done(tail)
        index = _Shard(self.files, f"{self.path}-idx", ".idx")
        index.write(token_index(np.array(self.sizes) // np.dtype(tail_kind(self.suffix)).itemsize, tail_kind(self.suffix)))
        return samples, parts + index.done(b"")[1]


class _ArrayShard(_Shard):
    """A NumPy file, whose head tells its length: what a shard holds is kept until it is full.  Rows of a fixed width are a table."""

    def __init__(self, files: fs.FileSystem, path: str, suffix: str, kind: str, width: int):
        super().__init__(files, path, suffix)
        self.held: list[bytes] = []
        self.kind, self.width = kind, width

    def add(self, sample: bytes) -> None:
        self.held.append(sample)
        self.samples += 1
        self.bytes += len(sample)

    def done(self, tail: bytes) -> tuple[int, list[tuple[str, str, int, str]]]:
        n, self.bytes, head = self.bytes // np.dtype(self.kind).itemsize, 0, io.BytesIO()
        shape = (self.samples, self.width) if self.width else (n,)
        np.lib.format.write_array_header_1_0(head, {"descr": self.kind, "fortran_order": False, "shape": shape})
        for part in (head.getvalue(), *self.held):
            self.write(part)
        return super().done(tail)


class ShardWriter(DataSourceArrowWriter):
    """Writes samples that ``encode`` makes of batches; ``tail`` ends a shard."""

    suffix, tail, shard = "", b"", _Shard

    def new_shard(self, files: fs.FileSystem, path: str) -> _Shard:
        return self.shard(files, path, self.suffix)

    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.overwrite = options["path"].rstrip("/"), overwrite
        self.limit = int(options.get("shardbytes", SHARD_BYTES))
        self.job = f"{self.folder}/_temporary-{uuid.uuid4().hex}"

    def encode(self, batch: pa.RecordBatch) -> Iterator[bytes]:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, folder = _open(self.job)
        files.create_dir(folder, recursive=True)
        attempt, shard, out = uuid.uuid4().hex, None, Written(TaskContext.get().partitionId())
        for batch in iterator:
            for sample in self.encode(batch):
                if shard and shard.bytes + len(sample) + len(self.tail) > self.limit:
                    out.shards.append(shard.done(self.tail))
                    shard = None
                shard = shard or self.new_shard(files, f"{folder}/{attempt}-{len(out.shards)}")
                shard.add(sample)
        if shard:
            out.shards.append(shard.done(self.tail))
        return out

    def commit(self, messages: list[Written | None]) -> None:
        files, folder = _open(self.folder)
        files.create_dir(folder, recursive=True)
        old = _files(files, folder)
        known = [] if self.overwrite else self._manifest(files, folder)
        first = 0 if self.overwrite else 1 + max((int(n[1]) for f in old if (n := re.search(r"shard-(\d+)", f.base_name))), default=-1)
        for f in old if self.overwrite else ():
            files.delete_file(f.path)
        shards = [s for m in sorted((m for m in messages if m), key=lambda m: m.partition) for s in m.shards]
        for number, (samples, parts) in enumerate(shards, first):
            for suffix, path, size, digest in parts:
                name = f"shard-{number:07d}{suffix}"
                files.move(path, f"{folder}/{name}")
                known.append({"file": name, "samples": samples, "bytes": size, "sha256": digest})
        for name, text in (("_manifest.json", json.dumps({"shards": known}, indent=1)), ("_SUCCESS", "")):
            with files.open_output_stream(f"{folder}/{name}") as out:
                out.write(text.encode())
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        files, folder = _open(self.job)
        if files.get_file_info(folder).type == fs.FileType.Directory:
            files.delete_dir(folder)

    @staticmethod
    def _manifest(files: fs.FileSystem, folder: str) -> list[dict]:
        if files.get_file_info(f"{folder}/_manifest.json").type != fs.FileType.File:
            return []
        with files.open_input_stream(f"{folder}/_manifest.json") as stream:
            return json.loads(stream.read())["shards"]


class TarWriter(ShardWriter):
    """Samples as files ``key.part``; a null part is left out.

    A key must not be null or end in a component with a dot, which would be read back as another key.
    """

    suffix, tail = ".tar", bytes(1024)

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        super().__init__(options, overwrite)
        self.key = options.get("keycolumn", "key")
        self.parts = [f.name for f in schema if f.name != self.key]
        wrong = [f.name for f in schema if f.dataType.simpleString() not in ("string", "binary")]
        if wrong or self.key not in schema.names:
            raise ValueError(f"a sample has string or binary columns and a column {self.key}: {wrong}")

    def encode(self, batch: pa.RecordBatch) -> Iterator[bytes]:
        columns = [batch.column(batch.schema.get_field_index(name)) for name in (self.key, *self.parts)]
        for key, *values in zip(*columns, strict=True):
            key = key.as_py()
            if not key or "." in key.rpartition("/")[2]:
                raise ValueError(f"no key of a sample: {key!r}")
            out = io.BytesIO()
            with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as tar:
                for part, value in zip(self.parts, values, strict=True):
                    if (value := value.as_py()) is not None:
                        data = value.encode() if isinstance(value, str) else value
                        member = tarfile.TarInfo(f"{key}.{part}")
                        member.size = len(data)
                        tar.addfile(member, io.BytesIO(data))
                end = tar.offset  # before the archive's own end
            yield out.getvalue()[:end]


def response_record(url: str | None, html: str | bytes | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A WARC response; its id follows from its URL and payload."""
    body = (html.encode() if isinstance(html, str) else html) or b""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
    fields = {"WARC-Type": "response", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url}#{digest}')}>", "WARC-Date": date, "WARC-Target-URI": url, "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


class WarcWriter(ShardWriter):
    suffix = ".warc.gz"

    def encode(self, batch: pa.RecordBatch) -> Iterator[bytes]:
        for url, html in zip(*[batch.column(batch.schema.get_field_index(n)) for n in ("url", "html")], strict=True):
            yield gzip.compress(response_record(url.as_py(), html.as_py()), 6, mtime=0)


class TokenWriter(ShardWriter):
    """Documents' token ids one after the other, of 16 bits (``u16``) or 32 (``i32``), with an index; an id that doesn't fit is an error."""

    shard = _IndexedShard

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        super().__init__(options, overwrite)
        self.column, self.kind = options.get("idscolumn", "ids"), options.get("kind", "<u2")
        self.suffix = SUFFIXES[self.kind]
        if schema[self.column].dataType.simpleString() not in ("array<int>", "array<bigint>"):
            raise ValueError(f"token ids are an array of integers: {self.column}")

    def encode(self, batch: pa.RecordBatch) -> Iterator[bytes]:
        limit = np.iinfo(self.kind)
        for ids in batch.column(batch.schema.get_field_index(self.column)):
            tokens = np.asarray(ids.values.to_numpy(zero_copy_only=False) if ids.is_valid else [], dtype=np.int64)
            if len(tokens) and (tokens.min() < limit.min or tokens.max() > limit.max):
                raise ValueError("a token doesn't fit the type")
            yield tokens.astype(self.kind).tobytes()


class ArrayWriter(TokenWriter):
    """Numbers of a column's arrays as NumPy files: all in one row, or a table of rows of ``width`` numbers, where another length is an error."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        super().__init__(options, schema, overwrite)
        self.width, self.suffix = int(options.get("width", 0)), ".npy"

    def new_shard(self, files: fs.FileSystem, path: str) -> _ArrayShard:
        return _ArrayShard(files, path, self.suffix, self.kind, self.width)

    def encode(self, batch: pa.RecordBatch) -> Iterator[bytes]:
        for data in super().encode(batch):
            if self.width and len(data) != self.width * np.dtype(self.kind).itemsize:
                raise ValueError(f"a row isn't {self.width} wide")
            yield data


SUFFIXES = {"<u2": ".u16.bin", "<i4": ".i32.bin"}


def tail_kind(suffix: str) -> str:
    return next(kind for kind, name in SUFFIXES.items() if name == suffix)


# Reading
@dataclass
class Range(InputPartition):
    """Records that begin from ``start`` on and before ``end``."""

    file: str
    start: int
    end: int

    def __post_init__(self) -> None:
        super().__init__(None)


def parsed(record: bytes) -> tuple[str | None, str | None, bytes]:
    """(type, URL, block) of one WARC record."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    if not record.startswith(b"WARC/") or not gap:
        raise ValueError("no WARC record")
    named = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        named[name.strip().lower()] = value.strip()
    size = int(named["content-length"])
    if len(rest) < size:
        raise ValueError(f"{len(rest)} of {size} bytes")
    return named.get("warc-type"), named.get("warc-target-uri"), rest[:size]


def _inflated(file, at: int) -> tuple[bytes, int]:
    """(content, length) of the gzip member at a place."""
    file.seek(at)
    inflate, out, read = zlib.decompressobj(31), [], 0
    while not inflate.eof:
        data = file.read(CHUNK)
        if not data:
            raise EOFError("the file ends within a record")
        read += len(data)
        out.append(inflate.decompress(data))
        if out[0] and not out[0].startswith(b"WARC/"[: len(out[0])]):
            raise ValueError("no WARC record")
    return b"".join(out), read - len(inflate.unused_data)


def _begins(file, at: int) -> bool:
    """Whether a gzip member with a WARC record begins at a place."""
    file.seek(at)
    try:
        return zlib.decompressobj(31).decompress(file.read(512), 5) == b"WARC/"
    except zlib.error:
        return False


def _next_member(file, at: int, size: int) -> int:
    """The first place from ``at`` on where a member begins, or the file's end."""
    if at < size and _begins(file, at):
        return at
    for start in range(at, size, CHUNK):
        file.seek(start)
        held = file.read(CHUNK + 2)
        place = held.find(b"\x1f\x8b\x08")
        while place >= 0:
            if _begins(file, start + place):
                return start + place
            place = held.find(b"\x1f\x8b\x08", place + 1)
    return size


def _compressed(file, part: Range, size: int) -> Iterator[tuple]:
    """(offset, length, record, error) of the members that begin in a range; what lies behind one that is no member is a row with its error, too."""
    at = _next_member(file, part.start, size)
    if part.start == 0 < at:
        yield 0, at, None, "no WARC record"
    while at < min(part.end, size):
        try:
            record, length = _inflated(file, at)
            yield at, length, record, None
            behind = at + length
            at = _next_member(file, behind, size)
            if at > behind:
                yield behind, at - behind, None, "no WARC record"
        except (zlib.error, EOFError, ValueError) as error:
            behind = _next_member(file, at + 1, size)
            yield at, behind - at, None, str(error) or type(error).__name__
            at = behind


def _plain(file, size: int) -> Iterator[tuple]:
    """(offset, length, record, error) of an uncompressed file, a record at a time; after a damaged one reading goes on at the next ``WARC/`` behind an empty line."""
    at = 0
    while at < size:
        file.seek(at)
        head = b""
        while b"\r\n\r\n" not in head and (data := file.read(CHUNK)):
            head += data
        named = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)\s*\r\n", head.partition(b"\r\n\r\n")[0] + b"\r\n")
        if head.startswith(b"WARC/") and named:
            length = head.index(b"\r\n\r\n") + 4 + int(named[1])
            file.seek(at)
            record = file.read(length)
            file.seek(at + length)
            length += len(re.match(rb"(\r\n){0,2}", file.read(4))[0])
            yield (at, len(record), None, "the file ends within a record") if len(record) < length - 4 else (at, length, record, None)
        else:
            after, length = at + 1, None
            while length is None:
                file.seek(after)
                data = file.read(CHUNK + 8)
                place = data.find(b"\r\n\r\nWARC/")
                length = after + place + 4 - at if place >= 0 else size - at if after + CHUNK >= size else None
                after += CHUNK
            yield at, length, None, "no WARC record"
        at += max(1, length)


class WarcReader(DataSourceReader):
    """Each task reads the records that begin in its range, one at a time.

    A file with a member a record (.gz) is cut into ranges of ``splitBytes``; a record belongs to the range that it
    begins in.  A file that isn't compressed has no marks that a payload couldn't hold, so it is one range.  A
    compressed payload that is itself such an archive, stored as it is, may be taken for records where a range begins
    within it; ``fetch`` with an index is exact for those, too.
    """

    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitbytes", SPLIT_BYTES))
        self.types, self.named = (set(json.loads(options[k])) if k in options else None for k in ("types", "files"))

    def partitions(self) -> list[Range]:
        files, folder = _open(self.path)
        out = []
        for f in _files(files, folder):
            if self.named is None or f.path in self.named:
                cuts = range(0, f.size, self.split) if f.path.endswith(".gz") else range(0, min(f.size, 1))
                out += [Range(f.path, a, a + self.split if f.path.endswith(".gz") else f.size) for a in cuts]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.file:
            return
        files, _ = _open(self.path)
        with files.open_input_file(partition.file) as file:
            size = file.size()
            for offset, length, record, error in _compressed(file, partition, size) if partition.file.endswith(".gz") else _plain(file, size):
                kind = url = block = None
                if not error:
                    try:
                        kind, url, block = parsed(record)
                    except (ValueError, KeyError) as wrong:
                        error = str(wrong)
                if self.types is None or kind in self.types:
                    yield partition.file, offset, length, kind, url, block, error


class TarShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tar_shards"

    def writer(self, schema: StructType, overwrite: bool) -> TarWriter:
        return TarWriter(dict(self.options), schema, overwrite)


class WarcShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc_shards"

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


class TokenShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "token_shards"

    def writer(self, schema: StructType, overwrite: bool) -> TokenWriter:
        return TokenWriter(dict(self.options), schema, overwrite)


class ArrayShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "array_shards"

    def writer(self, schema: StructType, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(dict(self.options), schema, overwrite)


class WarcRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc_records"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options))


def register(spark: SparkSession) -> None:
    for source in (TarShards, WarcShards, TokenShards, ArrayShards, WarcRecords):
        spark.dataSource.register(source)


def write_tar(rows: DataFrame, path: str, shard_bytes: int = SHARD_BYTES, key: str = "key", mode: str = "append") -> None:
    """Samples as tar shards.  Rows go to the shards in their order, so nothing is shuffled."""
    register(rows.sparkSession)
    rows.write.format("tar_shards").option("shardBytes", shard_bytes).option("keyColumn", key).mode(mode).save(path)


def write_tokens(rows: DataFrame, path: str, shard_bytes: int = SHARD_BYTES, kind: str = "<u2", ids: str = "ids", mode: str = "append") -> None:
    """Documents' token ids as indexed shards, in the order of the rows; a null is a document without tokens."""
    register(rows.sparkSession)
    rows.write.format("token_shards").option("shardBytes", shard_bytes).option("idsColumn", ids).option("kind", kind).mode(mode).save(path)


def write_arrays(rows: DataFrame, path: str, width: int = 0, shard_bytes: int = SHARD_BYTES, kind: str = "<u2", column: str = "ids", mode: str = "append") -> None:
    """A column of arrays as NumPy files, in the order of the rows: one after the other, or as rows of ``width`` numbers."""
    register(rows.sparkSession)
    rows.write.format("array_shards").option("shardBytes", shard_bytes).option("idsColumn", column).option("kind", kind).option("width", width).mode(mode).save(path)


def token_places(spark: SparkSession, path: str) -> DataFrame:
    """(file, document, offset, tokens, kind) of all documents of indexed shards, from their indexes alone: ``fetch_tokens`` reads any of them."""
    kinds = [("file", pa.string()), ("document", pa.int64()), ("offset", pa.int64()), ("tokens", pa.int64()), ("kind", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                kind, sizes, offsets = read_index(content.as_py())
                file = re.sub(r"\.idx$", SUFFIXES[kind], re.sub("^file:/*", "/", name.as_py()))
                cols = [pa.array([file] * len(sizes)), pa.array(np.arange(len(sizes))), pa.array(offsets), pa.array(sizes.astype(np.int64)), pa.array([kind] * len(sizes))]
                yield pa.record_batch([c.cast(k) for c, (_, k) in zip(cols, kinds, strict=True)], names=[n for n, _ in kinds])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.idx").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, document long, offset long, tokens long, kind string")


def fetch_tokens(places: DataFrame) -> DataFrame:
    """``places`` with ``ids``: each document's bytes alone are read, files stay open for the rows that follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, stream = None, None
        for batch in batches:
            for i, (path, offset, n, kind) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("file", "offset", "tokens", "kind")], strict=True)):
                if path != name:
                    files, place = _open(path)
                    name, stream = path, files.open_input_file(place)
                stream.seek(offset)
                data = stream.read(n * np.dtype(kind).itemsize)
                if len(data) < n * np.dtype(kind).itemsize:
                    raise EOFError(f"{path} ends within a document")
                ids = pa.array([np.frombuffer(data, kind).astype(np.int32)], pa.list_(pa.int32()))
                yield pa.record_batch([*batch.slice(i, 1).columns, ids], names=["file", "document", "offset", "tokens", "kind", "ids"])

    return places.select("file", "document", "offset", "tokens", "kind").mapInArrow(run, "file string, document long, offset long, tokens long, kind string, ids array<int>")


def verified(spark: SparkSession, path: str) -> DataFrame:
    """(file, problem): each shard of the manifest against its bytes; the problem is null, missing, size or digest.  Files are read a chunk at a time."""
    files, folder = _open(path)
    known = [(f"{path}/{s['file']}", s["bytes"], s["sha256"]) for s in ShardWriter._manifest(files, folder)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            problems = []
            for name, size, digest in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                store, place = _open(name)
                info = store.get_file_info(place)
                problem = "missing" if info.type != fs.FileType.File else "size" if info.size != size else None
                if not problem:
                    found = hashlib.sha256()
                    with store.open_input_stream(place) as stream:
                        while data := stream.read(1 << 20):
                            found.update(data)
                    problem = None if found.hexdigest() == digest else "digest"
                problems.append(problem)
            yield pa.record_batch([batch.column(0), pa.array(problems, pa.string())], names=["file", "problem"])

    rows = spark.createDataFrame(known, "file string, bytes long, sha256 string")
    return rows.repartition(max(1, min(len(known), spark.sparkContext.defaultParallelism)), "file").mapInArrow(run, "file string, problem string")


def write_warc(pages: DataFrame, path: str, shard_bytes: int = SHARD_BYTES, mode: str = "append") -> None:
    """(url, html) rows as WARC shards; a null page is an empty one, a null URL is left out."""
    register(pages.sparkSession)
    pages.select("url", "html").write.format("warc_shards").option("shardBytes", shard_bytes).mode(mode).save(path)


def read_warc(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, types: list[str] | None = None, files: list[str] | None = None) -> DataFrame:
    """``RECORDS`` of the archives in a folder; of ``files`` only, no other being opened, and records of ``types`` only, damage being of none.

    These are options and no filters that Spark pushes down: what Spark 4.1 pushes to a Python source stays with the
    loaded table, so that another query on it would miss rows.
    """
    register(spark)
    reader = spark.read.format("warc_records").option("splitBytes", split_bytes)
    for name, values in (("types", types), ("files", files)):
        reader = reader if values is None else reader.option(name, json.dumps(values))
    return reader.load(path)


def fetch(index: DataFrame) -> DataFrame:
    """``RECORDS`` of an index of (file, offset, length): each range alone is read, in the order of the index's rows; whatever is wrong with one is its error.

    A file that is open stays so for the ranges that follow, so an index is best ordered by file and offset.
    """
    kinds = [("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("url", pa.string()), ("content", pa.binary()), ("error", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, stream = None, None
        for batch in batches:
            for path, offset, length in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                kind = url = block = error = None
                try:
                    if path != name:
                        files, place = _open(path)
                        name, stream = path, files.open_input_file(place)
                    stream.seek(offset)
                    data = stream.read(length)
                    if len(data) < length:
                        raise EOFError(f"{len(data)} of {length} bytes")
                    kind, url, block = parsed(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)
                except (OSError, EOFError, zlib.error, ValueError, KeyError, TypeError, AttributeError) as wrong:
                    error = str(wrong) or type(wrong).__name__
                yield pa.record_batch([pa.array([v], k) for v, (_, k) in zip((path, offset, length, kind, url, block, error), kinds, strict=True)], names=[n for n, _ in kinds])

    return index.select("file", F.col("offset").cast("long"), F.col("length").cast("long")).mapInArrow(run, RECORDS)
