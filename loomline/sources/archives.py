"""Archives as tables: WARC responses, tar members, indexed token files.

Files are read by Spark's ``binaryFile`` source, so each must fit in a task's memory; a
damaged one gives a row with its error instead of failing the job.
"""

from __future__ import annotations

import gzip
import io
import re
import struct
import tarfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _responses(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(URL, HTTP message) of a WARC file's responses."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record")
        head = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        block = stream.read(int(head["content-length"]))
        if head.get("warc-type") == "response":
            yield head.get("warc-target-uri", ""), block


def html_of(message: bytes) -> str:
    """The body of an HTTP message as text: by the charset of its header, else of a meta tag, else UTF-8 and then Latin-1."""
    head, _, body = message.partition(b"\r\n\r\n")
    named = re.search(rb"(?i)content-type:[^\r\n]*charset=[\"']?([\w-]+)", head) or re.search(rb"(?i)<meta[^>]+charset=[\"']?([\w-]+)", body)
    for charset in ([named[1].decode()] if named else []) + ["utf-8"]:
        try:
            return body.decode(charset)
        except (UnicodeDecodeError, LookupError):
            continue
    return body.decode("latin-1")


def warc_html(spark: SparkSession, path: str, first_only: bool = False) -> DataFrame:
    """(file, nth, url, html, error) of the responses in WARC files, or the first of each; a damaged file ends with a row of its error."""
    names = ["file", "nth", "url", "html", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, nth = [], -1
                try:
                    for nth, (url, message) in enumerate(_responses(content.as_py())):
                        rows.append((file.as_py(), nth, url, html_of(message), None))
                        if first_only:
                            break
                except (ValueError, KeyError, EOFError, OSError) as error:
                    rows.append((file.as_py(), nth + 1, None, None, str(error) or type(error).__name__))
                if rows:
                    kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, nth int, url string, html string, error string")


def tar_members(spark: SparkSession, path: str) -> DataFrame:
    """(file, key, part, content, error) of tar files: a member's name is cut at the first dot of its last component into key and part."""
    kinds = {"file": pa.string(), "key": pa.string(), "part": pa.string(), "content": pa.binary(), "error": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = []
                try:
                    with tarfile.open(fileobj=io.BytesIO(content.as_py())) as tar:
                        for member in tar:
                            if member.isfile():
                                folder, _, name = member.name.rpartition("/")
                                stem, _, part = name.partition(".")
                                rows.append((file.as_py(), f"{folder}/{stem}" if folder else stem, part, tar.extractfile(member).read(), None))
                except (tarfile.TarError, EOFError, OSError) as error:
                    rows.append((file.as_py(), None, None, None, str(error) or type(error).__name__))
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, key string, part string, content binary, error string")


def samples(members: DataFrame, parts: list[str]) -> tuple[DataFrame, DataFrame]:
    """(complete, incomplete): a row a key with a column a part, and the keys that lack one."""
    wide = members.filter("key is not null").groupBy("file", "key").agg(*[F.max(F.when(F.col("part") == p, F.col("content"))).alias(p) for p in parts])
    has_all = F.lit(True)
    for p in parts:
        has_all = has_all & F.col(p).isNotNull()
    return wide.filter(has_all), wide.filter(~has_all).select("file", "key")


def images_by_url(members: DataFrame, image: str = "jpg", description: str = "json") -> DataFrame:
    """(url, content) of the images whose description says that they were fetched."""
    whole, _ = samples(members, [image, description])
    said = F.from_json(F.col(description).cast("string"), "struct<url:string,status:string>")
    return whole.select(said["url"].alias("url"), F.col(image).alias("content"), said["status"].alias("status")).filter("status = 'success'").drop("status")


# Fixed values of the indexed token format.
INDEX_MAGIC = b"MMIDIDX\x00\x00"
TOKEN_CODES = {"<u2": 8, "<i4": 4}


def token_index(sizes: np.ndarray, kind: str = "<u2") -> bytes:
    """The index of documents of these numbers of tokens, one after the other."""
    sizes = np.asarray(sizes).astype("<i4")
    pointers = np.concatenate([[0], np.cumsum(sizes[:-1].astype("<i8"))])[: len(sizes)] * np.dtype(kind).itemsize
    head = INDEX_MAGIC + struct.pack("<QBQQ", 1, TOKEN_CODES[kind], len(sizes), len(sizes) + 1)
    return head + sizes.tobytes() + pointers.astype("<i8").tobytes() + np.arange(len(sizes) + 1, dtype="<i8").tobytes()


def read_index(index: bytes) -> tuple[str, np.ndarray, np.ndarray]:
    """(type, tokens, offsets in bytes) of an index's documents."""
    if index[:9] != INDEX_MAGIC:
        raise ValueError("no token index")
    _, code, n, _ = struct.unpack_from("<QBQQ", index, 9)
    kind = next(k for k, c in TOKEN_CODES.items() if c == code)
    return kind, np.frombuffer(index, "<i4", n, 34), np.frombuffer(index, "<i8", n, 34 + 4 * n)


def indexed_tokens(documents: list[np.ndarray], kind: str = "<u2") -> tuple[bytes, bytes]:
    """(data, index) of token documents; a token that the type can't hold is an error."""
    limit = np.iinfo(kind)
    if any(len(d) and (d.min() < limit.min or d.max() > limit.max) for d in documents):
        raise ValueError("a token doesn't fit the type")
    return b"".join(d.astype(kind).tobytes() for d in documents), token_index(np.array([len(d) for d in documents], "<i4"), kind)


def tokens_at(data: bytes, index: bytes, document: int, offset: int = 0, length: int | None = None) -> np.ndarray:
    """Tokens of a document from ``offset`` on."""
    kind, sizes, pointers = read_index(index)
    count = sizes[document] - offset if length is None else min(length, sizes[document] - offset)
    return np.frombuffer(data, kind, max(0, count), pointers[document] + offset * np.dtype(kind).itemsize)


def indexed_shards(shards: DataFrame, kind: str = "<u2", id_col: str = "doc_id") -> DataFrame:
    """(shard, data, index) of (shard, id, start, ids) rows: each shard's documents in order, which are bounded by the shard's size."""
    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("start")
        data, index = indexed_tokens([np.array(x.as_py(), dtype=np.int64) for x in table["ids"]], kind)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([data], pa.binary()), "index": pa.array([index], pa.binary())})

    return shards.groupBy("shard").applyInArrow(pack, "shard long, data binary, index binary")


def array_shards(shards: DataFrame) -> DataFrame:
    """(shard, npy): each shard's tokens as the bytes of a one-dimensional NumPy file of 16-bit numbers; a larger token is an error."""
    def pack(key: tuple, table: pa.Table) -> pa.Table:
        tokens = np.concatenate([np.array(x.as_py(), dtype=np.int64) for x in table.sort_by("start")["ids"]])
        if tokens.max(initial=0) > np.iinfo(np.uint16).max or tokens.min(initial=0) < 0:
            raise ValueError("a token doesn't fit 16 bits")
        out = io.BytesIO()
        np.save(out, tokens.astype("<u2"))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "npy": pa.array([out.getvalue()], pa.binary())})

    return shards.groupBy("shard").applyInArrow(pack, "shard long, npy binary")
