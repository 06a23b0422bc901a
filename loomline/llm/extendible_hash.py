"""Exact deduplication by an extendible-hash index on shared files.

1. The 64-bit hash of a text is its address.  Row counts by the address's first
   bits say where the directory must double: a bucket with over ``capacity`` rows
   splits by one more bit, which doubles the directory when the bucket was as deep
   as the directory.  Counts are taken ``STEP`` bits at a time at most and only for
   buckets that are still overfull, until none is or all 64 bits are used up (rows
   of one address can't be split; they are copies of one text, or collide).
2. Copies that meet in one task are combined before anything moves: one entry a
   distinct text, with its number of rows and largest id.  Texts met more than once
   are held on while the rest is handed on, so a text that many rows hold goes out
   about once a task.
3. Owner tasks process key ranges: buckets next to each other, of as many bytes in
   all as the session advises for a shuffle partition.  An owner reads its entries by address and keeps a chain
   for the address at hand, comparing bytes along the chain, so that two texts count
   as equal only if all their bytes are.
4. Owners write their buckets to files in the shared folder: a row an address with
   its chain.  All documents then look up their address in that index and find their
   text's entry along the chain.

A null text counts as empty.  Rows with a null id take part; a group of which
every id is null has a null ``keep_id``.  A row repeated with the same id counts
each time in ``group_size`` and shares the verdict.  Only id and text are read, so
other columns may have any name.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grouping import attach_groups
from .scratch import materialise

#: Bits of the address by which overfull buckets are counted at a time, at most.
STEP = 14
#: Rows a bucket holds before it splits.
CAPACITY = 4096
#: Owners, at most, about.
MAX_OWNERS = 100_000
#: Entries are handed on when they hold so many bytes.
FLUSH_BYTES = 16 << 20

ENTRY = "owner int, address long, sha binary, text binary, last_id long, members long"
INDEX = "address long, chain array<struct<text_sha256:string,keep_id:long,group_size:long>>, members long"


class Directory:
    """Buckets as ranges of the address, in order: (local depth, first bits) each.

    A directory of global depth g would have 2**g slots, of which a bucket of local
    depth d fills 2**(g - d) next to each other; the ranges stand for these slots.
    """

    def __init__(self) -> None:
        self.buckets: list[tuple[int, int]] = [(0, 0)]
        self.sizes: list[tuple[int, int]] = [(0, 0)]

    def overfull(self, capacity: int) -> list[int]:
        return [i for i, ((depth, _), (rows, _)) in enumerate(zip(self.buckets, self.sizes, strict=True)) if rows > capacity and depth < 64]

    def split(self, counts: dict[tuple[int, int], tuple[int, int]], to: dict[tuple[int, int], int], capacity: int) -> None:
        """Split the overfull buckets ``to`` such a depth, until none is overfull.  ``counts``: (rows, bytes) by (depth, first bits)."""
        below: dict[tuple[int, int], tuple[int, int]] = {}
        roots = {depth: min(local for (local, _), d in to.items() if d == depth) for depth in to.values()}
        for (depth, prefix), (rows, size) in counts.items():
            for up in range(depth - roots[depth] + 1):
                r, s = below.get((depth - up, prefix >> up), (0, 0))
                below[depth - up, prefix >> up] = (r + rows, s + size)
        buckets, sizes = [], []
        for bucket, has in zip(self.buckets, self.sizes, strict=True):
            todo, depth = [bucket], to.get(bucket)
            while todo:
                at = todo.pop()
                rows = has if depth is None else below.get(at, (0, 0))
                if depth is not None and at[0] < depth and rows[0] > capacity:
                    todo += [(at[0] + 1, at[1] * 2 + 1), (at[0] + 1, at[1] * 2)]
                else:
                    buckets.append(at)
                    sizes.append(rows)
        self.buckets, self.sizes = buckets, sizes

    @property
    def depth(self) -> int:
        return max(depth for depth, _ in self.buckets)

    def starts(self) -> np.ndarray:
        """The first address of each bucket."""
        return np.array([prefix << (64 - depth) for depth, prefix in self.buckets], dtype=np.uint64)

    def owners(self, most: int) -> np.ndarray:
        """The owner of each bucket: runs of buckets that hold about ``most`` bytes."""
        ends = np.cumsum([size for _, size in self.sizes])
        return np.unique((ends - 1).clip(0) // max(most, ends[-1] // MAX_OWNERS, 1), return_inverse=True)[1]


def directory(addresses: DataFrame, capacity: int) -> Directory:
    """The directory for (address, size) rows.

    Each round counts overfull buckets by as many further bits as their rows need,
    so about as many counts reach the driver as there are buckets.
    """
    found = Directory()
    found.sizes = [tuple(addresses.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first())]
    while full := found.overfull(capacity):
        rounds: dict[tuple[int, int], list[int]] = {}
        for i in full:
            local, prefix = found.buckets[i]
            needed = math.ceil(math.log2(found.sizes[i][0] / capacity)) + 1
            rounds.setdefault((local, min(64, local + min(STEP, needed))), []).append(prefix)
        counts: dict[tuple[int, int], tuple[int, int]] = {}
        for (local, depth), prefixes in rounds.items():
            inside = addresses.filter(_bits(local).isin(prefixes)) if local else addresses
            by_bits = inside.groupBy(_bits(depth).alias("bits")).agg(F.count("*").alias("n"), F.sum("size").alias("size"))
            counts |= {(depth, r.bits & (1 << depth) - 1): (r.n, r["size"]) for r in by_bits.toLocalIterator()}
        found.split(counts, {(local, prefix): depth for (local, depth), prefixes in rounds.items() for prefix in prefixes}, capacity)
    return found


def _bits(depth: int) -> Column:
    return F.shiftrightunsigned("address", 64 - depth) if depth < 64 else F.col("address")


def _entries(starts: np.ndarray, owners: np.ndarray):
    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        size = 0

        def flush(keys: list[tuple]) -> pa.RecordBatch:
            addresses = np.array([a for a, _ in keys], dtype=np.int64)
            mine = owners[np.searchsorted(starts, addresses.view(np.uint64), side="right") - 1]
            entries = [held.pop(k) for k in keys]
            return pa.record_batch(
                [
                    pa.array(mine.astype(np.int32)),
                    pa.array(addresses),
                    pa.array([s for _, s in keys], pa.binary()),
                    pa.array([e[0] for e in entries], pa.binary()),
                    pa.array([e[1] for e in entries], pa.int64()),
                    pa.array([e[2] for e in entries], pa.int64()),
                ],
                names=["owner", "address", "sha", "text", "last_id", "members"],
            )

        for batch in batches:
            for doc, address, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "address", "text")), strict=True):
                key = (address, hashlib.sha256(text).digest())
                entry = held.get(key)
                if entry is None:
                    held[key] = [text, doc, 1]
                    size += len(text) + 200
                elif entry[0] == text:
                    entry[1] = doc if entry[1] is None else entry[1] if doc is None else max(entry[1], doc)
                    entry[2] += 1
                else:
                    raise ValueError("two texts share a SHA-256 digest")
                if size > FLUSH_BYTES:
                    yield flush([k for k, e in held.items() if e[2] == 1])
                    size = sum(len(e[0]) + 200 for e in held.values())
                    if size > FLUSH_BYTES // 2:
                        yield flush([*held])
                        size = 0
        if held:
            yield flush([*held])

    return combine


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A key range in order of address; holds the chain of one address."""
    at: int | None = None
    chain: list[list] = []
    done: list[tuple] = []

    def close() -> None:
        found = [{"text_sha256": sha.hex(), "keep_id": last, "group_size": n} for _, sha, last, n in chain]
        done.append((at, found, sum(n for *_, n in chain)))
        chain.clear()

    def packed() -> pa.RecordBatch:
        links = pa.list_(pa.struct([("text_sha256", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())]))
        out = pa.record_batch([pa.array(c, k) for c, k in zip(zip(*done, strict=True), (pa.int64(), links, pa.int64()), strict=True)], names=["address", "chain", "members"])
        done.clear()
        return out

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("address", "sha", "text", "last_id", "members")]
        for address, sha, text, last, n in zip(*cols, strict=True):
            if address != at:
                if chain:
                    close()
                at = address
            for entry in chain:
                if entry[0] == text:
                    entry[2] = last if entry[2] is None else entry[2] if last is None else max(entry[2], last)
                    entry[3] += n
                    break
            else:
                chain.append([text, sha, last, n])
        if done:
            yield packed()
    if chain:
        close()
    if done:
        yield packed()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The index (``INDEX``), written to the shared folder: a row an address, the chain in order of first entry."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("address"), text.cast("binary").alias("text"))
    addresses = materialise(keyed.select("address", F.octet_length("text").cast("long").alias("size")), "extendible-addresses")
    buckets = directory(addresses, capacity)
    advised = docs.sparkSession._jsparkSession.sessionState().conf().getConfString("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64m")
    owners = buckets.owners(docs.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(advised))
    entries = keyed.mapInArrow(_entries(buckets.starts(), owners), ENTRY)
    owned = entries.repartitionById(int(owners.max()) + 1, "owner").sortWithinPartitions("address")
    return materialise(owned.select("address", "sha", "text", "last_id", "members").mapInArrow(_own, INDEX), "extendible-hash")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """A row a document: doc_id, keep_id, group_size, kept, text_sha256."""
    index = build_index(docs, id_col, text_col, capacity)
    total = index.agg(F.sum("members")).first()[0] or 0
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("address"), F.sha2(text, 256).alias("text_sha256"))
    found = attach_groups(rows, index, "address", "members", total, F.col("doc_id"))
    entry = F.filter("chain", lambda x: x["text_sha256"] == F.col("text_sha256"))[0]
    found = found.select("doc_id", "text_sha256", entry.alias("entry"))
    keep = F.col("entry.keep_id")
    return found.select("doc_id", keep.alias("keep_id"), F.col("entry.group_size").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")
