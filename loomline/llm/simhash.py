"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints.  A-Z are lower-cased, words are runs of bytes other than space and
\\x09-\\x0D, shingles are ``width`` words joined by single spaces, repeats
included.  With fewer words the whole sequence is the one shingle; without words
the fingerprint is zero.  Each shingle is hashed with XXH64 (UTF-8, seed 42); a
fingerprint bit is set if over half of the hashes set it.

Links.  Equal fingerprints are one class.  Two fingerprints that differ in at
most 2 of 64 bits agree in two of four 16-bit segments at least, so classes meet
in groups that share two segments: six groups for each class.  A group with over
``MAX_GROUP`` members is dealt again by two of the four 8-bit segments of what its
members do not share yet, by the same argument; after that 16 bits are free, and
no group has over 65,536 members, whatever the input.

Index.  A group's members, in order of Gray rank, are the leaves.  Members next
to each other share most bits; a node holds, as a mask and its pattern, the bits
that all leaves under it share and its parent does not hold yet.  A search goes
down from the root and adds up the differing bits node by node: what has added up
is a lower bound for all leaves under a node, so beyond the limit the whole node
is left out, and at a leaf it is the distance.  Links found become a spanning
forest of the group, never all pairs.  Components over all groups then link the
classes.

A null text counts as empty.  Rows with a null id take part; a component of null
ids only has a null id.  An empty table gives an empty result.  Only id and text
are read, so other columns may have any name; ``keep_one`` returns all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grouping import attach_groups, components
from .scratch import discard, materialise

#: Bits in which linked fingerprints may differ.  The segments rely on it.
MAX_BITS = 2
#: Members of a group; larger ones are dealt again.
MAX_GROUP = 4096
#: Groups to be dealt again (8 bytes each) that are broadcast, at most, and into how many shares the rows of one go otherwise.
MAX_BROADCAST, SALTS = 1 << 20, 64
#: Children of an index node, and queries that search a group at a time.
FANOUT, QUERIES = 8, 256


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    words = text.lower().split()  # on bytes: A-Z only, and exactly the six ASCII white-space bytes
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(line, seed)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: len(words) - width] + 1).tolist()]
    hashes = np.array([digest(line[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(t.as_py(), width) for t in batch.column("text")], dtype=np.uint64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(marks.view(np.int64))], names=["doc_id", "mark"])

    return run


class GrayIndex:
    """Hierarchical index over fingerprints that are in order of Gray rank."""

    def __init__(self, marks: np.ndarray):
        every, some = [marks], [marks]  # the bits that all leaves under a node have, and those that any has
        while len(every[-1]) > 1:
            at = np.arange(0, len(every[-1]), FANOUT)
            every.append(np.bitwise_and.reduceat(every[-1], at))
            some.append(np.bitwise_or.reduceat(some[-1], at))
        shared = [~(a ^ b) for a, b in zip(every, some, strict=True)]
        #: (mask, pattern) of each level, leaves first: a node's shared bits without those of its parent.
        self.levels = []
        for depth, mine in enumerate(shared):
            above = shared[depth + 1][np.arange(len(mine)) // FANOUT] if depth + 1 < len(shared) else np.zeros_like(mine)
            self.levels.append((mine & ~above, every[depth] & mine & ~above))

    def search(self, queries: np.ndarray, limit: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) positions of all pairs within ``limit`` bits."""
        query = np.arange(len(queries))
        node = np.zeros(len(queries), np.int64)
        differ = np.zeros(len(queries), np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            mask, pattern = self.levels[depth]
            if depth < len(self.levels) - 1:
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                query, differ = np.repeat(query, FANOUT), np.repeat(differ, FANOUT)
                there = node < len(mask)
                query, node, differ = query[there], node[there], differ[there]
            differ = differ + np.bitwise_count((queries[query] & mask[node]) ^ pattern[node])
            near = differ <= limit
            query, node, differ = query[near], node[near], differ[near]
        return query, node


def forest(marks: np.ndarray) -> np.ndarray:
    """For each of a group's fingerprints, in Gray order, the first one that it's linked to, directly or not."""
    label = np.arange(len(marks))
    index, left, right = GrayIndex(marks), [], []
    for at in range(0, len(marks), QUERIES):
        query, member = index.search(marks[at : at + QUERIES])
        query = query + at
        above = member > query
        left.append(query[above])
        right.append(member[above])
    a, b = np.concatenate(left), np.concatenate(right)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if np.array_equal(label, before):
            break
    return label


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, part, mark) sorted by group and Gray rank; holds one group beyond a batch."""
    held: list[np.ndarray] = []

    def links(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.flatnonzero((rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])) + 1
        bounds = np.concatenate([[0], new, [len(rows)]])
        marks, froms, tos = rows[:, 2].view(np.uint64), [], []
        for i in np.flatnonzero(np.diff(bounds) > 1):
            group = marks[bounds[i] : bounds[i + 1]]
            first = forest(group)
            joined = np.flatnonzero(first != np.arange(len(group)))
            froms.append(group[joined])
            tos.append(group[first[joined]])
        if froms:
            a, b = (np.concatenate(x).view(np.int64) for x in (froms, tos))
            yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "part", "mark")], axis=1)
        other = np.flatnonzero((rows[:, :2] != (held[-1] if held else rows)[-1, :2]).any(axis=1))
        if held and not len(other):  # all of it belongs to the group that is open
            held.append(rows)
            continue
        last = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))
        cut = last[-1] + 1 if len(last) else 0
        if held or cut:
            yield from links(np.ascontiguousarray(np.concatenate([*held, rows[:cut]])))
        held = [rows[cut:].copy()]
    if held:
        yield from links(np.concatenate(held))


def _segment(mark, at: int, bits: int):
    return F.shiftrightunsigned(mark, at).bitwiseAND(F.lit((1 << bits) - 1))


_PAIRS = [(i, j) for i in range(4) for j in range(i)]


def _dealt(classes: DataFrame) -> DataFrame:
    """(mark, key, n): each mark in six groups."""
    mark = F.col("mark")
    keys = F.array(*[
        F.struct(
            (F.lit(n << 32) + F.shiftleft(_segment(mark, 16 * i, 16), 16) + _segment(mark, 16 * j, 16)).alias("key"),
            F.lit(n).alias("n"),
        )
        for n, (i, j) in enumerate(_PAIRS)
    ])
    return classes.select("mark", F.explode(keys).alias("k")).select("mark", "k.key", "k.n")


def _hot(classes: DataFrame) -> DataFrame:
    """The keys of groups that are dealt again."""
    return materialise(_dealt(classes).groupBy("key").count().filter(F.col("count") > MAX_GROUP).select(F.col("key").alias("_key")), "simhash-hot")


def links(classes: DataFrame, hot: DataFrame) -> DataFrame:
    """Edges (a, b) between the ``mark`` column's distinct fingerprints that connect all those within MAX_BITS."""
    pairs, mark, dealt = _PAIRS, F.col("mark"), _dealt(classes)
    if hot.count() <= MAX_BROADCAST:
        marked = dealt.join(F.broadcast(hot), F.col("key") == F.col("_key"), "left")
    else:
        salted = hot.select("_key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
        salt = F.pmod(F.xxhash64("mark"), F.lit(SALTS)).cast("int")
        marked = dealt.join(salted, (F.col("key") == F.col("_key")) & (salt == F.col("_salt")), "left")
    parts = F.lit(None).cast("array<long>")
    for n, (i, j) in enumerate(pairs):
        a, b = [16 * s for s in range(4) if s not in (i, j)]
        eights = [_segment(mark, a, 8), _segment(mark, a + 8, 8), _segment(mark, b, 8), _segment(mark, b + 8, 8)]
        again = F.array(*[F.lit(1 + (m << 16)) + F.shiftleft(eights[p], 8) + eights[q] for m, (p, q) in enumerate(pairs)])
        parts = F.when(F.col("n") == n, again).otherwise(parts)
    once = F.array(F.lit(0).cast("long"))
    grouped = marked.select("key", "mark", F.explode(F.when(F.col("_key").isNull(), once).otherwise(parts)).alias("part"))
    rank = F.col("mark")
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    rank = rank.bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order
    ordered = grouped.repartition("key", "part").sortWithinPartitions("key", "part", rank)
    return ordered.mapInArrow(_link, "a long, b long").distinct()


def _classes(marked: DataFrame) -> tuple[DataFrame, int]:
    """(mark, members, component_id, keeper) of the distinct fingerprints of (doc_id, mark, row) rows, and the number of rows.

    ``keeper`` is the row of the component that stays: the one with the smallest
    id (null ids after all others), then the smallest row number.
    """
    keeper = F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "row"))
    classes = materialise(marked.groupBy("mark").agg(F.count("*").alias("members"), keeper.alias("keeper")), "simhash-classes")
    total = classes.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    hot = _hot(classes)
    linked = components(links(classes, hot), "simhash-links")
    discard(hot)
    joined = classes.join(linked, F.col("mark") == F.col("node"), "left").withColumn("root", F.coalesce("component", "mark"))
    sizes = joined.groupBy("root").agg(F.min("keeper").alias("least"), F.count("*").alias("n"))
    rows = joined.select("mark", "members", "root")
    # a component may hold most classes: its keeper goes back to them like any other group's
    groups = attach_groups(rows, sizes, "root", "n", classes.count(), F.col("mark"))
    return groups.select("mark", "members", F.col("least.doc_id").alias("component_id"), F.col("least.row").alias("keeper")), total


def _marked(rows: DataFrame, width: int) -> DataFrame:
    return rows.mapInArrow(_fingerprints(width), "doc_id long, mark long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """A row a document: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    marked = materialise(_marked(rows, width), "simhash-marks")
    groups, total = _classes(marked.withColumn("row", F.lit(0).cast("long")))
    found = attach_groups(marked, groups, "mark", "members", total, F.col("doc_id"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("mark")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row of ``docs`` for each component: the one with the smallest id, null ids after all others.

    Rows are told apart by a number that each gets in a written copy, so a row
    without an id, or one that repeats another's id or text, stays or goes by itself.
    """

    @F.arrow_udf("long")
    def mark(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.array([fingerprint(t.as_py(), width) for t in texts], dtype=np.uint64).view(np.int64))

    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    packed = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).cast("long").alias("doc_id"), mark(text).alias("mark"))
    packed = materialise(packed.withColumn("row", F.monotonically_increasing_id()), "simhash-rows")
    groups, total = _classes(packed.select("doc_id", "mark", "row"))
    found = attach_groups(packed.select("doc", "mark", "row"), groups.select("mark", "members", "keeper"), "mark", "members", total, F.col("row"))
    return found.filter(F.col("row") == F.col("keeper")).select("doc.*")
