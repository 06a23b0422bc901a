"""Embedding near-duplicates by a forest of random-projection trees.

Each tree splits at random directions, at the median of a bounded sample; vectors
within ``SPILL`` of the median (half of it on either side) go to both children.
Every vector is then routed through every tree, the leaves compare their members,
and the links found are united.  Equal vectors are one class: copies are combined
where they are routed, all take the same ways, and a leaf combines the rest.

A pair at the threshold stays together in a split with a probability that follows
from threshold and spill, and in a tree with its power of the tree's depth.  There
are as many trees as it takes to bring such a pair together at least once with
probability ``FOUND``, so their number grows with the logarithm of the input.

A median split would part a large group of different vectors that all link, so
such groups are taken out first.  A sampled class within the threshold of
``DENSE`` leaves' worth of the sample is a centre; vectors within the threshold
of a centre belong to the nearest one's cell.  By the triangle inequality all that
a cell's vector links with lies within twice the centre's angle, and each of these
vectors goes to the cell too, so links of cell vectors are found exactly.  Cells
are cut into chunks, and each pair of chunks is a task.  The trees see the rest.

Leaves compare in blocks, by cosine in single precision; pairs so near the threshold
that this could err are computed again in double precision.  A block's links are
added to counts and to a spanning forest at once, so pairs are neither kept nor sent
anywhere.  A pair may meet in several leaves: each vector carries the numbers of all
its leaves, and a pair counts only in the smallest leaf that both are in.  A pair of
two cells counts in the smaller one.  Nothing is capped.

The sample is bounded (``MAX_SAMPLE``, ``MAX_SAMPLE_BYTES``) while every vector is
indexed.  Trees grow until a leaf would hold about ``LEAF`` of all classes, or
``LEAST_SAMPLE`` of the sample.  A leaf that is larger than ``WHOLE`` for that reason
grows a forest of its own in its task, by the same rules, so its work stays in
proportion to its members; only its vectors must fit in the task's memory.

Vectors that are null, empty or zero, or hold null or non-finite components, and
rows with a null id link with nothing: n_links 0, component_id their own id, kept
true (false if the id is null).  Vectors are compared among those of equal length;
lengths of up to ``LEAF`` classes need no tree.  Rows that repeat an id and vector
count as further vectors.  Only id and vector are read, so other columns may have any
name.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grouping import attach_groups, components
from .scratch import materialise

#: Classes that the trees are fitted on, at most (in expectation: they're picked by hash), and their bytes.
MAX_SAMPLE, MAX_SAMPLE_BYTES = 32_768, 64 << 20
#: Probability that a pair at the threshold meets in some tree, at least.
FOUND = 0.99
MIN_TREES = 3
#: Classes in a leaf, about, and in a leaf that is compared whole, at most.
LEAF, WHOLE = 512, 32_768
#: Sampled classes in a leaf, at least.
LEAST_SAMPLE = 16
#: Share of a node's sample that goes to both children.
SPILL = 0.08
#: Members compared at a time.
BLOCK = 1024
#: Leaves' worth of the sample within the threshold of a class that make it a cell's centre.
DENSE = 0.5
#: Sampled classes that are tried as centres, at most.
PROBES = 8192
#: Members in a chunk of a cell, about, and their bytes at most.
CHUNK, CHUNK_BYTES = 16_384, 1 << 26


def _rows(batch: pa.RecordBatch, kind: str) -> tuple[list[bytes | None], np.ndarray]:
    """Each row's vector as bytes, null if it links with nothing, and its length."""
    ids, lists = batch.column("vec_id"), batch.column("embedding")
    sizes = np.diff(np.asarray(lists.offsets)) if len(lists) else np.zeros(0, int)
    values = np.asarray(lists.values.to_numpy(zero_copy_only=False), dtype=kind) + 0  # null components become NaN, -0 is 0
    ends = (lists.offsets[0].as_py() if len(lists) else 0) + np.cumsum(sizes)
    usable = ~np.asarray(lists.is_null()) & ~np.asarray(ids.is_null()) & (sizes > 0)
    vecs: list[bytes | None] = []
    for ok, end, n in zip(usable, ends, sizes, strict=True):
        v = values[end - n : end]
        vecs.append(v.tobytes() if ok and np.isfinite(v).all() and v.any() else None)
    return vecs, sizes


def _key(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def _keys(kind: str):
    """(vec_id, key, dim): the digest of the vector, null if it links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs, sizes = _rows(batch, kind)
            yield pa.record_batch([batch.column("vec_id"), pa.array([v and _key(v) for v in vecs], pa.binary()), pa.array(sizes.astype(np.int32))], names=["vec_id", "key", "dim"])

    return run


def _sampled(kind: str, dim: int, share: float):
    """(key, vec) of the classes of a length that are picked by hash, with few copies."""
    below = int(share * 2**32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs, sizes = _rows(batch, kind)
            found = {key: v for v, n in zip(vecs, sizes, strict=True) if v and n == dim and int.from_bytes((key := _key(v))[:4], "big") < below}
            yield pa.record_batch([pa.array([*found], pa.binary()), pa.array([*found.values()], pa.binary())], names=["key", "vec"])

    return run


def unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def stays(threshold: float, spill: float = SPILL) -> float:
    """Probability that a pair at the threshold isn't parted by a split: its difference along a random direction is normal."""
    apart = math.sqrt(max(0.0, 2 - 2 * threshold))  # in standard deviations of all
    band = spill / 0.3989  # the overlap's width, at the normal density's peak
    if not apart:
        return 1.0
    a = band / apart
    beyond = 2 * (apart * 0.3989 * math.exp(-a * a / 2) - band * 0.5 * math.erfc(a / math.sqrt(2)))
    return min(1.0, max(0.05, 1 - 0.3989 * beyond))


def trees_for(classes: float, leaf: float, threshold: float) -> int:
    """Trees that bring a pair at the threshold together with probability FOUND."""
    depth = max(0.0, math.log(max(1.0, classes / leaf)) / math.log(2 / (1 + SPILL)))
    p = stays(threshold) ** math.ceil(depth)
    return max(MIN_TREES, math.ceil(math.log(1 - FOUND) / math.log(max(1e-9, 1 - p)))) if p < 1 else MIN_TREES


@dataclass
class Tree:
    """Node i: a direction, the two bounds of its overlap, two children (leaf n is -1 - n)."""

    directions: np.ndarray
    low: np.ndarray
    high: np.ndarray
    children: np.ndarray
    leaves: int

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs."""
        if self.directions.dtype != x.dtype:
            self.directions = self.directions.astype(x.dtype)
        row, node, rows, leaves = np.arange(len(x)), np.full(len(x), 0 if len(self.low) else -1), [], []
        while True:
            out = node < 0
            rows.append(row[out])
            leaves.append(-1 - node[out])
            row, node = row[~out], node[~out]
            if not len(row):
                return np.concatenate(rows), np.concatenate(leaves)
            at = np.einsum("ij,ij->i", x[row], self.directions[node])
            left, right = at <= self.high[node], at >= self.low[node]
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([self.children[node[left], 0], self.children[node[right], 1]])


def grow(x: np.ndarray, leaf: float, rng: np.random.Generator, spill: float = SPILL) -> Tree:
    """A tree whose leaves hold up to ``leaf`` of the sample ``x``, about."""
    directions, low, high, children, leaves = [], [], [], [], 0

    def node(mine: np.ndarray, depth: int) -> int:
        nonlocal leaves
        if len(mine) > 1.25 * leaf and depth < 40:
            direction = rng.standard_normal(x.shape[1])
            direction /= np.linalg.norm(direction)
            at = x[mine] @ direction
            lo, hi = np.quantile(at, [0.5 - spill / 2, 0.5 + spill / 2])
            left, right = mine[at <= hi], mine[at >= lo]
            if max(len(left), len(right)) < len(mine):
                i = len(low)
                directions.append(direction)
                low.append(lo)
                high.append(hi)
                children.append([0, 0])
                children[i] = [node(left, depth + 1), node(right, depth + 1)]
                return i
        leaves += 1
        return -leaves

    node(np.arange(len(x)), 0)
    return Tree(np.array(directions).reshape(-1, x.shape[1]), np.array(low), np.array(high), np.array(children, dtype=np.int64).reshape(-1, 2), leaves)


@dataclass
class Cells:
    """Centres, the cosine of their cells, that of all that may link with a cell, and each cell's number of chunks."""

    centres: np.ndarray
    threshold: float
    reach: float
    chunks: np.ndarray

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's cell (-1 if it has none), and whether it goes to each cell: its own, and those in reach that count its links."""
        if not len(self.centres):
            return np.full(len(x), -1), np.zeros((len(x), 0), bool)
        at = x @ self.centres.T
        own = np.where(at.max(axis=1) >= self.threshold, at.argmax(axis=1), -1)
        cell = np.arange(len(self.centres))
        return own, (at >= self.reach) & ((own < 0)[:, None] | (own[:, None] >= cell)) | (own[:, None] == cell)


def dense_cells(x: np.ndarray, leaf: float, share: float, threshold: float, rng: np.random.Generator) -> Cells:
    """Cells of the sample ``x``, a ``share`` of all classes, until no probe has ``DENSE`` leaves' worth of the rest near it."""
    fast = x.astype(np.float32)
    probes = np.sort(rng.permutation(len(x))[:PROBES])
    rest, centres = np.ones(len(x), bool), []

    def near(rows: np.ndarray) -> np.ndarray:
        return sum(((fast[probes] @ fast[rows[a : a + BLOCK]].T >= threshold).sum(axis=1) for a in range(0, len(rows), BLOCK)), np.zeros(len(probes), int))

    counts = near(np.arange(len(x)))
    while len(probes) and counts.max() >= max(2, DENSE * leaf):
        centre = probes[counts.argmax()]
        inside = np.flatnonzero(rest & (x @ x[centre] >= threshold))
        if not len(inside):
            break
        rest[inside] = False
        counts -= near(inside)
        centres.append(centre)
    # cos(2a) = 2 cos(a)^2 - 1; from a right angle on, everything is in reach
    cells = Cells(x[centres], threshold, 2 * threshold**2 - 1 - 1e-6 if threshold > 0 else -2.0, np.ones(len(centres), int))
    sizes = cells.home(x)[1].sum(axis=0) / share
    cells.chunks = np.maximum(1, np.ceil(sizes / max(BLOCK, min(CHUNK, CHUNK_BYTES // (8 * x.shape[1]))))).astype(int)
    return cells


def _groups(batch: pa.RecordBatch, kind: str, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, smallest id, number, hash) of a batch's classes of a length."""
    vecs, sizes = _rows(batch, kind)
    found: dict[bytes, list[int]] = {}
    for v, n, i in zip(vecs, sizes, batch.column("vec_id").to_pylist(), strict=True):
        if v and n == dim:
            entry = found.setdefault(v, [i, 0])
            entry[0], entry[1] = min(entry[0], i), entry[1] + 1
    x = np.frombuffer(b"".join(found), kind).reshape(len(found), dim)
    reps, counts = (np.array([e[k] for e in found.values()], dtype=np.int64) for k in (0, 1))
    return x, reps, counts, np.array([int.from_bytes(_key(v)[4:8], "big") for v in found], dtype=np.int64)


ROUTED = "leaf int, rep long, size long, vec binary, leaves array<int>"


def _members(leaf: np.ndarray, x: np.ndarray, rep: np.ndarray, size: np.ndarray, lists: pa.ListArray) -> pa.RecordBatch:
    vecs = pa.array([v.tobytes() for v in x], pa.binary())
    return pa.record_batch([pa.array(leaf.astype(np.int32)), pa.array(rep), pa.array(size), vecs, lists], names=["leaf", "rep", "size", "vec", "leaves"])


def _lists(flat: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(flat.astype(np.int32)))


def _route(kind: str, dim: int, trees: list[Tree], cells: Cells):
    """Leaf n of the forest is n, and the chunks a and b of a cell, in which ``leaves`` holds a row's own cell and chunk, are a number below 0."""
    offsets = np.concatenate([[0], np.cumsum(cells.chunks**2)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, rep, size, spread = _groups(batch, kind, dim)
            if not len(raw):
                continue
            x = unit(raw)
            own, goes = cells.home(x)
            row, leaf = route_all(trees, x.astype(np.float32), np.flatnonzero(own < 0))
            if len(row):
                counts = np.bincount(row, minlength=len(x))
                lists = _lists(leaf, counts).take(pa.array(row))
                yield _members(leaf, raw[row], rep[row], size[row], lists)
            for cell in np.flatnonzero(goes.any(axis=0)):
                k = cells.chunks[cell]
                row = np.repeat(np.flatnonzero(goes[:, cell]), k)
                mine, other = spread[row] % k, np.tile(np.arange(k), len(row) // k)
                pair = offsets[cell] + np.minimum(mine, other) * k + np.maximum(mine, other)
                lists = _lists(np.stack([own[row], mine], axis=1).ravel(), np.full(len(row), 2))
                yield _members(-1 - pair, raw[row], rep[row], size[row], lists)

    return run


def _by_length(kind: str, lengths: frozenset[int]):
    """Vectors of the lengths that need no tree: the length is the leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(np.asarray(batch.column("embedding").offsets)) if batch.num_rows else np.zeros(0, int)
            for dim in np.unique(sizes):
                raw, rep, size, _ = _groups(batch, kind, int(dim)) if dim and int(dim) not in lengths else ((),) * 4
                if len(raw):
                    yield _members(np.full(len(raw), dim), raw, rep, size, _lists(np.zeros(0), np.zeros(len(raw), int)))

    return run


def route_all(trees: list[Tree], x: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) pairs of ``rows`` in the forest, in order; leaves are numbered tree after tree."""
    offset, found, leaves = 0, [np.zeros(0, int)], [np.zeros(0, int)]
    for tree in trees if len(rows) else ():
        row, leaf = tree.route(x[rows])
        found.append(rows[row])
        leaves.append(leaf + offset)
        offset += tree.leaves
    row, leaf = np.concatenate(found), np.concatenate(leaves)
    order = np.lexsort((leaf, row))
    return row[order], leaf[order]


class Linked:
    """Members' numbers of links and the components so far; takes the links of two blocks of members at a time."""

    def __init__(self, x: np.ndarray, size: np.ndarray, threshold: float):
        self.x, self.fast, self.size, self.threshold = x, x.astype(np.float32), size.astype(float), threshold
        self.margin = max(1e-5, 1.2e-7 * x.shape[1])  # what single precision may err
        self.found, self.label = np.zeros(len(x)), np.arange(len(x))

    def near(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which pairs of two blocks have the threshold's cosine, in double precision."""
        at = self.fast[left] @ self.fast[right].T
        linked = at >= self.threshold + self.margin
        i, j = np.nonzero(~linked & (at >= self.threshold - self.margin))
        for a in range(0, len(i), 1 << 16):
            p, q = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
            linked[p, q] = np.einsum("ij,ij->i", self.x[left[p]], self.x[right[q]]) >= self.threshold
        return linked

    def add(self, left: np.ndarray, right: np.ndarray, linked: np.ndarray) -> None:
        self.found[left] += linked @ self.size[right]
        self.found[right] += self.size[left] @ linked
        i, j = np.nonzero(linked)
        self.label = unite(self.label, left[i], right[j])


def _leaves_table(leaves: list[np.ndarray]) -> np.ndarray:
    wide = max([1, *map(len, leaves)])
    table = np.full((len(leaves), wide), -1)
    for i, mine in enumerate(leaves):
        table[i, : len(mine)] = mine
    return table


def _met(table: np.ndarray, left: np.ndarray, right: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """``linked`` without the pairs that have a leaf of the table in common."""
    i, j = np.nonzero(linked)
    met = np.zeros(len(i), bool)
    for c in range(table.shape[1]):
        mine = table[left[i], c]
        met |= (mine >= 0) & (table[right[j]] == mine[:, None]).any(axis=1)
    linked[i[met], j[met]] = False
    return linked


def compare(found: Linked, members: np.ndarray, earlier: list[np.ndarray]) -> None:
    """Add the links among ``members`` that no table of ``earlier`` leaves has met."""
    for a in range(0, len(members), BLOCK):
        left = members[a : a + BLOCK]
        for b in range(a, len(members), BLOCK):
            right = members[b : b + BLOCK]
            linked = found.near(left, right)
            if a == b:
                linked = np.triu(linked, 1)
            for table in earlier:
                if linked.any():
                    linked = _met(table, left, right, linked)
            if linked.any():
                found.add(left, right, linked)


def compare_leaf(found: Linked, earlier: np.ndarray, seed: int) -> None:
    """All links in a leaf; a large one is compared in the leaves of a forest of its own."""
    n = len(found.x)
    if n <= WHOLE:
        return compare(found, np.arange(n), [earlier])
    rng = np.random.default_rng(seed)
    sample = found.fast[np.sort(rng.permutation(n)[:MAX_SAMPLE])]
    size = max(LEAST_SAMPLE, LEAF * len(sample) / n)
    trees = [grow(sample, size, rng) for _ in range(trees_for(n, LEAF, found.threshold))]
    row, leaf = route_all(trees, found.fast, np.arange(n))
    mine = np.split(leaf, np.cumsum(np.bincount(row, minlength=n))[:-1])
    order = np.lexsort((row, leaf))
    local = _leaves_table(mine)
    for members, number in zip(np.split(row[order], np.flatnonzero(np.diff(leaf[order])) + 1), np.unique(leaf), strict=True):
        compare(found, members, [earlier, np.where(local < number, local, -1)])
    return None


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``label``, the smallest member of each component, with the links (i, j) added."""
    while len(i := i[part := label[i] != label[j]]):
        j = j[part]
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while not np.array_equal(further := label[label], label):
            label = further
    return label


def compare_cell(found: Linked, inside: np.ndarray, chunk: np.ndarray) -> None:
    """The links of a pair of a cell's chunks, or of one: pairs with a member ``inside`` the cell, between the two chunks."""
    parts = [np.flatnonzero(chunk == c) for c in np.unique(chunk)]
    one, other = parts[0], parts[-1]
    for a in range(0, len(one), BLOCK):
        left = one[a : a + BLOCK]
        for b in range(a if len(parts) == 1 else 0, len(other), BLOCK):
            right = other[b : b + BLOCK]
            linked = found.near(left, right) & (inside[left][:, None] | inside[right])
            if len(parts) == 1 and a == b:
                linked = np.triu(linked, 1)
            found.add(left, right, linked)


def _compare(kind: str, threshold: float, cells: Cells | None):
    offsets = np.concatenate([[0], np.cumsum(cells.chunks**2)]) if cells else np.zeros(1, int)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        leaf, vecs = key[0].as_py(), table["vec"].to_pylist()
        # rows of a class from several batches
        first, at = {}, np.zeros(len(vecs), int)
        for i, v in enumerate(vecs):
            at[i] = first.setdefault(v, len(first))
        rep, size = np.full(len(first), np.iinfo(np.int64).max), np.zeros(len(first), np.int64)
        np.minimum.at(rep, at, table["rep"].to_numpy())
        np.add.at(size, at, table["size"].to_numpy())
        own = np.zeros(len(first), int)
        own[at] = np.arange(len(vecs))
        lists = table["leaves"].take(pa.array(own)).to_pylist()
        found = Linked(unit(np.frombuffer(b"".join(first), kind).reshape(len(first), -1)), size, threshold)
        if leaf >= 0:
            compare_leaf(found, _leaves_table([[n for n in mine if n < leaf] for mine in lists]), leaf)
        else:
            cell = int(np.searchsorted(offsets, -1 - leaf, side="right")) - 1
            a, b = divmod(-1 - leaf - int(offsets[cell]), int(cells.chunks[cell]))
            home, chunk = np.array(lists).T
            if a == b or len(np.unique(chunk)) == 2:
                compare_cell(found, home == cell, chunk)
        on = np.flatnonzero(found.found)
        return pa.table({"rep": rep[on], "root": rep[found.label[on]], "links": found.found[on].astype(np.int64)})

    return run


LINKS = "rep long, root long, links long"


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, trees: int | None = None, seed: int = 7) -> DataFrame:
    """A row a vector: vec_id, n_links, component_id, kept.  ``trees``: instead of as many as ``FOUND`` takes."""
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("embedding"))
    base = materialise(rows.mapInArrow(_keys(kind), "vec_id long, key binary, dim int"), "forest-keys")
    classes = base.filter("key is not null").groupBy("key", "dim").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"))
    classes = materialise(classes, "forest-classes")
    large = {r.dim: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).filter(F.col("n") > LEAF).orderBy("dim").collect()}
    found = rows.mapInArrow(_by_length(kind, frozenset(large)), ROUTED).groupBy("leaf").applyInArrow(_compare(kind, threshold, None), LINKS)
    for dim, n in large.items():  # each needs over LEAF classes
        found = found.unionByName(_forest_links(rows, kind, dim, n, threshold, trees, seed))
    found = materialise(found, "forest-links")
    united = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), "forest-components")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links")).withColumnRenamed("rep", "_rep")
    out = classes.join(counts, F.col("rep") == F.col("_rep"), "left").join(united, F.col("rep") == F.col("node"), "left")
    groups = out.select("key", "size", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    total = classes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    dealt = attach_groups(base.select("vec_id", "key"), groups, "key", "size", total, F.col("vec_id"))
    component = F.coalesce("component_id", "vec_id")
    return dealt.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _forest_links(rows: DataFrame, kind: str, dim: int, n: int, threshold: float, trees: int | None, seed: int) -> DataFrame:
    share = min(1.0, MAX_SAMPLE / n, MAX_SAMPLE_BYTES / (n * dim * np.dtype(kind).itemsize))
    picked = rows.mapInArrow(_sampled(kind, dim, share), "key binary, vec binary").groupBy("key").agg(F.min("vec").alias("vec"))
    sample = picked.orderBy("key").toArrow()["vec"].to_pylist()
    if not sample:
        raise RuntimeError(f"no class of length {dim} was sampled; raise MAX_SAMPLE_BYTES")
    x = unit(np.frombuffer(b"".join(sample), kind).reshape(len(sample), dim))
    leaf = max(LEAST_SAMPLE, LEAF * len(x) / n)
    cells = dense_cells(x, leaf, len(x) / n, threshold, np.random.default_rng([seed, dim]))
    rest = x[cells.home(x)[0] < 0].astype(np.float32)
    n_trees = trees or trees_for(len(rest), leaf, threshold)
    forest = [grow(rest, leaf, np.random.default_rng([seed, t])) for t in range(n_trees)]
    routed = rows.mapInArrow(_route(kind, dim, forest, cells), ROUTED)
    return routed.groupBy("leaf").applyInArrow(_compare(kind, threshold, cells), LINKS)
