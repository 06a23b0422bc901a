"""Merkle manifest of a dataset: a hash tree a group of rows, and one over the groups.

H is the lower-case hex SHA-256 of its inputs' concatenation, digests as hex text.
The leaves of a group ascend by id; while several nodes remain, every ``WIDTH``
consecutive ones become their H.  What remains is the group's subroot; the subroots,
in the order of their groups (null first, then by UTF-8 bytes), make the root likewise.

Rows are put in order once, by a range partition, and then gathered in blocks of
``WIDTH ** DEPTH`` consecutive leaves.  A block is one row with an ordered array, which
higher-order functions collapse by ``DEPTH`` levels (sequence the runs, slice each,
hash it, add up the levels by aggregate).  The roots of the blocks are the leaves of
the next round, which has 1 / WIDTH ** DEPTH of the rows, until each group has one
node.  On the way back each block learns the siblings above it.  No task ever holds
more than a block, and a group's blocks are spread over all tasks.

A null is a value of its own in every field; a null id comes first in its group and a
null group is a group.  Of rows with the same group and id the order is that of their
leaves; wholly equal rows are equal leaves side by side.  A table of one row has its
leaf as the root and no siblings; an empty table gives an empty result.  Columns of any
other name are neither read nor changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grouping import attach_groups
from .scratch import materialise

#: Nodes a run, and levels that a block collapses.
WIDTH, DEPTH = 8, 4

PATH = "array<struct<left:string,right:string>>"
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return digest(*map(field, values))


def proof(path: Column) -> Column:
    """H of all siblings on the way to the root, from the lowest level up and from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def fold(node: Column, path: Column) -> Column:
    """The root that a leaf gives with these siblings."""
    return F.aggregate(path, node, lambda below, s: digest(s["left"], below, s["right"]))


def in_order(rows: DataFrame, by: list[str], label: str) -> DataFrame:
    """``rows`` with ``at``, their place in the order of ``by`` from 0 on.

    They are range partitioned, sorted and written with their place in the partition;
    what precedes a partition is a sum over a row a partition.
    """
    ranged = materialise(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_row", F.monotonically_increasing_id()), label)
    task = F.shiftright("_row", 33)
    sizes = ranged.groupBy(task.alias("_task")).agg(F.count("*").alias("_size"))
    earlier = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_task", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    within = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.join(F.broadcast(before), task == F.col("_task")).select(*rows.columns, (F.col("_before") + within).alias("at"))


def _depth(n: Column) -> Column:
    """Levels that a block of a tree with n nodes collapses."""
    out = F.lit(DEPTH)
    for k in reversed(range(DEPTH)):
        out = F.when(n <= WIDTH**k, k).otherwise(out)
    return out


def _numbers(last: Column) -> Column:
    """0 to ``last``; none below 0."""
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _collapsed(nodes: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / WIDTH).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * WIDTH + 1, F.lit(WIDTH)), ""), 256))


def _levels(items: Column, depth: Column) -> Column:
    """The block's nodes by level, from the leaves up to its one root."""
    lowest = F.array(F.transform(items, lambda x: x["node"]))
    return F.aggregate(_numbers(depth - 1), lowest, lambda levels, _: F.concat(levels, F.array(_collapsed(F.element_at(levels, -1)))))


def _siblings(levels: Column, place: Column, depth: Column) -> Column:
    """By level: what stands left and right of the node at ``place``, or of its ancestor, in its run."""

    def of(k: Column) -> Column:
        here = F.floor(place / F.pow(F.lit(WIDTH), k)).cast("int")
        row, nth = F.element_at(levels, k + 1), here % WIDTH
        left, right = F.slice(row, here - nth + 1, nth), F.slice(row, here + 2, F.lit(WIDTH - 1) - nth)
        return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))

    return F.transform(_numbers(depth - 1), of)


def _once(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once, however often a lambda within reads it."""
    return F.transform(F.array(value), use)[0]


def _grow(nodes: DataFrame, label: str) -> list[tuple[DataFrame, DataFrame]]:
    """Rounds of (blocks, the trees that end there as ``tree, node``) from nodes (tree, pos, n, node, more ...)."""
    rounds = []
    while True:
        item = F.struct("pos", *[c for c in nodes.columns if c not in ("tree", "pos", "n")])
        block = F.floor(F.col("pos") / WIDTH**DEPTH).alias("block")
        blocks = nodes.groupBy("tree", "n", block).agg(F.sort_array(F.collect_list(item)).alias("items"))
        blocks = materialise(blocks, f"{label}-blocks-{len(rounds)}")
        top = F.element_at(F.element_at(_levels(F.col("items"), _depth(F.col("n"))), -1), 1)
        above = blocks.select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / WIDTH**DEPTH).alias("n"), top.alias("node"))
        above = materialise(above, f"{label}-roots-{len(rounds)}")
        rounds.append((blocks, above.filter("n = 1").select("tree", "node")))
        nodes = above.filter("n > 1")
        if nodes.isEmpty():
            return rounds


def _descend(rounds: list[tuple[DataFrame, DataFrame]], ends, kept: list[str]) -> DataFrame:
    """(tree, pos, path, kept ..., the items' own columns) of the lowest round.

    ``ends`` gives trees (tree, node) their row: tree, path above them, and the columns ``kept``.
    """
    down = None
    for blocks, done in reversed(rounds):
        top = ends(done).select("tree", F.lit(0).cast("long").alias("block"), F.col("path").alias("_above"), *kept)
        if down is not None:
            top = top.unionByName(down.select("tree", F.col("pos").alias("block"), F.col("path").alias("_above"), *kept))

        def with_paths(levels: Column) -> Column:
            return F.transform("items", lambda x, i: F.struct(x.alias("x"), F.concat(_siblings(levels, i, _depth(F.col("n"))), F.col("_above")).alias("path")))

        rows = blocks.join(top, ["tree", "block"]).select("tree", *kept, F.explode(_once(_levels(F.col("items"), _depth(F.col("n"))), with_paths)).alias("_i"))
        down = rows.select("tree", "_i.path", *kept, "_i.x.*")
    return down


def manifest(rows: DataFrame, group: str = "lang", id_col: str = "doc_id", node: str = "leaf", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row a leaf: id, leaf, subroot, root, path, and the columns to ``keep``.

    ``path`` lists what stands left and right of the leaf and its ancestors in their
    runs, from the leaf's level up through the subroot to the root, as ``PATH``.
    """
    leaves = rows.select(F.col(group).alias("_group"), F.col(id_col).alias("_id"), F.col(node).alias("node"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)])
    # written first: a range partition samples its input, and would hash all texts twice
    placed = in_order(materialise(leaves, "leaves"), ["_group", "_id", "node"], "leaves-in-order")
    key = F.coalesce(F.concat(F.lit("+"), F.col("_group").cast("string")), F.lit("-"))
    trees = placed.groupBy("_group").agg(F.min("at").alias("_first"), F.count("*").alias("n"))
    trees = materialise(in_order(trees, ["_group"], "trees-in-order").select(key.alias("_key"), "_first", "n", F.col("at").alias("tree")), "trees")
    total, n_trees = trees.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    members = trees.withColumn("_members", F.col("n"))
    placed = attach_groups(placed.withColumn("_key", key), members, "_key", "_members", total, F.col("at"))
    rounds = _grow(placed.select("tree", (F.col("at") - F.col("_first")).alias("pos"), "n", "node", "_id", *[f"_k{i}" for i in range(len(keep))]), "leaf")
    subroots = rounds[0][1]
    for _, done in rounds[1:]:
        subroots = subroots.unionByName(done)
    whole = F.lit(0).cast("long")
    over = _grow(subroots.select(whole.alias("tree"), F.col("tree").alias("pos"), F.lit(n_trees).alias("n"), F.col("node")), "root")
    tops = _descend(over, lambda done: done.select("tree", F.array().cast(PATH).alias("path"), F.col("node").alias("root")), ["root"])
    tops = materialise(tops.select(F.col("pos").alias("tree"), "path", F.col("node").alias("subroot"), "root"), "subroots")
    found = _descend(rounds, lambda done: done.select("tree").join(tops, "tree"), ["subroot", "root"])
    return found.select(F.col("_id").alias(id_col), F.col("node").alias(node), "subroot", "root", "path", *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)])


def verify(docs: DataFrame, group: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """Leaves of documents, their proofs, and the roots that folding gives after a third of the texts were lower-cased."""
    def of(text: Column) -> Column:
        return leaf(F.col(id_col), F.col("source"), F.col("lang"), F.col("n_chars"), text)

    picked = F.crc32(F.col(id_col).cast("string")) % 3 == 0
    rows = docs.select(id_col, group, of(F.col("text")).alias("leaf"), F.when(picked, of(F.translate("text", *LOWER))).alias("tampered"))
    found = manifest(rows, group, id_col, "leaf", ("tampered",))
    found = found.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("path")))
    return found.select(id_col, "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
