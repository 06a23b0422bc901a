"""Skew-proof building blocks: group lookup, prefix sums, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import discard, materialise

#: A group is hot if it holds over 1/HOT_SHARE of all rows, so at most HOT_SHARE groups are.
HOT_SHARE = 1000


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, members: str, total: int, spread: Column) -> DataFrame:
    """``rows`` left-joined with ``groups`` on ``key``; each row gets all other group columns.

    ``groups`` has one row a key and its number of rows in ``members``; ``total``
    is the sum of ``members``.  Hot groups number HOT_SHARE at most by
    definition, whatever the input, and are broadcast.  Rows that found theirs,
    and rows with a null key, are dealt evenly by ``spread`` and join nothing more;
    the others meet their group in a shuffled join in which no key holds over
    1/HOT_SHARE of the rows.
    """
    others = [c for c in groups.columns if c != key]
    packed = groups.select(F.col(key).alias("_k"), F.col(members).alias("_m"), F.struct(*others).alias("_g"))
    hot = packed.filter(F.col("_m") * HOT_SHARE > F.lit(total)).select("_k", F.col("_g").alias("_hot"))
    # 0, but no literal: Catalyst would take a literal out of the join's keys and deal hot rows by their key again
    zero = F.least(F.lit(0).cast("long"), F.col("_m").cast("long")).cast("int")
    cold = packed.filter(F.col("_m") * HOT_SHARE <= F.lit(total)).select("_k", zero.alias("_s"), F.col("_g").alias("_cold"))
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("_k"), "left").drop("_k")
    salt = F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), F.lit(0)).otherwise(F.lit(1) + F.pmod(F.xxhash64(spread), F.lit(1 << 20)).cast("int"))
    out = out.withColumn("_salt", salt).join(cold, (F.col(key) == F.col("_k")) & (F.col("_salt") == F.col("_s")), "left")
    got = F.coalesce("_hot", "_cold")
    return out.select(*rows.columns, *[got[c].alias(c) for c in others])


def prefix_sums(rows: DataFrame, group: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Running sum of ``value``, own row included, by ``bucket`` and then ``order`` within each ``group``.

    Buckets are summed first (with partial sums before the shuffle) and only
    those sums are accumulated in one place, so that no task holds a group.
    """
    sums = rows.groupBy(*group, bucket).agg(F.sum(value).alias("_sum"))
    over = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    keys = [*group, bucket]
    before = sums.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(keys)], F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    on = [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(keys)]
    joined = rows.join(before, on, "inner")
    return joined.withColumn(out, F.col("_before") + F.sum(value).over(within)).select(*rows.columns, out)


def components(edges: DataFrame, label: str, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b): rows (node, component).

    Alternates the large-star and small-star steps of Kiveris et al.,
    "Connected Components in MapReduce and Beyond" (SoCC 2014), until the edges
    are stars around the smallest node of each component.  Only the linked nodes
    take part.  The hub of a large component has most edges of a round: a node's
    smallest neighbour is an aggregate with partial sums, and goes back to the
    node's edges by ``attach_groups``, so that no task holds a hub.  Each round is
    written to the shared folder, and the driver sees three numbers a round.  Not
    settling within ``max_rounds`` is an error.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    current = materialise(edges.filter(F.col("a") != F.col("b")).select(high.alias("a"), low.alias("b")).distinct(), f"{label}-0")
    seen = _digest(current)
    for step in range(1, max_rounds + 1):
        if seen[0] == 0:
            break
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("m"), F.count("*").alias("n"))
        large = attach_groups(both, least, "a", "n", 2 * seen[0], F.col("b")).filter(F.col("b") > F.col("a"))
        before, large = current, materialise(large.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), f"{label}-{step}-large")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = attach_groups(large, least, "a", "n", large.count(), F.col("b")).filter(F.col("b") != F.col("m"))
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        current = materialise(small, f"{label}-{step}")
        discard(before, large)
        now = _digest(current)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components of {label} did not settle in {max_rounds} rounds")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _digest(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.shiftright(h, 20)), F.lit(0)), F.coalesce(F.bit_xor(h), F.lit(0))).first())
