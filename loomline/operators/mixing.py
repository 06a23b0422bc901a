"""Budgets, samples, splits and packing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .lookup import attach


def shuffled(id_col: str, seed: str = "0") -> Column:
    """A repeatable shuffle order that DuckDB can reproduce."""
    return F.md5(F.concat(F.lit(seed + ":"), F.col(id_col).cast("string")))


def budgets(weights: DataFrame, tokens: int, characters_per_token: float = 3.8) -> DataFrame:
    """Adds char_budget: a source's weight over all weights, of all characters."""
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy())
    return weights.withColumn("char_budget", share * F.lit(tokens * characters_per_token))


def numbered(rows: DataFrame, bucket: Column, order: list, out: str, by: list[str] | None = None, total: str | None = None) -> DataFrame:
    """Adds the row number from 0 in order of ``bucket`` and ``order`` within ``by``, and the number of rows as ``total``.

    ``bucket`` doesn't go down in the order.  Buckets are counted first and only their
    counts are added up in one place, so no task holds a group.
    """
    by = by or []
    dealt = rows.withColumn("_b", bucket)
    counts = dealt.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    within = Window.partitionBy(*by)
    earlier = within.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    keys = [*by, "_b"]
    starts = counts.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"), F.sum("_n").over(within).alias("_total"))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)]
    here = Window.partitionBy(*keys).orderBy(*order)
    joined = dealt.join(starts, same).withColumn("_row", F.col("_start") + F.row_number().over(here) - 1)
    return joined.select(*rows.columns, F.col("_row").alias(out), *([F.col("_total").alias(total)] if total else []))


def placed(rows: DataFrame, order: list[str], out: str, by: list[str] | None = None, total: str | None = None) -> DataFrame:
    """Adds the row number from 0 in ``order`` within ``by``, and the number of rows as ``total``, whatever the order's values.

    The rows are range partitioned, sorted and written with their place in the partition; a partition's start is a
    sum over a row a partition, and a group's start is that of its first row, which goes to its rows dealt.
    """
    by = by or []
    ranged = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_row", F.monotonically_increasing_id())
    ranged = written(ranged, "in-order")
    task = F.shiftright("_row", 33)
    sizes = ranged.groupBy(task.alias("_task")).agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_task", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    at = F.col("_start") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    numbered_rows = ranged.join(F.broadcast(starts), task == F.col("_task")).select(*rows.columns, at.alias("_at"))  # a row a partition
    if not by:
        number = F.col("_at").alias(out)
        return numbered_rows.select(*rows.columns, number, *([F.lit(ranged.agg(F.count("*")).scalar()).alias(total)] if total else []))
    keyed = numbered_rows.withColumn("_group", F.struct(*by))
    groups = keyed.groupBy("_group").agg(F.min("_at").alias("_first"), F.count("*").alias("_all"))
    found = attach(keyed, groups, ["_group"])
    return found.select(*rows.columns, (F.col("_at") - F.col("_first")).alias(out), *([F.col("_all").alias(total)] if total else []))


def by_id(id_col: str) -> Column:
    """Buckets of 65,536 ids, for ids that are dense; ``placed`` numbers rows of any order."""
    return F.shiftright(F.col(id_col).cast("long"), 16)


def by_hash(hashed: str | Column, digits: int = 4) -> Column:
    """Buckets by the first hex digits of a hash: 65,536 of them."""
    return F.conv(F.substring(hashed, 1, digits), 16, 10).cast("int")


def running(rows: DataFrame, by: list[str], order: list, value: Column, out: str, id_col: str = "doc_id", seed: str = "0") -> DataFrame:
    """Exclusive running sum in shuffled order within ``by``, in two levels of 65,536 buckets so that no task holds a group."""
    dealt = rows.withColumn("_h", shuffled(id_col, seed)).withColumn("_v", value)
    dealt = dealt.withColumn("_b", by_hash("_h"))
    sums = dealt.groupBy(*by, "_b").agg(F.sum("_v").alias("_s"))
    earlier = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_s").over(earlier), F.lit(0))).drop("_s")
    within = Window.partitionBy(*by, "_b").orderBy("_h", *order).rowsBetween(Window.unboundedPreceding, -1)
    joined = dealt.join(starts, [*by, "_b"])
    return joined.withColumn(out, F.col("_start") + F.coalesce(F.sum("_v").over(within), F.lit(0))).drop("_b", "_v", "_start")


def cap_by_budget(docs: DataFrame, limits: DataFrame, source: str = "source", id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows while the sum of those before is under their source's char_budget: the crossing row stays.  Unknown sources go."""
    known = docs.join(limits.select(source, "char_budget"), source)
    return running(known, [source], [id_col], F.length(text), "before", id_col=id_col).filter(F.col("before") < F.col("char_budget")).drop("_h", "before", "char_budget")


def take_per_key(rows: DataFrame, key: str, order: str, n: int, shares: int = 64) -> DataFrame:
    """The first ``n`` rows of each key; each share of a key is cut to ``n`` rows before they meet."""
    dealt = rows.withColumn("_share", F.pmod(F.xxhash64(order), F.lit(shares)))
    first = dealt.withColumn("_r", F.row_number().over(Window.partitionBy(key, "_share").orderBy(order))).filter(F.col("_r") <= n)
    return first.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("_r") <= n).drop("_r", "_share")


def stratified_split(rows: DataFrame, key: str, id_col: str, share: float, seed: str = "0") -> DataFrame:
    """Adds ``part``: train for the first max(1, floor(n * share)) of a key in shuffled order, else test."""
    placed = numbered(rows.withColumn("_h", shuffled(id_col, seed)), by_hash("_h"), ["_h", id_col], "_i", [key], "_all")
    train = F.col("_i") < F.greatest(F.lit(1), F.floor(F.col("_all") * share))
    return placed.withColumn("part", F.when(train, "train").otherwise("test")).drop("_h", "_i", "_all")


def interleave(rows: DataFrame, source: str, order: str) -> DataFrame:
    """Round robin: adds ``round``; sort by (round, source)."""
    return placed(rows, [order], "round", [source]).withColumn("round", (F.col("round") + 1).cast("int"))


def group_diverse_batches(rows: DataFrame, group: str, id_col: str, size: int, seed: str = "0") -> DataFrame:
    """One pseudo-random row of each group, dealt into batches of ``size``; an incomplete last batch is dropped."""
    picked = rows.groupBy(group).agg(F.min(F.struct(shuffled(id_col, seed).alias("h"), F.col(id_col).alias("i"))).alias("p")).select(group, F.col("p.i").alias(id_col), F.col("p.h").alias("_h"))
    placed = numbered(picked, by_hash("_h"), ["_h", group], "_i", total="_n").withColumn("batch", F.floor(F.col("_i") / size))
    return placed.filter((F.col("batch") + 1) * size <= F.col("_n")).select(group, id_col, "batch")


def subset_of(i: Column, n: Column, subsets: int) -> Column:
    """Number from 1 of the contiguous subset that row ``i`` of ``n`` belongs to; the first ones hold one row more."""
    small, more = F.floor(n / subsets), F.pmod(n, F.lit(subsets))
    large = more * (small + 1)
    return F.when(i < large, F.floor(i / (small + 1))).otherwise(more + F.floor((i - large) / F.greatest(small, F.lit(1)))).cast("int") + 1


def cubic_permutation(index: Column, factor: int, prime: int) -> Column:
    """factor * i**3 mod prime, reduced after each product; a bijection if prime % 3 == 2."""
    if prime % 3 != 2:
        raise ValueError("the prime must be 2 modulo 3")
    p = F.lit(prime).cast("long")
    i = F.pmod(index.cast("long"), p)
    return F.pmod(F.pmod(F.pmod(i * i, p) * i, p) * F.lit(factor).cast("long"), p)


def concat_and_chunk(lengths: DataFrame, block: int, id_col: str = "doc_id", length: str = "n") -> DataFrame:
    """(id, start, first_block, last_block) of documents laid end to end, each with one end token; whole blocks of ``block`` + 1."""
    total = F.col(length) + 1
    laid = running(lengths.withColumn("_all", F.lit(0)), ["_all"], [id_col], total, "start", id_col=id_col)
    return laid.select(id_col, "start", F.floor(F.col("start") / (block + 1)).alias("first_block"), F.floor((F.col("start") + F.col(length)) / (block + 1)).alias("last_block"))


def next_fit(lengths: Column, capacity: int) -> Column:
    """Pack number of each length, in order; a pack closes when the next length doesn't fit."""

    @F.arrow_udf("array<int>")
    def packs(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for row in batch:
                pack, used, numbers = 0, 0, []
                for n in row.as_py() or ():
                    if used and used + n > capacity:
                        pack, used = pack + 1, 0
                    used += n
                    numbers.append(pack)
                out.append(numbers if row.is_valid else None)
            yield pa.array(out, pa.list_(pa.int32()))

    return packs(lengths.cast("array<bigint>"))


#: Rows of a shard that is packed by itself, about.
SHARD_ROWS = 1 << 16


def shards_for(rows: DataFrame, least: int = 8) -> int:
    """As many shards as keep each at about SHARD_ROWS rows."""
    return max(least, -(-rows.count() // SHARD_ROWS))


def lpt_fits(lengths: list[int], bins: int, capacity: int) -> bool:
    """Whether longest-processing-time packing fits."""
    heap = [0] * bins
    for n in sorted(lengths, reverse=True):
        if heap[0] + n > capacity:
            return False
        heapq.heapreplace(heap, heap[0] + n)
    return True


def multipack(lengths: list[int], bins: int, capacity: int) -> list[int]:
    """Step of each length: each step takes the longest prefix that LPT fits into ``bins`` of ``capacity``.  A length over capacity is -1."""
    out, at, step = [-1] * len(lengths), 0, 0
    usable = [i for i, n in enumerate(lengths) if n <= capacity]
    while at < len(usable):
        low, high = at + 1, min(len(usable), at + 1 + bins * capacity)
        while low < high:
            middle = (low + high + 1) // 2
            if lpt_fits([lengths[i] for i in usable[at:middle]], bins, capacity):
                low = middle
            else:
                high = middle - 1
        for i in usable[at:low]:
            out[i] = step
        at, step = low, step + 1
    return out


def lpt_bins(lengths: list[int], bins: int) -> list[int]:
    """Bin of each length by longest-processing-time packing."""
    heap, out = [(0, b) for b in range(bins)], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        used, b = heap[0]
        out[i] = b
        heapq.heapreplace(heap, (used + lengths[i], b))
    return out


def multipack_by_shard(rows: DataFrame, shards: int, bins: int, capacity: int, id_col: str = "doc_id", length: str = "n") -> DataFrame:
    """(id, shard, step, bin): packing is sequential, so rows are dealt into shards, each packed on its own; bin is the rank's in a step, -1 over capacity."""
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col)[[id_col, "shard", length]].reset_index(drop=True)
        pdf = pdf.assign(step=multipack(pdf[length].tolist(), bins, capacity), bin=-1)
        for step, part in pdf.groupby("step"):
            if step >= 0:
                pdf.loc[part.index, "bin"] = lpt_bins(part[length].tolist(), bins)
        return pdf[[id_col, "shard", "step", "bin"]]

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(id_col), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(pack, f"{id_col} long, shard int, step int, bin int")


def first_fit_by_shard(rows: DataFrame, shards: int, tokens: int, images: int, id_col: str = "doc_id") -> DataFrame:
    """(id, shard, pack) of rows with ``tokens`` and ``images``, in order of id, by greedy first fit within each shard."""
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col)
        return pdf[[id_col, "shard"]].assign(pack=greedy_first_fit(zip(pdf["tokens"], pdf["images"], strict=True), tokens, images))

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(id_col), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(pack, f"{id_col} long, shard int, pack int")


class _Free:
    """What is free in packs, of two kinds, in a tree that knows the most of each below its nodes."""

    def __init__(self) -> None:
        self.size, self.packs, self.most = 1, 0, [[-1, -1], [-1, -1]]

    def first(self, need: tuple[int, int]) -> int:
        """The first pack with room for both kinds, -1 without one; a part of the tree whose two greatest are different packs may be searched in vain."""
        stack = [1]
        while stack:
            at = stack.pop()
            if self.most[at][0] >= need[0] and self.most[at][1] >= need[1]:
                if at >= self.size:
                    return at - self.size
                stack += [2 * at + 1, 2 * at]
        return -1

    def put(self, pack: int, free: list[int]) -> None:
        at = self.size + pack
        self.most[at] = free
        while at := at // 2:
            a, b = self.most[2 * at], self.most[2 * at + 1]
            self.most[at] = [max(a[0], b[0]), max(a[1], b[1])]

    def open(self) -> int:
        if self.packs == self.size:
            old = self.most[self.size :]
            self.size *= 2
            self.most = [[-1, -1] for _ in range(2 * self.size)]
            for pack, free in enumerate(old):
                self.put(pack, free)
        self.packs += 1
        return self.packs - 1


def greedy_first_fit(items: Iterator[tuple[int, int]], tokens: int, images: int) -> list[int]:
    """Pack of each (tokens, images); an item over a capacity is dropped (-1)."""
    free, out = _Free(), []
    for t, i in items:
        if t > tokens or i > images:
            out.append(-1)
            continue
        pack = free.first((t, i))
        room = free.most[free.size + pack] if pack >= 0 else [tokens, images]
        pack = pack if pack >= 0 else free.open()
        free.put(pack, [room[0] - t, room[1] - i])
        out.append(pack)
    return out


def uniform(*keys: Column | str, seed: str = "0") -> Column:
    """A number between 0 and 1, neither included, that only depends on the keys and the seed."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in (F.col(k) if isinstance(k, str) else k for k in keys)])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)


def random_interleave(rows: DataFrame, shard: str, position: str, seed: str = "0") -> DataFrame:
    """Adds ``at``: read in its order, the next row comes from one of the shards that have rows left, each with equal probability.

    Each shard is a clock that ticks after exponential times, and its i-th row stands at its i-th tick.  Clocks have
    no memory, so whichever shards are left, the next tick is any one's alike; a shard that has run out ticks no more.
    Ticks are running sums, by buckets of 65,536 positions, so no task holds a shard; the order is one global sort
    away, and whatever reads a range of ``at`` needs no more than that range.  ``position`` counts a shard's rows from 0.
    """
    dealt = rows.withColumn("_wait", -F.ln(uniform(shard, position, seed=seed))).withColumn("_b", F.shiftright(F.col(position).cast("long"), 16))
    sums = dealt.groupBy(shard, "_b").agg(F.sum("_wait").alias("_s"))
    earlier = Window.partitionBy(shard).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col(shard).alias("_shard"), F.col("_b").alias("_k"), F.coalesce(F.sum("_s").over(earlier), F.lit(0.0)).alias("_start"))
    within = Window.partitionBy(shard, "_b").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    joined = dealt.join(starts, F.col(shard).eqNullSafe(F.col("_shard")) & (F.col("_b") == F.col("_k")))
    return joined.select(*rows.columns, (F.col("_start") + F.sum("_wait").over(within)).alias("at"))


def buffer_shuffled(rows: DataFrame, place: str, buffer: int, out: str, seed: str = "0") -> DataFrame:
    """``rows`` with ``out``, their new places from 0 on, after a shuffle that moves them about as far as a buffer of that size would.

    A row leaves a full buffer with probability 1/buffer a step, so it comes out after a wait that is geometric; here
    the wait is its continuous counterpart, which each row draws for itself.
    """
    moved = rows.withColumn("_to", F.col(place) - buffer * F.ln(uniform(place, seed=seed)))
    return numbered(moved, F.floor(F.col("_to") / 65536), ["_to", place], out).drop("_to")


def shard_stream(rows: DataFrame, shard: str, position: str, batch: int, buffers: tuple[int, int, int, int] = (100, 100, 100, 1000), seed: str = "0") -> DataFrame:
    """Adds ``batch`` and ``slot``: shards shuffled twice through buffers, their rows in sequence through a third, batches of them through a fourth.

    Shards are as many as files and are ordered in one place; rows are counted by shard and numbered by buckets.
    """
    shards = rows.groupBy(shard).agg(F.count("*").alias("_rows"))
    shards = shards.withColumn("_p0", F.row_number().over(Window.orderBy(F.col(shard).asc_nulls_first())) - 1)
    for level in (0, 1):
        shards = buffer_shuffled(shards, f"_p{level}", buffers[level], f"_p{level + 1}", f"{seed}:{level}")
    before = Window.orderBy("_p2").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select(F.col(shard).alias("_shard"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    placed = rows.join(shards, F.col(shard).eqNullSafe(F.col("_shard"))).withColumn("_place", F.col("_start") + F.col(position)).drop("_shard", "_start")
    dealt = buffer_shuffled(placed, "_place", buffers[2], "_q", f"{seed}:2").withColumn("_batch", F.floor(F.col("_q") / batch)).withColumn("slot", (F.col("_q") % batch).cast("int"))
    batches = buffer_shuffled(dealt.select("_batch").distinct(), "_batch", buffers[3], "batch", f"{seed}:3").withColumnRenamed("_batch", "_of")
    return dealt.join(batches, F.col("_batch") == F.col("_of")).select(*rows.columns, "batch", "slot")
