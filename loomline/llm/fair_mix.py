"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source is a queue of its documents in a fixed pseudo-random order, twice
over.  A document copy's virtual finish time is the number of words that its
queue has sent when the copy ends, divided by the source's target.  All copies
are then ranged by finish time, and the mix is the longest beginning of that
range which stays within the total budget.

Targets: sources, by code point with null last, weigh 5, 2, 1 and so on again,
and share ``share`` of all words; no target exceeds ``epochs`` times its
source's words, and what that leaves over is shared again by weight until no
target is above.  That fixed point is found in closed form (``targets``).

The order hashes the id (MD5), so it doesn't depend on partitions: reruns
agree.  A null text has size 0.  Rows of size 0 take no words; sources without
words have target 0.  Repeated rows are queued each for itself.  An empty table
gives an empty result.  Only id, text and source are read, so other columns may have
any name; ``mixed_rows`` returns all of them.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialise

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: Words that all targets hold, as a share of all words there are.
SHARE = 1.5
#: How often a document may be taken.
EPOCHS = 2
#: Slots of the finish times at each of two levels.
SLOTS = 4096
#: The targets' sum is a float; sums of words are whole.
SLACK = 1e-6
WORD = r"[^\x20\x09-\x0D]+"


def targets(sized: DataFrame, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, size): a row a source.

    Sources are a dimension: one row for each is ranked in one place.  In order
    of cap by weight, the sources before some point are held at their caps; the
    level of the rest is what remains of the budget divided by their weights.  The
    point is the first at which the next source's cap is no longer below that
    level.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS)))
    weighed = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (turn + 1).cast("int")))
    weighed = weighed.withColumn("_cap", F.col("source_size") * epochs)
    by_level = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.partitionBy()
    level = (F.lit(share) * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("_w").over(after)
    leveled = weighed.withColumn("_level", level)
    free = F.col("_cap") / F.col("_w") >= F.col("_level")
    settled = leveled.withColumn("_final", F.min(F.when(free, F.struct(F.col("_cap") / F.col("_w"), F.col("_level").alias("l")))).over(all_rows)["l"])
    target = F.when(F.col("_cap") <= F.col("_w") * F.col("_final"), F.col("_cap").cast("double")).otherwise(F.col("_w") * F.col("_final"))
    return settled.select("source", "source_size", F.coalesce(target, F.col("_cap").cast("double")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = SHARE, epochs: int = EPOCHS, row_col: str | None = None) -> DataFrame:
    """A row a document: doc_id, size, source_size, target, copies, taken and, if ``row_col`` is given, that column as row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = [F.col(row_col).alias("row")] if row_col else []
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), *row)
    row = ["row"] if row_col else []
    hashed = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    # texts are read once; all that follows works on sizes
    sized = materialise(sized.withColumn("_turn", hashed), "mix-sizes").withColumn("_b", F.conv(F.substring("_turn", 1, 3), 16, 10).cast("int"))
    goals = targets(sized, share, epochs)

    sums = sized.groupBy("source", "_b").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    starts = starts.join(goals.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    starts = starts.withColumnsRenamed({"source": "_source", "_b": "_bucket"})
    here = Window.partitionBy("source", "_b").orderBy("_turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = sized.join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_b") == F.col("_bucket")))
    queued = queued.withColumn("_cum", F.col("_start") + F.sum("size").over(here))
    queued = materialise(queued.select("doc_id", "size", "source_size", "target", "_turn", "_cum", *row), "mix-queues")

    budget = goals.agg(F.sum("target")).first()[0] or 0.0
    end = _end_of_mix(queued, budget, epochs)
    copies = []
    for epoch in range(epochs):
        taken = F.col("size") > 0
        if end is not None:
            taken = taken & (_place(F.lit(epoch)) <= F.struct(*(F.lit(x) for x in end)))
        copies.append(F.when(taken, F.lit(1)).otherwise(F.lit(0)))
    n = reduce(add, copies).cast("long")
    return queued.select("doc_id", "size", "source_size", "target", n.alias("copies"), (n * F.col("size")).alias("taken"), *row)


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **parameters) -> DataFrame:
    """``docs`` with each row as often as the mix takes it.  Rows without words have nothing to mix and stay once.

    Rows are told apart by a number that each gets in a written copy, so repeated
    and null ids count each for itself.
    """
    packed = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"), F.monotonically_increasing_id().alias("row"))
    packed = materialise(packed.select("doc", "id", "source", "row"), "mix-rows")
    text = packed["doc"][text_col].alias("text")
    queues = mix(packed.select("id", text, "source", "row"), "id", "text", "source", row_col="row", **parameters)
    times = queues.select(F.col("row").alias("_row"), F.when(F.col("size") == 0, 1).otherwise(F.col("copies")).cast("int").alias("times")).filter("times > 0")
    taken = packed.select("doc", "row").join(times, F.col("row") == F.col("_row"))
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select("doc.*")


def _place(epoch: Column) -> Column:
    """Where a copy stands in the global range; copies that tie in all of it are taken together."""
    return F.struct(_finish(epoch), F.col("_turn"), epoch.cast("int"))


def _finish(epoch: Column) -> Column:
    return (F.col("_cum") + epoch * F.col("source_size")) / F.col("target")


def _end_of_mix(queued: DataFrame, budget: float, epochs: int) -> tuple | None:
    """The place (finish, turn, epoch) of the last copy within the budget; None if all are.

    Finish times are ranged in slots, then the slot in which the budget ends in
    finer ones; only the copies of one finest slot, a 2**-24 part of a source's
    queue, are put in order in one place.
    """
    copies = queued.filter("size > 0").withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    copies = copies.withColumn("_finish", _finish(F.col("_epoch")))
    sent, inside = 0, copies
    for width in (2.0 / SLOTS, 2.0 / SLOTS / SLOTS):
        slots = inside.groupBy(F.floor(F.col("_finish") / width).alias("_slot")).agg(F.sum("size").alias("_sum"))
        # over SLOTS slots only those beyond finish time 2, which no mix within its targets reaches
        slots = slots.withColumn("_until", F.lit(sent) + F.sum("_sum").over(Window.orderBy("_slot")))
        cut = slots.filter(F.col("_until") > budget + SLACK).agg(F.min(F.struct("_slot", F.col("_until") - F.col("_sum")))).first()[0]
        if cut is None:
            return None
        inside, sent = inside.filter(F.floor(F.col("_finish") / width) == cut[0]), cut[1]
        first = cut[0] * width
    ranged = Window.orderBy("_finish", "_turn", "_epoch")
    edge = inside.withColumn("_total", F.lit(sent) + F.sum("size").over(ranged)).filter(F.col("_total") <= budget + SLACK)
    last = edge.agg(F.max(F.struct("_finish", "_turn", "_epoch"))).first()[0]
    return (first, "", -1) if last is None else tuple(last)
