"""Rows joined with what is known of their key, however often a key occurs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot if more than 1 / HOT_SHARE of the rows have it, so at most HOT_SHARE keys are.
HOT_SHARE = 1000


def attach(rows: DataFrame, known: DataFrame, key: list[str], sizes: DataFrame | None = None) -> DataFrame:
    """``rows`` left-joined with ``known``, which has a row a key at most; ``rows`` should be a written table, for it is read three times.

    With ``sizes`` (key ..., n), the number of rows of each key, as a written table, the rows are read once.

    The keys of the rows are counted with partial sums.  What is known of hot keys, at most HOT_SHARE rows by
    definition, is broadcast; their rows then take part in the shuffled join under a salt that nothing matches, so
    that they are dealt evenly.  A key with a null matches nothing and is dealt likewise.
    """
    others = [c for c in known.columns if c not in key]
    on = [f"_k{i}" for i in range(len(key))]
    named = [F.col(c).alias(k) for c, k in zip(key, on, strict=True)]
    total = rows.agg(F.count("*")).scalar() if sizes is None else sizes.agg(F.sum("n")).scalar()
    counted = rows.groupBy(*named).agg(F.count("*").alias("_n")) if sizes is None else sizes.select(*named, F.col("n").alias("_n"))
    hot = counted.filter(F.col("_n") * HOT_SHARE > total).drop("_n")
    packed = known.select(*named, F.struct(F.lit(1).alias("_there"), *others).alias("_v"))
    hot = hot.join(packed.withColumnRenamed("_v", "_hot"), on, "left").withColumn("_is_hot", F.lit(True))

    def same(left: list[str], right: list[str]) -> Column:
        out = F.lit(True)
        for a, b in zip(left, right, strict=True):
            out = out & (F.col(a) == F.col(b))
        return out

    out = rows.join(F.broadcast(hot), same(key, on), "left").drop(*on)
    settled = F.coalesce("_is_hot", F.lit(False))
    for c in key:
        settled = settled | F.col(c).isNull()
    # the salt is no literal where it is 0: Catalyst would take a literal out of the join's keys
    salt = F.when(settled, F.lit(1) + F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 20)).cast("int")).otherwise(F.lit(0))
    cold = packed.withColumn("_s", F.least(F.lit(0), F.col("_v._there") - 1))
    out = out.withColumn("_salt", salt).join(cold, same([*key, "_salt"], [*on, "_s"]), "left")
    value = F.coalesce("_hot", "_v")
    return out.select(*rows.columns, *[value[c].alias(c) for c in others])


#: Keys (distinct) that are broadcast, at most, so that only the wide rows that are asked for are shuffled.
MAX_KEYS = 1 << 20
#: Copies of a wide row that a hot key's rows are dealt over.
COPIES = 64


def deal(rows: DataFrame, wide: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``wide``, which has a row of any size a key; ``rows`` should be a written table.

    The wide row of a hot key is not broadcast but shuffled in COPIES copies, over which the key's rows are dealt.
    Wide rows that no row asks for stay where they are, if at most MAX_KEYS are asked for.
    """
    others = [c for c in wide.columns if c != key]
    asked = rows.select(F.col(key).alias("_asked")).distinct()
    if asked.count() <= MAX_KEYS:
        wide = wide.join(F.broadcast(asked), F.col(key) == F.col("_asked"), "left_semi")
    total = rows.agg(F.count("*")).scalar()
    hot = rows.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n")).filter(F.col("_n") * HOT_SHARE > total).select("_k", F.lit(True).alias("_hot"))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(COPIES)).cast("int")).otherwise(F.lit(0))
    salted = rows.join(F.broadcast(hot), F.col(key) == F.col("_k"), "left").select(*rows.columns, salt.alias("_salt"))
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(COPIES - 1))).otherwise(F.array(F.lit(0)))
    copied = wide.join(F.broadcast(hot), F.col(key) == F.col("_k"), "left").select(F.col(key).alias("_key"), F.explode(copies).alias("_copy"), *others)
    return salted.join(copied, (F.col(key) == F.col("_key")) & (F.col("_salt") == F.col("_copy"))).select(*rows.columns, *others)
