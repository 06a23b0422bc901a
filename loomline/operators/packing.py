"""Token streams: shards, blocks, layouts and the order in which sources are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import mixing


def laid_out(rows: DataFrame, length: Column, id_col: str = "doc_id", seed: str = "0") -> DataFrame:
    """Adds ``start``: where a row begins when all are laid end to end in shuffled order."""
    laid = mixing.running(rows.withColumn("_all", F.lit(0)), ["_all"], [id_col], length.cast("long"), "start", id_col=id_col, seed=seed)
    return laid.drop("_all", "_h")


def token_shards(rows: DataFrame, end: int, most: int, id_col: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(shard, id, start, ids): documents closed by ``end``, in shards of about ``most`` tokens; a document isn't cut."""
    closed = rows.select(id_col, F.concat(F.col(ids), F.array(F.lit(end))).alias("ids"))
    return laid_out(closed, F.size("ids"), id_col).select(F.floor(F.col("start") / most).alias("shard"), id_col, "start", "ids")


def token_blocks(rows: DataFrame, block: int, end: int, id_col: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(block, ids): the stream of documents, each closed by ``end``, in whole blocks of ``block`` tokens; what is left at the end goes.

    ``ids`` may be a string, whose tokens are its characters: it moves as text, not as an array of them.
    """
    text = isinstance(rows.schema[ids].dataType, StringType)
    size, cut = (F.length, F.substring) if text else (F.size, F.slice)
    closed = laid_out(rows.select(id_col, F.concat(F.col(ids), F.lit(end) if text else F.array(F.lit(end))).alias("ids")), size("ids"), id_col)
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + size("ids") - 1) / block)
    pieces = closed.select("start", "ids", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest(F.col("block") * block - F.col("start"), F.lit(0)).cast("int")
    until = F.least((F.col("block") + 1) * block - F.col("start"), size("ids")).cast("int")
    pieces = pieces.select("block", "start", cut("ids", begin + 1, until - begin).alias("ids"))
    joined = pieces.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("start", "ids"))).alias("p"))  # a block's pieces hold ``block`` tokens
    parts = F.transform("p", lambda x: x["ids"])
    return joined.select("block", (F.array_join(parts, "") if text else F.flatten(parts)).alias("ids")).filter(size("ids") == block)


def instruction_layout(rows: DataFrame, context: int, id_col: str = "doc_id") -> DataFrame:
    """(id, start, answer, end) of (id, instruction, response) lengths: marks before and after an instruction with a condition, and after its response.

    A row that reaches ``context`` is an error.
    """
    size = F.col("instruction") + F.col("response") + 4
    checked = rows.select(id_col, "instruction", "response", F.when(size < context, size).otherwise(F.raise_error(F.lit("a row is as long as the context"))).cast("long").alias("size"))
    laid = laid_out(checked, F.col("size"), id_col)
    return laid.select(id_col, "start", (F.col("start") + F.col("instruction") + 3).alias("answer"), (F.col("start") + F.col("size")).alias("end"))


def sequence_bounds(ids: Column) -> Column:
    """Bounds of the runs of equal ids in a packed row, from 0 to its length; padding (id 0) at the end is no run."""
    places = F.sequence(F.lit(0), F.greatest(F.size(ids) - 1, F.lit(0)))
    starts = F.filter(places, lambda i: (F.get(ids, i) != 0) & ((i == 0) | (F.get(ids, i) != F.get(ids, i - 1))))
    used = F.size(F.filter(ids, lambda x: x != 0))
    return F.when(used > 0, F.concat(starts, F.array(used))).otherwise(F.array(F.lit(0)))


def until_budget(rows: DataFrame, size: Column, per_source: int, total: int, source: str = "source", id_col: str = "doc_id") -> DataFrame:
    """Rows of each source until its sizes reach ``per_source``, then of all until they reach ``total``: crossing rows stay."""
    kept = mixing.running(rows, [source], [id_col], size, "_before", id_col=id_col).filter(F.col("_before") < per_source).drop("_before", "_h")
    capped = mixing.running(kept.withColumn("_all", F.lit(0)), ["_all"], [id_col], size, "_before", id_col=id_col)
    return capped.filter(F.col("_before") < total).select(*rows.columns)


def two_level_budgets(sizes: DataFrame, shares: dict[str, float], total: int, least: int, language: str = "lang", source: str = "source") -> DataFrame:
    """(language, source, size, budget): a language's share of ``total`` dealt to its sources by size, no source above what it has.  Sources under ``least`` go."""
    share = F.lit(None).cast("double")
    for name, part in shares.items():
        share = F.when(F.col(language) == name, part).otherwise(share)
    used = sizes.groupBy(language, source).agg(F.sum("size").alias("size")).filter(F.col("size") >= least).withColumn("_share", share).filter("_share is not null")
    part = F.col("size") / F.sum("size").over(Window.partitionBy(language))
    return used.select(language, source, "size", F.least(part * F.col("_share") * total, F.col("size").cast("double")).alias("budget"))


def mixture_weights(names: DataFrame, short: float, name: str = "name") -> DataFrame:
    """(name, modality, alias, weight) of names like ``kind_alias_s``: short ones (ending in _s) weigh ``short``, and names that share an alias share its weight."""
    parts = names.select(name, F.regexp_extract(name, "^([a-z]+)_", 1).alias("modality"), F.regexp_extract(name, "^[a-z]+_(.*?)(_s)?$", 1).alias("alias"), F.col(name).endswith("_s").alias("_short"))
    one = F.when(F.col("_short"), short).otherwise(1.0)
    return parts.select(name, "modality", "alias", (one / F.count("*").over(Window.partitionBy("alias"))).alias("weight"))


def sampling_fractions(entries: DataFrame, percent: dict[str, float], short: float, second_share: float, origins: tuple[str, str], full: tuple[str, ...] = ()) -> DataFrame:
    """``entries`` (name, path, modality) with ``alias``, ``fraction`` and ``strategy``, how much of each data set a mixture samples.

    Names are ``origin:alias``.  A modality takes its ``percent``; unknown ones all, but
    names that hold "multiimage" that modality's.  Videos of at most 60 seconds, by the
    ``_from_to_s`` of the name or else the path, take ``short`` of it.  If several entries
    share an alias, those of the second origin take ``second_share`` and those of the first
    the rest.  Entries whose name or path holds one of ``full`` are taken whole.
    """
    name, path, modality = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in ("name", "path", "modality"))
    until = lambda c: F.regexp_extract(c, r"_(\d+)_(\d+)_s", 2).try_cast("long")
    many = percent.get("multiimage", 100) / 100
    base = F.when(modality == "video", percent["video"] / 100 * F.when(F.coalesce(until(name), until(path)) <= 60, short).otherwise(1.0))
    for kind in ("text", "image"):
        base = base.when(modality == kind, percent[kind] / 100)
    base = base.when((modality == "multiimage") | name.contains("multiimage"), many).otherwise(1.0)
    alias = F.when(name.contains(":"), F.trim(F.regexp_replace(name, "^[^:]*:", ""))).otherwise(name)
    shared = F.count("*").over(Window.partitionBy("alias")) > 1
    part = F.when(shared & name.startswith(origins[0] + ":"), 1 - second_share).when(shared & name.startswith(origins[1] + ":"), second_share).otherwise(1.0)
    whole = F.lit(False)
    for word in full:
        whole = whole | name.contains(word) | path.contains(word)
    fraction = F.when(whole, 1.0).otherwise(base * part)
    out = entries.withColumn("alias", alias).withColumn("fraction", fraction)
    return out.withColumn("strategy", F.concat(F.lit("random:"), F.when(whole, F.lit("100")).otherwise(F.round(F.col("fraction") * 100, 2).cast("string")), F.lit("%")))


def mini_epoch(rows: DataFrame, share: float, epoch: int, id_col: str = "doc_id", seed: str = "0") -> DataFrame:
    """Rows of one mini-epoch: below 1 the shard of 1/share that is its turn, from 1 on whole repeats and a shard for the rest.  Adds ``copy``."""
    place = F.conv(F.substring(mixing.shuffled(id_col, seed), 1, 8), 16, 10).cast("long")
    whole, rest = int(share), share - int(share)
    copies = F.lit(whole)
    if rest > 1e-9:
        shards = round(1 / rest)
        copies = copies + F.when(F.pmod(place, F.lit(shards)) == epoch % shards, 1).otherwise(0)
    return rows.withColumn("_n", copies).filter("_n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n")


def weighted_order(rows: DataFrame, weights: dict[str, float], source: str = "source", id_col: str = "doc_id", seed: str = "0") -> DataFrame:
    """Adds ``at``: read in its order, sources come up in proportion to their weights until they run dry.  Sources without a weight go."""
    weight = F.lit(None).cast("double")
    for name, w in weights.items():
        weight = F.when(F.col(source) == name, float(w)).otherwise(weight)
    known = rows.withColumn("_w", weight).filter("_w > 0").withColumn("_h", mixing.shuffled(id_col, seed))
    placed = mixing.numbered(known, mixing.by_hash("_h"), ["_h", id_col], "_i", [source])
    return placed.withColumn("at", (F.col("_i") + 1) / F.col("_w")).select(*rows.columns, "at")


def phase_of(step: Column, switch: int) -> Column:
    return F.when(step >= switch, "decay").otherwise("main")


def resumed(rows: DataFrame, seen: int, id_col: str = "doc_id", epoch: int = 0) -> DataFrame:
    """An epoch's rows without the first ``seen`` of its order; adds ``place``."""
    ordered = rows.withColumn("_h", mixing.shuffled(id_col, str(epoch)))
    placed = mixing.numbered(ordered, mixing.by_hash("_h"), ["_h", id_col], "place")
    return placed.filter(F.col("place") >= seen).drop("_h")
