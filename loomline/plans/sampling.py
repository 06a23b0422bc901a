"""Queries that sample, split, mix and pack."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mixing
from ..tables import table
from .registry import query

_LAID = "sum({v}) OVER ({by} ORDER BY md5('0:' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_WEIGHTS = [("src0", 5.0), ("src1", 2.0), ("src2", 1.0), ("src3", 2.0)]
_W_SQL = "(VALUES " + ", ".join(f"('{s}', {w}::DOUBLE)" for s, w in _WEIGHTS) + ") t(source, weight)"


def _budgets(spark):
    return mixing.budgets(spark.createDataFrame(_WEIGHTS, "source string, weight double"), 50_000)


@query("SELECT source, weight, weight / sum(weight) OVER () * (50000 * 3.8::DOUBLE) AS char_budget FROM (SELECT source, sqrt(sum(length(text))) AS weight FROM documents GROUP BY source)")
def source_budgets(spark, d):
    """Weighed by the root of a source's size, so that large ones don't take all."""
    sizes = table(spark, d, "documents").groupBy("source").agg(F.sqrt(F.sum(F.length("text"))).alias("weight"))
    return mixing.budgets(sizes, 50_000)


@query(f"""
WITH b AS (SELECT source, weight / sum(weight) OVER () * (50000 * 3.8::DOUBLE) AS char_budget FROM {_W_SQL}),
r AS (SELECT d.doc_id, d.source, char_budget, coalesce({_LAID.format(v='length(text)', by='PARTITION BY d.source')}, 0) AS before FROM documents d JOIN b USING (source))
SELECT doc_id, source FROM r WHERE before < char_budget""")
def capped_by_budget(spark, d):
    return mixing.cap_by_budget(table(spark, d, "documents"), _budgets(spark)).select("doc_id", "source")


@query(f"""
WITH r AS (SELECT doc_id, source, md5('0:' || doc_id) AS h, coalesce({_LAID.format(v='length(text)', by='PARTITION BY source')}, 0) AS before FROM documents)
SELECT doc_id, 'val-' || lpad((row_number() OVER (ORDER BY h, doc_id) - 1)::VARCHAR, 8, '0') AS val_id FROM r WHERE before < 5000""")
def validation_sample(spark, d):
    cut = mixing.running(table(spark, d, "documents"), ["source"], ["doc_id"], F.length("text"), "before").filter("before < 5000")
    placed = mixing.numbered(cut.select("doc_id", "_h"), mixing.by_hash("_h"), ["_h", "doc_id"], "n")
    return placed.select("doc_id", F.concat(F.lit("val-"), F.lpad(F.col("n").cast("string"), 8, "0")).alias("val_id"))


@query(f"""
WITH r AS (SELECT doc_id, length(text) AS n, coalesce({_LAID.format(v='length(text) + 1', by='')}, 0) AS start FROM documents)
SELECT doc_id, start::BIGINT AS start, (start // 2049)::BIGINT AS first_block, ((start + n) // 2049)::BIGINT AS last_block FROM r""")
def packed_blocks(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("n"))
    return mixing.concat_and_chunk(rows, 2048)


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 3")
def few_shots(spark, d):
    return mixing.take_per_key(table(spark, d, "documents"), "source", "doc_id", 3).select("doc_id", "source")


@query("""
SELECT doc_id, quality, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY md5('0:' || doc_id), doc_id) <= greatest(1, floor(count(*) OVER (PARTITION BY quality) * 0.9::DOUBLE)) THEN 'train' ELSE 'test' END AS part FROM labels""")
def stratified_split(spark, d):
    return mixing.stratified_split(table(spark, d, "labels"), "quality", "doc_id", 0.9).select("doc_id", "quality", "part")


@query("SELECT item_id, ntile(7) OVER (ORDER BY item_id)::INT AS subset, CASE WHEN row_number() OVER (ORDER BY item_id) > count(*) OVER () - ceil(0.05::DOUBLE * count(*) OVER ()) THEN 'test' ELSE 'train' END AS part FROM benchmark")
def contiguous_subsets(spark, d):
    rows = mixing.placed(table(spark, d, "benchmark").select("item_id"), ["item_id"], "i", total="n")
    tail = F.col("i") >= F.col("n") - F.ceil(F.lit(0.05) * F.col("n"))
    return rows.select("item_id", mixing.subset_of(F.col("i"), F.col("n"), 7).alias("subset"), F.when(tail, "test").otherwise("train").alias("part"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('0:' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM documents) WHERE r <= ceil(n * 12.5::DOUBLE / 100)")
def random_percent(spark, d):
    docs = table(spark, d, "documents").select("doc_id", mixing.shuffled("doc_id").alias("_h"))
    placed = mixing.numbered(docs, mixing.by_hash("_h"), ["_h", "doc_id"], "i", total="n")
    return placed.filter(F.col("i") < F.ceil(F.col("n") * 0.125)).select("doc_id")


@query("SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT AS round FROM documents")
def round_robin(spark, d):
    return mixing.interleave(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id")


@query("""
WITH p AS (SELECT source, arg_min(doc_id, md5('0:' || doc_id)) AS doc_id, min(md5('0:' || doc_id)) AS h FROM documents GROUP BY source),
b AS (SELECT source, doc_id, (row_number() OVER (ORDER BY h, source) - 1) // 6 AS batch, count(*) OVER () AS n FROM p)
SELECT source, doc_id, batch::BIGINT AS batch FROM b WHERE (batch + 1) * 6 <= n""")
def group_diverse_batches(spark, d):
    return mixing.group_diverse_batches(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 6)


@query("SELECT event_id, ((((event_id % 1000037) * (event_id % 1000037)) % 1000037 * (event_id % 1000037)) % 1000037 * 12345) % 1000037 AS place FROM events")
def cubic_order(spark, d):
    # 1000037 is prime and 2 modulo 3
    return table(spark, d, "events").select("event_id", mixing.cubic_permutation(F.col("event_id"), 12345, 1_000_037).alias("place"))


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('k' || doc_id), doc_id) = 1")
def one_per_source(spark, d):
    from ..operators import dedup

    return dedup.keep_one_per_key(table(spark, d, "documents"), "source", "doc_id", "k").select("doc_id", "source")


@query()
def multipacked(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    return mixing.multipack_by_shard(rows, mixing.shards_for(rows), 4, 4096)


@query()
def next_fit_packs(spark, d):
    grouped = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))).alias("a"))
    lengths = F.transform("a", lambda x: x["n"])
    return grouped.select("conv_id", mixing.next_fit(lengths, 600).alias("packs"))


_POSITIONS = "WITH p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS position FROM documents)"


def _u(keys: str, seed: str = "0") -> str:
    return f"((('0x' || substr(md5('{seed}:' || {keys}), 1, 12))::BIGINT::DOUBLE + 0.5::DOUBLE) / 281474976710656::DOUBLE)"


def _positions(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return mixing.placed(docs, ["doc_id"], "position", ["source"])


@query(f"{_POSITIONS} SELECT doc_id, source, round(sum(-ln({_u("source || ':' || position")})) OVER (PARTITION BY source ORDER BY position), 6) AS at FROM p")
def live_shards_interleaved(spark, d):
    """Sources as shards, of which each next row comes from any that is left."""
    return mixing.random_interleave(_positions(spark, d), "source", "position").select("doc_id", "source", F.round("at", 6).alias("at"))


def _moved(table_: str, place: str, buffer: int, level: int, out: str) -> str:
    return f"SELECT *, row_number() OVER (ORDER BY {place} - {buffer} * ln({_u(place, f'0:{level}')}), {place}) - 1 AS {out} FROM {table_}"


@query(f"""
{_POSITIONS}, s AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS p0 FROM p GROUP BY source),
s1 AS ({_moved("s", "p0", 100, 0, "p1")}), s2 AS ({_moved("s1", "p1", 100, 1, "p2")}), t AS (SELECT *, coalesce(sum(n) OVER (ORDER BY p2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s2),
q AS (SELECT p.doc_id, (start + position)::BIGINT AS place FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source), r AS ({_moved("q", "place", 100, 2, "r")}),
b AS (SELECT DISTINCT r // 16 AS b FROM r), c AS ({_moved("b", "b", 1000, 3, "batch")})
SELECT doc_id, batch, (r % 16)::INT AS slot FROM r JOIN c ON r // 16 = b""")
def shards_streamed(spark, d):
    """Shards, their rows and batches of 16 through four shuffle buffers."""
    return mixing.shard_stream(_positions(spark, d), "source", "position", 16).select("doc_id", "batch", "slot")
