"""Token counts as an exact length histogram.

Each document is encoded once, whole, and only its length is kept.  Documents are
aggregated by encoded length and that histogram is written to the shared folder, so
that what reads it twice encodes nothing again.  Suffix sums over it answer, for
every context limit L, what would otherwise need another pass: how many documents
reach L, how many tokens they hold, how many tokens are left when each document
is cut at L, and which length stands at a quantile.

Documents may have columns of any name: only the id and the text are read.

The histogram has one row a distinct length.  Its suffix sums run in blocks of
``BLOCK`` lengths, so no task holds more than a block and the list of blocks.

A null text counts as empty and an empty text has length 0.  Limits between two
lengths are answered by ``truncated_total``; an empty table has no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialise

#: Lengths whose sums one window holds.
BLOCK = 256

_loaded: dict[tuple[str, str], object] = {}


def _encoding(rank_file: str, pattern: str):
    if (rank_file, pattern) not in _loaded:
        import tiktoken

        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
        _loaded[rank_file, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[rank_file, pattern]


def document_lengths(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens), in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(rank_file, pattern).encode_ordinary
        for batch in batches:
            counts = [len(encode(text.as_py())) for text in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id"), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """A row a length: n_tokens, n_docs, docs_at_least, tokens_at_least, truncated_tokens, quantile.

    ``truncated_tokens`` is the corpus's size when documents are cut at this
    length, ``quantile`` the share of documents of this length or less.
    """
    counts = materialise(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "token-histogram")
    counts = counts.withColumn("_block", F.floor(F.col("n_tokens") / BLOCK))
    counts = counts.withColumn("_tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = counts.groupBy("_block").agg(F.sum("n_docs").alias("_d"), F.sum("_tokens").alias("_t"))
    later = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    sums = blocks.select(
        F.col("_block").alias("_b"),
        F.coalesce(F.sum("_d").over(later), F.lit(0)).alias("_docs_after"),
        F.coalesce(F.sum("_t").over(later), F.lit(0)).alias("_tokens_after"),
        F.sum("_d").over(everything).alias("_docs"),
        F.sum("_t").over(everything).alias("_all"),
    )
    here = Window.partitionBy("_block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    joined = counts.join(sums, F.col("_block") == F.col("_b"))
    joined = joined.withColumn("docs_at_least", F.col("_docs_after") + F.sum("n_docs").over(here))
    joined = joined.withColumn("tokens_at_least", F.col("_tokens_after") + F.sum("_tokens").over(here))
    cut = F.col("_all") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")
    quantile = (F.col("_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("_docs")
    return joined.select("n_tokens", "n_docs", "docs_at_least", "tokens_at_least", cut.alias("truncated_tokens"), quantile.alias("quantile"))


def truncated_total(histogram: DataFrame, limit: int) -> int:
    """Tokens left when every document is cut at ``limit``, which need not be a length there is."""
    kept: Column = F.least(F.col("n_tokens"), F.lit(limit)) * F.col("n_docs")
    return histogram.agg(F.coalesce(F.sum(kept), F.lit(0))).first()[0]


def quantile_length(histogram: DataFrame, q: float) -> int | None:
    """The smallest length that a share ``q`` of all documents doesn't exceed."""
    return histogram.filter(F.col("quantile") >= q).agg(F.min("n_tokens")).first()[0]
