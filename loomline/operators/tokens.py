"""Token ids by a public vocabulary, whose file and pattern are parameters."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import mixing

_encodings: dict[tuple[str, str], object] = {}


def encoding(path: str, pattern: str):
    """One a worker process and vocabulary: tasks carry the path, which all executors must see."""
    if (path, pattern) not in _encodings:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        _encodings[path, pattern] = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path, pattern]


def token_ids(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids array<int>) of whole texts, without special tokens; a null text has none.  Rows are handed on one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoding(path, pattern)
        for batch in batches:
            for i, value in enumerate(batch.column(1)):
                ids = known.encode_ordinary(value.as_py() or "")
                yield pa.record_batch([batch.column(0).slice(i, 1), pa.array([ids], pa.list_(pa.int32()))], names=[id_col, "ids"])

    return docs.select(F.col(id_col).cast("long"), text).mapInArrow(run, f"{id_col} long, ids array<int>")


def token_blocks(tokens: DataFrame, block: int, end: int, id_col: str = "doc_id", seed: str = "0") -> DataFrame:
    """(block, ids): all documents one after the other in shuffled order, each followed by ``end``, cut every ``block`` ids; the last one may be shorter.

    Where a document begins is a sum of lengths by buckets; then each sends its pieces to the blocks that it lies in,
    so a task holds a block and never the stream.
    """
    sized = tokens.withColumn("_n", F.size("ids") + 1)
    placed = mixing.running(sized, [], [id_col], F.col("_n"), "_from", id_col, seed)
    first, last = F.floor(F.col("_from") / block), F.floor((F.col("_from") + F.col("_n") - 1) / block)
    pieces = placed.select("_from", F.concat("ids", F.array(F.lit(end))).alias("_all"), F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest(F.col("block") * block - F.col("_from"), F.lit(0)).cast("int")
    stop = F.least((F.col("block") + 1) * block - F.col("_from"), F.size("_all")).cast("int")
    cut = pieces.select("block", F.greatest(F.col("_from"), F.col("block") * block).alias("_at"), F.slice("_all", begin + 1, stop - begin).alias("_ids"))
    joined = cut.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("_at", "_ids"))).alias("_parts"))
    return joined.select("block", F.flatten(F.transform("_parts", lambda p: p["_ids"])).alias("ids"))


def byte_ngram_ids(docs: DataFrame, most: int = 4, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids array<bigint>): ``T.ngram_ids`` of a text's UTF-8 bytes, each where it first occurs; a null text has none.

    As lambdas over arrays a document of 2,500 bytes took about 10 ms; rows are handed on a few at a time.
    """
    def distinct(raw: bytes) -> pa.Array:
        one = np.frombuffer(raw, np.uint8).astype(np.int64) + 1
        ids = [one]
        for n in range(2, most + 1):  # without a zero digit no two lengths share a number
            ids.append(ids[-1][:-1] * 256 + one[n - 1 :])
        return pa.array(np.concatenate(ids)).unique()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                ids, raw = batch.slice(at, 64).columns
                found = [distinct(x.as_py()) for x in raw]
                ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                yield pa.record_batch([ids, pa.ListArray.from_arrays(ends, pa.concat_arrays(found))], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("_b")).mapInArrow(run, f"{id_col} {kind}, ids array<bigint>")
