"""The batch operators as Structured Streaming stages, and stateful token packing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def run_available(spark: SparkSession, source: str, schema, stage: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_per_batch: int = 100) -> None:
    """Everything that ``source`` holds and no earlier run has done; the checkpoint makes it resumable."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.parquet").parquet(source)
    query = stage(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def pack_tokens(rows: DataFrame, block: int, end: int) -> DataFrame:
    """(shard, tokens): blocks of ``block`` tokens; what is left of a shard's stream is carried to its next rows.

    ``rows``: (shard, tokens array<int>).  Each document ends with ``end``.
    """
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        out = []
        for frame in frames:
            for tokens in frame["tokens"]:
                held += [*map(int, tokens), end]  # NumPy numbers can't be kept as state
            whole = len(held) // block * block
            out += [held[i : i + block] for i in range(0, whole, block)]
            held = held[whole:]
        state.update((held,))
        yield pd.DataFrame({"shard": [key[0]] * len(out), "tokens": out})

    return rows.groupBy("shard").applyInPandasWithState(step, "shard int, tokens array<int>", "held array<int>", "append", GroupStateTimeout.NoTimeout)
