"""Sinks: Parquet with one schema, resumable stages, manifests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mixing


def write_documents(docs: DataFrame, path: str) -> None:
    docs.write.option("compression", "snappy").parquet(path)


def once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A stage that's skipped if its folder was committed before: the file ``_rows``, written last, is the sentinel and holds the number of rows.

    A folder whose tables hold another number is an error: files were lost or added.
    """
    paths = spark._jvm.org.apache.hadoop.fs
    done = paths.Path(path, "_rows")
    files = done.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(done):
        make().write.mode("overwrite").parquet(path)
        out = files.create(done, True)
        out.writeBytes(str(spark.read.parquet(path).count()))  # from the footers
        out.close()
        return spark.read.parquet(path)
    rows, text = spark.read.parquet(path), files.open(done)
    said = int(bytes(text.read() for _ in range(files.getFileStatus(done).getLen())))
    text.close()
    if rows.count() != said:
        raise RuntimeError(f"{path} was committed with {said} rows")
    return rows


def contiguous_shards(rows: DataFrame, id_col: str, size: int, valid_shards: int = 2) -> DataFrame:
    """Adds shard and part (the first shards are valid, the rest train) in order of id."""
    placed = mixing.placed(rows, [id_col], "_n").withColumn("shard", F.floor(F.col("_n") / size)).drop("_n")
    return placed.withColumn("part", F.when(F.col("shard") < valid_shards, "valid").otherwise("train"))


def fingerprint(*columns: str) -> Column:
    """SHA-256 of the columns' texts, joined with a separator."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def collapse_to_meta(rows: DataFrame, keep: list[str], name: str = "meta") -> DataFrame:
    """All other columns become one JSON text."""
    return rows.select(*keep, F.to_json(F.struct(*[c for c in rows.columns if c not in keep])).alias(name))
