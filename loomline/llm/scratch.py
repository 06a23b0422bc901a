"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import discard, shuffles_deleted

__all__ = ["discard", "materialise", "scratch_path", "shared_dir"]

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a session on a plain local master may go without that setting (unit
    tests); it then gets a temporary folder of its own.  On a cluster a missing
    setting is an error, because no machine-local folder would do.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = context.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="loomline-")
        context.setCheckpointDir(_local_dirs[app])
    return _local_dirs[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/loomline/{uuid.uuid4().hex}/{label}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a Parquet table in the shared folder and read it again.

    This cuts the lineage without a local checkpoint: losing an executor costs
    nothing that has been written.  The shuffle files go with the write.
    """
    path = scratch_path(df.sparkSession, label)
    with shuffles_deleted(df.sparkSession):
        df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table
