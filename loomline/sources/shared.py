"""Where queries put files that other tasks read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_path(spark: SparkSession, label: str) -> str:
    """A new place in the folder that ``spark.checkpoint.dir`` names; only a session on a local master may do without that setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = _own.setdefault(context.applicationId, tempfile.mkdtemp(prefix="loomline-"))
    return f"{folder.rstrip('/')}/loomline/{uuid.uuid4().hex}/{label}"


#: Spark 4.1 deletes a query's shuffle files at its end if so set, else some time after the driver's collector has found them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """What is written within leaves no shuffle files."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def written(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` as a table in that folder: several readers compute it once, and a lost executor costs nothing of it."""
    path = shared_path(rows.sparkSession, label)
    with shuffles_deleted(rows.sparkSession):
        rows.write.parquet(path)
    table = rows.sparkSession.read.schema(rows.schema).parquet(path)
    table._scratch = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more: all that came of them has been written."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._scratch)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path.getParent(), True)
