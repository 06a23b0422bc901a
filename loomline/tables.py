"""Tables by name."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame, per_task: int = 2000) -> DataFrame:
    """``rows`` dealt evenly over tasks of about ``per_task``: a small file is one task, however much is made of each of its rows."""
    return rows.repartition(max(1, math.ceil(rows.count() / per_task)))
