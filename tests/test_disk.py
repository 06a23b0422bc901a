"""Tables and shuffle files that nothing reads any more go while a query runs (F1, F4)."""

import os
import time

from loomline.operators import dedup
from loomline.sources.shared import written


def test_shuffle_files_go_with_the_write(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = disk.getAllFiles().size()
    rows = written(spark.range(100_000).selectExpr("id % 5003 AS k").groupBy("k").count(), "grouped")
    for _ in range(50):
        if disk.getAllFiles().size() <= before:
            break
        time.sleep(0.2)
    assert disk.getAllFiles().size() <= before and rows.count() == 5003
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def tables(spark):
    return {os.path.join(at, name) for at, folders, _ in os.walk(spark.conf.get("spark.checkpoint.dir")) for name in folders}


def test_near_dedup_leaves_no_wide_tables(spark):
    before = tables(spark)
    texts = [f"{a} b c d e f g h i j k l m n o p q r s {z}" for a in "uv" for z in ("t", "x", "y")] + ["another text of few words"]
    kept = dedup.minhash_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 6]
    left = {os.path.basename(x) for x in tables(spark) - before}
    assert left and not [x for x in left if x.startswith(("shingles", "buckets", "met-", "pairs-", "with-a", "left-", "prefixes", "missed-", "edges", "moved"))]
