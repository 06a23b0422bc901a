"""Small files of which much is made a row."""

import random

from pyspark.sql import functions as F

from loomline.operators import puzzles
from loomline.plans import packing
from loomline.tables import spread


def parts(spark, folder, n):
    rows = spark.range(n).select(F.col("id").alias("p_partkey"), F.concat(F.lit("b"), F.col("id") % 5).alias("p_brand"), (F.col("id") % 50).cast("int").alias("p_size"))
    rows.coalesce(1).write.parquet(f"{folder}/part.parquet")
    return str(folder)


def test_rows_of_one_file_are_dealt(spark, tmp_path):
    folder = parts(spark, tmp_path, 5000)
    assert spread(spark.read.parquet(f"{folder}/part.parquet"), 1000).rdd.getNumPartitions() == 5
    outputs, names = packing._outputs(packing._tests(spark, folder))
    assert outputs.rdd.getNumPartitions() >= 3
    assert outputs.count() == names.count() == 40_000
    assert names.columns == ["identifier", "name"] and "name" not in outputs.columns
    assert spread(spark.range(0)).count() == 0


def test_grids_of_any_shape_and_place(spark):
    rng = random.Random(5)
    made = []
    for i in range(200):
        h, w, top, left = (rng.randrange(1, 7), rng.randrange(1, 7), rng.randrange(3), rng.randrange(3))
        made.append((i, [[rng.randrange(10) for _ in range(w)] for _ in range(h)], top, left))
    rows = spark.createDataFrame(made, "i int, g array<array<int>>, top int, left int")
    tokens = puzzles.encoded(F.col("g"), 7, F.col("top"), F.col("left"))
    got = {r.i: (r.e, r.c) for r in rows.select("i", tokens.alias("e"), puzzles.cropped(tokens, 7).alias("c")).collect()}
    for i, g, top, left in made:
        try:
            want = puzzles.encode(g, 7, top, left)
        except ValueError:
            want = None
        assert got[i][0] == want
        assert want is None or got[i][1] == (puzzles.crop(want, 7) or [])
    odd = spark.createDataFrame([([[1, 2], [3]],), ([[1, None], [3, 4, 5]],)], "g array<array<int>>").select(puzzles.encoded(F.col("g"), 3).alias("e")).collect()
    assert [r.e for r in odd] == [[3, 4, 1, 5, None, 1, 1, 1, 0], [3, None, 1, 5, 6, 1, 1, 1, 0]]


def test_each_query_of_a_small_file_makes_its_rows_in_several_tasks(spark, tmp_path):
    folder = parts(spark, tmp_path, 12_000)
    spark.range(25_000).select(F.col("id").alias("event_id")).coalesce(1).write.parquet(f"{folder}/events.parquet")
    assert packing.maze_symmetries(spark, folder).rdd.getNumPartitions() >= 3
    drawn = packing.sudoku_pool(spark, folder)
    assert drawn.count() == 12_000 and len([f for f in drawn.inputFiles() if "kept-0" in f]) > 0
    for query in (packing.puzzle_symmetries, packing.puzzle_colourings):
        plan = query(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
        assert "Repartition 6, true" in plan


def test_symmetries_of_rows_that_repeat_an_id(spark):
    grids = [(1, [[1, 2], [3, 4]]), (1, [[1, 3], [2, 4]]), (2, [[5]]), (3, [[0, 1, 2]])]
    rows = spark.createDataFrame(grids, "puzzle_id int, grid array<array<int>>")
    made = puzzles.augment(rows, colours=0).collect()
    want = {}
    for i, g in grids:
        for k in range(8):
            t = str(puzzles.dihedral(g, k))
            want[i, t] = min(k, want.get((i, t), 9))
    assert {(r.puzzle_id, str(r.grid)): r.symmetry for r in made} == want and len(made) == len(want)
    turned = puzzles.all_turned(rows.limit(1), "grid").collect()
    assert [r.grid for r in sorted(turned, key=lambda r: r.symmetry)] == [puzzles.dihedral(grids[0][1], k) for k in range(8)]
