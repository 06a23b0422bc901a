"""Mazes as masks against breadth-first search, and pools of puzzles without repeats."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from loomline.operators import puzzles
from loomline.plans import packing

FOLDER = "/root/testdata/sf0.001"


def test_steps_of_all_mazes_of_a_table(spark):
    found = packing.maze_steps(spark, FOLDER).collect()
    assert all(r.steps == puzzles.maze_distance(r.maze.split("\n")) for r in found)
    assert len({r.steps for r in found}) > 3 and any(r.steps == -1 for r in found) and len(found) == spark.read.parquet(f"{FOLDER}/events.parquet").count()


def test_steps_of_odd_mazes(spark):
    rng = random.Random(2)
    mazes = [["SG"], ["S", "G"], ["S#G"], ["G   S"], ["S"], [], [""], ["S ", "  #", "   G"], ["#" * 62, "S" + " " * 60 + "G"], ["S" + "#" * 10, "G"]]
    for _ in range(60):
        rows = [[rng.choice("  #") for _ in range(rng.randrange(1, 9))] for _ in range(rng.randrange(1, 7))]
        (a, b), (c, e) = (lambda r: (r, rng.randrange(len(rows[r]))))(rng.randrange(len(rows))), (lambda r: (r, rng.randrange(len(rows[r]))))(rng.randrange(len(rows)))
        rows[a][b], rows[c][e] = "S", "G"
        mazes.append(["".join(r) for r in rows])
    frame = spark.createDataFrame([(i, m) for i, m in enumerate(mazes)], "i int, m array<string>")
    got = {r.i: r.x for r in frame.select("i", puzzles.maze_steps(F.col("m")).alias("x")).collect()}
    assert [got[i] for i in range(len(mazes))] == [puzzles.maze_distance(m) for m in mazes]


def test_solutions_and_positions(spark):
    maze = ["S #", "# #", "  G"]
    marked = {"path": (["So#", "#o#", " oG"], True), "gap": (["So#", "# #", " oG"], False), "wall": (["So#", "#oo", " oG"], False), "none": (["S #", "# #", "  G"], False)}
    frame = spark.createDataFrame([(k, maze, s) for k, (s, _) in marked.items()], "k string, m array<string>, s array<string>")
    assert {r.k: r.x for r in frame.select("k", puzzles.maze_solved(F.col("m"), F.col("s")).alias("x")).collect()} == {k: ok for k, (_, ok) in marked.items()}
    turns = frame.select(*[puzzles.maze_turned(F.col("m"), k).alias(f"t{k}") for k in range(8)]).first()
    assert [list(t) for t in turns] == [["".join(r) for r in puzzles.dihedral([list(r) for r in maze], k)] for k in range(8)]


def solution_ok(text, size):
    rows, (height, width) = [text[i * size : (i + 1) * size] for i in range(size)], puzzles.BOXES[size]
    boxes = ["".join(rows[r + i][c : c + width] for i in range(height)) for r in range(0, size, height) for c in range(0, size, width)]
    return all(sorted(u) == [str(i + 1) for i in range(size)] for u in itertools.chain(rows, map("".join, zip(*rows, strict=True)), boxes))


@pytest.mark.parametrize(("size", "n"), [(4, 200), (6, 60), (9, 20)])
def test_pools_hold_no_solution_twice(spark, size, n):
    seeds = spark.range(n).withColumnRenamed("id", "seed").repartition(3)
    rows = puzzles.sudoku_pool(seeds, size, size, 2 * size).collect()
    assert sorted(r.seed for r in rows) == list(range(n)) and len({r.solution for r in rows}) == n
    assert all(solution_ok(r.solution, size) and size <= sum(c != "0" for c in r.puzzle) <= 2 * size for r in rows)
    assert all(p in ("0", s) for r in rows for p, s in zip(r.puzzle, r.solution, strict=True))
    if size == 6:
        assert sorted(map(tuple, puzzles.sudoku_pool(seeds, size, size, 2 * size).collect())) == sorted(map(tuple, rows))


def test_a_pool_that_is_too_large_is_refused(spark):
    with pytest.raises(ValueError, match="at most 90%"):
        puzzles.sudoku_pool(spark.range(260).withColumnRenamed("id", "seed"), 4, 4, 8)
    assert puzzles.sudoku_pool(spark.range(0).withColumnRenamed("id", "seed"), 4, 4, 8).count() == 0
