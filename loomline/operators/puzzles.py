"""Grid puzzles: encodings, symmetries and validity, as pure functions on lists with DataFrame wrappers."""

from __future__ import annotations

import hashlib
import math
import re
from collections import deque

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import written

Grid = list[list[int]]
#: Tokens: 0 pads, 1 ends a row or column, digits follow.
PAD, END, FIRST = 0, 1, 2


def dihedral(grid: Grid, k: int) -> Grid:
    """One of the 8 symmetries: k % 4 quarter turns counter-clockwise, mirrored first if k >= 4."""
    out = [row[::-1] for row in grid] if k >= 4 else [row[:] for row in grid]
    for _ in range(k % 4):
        out = [list(r) for r in zip(*out, strict=True)][::-1]
    return out


def undo_dihedral(grid: Grid, k: int) -> Grid:
    """Turns back by k % 4 quarters, then mirrors if k >= 4."""
    out = dihedral(grid, (4 - k % 4) % 4)
    return dihedral(out, 4) if k >= 4 else out


def recolour(grid: Grid, mapping: list[int]) -> Grid:
    return [[mapping[v] for v in row] for row in grid]


def encode(grid: Grid, size: int = 30, top: int = 0, left: int = 0) -> list[int]:
    """size * size tokens; the cells right of and below the grid are marked where there's room."""
    out = [PAD] * (size * size)
    h, w = len(grid), len(grid[0])
    if top + h > size or left + w > size:
        raise ValueError("the grid doesn't fit")
    for r, row in enumerate(grid):
        for c, v in enumerate(row):
            out[(top + r) * size + left + c] = v + FIRST
    for c in range(left, min(size, left + w)):
        if top + h < size:
            out[(top + h) * size + c] = END
    for r in range(top, min(size, top + h)):
        if left + w < size:
            out[r * size + left + w] = END
    return out


def crop(tokens: list[int], size: int = 30) -> Grid:
    """The largest rectangle of digits from the top left."""
    best, widest, found = 0, size, (0, 0)
    for r in range(size):
        width = next((c for c in range(widest) if not FIRST <= tokens[r * size + c] < FIRST + 10), widest)
        widest = min(widest, width)
        if (r + 1) * widest > best:
            best, found = (r + 1) * widest, (r + 1, widest)
    return [[tokens[r * size + c] - FIRST for c in range(found[1])] for r in range(found[0])]


def sudoku_symmetry(board: Grid, digits: list[int], rows: list[int], columns: list[int], transpose: bool) -> Grid:
    """``digits`` maps 1-9 (index 0 stays 0); rows and columns are permuted after a transposition."""
    out = [list(r) for r in zip(*board, strict=True)] if transpose else board
    return [[digits[out[r][c]] for c in columns] for r in rows]


def sudoku_valid(cells: Column) -> Column:
    """Whether 81 digits hold 1-9 in each row, column and box."""
    units = []
    for i in range(9):
        units.append([9 * i + j for j in range(9)])
        units.append([9 * j + i for j in range(9)])
        units.append([9 * (3 * (i // 3) + j // 3) + 3 * (i % 3) + j % 3 for j in range(9)])
    ok = F.size(cells) == 81
    for unit in units:
        part = F.array(*[F.get(cells, F.lit(i)) for i in unit])
        ok = ok & (F.size(F.array_intersect(part, F.array(*[F.lit(d) for d in range(1, 10)]))) == 9)
    return F.coalesce(ok, F.lit(False))


def maze_distance(maze: list[str], start: str = "S", goal: str = "G", wall: str = "#") -> int:
    """Steps of the shortest way, -1 without one."""
    where = {v: (r, c) for r, row in enumerate(maze) for c, v in enumerate(row) if v in (start, goal)}
    if len(where) < 2:
        return -1
    seen, queue = {where[start]}, deque([(where[start], 0)])
    while queue:
        (r, c), n = queue.popleft()
        if (r, c) == where[goal]:
            return n
        for y, x in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
            if 0 <= y < len(maze) and 0 <= x < len(maze[y]) and maze[y][x] != wall and (y, x) not in seen:
                seen.add((y, x))
                queue.append(((y, x), n + 1))
    return -1


def _transposed(grid: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(grid[0]) - 1), lambda j: F.transform(grid, lambda row: F.get(row, j)))


def turned(grid: Column, k: int, transposed: Column | None = None) -> Column:
    """``dihedral`` as an expression on array<array<int>>: a transposition at most, then rows or columns the other way round.

    The transposition reads the grid once a column, so an expression that costs should be a column first (``once``).
    ``transposed`` is the transposition where it is known, for those who turn a grid more than once.
    """
    out = (_transposed(grid) if transposed is None else transposed) if k % 2 else grid
    if k in (2, 3, 4, 7):
        out = F.transform(out, lambda row: F.reverse(row))
    return F.reverse(out) if k in (1, 2, 6, 7) else out


def colouring(seed: Column) -> Column:
    """Colours 1 to 9 in an order that only depends on the seed, behind 0, which stays: the new colour by the old one."""
    order = F.array_sort(F.transform(F.sequence(F.lit(1), F.lit(9)), lambda c: F.struct(F.md5(F.concat_ws(":", seed, c.cast("string"))).alias("h"), c.alias("c"))))
    return F.concat(F.array(F.lit(0)), F.transform(order, lambda x: x["c"]))


def mapped(grid: Column, mapping: Column) -> Column:
    return F.transform(grid, lambda row: F.transform(row, lambda v: F.get(mapping, v.cast("int"))))


def recoloured(grid: Column, seed: Column) -> Column:
    """Colours 1 to 9 in an order that only depends on the seed; 0 stays."""
    return mapped(grid, colouring(seed))


def augment(puzzles: DataFrame, id_col: str = "puzzle_id", grid: str = "grid", colours: int = 0, seed: str = "0") -> DataFrame:
    """(id, symmetry, colouring, grid): the distinct symmetries of each puzzle, as it is (colouring 0) and in ``colours`` other colourings."""
    rows = puzzles.select(id_col, F.col(grid).cast("array<array<int>>").alias(grid))
    seeds = [F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string"), F.lit(str(i))) for i in range(1, colours + 1)]
    rows = T.once(rows, _m=F.array(*[colouring(s) for s in seeds]).cast("array<array<int>>"))  # an order a colouring, not a cell
    rows = T.once(rows, _g=F.concat(F.array(grid), F.transform("_m", lambda m: mapped(F.col(grid), m))))
    each = [F.struct((F.col("_i") * 8 + k).alias("n"), turned(F.col("_c"), k, F.col("_t")).alias(grid)) for k in range(8)]
    made = T.once(rows.select(id_col, F.posexplode("_g").alias("_i", "_c")), _t=_transposed(F.col("_c"))).select(id_col, F.inline(F.array(*each)))
    first = made.groupBy(id_col, grid).agg(F.min("n").alias("n"))  # numbers and grids as they are: counted in a hash table, not sorted
    return first.select(id_col, (F.col("n") % 8).cast("int").alias("symmetry"), F.floor(F.col("n") / 8).cast("int").alias("colouring"), grid)


# How the name of an augmented puzzle is put together, and ``turned``'s number of each of its transforms.
NAME_SEPARATOR = "|||"
NAMED_TRANSFORMS = [0, 1, 2, 3, 4, 6, 5, 7]


def augmented_name(name: Column, transform: int, mapping: Column) -> Column:
    """The name of a puzzle that was recoloured and then put through a named transform."""
    return F.concat_ws(NAME_SEPARATOR, name, F.lit(f"t{transform}"), F.array_join(F.transform(mapping, lambda v: v.cast("string")), ""))


def named_augmentation(name: Column) -> Column:
    """struct(name, transform, mapping): what an augmented name says; a plain name has transform 0 and a null mapping."""
    parts = F.split(name, r"\|\|\|")
    plain = F.size(parts) < 3
    digits = F.filter(F.split(F.element_at(parts, -1), ""), lambda c: c != "")
    mapping = F.when(~plain, F.transform(digits, lambda c: c.cast("int")))
    number = F.when(plain, F.lit(0)).otherwise(F.substring(F.element_at(parts, -2), 2, 1).cast("int"))
    return F.struct(parts[0].alias("name"), number.alias("transform"), mapping.alias("mapping"))


def augmented(grid: Column, transform: int, mapping: Column) -> Column:
    return turned(mapped(grid, mapping), NAMED_TRANSFORMS[transform])


def unaugmented(grid: Column, transform: Column, mapping: Column) -> Column:
    """The inverse of ``augmented``, with the transform as a column; one of the eight ways back is evaluated a row."""
    back = F.when(transform == 0, grid)
    for number in range(1, 8):  # quarter turns are undone by the rest of a full turn; mirrorings undo themselves
        k = NAMED_TRANSFORMS[number]
        back = back.when(transform == number, turned(grid, k if k >= 4 else 4 - k))
    order = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda v: F.array_position(mapping, v).cast("int") - 1)
    return F.when(mapping.isNull(), back).otherwise(F.transform(F.array(order), lambda o: mapped(back, o))[0])


def encoded(grid: Column, size: int = 30, top: Column | int = 0, left: Column | int = 0) -> Column:
    """``encode`` as an expression on array<array<int>>; a grid that doesn't fit gives null."""
    top, left = (F.lit(v) if isinstance(v, int) else v for v in (top, left))
    height, width = F.size(grid), F.size(grid[0])

    def token(i: Column) -> Column:
        r, c = F.floor(i / size).cast("int") - top, i % size - left
        in_rows, in_columns = (r >= 0) & (r < height), (c >= 0) & (c < width)
        edge = ((r == height) & in_columns) | ((c == width) & in_rows)
        return F.when(in_rows & in_columns, F.get(F.get(grid, r), c).cast("int") + FIRST).when(edge, END).otherwise(PAD)

    def line(row: Column) -> Column:
        cells = F.transform(F.sequence(F.lit(0), width - 1), lambda c: F.get(row, c).cast("int") + FIRST)
        edge = F.array_repeat(F.lit(END), F.when(left + width < size, 1).otherwise(0))
        return F.concat(F.array_repeat(F.lit(PAD), left), cells, edge, F.array_repeat(F.lit(PAD), F.greatest(size - left - width - 1, F.lit(0))))

    # row by row, so that what pads costs nothing a cell; each cell by itself only where the grid has none or begins outside
    under = F.concat(F.array_repeat(F.lit(PAD), left), F.array_repeat(F.lit(END), width), F.array_repeat(F.lit(PAD), size - left - width))
    below = F.when(top + height < size, under).otherwise(F.array().cast("array<int>"))
    rest = F.array_repeat(F.lit(PAD), size * F.greatest(size - top - height - 1, F.lit(0)))
    by_row = F.concat(F.array_repeat(F.lit(PAD), size * top), F.flatten(F.transform(grid, line)), below, rest)
    inside = (top >= 0) & (left >= 0) & (height > 0) & (width > 0) & ~F.exists(grid, lambda row: row.isNull())
    cells = F.when(inside, by_row).otherwise(F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), token))
    return F.when((top + height <= size) & (left + width <= size), cells)


def cropped(tokens: Column, size: int = 30) -> Column:
    """``crop`` as an expression: the largest rectangle of digits from the top left, the one with fewer rows of equals; empty without a digit."""
    best = F.struct(F.lit(size).alias("w"), F.lit(0).alias("rows"), F.lit(0).alias("columns"))

    def grown(b: Column, r: Column) -> Column:
        digit = F.transform(F.slice(tokens, r * size + 1, b["w"]), lambda x: (x >= FIRST) & (x < FIRST + 10))

        def after(end: Column) -> Column:
            w = F.when(end > 0, end - 1).otherwise(b["w"])
            larger = (r + 1) * w > b["rows"] * b["columns"]
            return F.struct(w.alias("w"), F.when(larger, r + 1).otherwise(b["rows"]).alias("rows"), F.when(larger, w).otherwise(b["columns"]).alias("columns"))

        return F.when(b["w"] == 0, b).otherwise(F.transform(F.array(F.array_position(digit, False).cast("int")), after)[0])

    found = F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), best, grown)  # read in a lambda, which evaluates it once
    rows = F.transform(F.array(found), lambda b: F.when(b["rows"] > 0, F.transform(F.sequence(F.lit(0), b["rows"] - 1), lambda r: F.transform(F.slice(tokens, r * size + 1, b["columns"]), lambda x: x - FIRST))))
    return F.coalesce(rows[0], F.array().cast("array<array<int>>"))


def grid_key(grid: Column) -> Column:
    """SHA-256 of the number of rows, that of columns, and the cells, a byte each: equal for equal grids only."""
    numbers = F.concat(F.array(F.size(grid), F.when(F.size(grid) > 0, F.size(grid[0])).otherwise(0)), F.flatten(grid))
    return F.sha2(F.unhex(F.array_join(F.transform(numbers, lambda v: F.lpad(F.hex(v), 2, "0")), "")), 256)


def predictions(outputs: DataFrame, names: DataFrame, blank: int = 0, size: int = 30) -> DataFrame:
    """(name, input_key, prediction_key, prediction, confidence) of a model's outputs (identifier, inputs, preds, halt_logit).

    ``names`` (identifier, name) tells how a puzzle was augmented; both grids are cropped and put back to what they
    were, so that they can be joined with the puzzle's own.  Rows of the blank identifier are padding.  The names are
    as many as the augmented puzzles, however small the table that they are made of, and are never broadcast.
    """
    grids = outputs.filter(F.col("identifier") != blank)
    grids = T.once(grids, _i=cropped(F.col("inputs"), size), _p=cropped(F.col("preds"), size)).select("identifier", "_i", "_p", "halt_logit")  # before the join, which moves less
    rows = T.once(grids.join(names.hint("merge"), "identifier"), _n=named_augmentation(F.col("name"))).select("_n.*", "_i", "_p", "halt_logit")
    rows = T.once(rows, _was=unaugmented(F.col("_i"), F.col("transform"), F.col("mapping")), prediction=unaugmented(F.col("_p"), F.col("transform"), F.col("mapping")))
    confidence = 1 / (1 + F.exp(-F.col("halt_logit")))
    return rows.select("name", grid_key(F.col("_was")).alias("input_key"), grid_key(F.col("prediction")).alias("prediction_key"), "prediction", confidence.alias("confidence"))


def test_votes(found: DataFrame, tests: DataFrame) -> DataFrame:
    """(name, test, prediction_key, prediction, votes, mean_confidence, rank, right) by test input, from ``predictions`` and ``tests`` (name, test, input, output).

    Predictions count for every test of their puzzle with their input.  They rank by votes, then by mean confidence
    to nine places, then by key; a test without predictions gives no row.
    """
    keyed = tests.select("name", "test", grid_key(F.col("input")).alias("input_key"), grid_key(F.col("output")).alias("_truth"))
    counted = found.groupBy("name", "input_key", "prediction_key").agg(F.count("*").alias("votes"), F.round(F.avg("confidence"), 9).alias("mean_confidence"), F.first("prediction").alias("prediction"))
    rows = keyed.join(counted, ["name", "input_key"])
    order = Window.partitionBy("name", "test").orderBy(F.desc("votes"), F.desc("mean_confidence"), "prediction_key")
    ranked = rows.withColumn("rank", F.row_number().over(order))
    return ranked.select("name", "test", "prediction_key", "prediction", "votes", "mean_confidence", "rank", (F.col("prediction_key") == F.col("_truth")).alias("right"))


def pass_at(voted: DataFrame, tests: DataFrame, ks: list[int]) -> DataFrame:
    """(k, score): the mean over puzzles of the share of their tests with a right prediction among the k best; a test without predictions counts as missed."""
    firsts = voted.filter("right").groupBy("name", "test").agg(F.min("rank").alias("_r"))
    joined = tests.select("name", "test").join(firsts, ["name", "test"], "left")
    hits = [F.avg(F.coalesce((F.col("_r") <= k).cast("double"), F.lit(0.0))).alias(f"k{k}") for k in ks]
    means = joined.groupBy("name").agg(*hits).agg(*[F.avg(f"k{k}").alias(f"k{k}") for k in ks])
    return means.select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("score")) for k in ks])))


def maze_ids(maze: Column, characters: str = "# SGo") -> Column:
    """A maze's rows as one array of ids from 1 on, in the order of ``characters``."""
    return F.transform(F.filter(F.split(F.array_join(maze, ""), ""), lambda c: c != ""), lambda c: F.position(c, F.lit(characters)))


def pool(made: DataFrame, key: str, available: int, most: float = 0.9) -> DataFrame:
    """Distinct puzzles, the smallest id of each; more than a share ``most`` of those available are an error."""
    unique = made.groupBy(key).agg(F.min("id").alias("id"))
    if unique.count() > most * available:
        raise ValueError("too few puzzles are available for so many distinct ones")
    return unique


def _bits(row: Column, characters: str, other: bool = False) -> Column:
    """A mask of a row's cells that hold one of some characters (or none, with ``other``); column c is bit c, so a row has 62 at most."""
    inside = re.escape(characters)
    ones = F.regexp_replace(F.regexp_replace(F.reverse(row), f"[{'^' if not other else ''}{inside}]", "\u0000"), "[^\u0000]", "1")
    return F.coalesce(F.conv(F.replace(ones, F.lit("\u0000"), F.lit("0")), 2, 10).cast("long"), F.lit(0).cast("long"))


def _flood(free: Column, start: Column, goal: Column) -> Column:
    """Steps of the shortest way over free cells between two masks of cells, -1 without one; arrays of a mask a row."""

    def grown(r: Column, free: Column) -> Column:
        def row(here: Column, i: Column) -> Column:
            near = here.bitwiseOR(F.shiftleft(here, 1)).bitwiseOR(F.shiftright(here, 1))
            for other in (i - 1, i + 1):
                near = near.bitwiseOR(F.coalesce(F.get(r, other), F.lit(0).cast("long")))
            return near.bitwiseAND(F.get(free, i))

        return F.transform(r, row)

    def search(m: Column) -> Column:
        def step(s: Column, _: Column) -> Column:
            def after(g: Column) -> Column:
                met = F.exists(F.zip_with(g, m["goal"], lambda a, b: a.bitwiseAND(b)), lambda x: x != 0)
                return F.struct(g.alias("r"), (s["d"] + 1).alias("d"), F.when(met, 1).when(g == s["r"], 2).otherwise(0).alias("end"))

            return F.when(s["end"] != 0, s).otherwise(F.transform(F.array(grown(s["r"], m["free"])), after)[0])

        begin = F.struct(m["start"].alias("r"), F.lit(0).alias("d"), F.lit(0).alias("end"))
        cells = F.aggregate(m["free"], F.lit(0), lambda n, x: n + F.bit_count(x))
        found = F.aggregate(F.sequence(F.lit(1), F.greatest(cells, F.lit(1))), begin, step)
        return F.transform(F.array(found), lambda s: F.when(s["end"] == 1, s["d"]).otherwise(-1))[0]

    return F.transform(F.array(F.struct(free.alias("free"), start.alias("start"), goal.alias("goal"))), search)[0]


def maze_steps(maze: Column, start: str = "S", goal: str = "G", wall: str = "#") -> Column:
    """``maze_distance`` as an expression on array<string> whose rows have 62 characters at most: a flood over masks of rows."""
    free, begin, end = (F.transform(maze, of) for of in (lambda r: _bits(r, wall, True), lambda r: _bits(r, start), lambda r: _bits(r, goal)))
    return _flood(free, begin, end)


def maze_solved(maze: Column, solution: Column, path: str = "o", start: str = "S", goal: str = "G", wall: str = "#") -> Column:
    """Whether the cells that a solution marks, with the maze's start and goal, lead from one to the other and cross no wall."""
    begin, end, walls = (F.transform(maze, of) for of in (lambda r: _bits(r, start), lambda r: _bits(r, goal), lambda r: _bits(r, wall)))
    marked = F.transform(solution, lambda r: _bits(r, path))
    crossed = F.exists(F.zip_with(marked, walls, lambda a, b: F.coalesce(a.bitwiseAND(b), F.lit(0).cast("long"))), lambda x: x != 0)
    either = lambda a, b: F.coalesce(a, F.lit(0).cast("long")).bitwiseOR(F.coalesce(b, F.lit(0).cast("long")))
    free = F.zip_with(F.zip_with(marked, begin, either), end, either)
    return ~crossed & (_flood(free, begin, end) > 0)


def all_turned(rows: DataFrame, grid: str, number: str = "symmetry") -> DataFrame:
    """A row a symmetry and its number instead of each; the grid is transposed once for all."""
    others = [c for c in rows.columns if c != grid]
    each = F.array(*[F.struct(F.lit(k).alias(number), turned(F.col(grid), k, F.col("_t")).alias(grid)) for k in range(8)])
    return T.once(rows, _t=_transposed(F.col(grid))).select(*others, F.inline(each))


def maze_turned(maze: Column, k: int) -> Column:
    """One of the 8 symmetries of a maze whose rows are equally long."""
    cells = F.transform(maze, lambda row: F.filter(F.split(row, ""), lambda c: c != ""))
    return F.transform(F.transform(F.array(cells), lambda g: turned(g, k))[0], lambda row: F.array_join(row, ""))


# Rows and columns of a box, and the number of solutions there are.
BOXES = {4: (2, 2), 6: (2, 3), 9: (3, 3)}
SOLUTIONS = {4: 288, 6: 28_200_960, 9: 6_670_903_752_021_072_936_960}
#: Seeds that one task draws for.
SEEDS_A_TASK = 5000


def filled(size: int, rng: np.random.Generator) -> np.ndarray:
    """A random solution: cells in order, digits in random order, back where none fits."""
    height, width = BOXES[size]
    board = np.zeros((size, size), dtype=np.int8)

    def place(at: int) -> bool:
        if at == size * size:
            return True
        r, c = divmod(at, size)
        top, left = r - r % height, c - c % width
        used = {*board[r].tolist(), *board[:, c].tolist(), *board[top : top + height, left : left + width].ravel().tolist()}
        for digit in rng.permutation(size) + 1:
            if digit not in used:
                board[r, c] = digit
                if place(at + 1):
                    return True
        board[r, c] = 0
        return False

    place(0)
    return board


@F.udtf(returnType="puzzle string, solution string")
class SudokuOf:
    """A puzzle a seed: a random solution of which ``least`` to ``most`` digits are given, 0 for the others."""

    def eval(self, seed: str, size: int, least: int, most: int):
        rng = np.random.default_rng(list(hashlib.sha256(seed.encode()).digest()))
        board = filled(size, rng)
        given = np.zeros(size * size, dtype=bool)
        given[rng.permutation(size * size)[: rng.integers(least, most + 1)]] = True
        cells = board.ravel()
        yield "".join(map(str, np.where(given, cells, 0))), "".join(map(str, cells))


def sudoku_pool(seeds: DataFrame, size: int, least: int, most: int, id_col: str = "seed", share: float = 0.9, rounds: int = 200) -> DataFrame:
    """(id, puzzle, solution): a puzzle a row of ``seeds``, no two with one solution.

    All seeds draw; of those with one solution the smallest keeps it, the others and those whose solution is taken
    draw again, with the round in their seed.  The rows of a round are as many as were rejected, so the first rounds
    do nearly all the work; every round is written to the shared folder.  More seeds than ``share`` of the solutions
    that there are is an error, and so is not ending within ``rounds``.  Seeds must not repeat.
    """
    n = seeds.count()
    if n > share * SOLUTIONS[size]:
        raise ValueError(f"{n} puzzles of {SOLUTIONS[size]} solutions: at most {share:.0%} can be told apart")
    left, taken = seeds.select(F.col(id_col).alias("id")), None
    left = left.repartition(max(1, math.ceil(n / SEEDS_A_TASK)))  # a file of many seeds can be one split
    for step in range(rounds):
        drawn = left.select("id", F.concat_ws(":", F.col("id").cast("string"), F.lit(str(step))).alias("s"))
        drawn = written(drawn.lateralJoin(SudokuOf(F.col("s").outer(), F.lit(size), F.lit(least), F.lit(most))).drop("s"), f"drawn-{step}")
        fresh = drawn if taken is None else drawn.join(taken.select("solution"), "solution", "left_anti")
        kept = written(fresh.groupBy("solution").agg(F.min(F.struct("id", "puzzle")).alias("k")).select("k.id", "k.puzzle", "solution"), f"kept-{step}")
        taken = kept if taken is None else taken.unionByName(kept)
        left = written(drawn.select("id").join(kept.select("id"), "id", "left_anti"), f"left-{step}")
        if left.isEmpty():
            return taken.withColumnRenamed("id", id_col)
    raise RuntimeError(f"{rounds} rounds weren't enough")


def puzzle_metadata(rows: DataFrame, group: str, puzzle: str, size: int, pad: int = PAD, ignore: int = 0, vocabulary: int = 12) -> DataFrame:
    """One row that describes a set of puzzles: pad_id, ignore_label_id, blank_identifier_id, vocab_size, seq_len, num_puzzle_identifiers, total_groups, mean_puzzle_examples."""
    fixed = {"pad_id": pad, "ignore_label_id": ignore, "blank_identifier_id": 0, "vocab_size": vocabulary, "seq_len": size}
    counted = rows.agg(F.countDistinct(puzzle).alias("_p"), F.countDistinct(group).alias("total_groups"), F.count("*").alias("_n"))
    means = (F.col("_n") / F.col("_p")).alias("mean_puzzle_examples")
    return counted.select(*[F.lit(v).alias(k) for k, v in fixed.items()], (F.col("_p") + 1).alias("num_puzzle_identifiers"), "total_groups", means)
