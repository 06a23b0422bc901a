"""Edit distances of whole texts."""

import random

from pyspark.sql import functions as F

from loomline.functions import answers


def test_edit_distance_is_that_of_the_table(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("ab😀é") for _ in range(rng.randrange(80)))
    pairs = [(word(), word()) for _ in range(300)] + [("", ""), ("a", ""), ("abc", "abc"), ("xx" + "a" * 70, "a" * 70)]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.levenshtein("a", "b").alias("d")).collect()
    assert [answers.edit_distance(r.a, r.b) for r in rows] == [r.d for r in rows]
    long = "".join(rng.choice("abcdefgh") for _ in range(40_000))  # a table of 1.6 * 10 ** 9 cells
    assert answers.edit_distance("z" + long[::2], "y" + long[::2][:-1]) == 2


def test_anls_of_missing_texts(spark):
    rows = spark.createDataFrame([(1, None, ["a"]), (2, "a", [None]), (3, "a", []), (4, "a", None), (5, " ", ["a"]), (6, " Ab", ["x", "ab ", None]), (7, "abcd", ["abxy"])], "i int, p string, a array<string>")
    got = {r.i: r.s for r in rows.select("i", answers.anls(F.col("p"), F.col("a")).alias("s")).collect()}
    assert got == {1: 0.0, 2: 0.0, 3: None, 4: None, 5: 0.0, 6: 1.0, 7: 0.0}
