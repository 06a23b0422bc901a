"""Answers of mathematical texts, case by case."""

import pytest
from pyspark.sql import functions as F

from loomline.functions import latex

EXTRACTED = [
    (r"so \boxed{\frac12} ok", "math", r"\frac{1}{2}"),
    (r"The final answer is $5 \text{ m}$. I hope it is correct.", "minerva_math", "5"),
    ("The final answer is $a$. I hope. The final answer is $b$. I hope", "math", "a"),
    ("so the answer is 12 apples.", "gsm8k", "12"),
    ("it cost 3,456.00 dollars", "gsm8k", "3456"),
    ("first 7, then -0.5", "gsm8k", "-0.5"),
    ("the answer is (B).", "mmlu_stem", "B"),
    ("the answer is maybe", "aqua", "maybe"),
    ("答案是 C\n\nfoo 答案是 D", "aqua", "C"),
    ("x boxed", "math", ""),
    (r"\boxed{a{b}c} and \boxed 7$ z", "math", "7"),
    (r"\boxed{{3}^{4}} and {", "math", "{3}^{4}"),
    (r"\boxed{3", "math", "3"),
    ("The answer is: 4\n  2./", "x", "42"),
    ("the answer is кипять", "x", "пять"),
    ("no number", "x", ""),
    ("", "", ""),
    (None, "x", None),
    ("7", None, "7"),
]
NORMALISED = [
    (r" 3\dfrac{1}{2}. ", r"3\frac{1}{2}"),
    (r"\begin{array}{cc} 1 & 2 \end{array}", r"\begin{pmatrix}1&2\end{pmatrix}"),
    (r"\left( 1, 2 \right)", "(1,2)"),
    (r"x \neq 3", r"x\ne3"),
    (r"45^\circ", "45"),
    (r"\$12.50", "12.50"),
    (r"10 \text{ hours}", "10"),
    (r"\text{yes}", "yes"),
    ("5 miles", "5"),
    ("5 km h", "5"),
    ("m", "m"),
    ("twenty-one", "21"),
    ("two hundred five point two five", "205.25"),
    ("three million four thousand", "3004000"),
    ("two thousand thousand", "twothousthous"),
    ("007", "7"),
    ("000", "0"),
    (r"x\in (-\infty,\infty)", r"\mathbb{R}"),
    ("50 \\%", "50"),
    ("infinity", r"\infty"),
    ("-inf", r"-\infty"),
    ("3j + 2", "3i+2"),
    ("4.000", "4"),
    ("4.000x", "4x"),
    ("4.050", "4.050"),
    (".5", "0.5"),
    ("k = 5", "5"),
    ("abc = 5", "abc=5"),
    (r"\sqrt2", r"\sqrt{2}"),
    (r"\frac1{72}", r"\frac{1}{72}"),
    (r"\frac12 + \frac{3}{4}", r"\frac{1}{2}+\frac{3}{4}"),
    (r"\frac1", r"\frac1"),
    (r"\frac1\frac23", r"\frac1\frac23"),
    ("3/4", r"\frac{3}{4}"),
    ("-3/4", r"\frac{-3}{4}"),
    ("03/4", "03/4"),
    ("1/2/3", "1/2/3"),
    (r"\sqrt{3}/2", r"\frac{\sqrt{3}}{2}"),
    (r"5\mbox{cm}", "5"),
    (r"\mathbf{v}", "{v}"),
    ("", ""),
    (None, None),
]


def test_extracted_cases(spark):
    rows = spark.createDataFrame(EXTRACTED, "t string, d string, want string").repartition(4)
    assert [r for r in rows.withColumn("x", latex.extracted(F.col("t"), F.col("d"))).collect() if r.x != r.want] == []
    assert spark.createDataFrame([("no 5",)], "t string").select(latex.extracted(F.col("t"), F.lit("x"), last_number=False)).first()[0] == ""


def test_normalised_cases(spark):
    rows = spark.createDataFrame(NORMALISED, "t string, want string").repartition(4)
    assert [r for r in rows.withColumn("x", latex.normalised(F.col("t"))).collect() if r.x != r.want] == []
    assert spark.createDataFrame([("5 miles",)], "t string").select(latex.normalised(F.col("t"), keep_units=True)).first()[0] == "5miles"


@pytest.mark.parametrize("text", ["\\", "$", "{", "}", "\\frac", "\\boxed{", "he answer is", "答案是", "x" * 20_000 + " boxed{" + "{" * 300])
def test_odd_texts_give_something(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(latex.extracted(F.col("t"), F.lit("mmlu"))).first()[0] is not None
