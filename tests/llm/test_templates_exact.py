"""op4: lines of a leaf that agree in enough positions are one template, whatever other lines there are."""

import random

import pytest
from pyspark.sql import functions as F

from loomline.llm import line_templates


def kept(spark, rows):
    return {r.doc_id: r.n_dropped for r in line_templates.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_lines_that_share_a_block_with_a_commoner_one_still_meet(spark):
    """Ten tokens, blocks of two: documents 1 and 2 share only "p q", whose commonest line agrees with neither."""
    rows = [(1, "a b c d p q r s t u"), (2, "a b c d p q r S t U"), *((i, "a b c d p q v w x y") for i in (3, 4, 5))]
    assert kept(spark, rows) == {1: 0, 2: 1, 3: 0, 4: 1, 5: 1}


@pytest.mark.parametrize("partners", [32, 1])
def test_templates_are_the_components_of_all_pairs(spark, monkeypatch, partners):
    """Also where blocks must be cut again and are dealt in chunks."""
    monkeypatch.setattr(line_templates, "PARTNERS", partners)
    monkeypatch.setattr(line_templates, "CHUNK", 5)
    rng = random.Random(7)
    lines = sorted({" ".join(["a", "b", "c", "d", *rng.choices("pqr", k=n - 4)]) for n in (5, 6, 7, 11, 16) for _ in range(90)})
    rng.shuffle(lines)
    root = {line: line for line in lines}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(lines):
        for y in lines[:i]:
            a, b = x.split(), y.split()
            if len(a) == len(b) and 5 * sum(map(str.__eq__, a, b)) >= 4 * len(a):
                root[top(x)] = top(y)
    first = {}
    for i, line in enumerate(lines):
        first.setdefault(top(line), i)
    assert len(first) > 20
    assert kept(spark, list(enumerate(lines))) == {i: int(first[top(line)] < i) for i, line in enumerate(lines)}


def test_only_pairs_that_may_be_linked_are_written(spark, monkeypatch):
    """300 lines of a leaf that have no link made a pair of texts each two; their sketches tell most apart, and never linked ones."""
    written, real = {}, line_templates.materialise

    def counted(df, label):
        out = real(df, label)
        written[label] = written.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(line_templates, "materialise", counted)
    monkeypatch.setattr(line_templates, "PARTNERS", 2048)
    rng = random.Random(3)
    lines = [" ".join(["a", "b", "c", "d", *("".join(rng.choices("pqrstuvw", k=3)) for _ in range(n - 4))]) for n in (40, 90) for _ in range(150)]
    changed = [(line.split(), at) for line in lines[::30] for at in (5, 20)]
    lines += [" ".join([*words[:at], "x", *words[at + 1 :]]) for words, at in changed]
    got = kept(spark, list(enumerate(lines)))
    assert sum(got.values()) == 20 and all(got[i] for i in range(300, 320))
    assert written["templates-apart-0"] < 300


@pytest.mark.parametrize("tokens", [5, 6, 11, 20, 68, 69, 150, 200])
def test_sketches_leave_linked_lines_open(spark, tokens):
    rng = random.Random(tokens)
    pairs = []
    for _ in range(60):
        a = ["a", "b", "c", "d", *rng.choices("pqrstuvw", k=tokens - 4)]
        b = list(a)
        for at in rng.sample(range(4, tokens), min(tokens // 5, tokens - 4)):
            b[at] = rng.choice("xyz")
        pairs.append((" ".join(a), " ".join(b)))
    rows = line_templates._sketched(spark.createDataFrame(pairs, "line string, other string")).withColumnRenamed("sketch", "s")
    rows = line_templates._sketched(rows.select(F.col("other").alias("line"), "s"))
    assert rows.filter(line_templates._alike("s", "sketch")).count() == 60
