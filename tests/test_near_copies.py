"""Near copies by MinHash against all pairs, with hubs of many."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.operators import dedup, lookup
from loomline.sources.shared import written


def jaccard_pairs(docs, threshold=0.8):
    """All pairs by brute force over words, in Python."""
    import re

    sets = {}
    for r in docs.collect():
        words = re.findall(r"[^\W]+", (r.text or "").lower())
        sets[r.doc_id] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())
    ids, out = sorted(i for i in sets if sets[i]), {}
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if min(len(sets[a]), len(sets[b])) >= threshold * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                    out[a, b] = both / (len(sets[a]) + len(sets[b]) - both)
    return out


def components(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


def test_recall_and_precision_on_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    unique = dedup.exact(docs, F.sha2("text", 256), "doc_id")
    want = jaccard_pairs(unique)
    links = {(r.a, r.b): r.similarity for r in dedup.near_links(unique).collect()}
    assert all(links[p] == pytest.approx(want[p]) for p in links)
    got, true = components(links), components(want)
    joined = sum(got.get(a) is not None and got.get(a) == got.get(b) for a, b in want) / max(1, len(want))
    print("pairs", len(want), "recall", joined)
    assert len(want) >= 3 and joined >= 0.97 and sum(got.get(x) == true[x] for x in true) >= 0.97 * len(true)


def test_recall_near_the_threshold(spark):
    """Pairs planted at similarities from 0.8 to 0.86 among unrelated texts, and below it, where none may be linked."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(20_000)]
    rows, planted, below = [], [], []
    for k in range(300):
        base = rng.choices(words, k=200)
        for target, into in ((rng.uniform(0.8, 0.86), planted), (rng.uniform(0.6, 0.75), below)):
            other, changed = list(base), 0
            while True:  # a changed word spoils up to five shingles
                a, b = ({tuple(t[i : i + 5]) for i in range(196)} for t in (base, other))
                s = len(a & b) / len(a | b)
                if s < target + 0.03:
                    break
                other[rng.randrange(200)] = rng.choice(words)
                changed += 1
            into.append((len(rows), len(rows) + 1, s))
            rows += [" ".join(base), " ".join(other)]
            base = rng.choices(words, k=200)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(8)
    links = {(r.a, r.b) for r in dedup.near_links(docs).collect()}
    at = [(a, b) for a, b, s in planted + below if s >= 0.8]
    recall = sum(p in links for p in at) / len(at)
    print("recall at 0.8 to 0.89:", recall, "of", len(at))
    assert len(at) > 200 and recall >= 0.95 and links <= set(at)


def test_a_group_of_a_third_of_all_texts(spark):
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in rng.integers(0, 5000, 150)]
    texts = []
    for _ in range(1500):
        other = list(base)
        for at in rng.integers(0, 150, 2):
            other[at] = f"x{rng.integers(0, 10_000)}"
        texts.append(" ".join(other))
    texts += [" ".join(f"w{i}" for i in rng.integers(0, 5000, 60)) for _ in range(3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    kept = sorted(r.doc_id for r in dedup.minhash_dedup(docs).select("doc_id").collect())
    assert kept[0] == 0 and len([k for k in kept if k < 1500]) <= 15 and [k for k in kept if k >= 1500] == list(range(1500, 4500))


def test_components_and_dealt_rows(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(900, 900 + i) for i in range(1, 3000)]
    edges = [(a, b) for a, b in edges if a != b]
    got = {r.node: r.component for r in dedup.min_label(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == components(edges)
    rows = written(spark.range(5000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"), "id"), "t")
    wide = spark.range(0, 5000, 3).select(F.col("id").alias("k"), F.array_repeat("id", 10).alias("v"))
    found = lookup.deal(rows, wide, "k").collect()
    assert sorted(r.id for r in found) == sorted(i for i in range(5000) if i % 2 == 0 or i % 3 == 0) and all(r.v == [r.k] * 10 for r in found)
