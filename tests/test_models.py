"""Language models against plain versions, and on rows that they didn't learn from."""

import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomline.operators import language_models, lookup
from loomline.sources.shared import written


def test_lookup_of_hot_unknown_and_null_keys(spark):
    rows = written(spark.range(6000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "unknown").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 900)).alias("a"), (F.col("id") % 2).alias("b"), "id"), "t")
    known = rows.filter("a is not null and a <> 'unknown'").groupBy("a", "b").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    got = lookup.attach(rows, known, ["a", "b"])
    assert got.columns == ["a", "b", "id", "n", "least"]
    want = {(r.a, r.b): (r.n, r.least) for r in known.collect()}
    found = got.collect()
    assert len(found) == 6000 and all((r.n, r.least) == want.get((r.a, r.b), (None, None)) for r in found)
    assert lookup.attach(rows.filter("false"), known, ["a", "b"]).count() == 0
    assert lookup.attach(rows, known.filter("false"), ["a", "b"]).filter("n is null").count() == 6000


def slow_perplexity(learn, texts, d=0.75):
    def grams(text):
        words = [" b", " b", *(text or "").split(), " e"]
        return list(zip(words, words[1:], words[2:], strict=False))

    c3 = Counter(g for t in learn for g in grams(t))
    c2 = Counter((v, w) for _, v, w in c3)
    c1 = Counter(w for _, w in c2)
    x3, k3, x2, k2 = Counter(), Counter(), Counter(), Counter()
    for (u, v, _), n in c3.items():
        x3[u, v] += n
        k3[u, v] += 1
    for (v, _), n in c2.items():
        x2[v] += n
        k2[v] += 1
    total = sum(c1.values())
    out = []
    for t in texts:
        logs = []
        for u, v, w in grams(t):
            p = max(c1[w] - d, 0) / total + d * len(c1) / total / (len(c1) + 1)
            if x2[v]:
                p = max(c2[v, w] - d, 0) / x2[v] + d * k2[v] / x2[v] * p
            if x3[u, v]:
                p = max(c3[u, v, w] - d, 0) / x3[u, v] + d * k3[u, v] / x3[u, v] * p
            logs.append(math.log10(p))
        out.append(round(10 ** (-sum(logs) / len(logs)), 1))
    return out


def test_perplexity_of_small_and_odd_texts(spark):
    learn = ["the cat sat on the mat", "the cat sat", "the dog sat on the mat", "a b a b a b", "", None, "the"]
    texts = ["the cat sat on the mat", "unseen words only", "", None, "the the the the", "a b a b", "the cat"]
    docs = [spark.createDataFrame(list(enumerate(t)), "doc_id long, text string") for t in (learn, texts)]
    model = language_models.train(language_models.trigrams(docs[0]))
    got = {r.doc_id: r.perplexity for r in language_models.perplexity(docs[1], model).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(slow_perplexity(learn, texts), abs=0.11)
    assert language_models.perplexity(docs[1].filter("false"), model).count() == 0
    # the probabilities of all words and of an unknown one add up to 1 after any context
    words = [w for t in learn for w in (t or "").split()]
    distinct = spark.createDataFrame([(w,) for w in {*words, " end", "never seen"}], "w string")
    for u, v in ((" begin", " begin"), (" begin", "the"), ("on", "the"), ("no", "the"), ("no", "no")):
        rows = written(distinct.select(F.xxhash64(F.lit(u)).alias("u"), F.xxhash64(F.lit(v)).alias("v"), F.xxhash64("w").alias("w")), "all")
        assert sum(10**r.logp for r in language_models.log_probabilities(rows, model).collect()) == pytest.approx(1)


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_models.language_classifier(language_models.language_sample(docs))
    lang = {r.doc_id: r.lang for r in docs.collect()}
    found = [r for r in language_models.identify(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    share = sum(r.language == lang[r.doc_id] for r in found) / len(found)
    print("accuracy", share, "of", len(found))
    assert share >= 0.97 and all(0 <= r.score <= 1 for r in found)
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x" * 100_000), (4, "\n\n")], "doc_id long, text string")
    assert language_models.identify(odd, model).count() == 4
