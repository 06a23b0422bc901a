"""Words counted in their task against the expression that lists them."""

from collections import Counter

from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.operators import lexicon


def test_words_of_odd_texts_are_counted_without_a_shuffle(spark):
    texts = ["The the THE, cat.\nCat\tcat", "", None, " \n\t ", "...", "ΟΔΟΣ. ΟΔΟΣ ΟΔΟΣA İI ẞ", "a b a b a\rb", "12x3 (x) x", "é é 'É'", "\u0000x x\u0000 😀! 😀"]
    docs = spark.createDataFrame([*enumerate(texts), (0, "the dog"), (None, "the")], "doc_id long, text string")
    got, want = Counter(), Counter()
    for r in lexicon.word_counts(docs).collect():
        got[r.doc_id, r.word] += r.c
    for r in docs.select("doc_id", F.explode(T.words(F.col("text"))).alias("word")).collect():
        want[r.doc_id, r.word] += 1
    assert got == want and len(want) > 15
    plan = docs.select("doc_id", F.inline(lexicon._counted(F.lower("text"))))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    sizes = {r.word: (r.n, r.total) for r in lexicon.word_sizes(lexicon.word_counts(docs)).collect()}
    assert sizes["the"] == (3, 5) and sizes["cat"] == (1, 3)
