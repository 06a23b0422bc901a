"""The checks of web texts don't depend on their order, and count as plain loops do."""

import random
from collections import Counter

from loomline.functions import text as T
from loomline.operators import lexicon, quality


def test_a_text_fails_in_either_order_or_in_none():
    rng = random.Random(5)
    words = ["the", "of", "tree", "login", "x1", "(a)", "...", "it's", "🙂", "Σ"]
    texts = ["", "END", *(" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(500))]
    lists = frozenset({"the", "of"}), frozenset({"login"}), frozenset({"the", "of", "tree", "it's", "a", "σ"})
    for p in (quality.Web(), quality.DOCUMENT):
        first = [quality.web_check(t, *lists, p) for t in texts]
        cheap = [quality.web_check(t, *lists, p, quality.BY_COST) for t in texts]
        assert [f is None for f in first] == [c is None for c in cheap]
        assert len(set(cheap)) > 2
    assert quality.web_check("the of tree it's a the of.", *lists) is None
    assert sorted(quality.CHECKS) == sorted(quality.BY_COST)


def test_top_share_counts_every_n_gram():
    rng = random.Random(6)
    for _ in range(200):
        text = "".join(rng.choice("ab é🙂") for _ in range(rng.randrange(120)))
        counts = sorted(Counter(text[i : i + 3] for i in range(len(text) - 2)).values(), reverse=True)
        top = min(int(len(counts) ** 0.5), sum(c > 1 for c in counts))
        want = sum(counts[:top]) / sum(counts) if counts else 0.0
        assert abs(quality.top_share(text, 3, quality.multipliers(3)) - want) < 1e-12


def test_frequencies_are_those_of_all_words(spark):
    texts = ["The tree,\tthe TREE", None, "", "12 ... Tree\nof"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.word: r.total for r in lexicon.frequencies(docs).collect()}
    assert got == {"the": 2, "tree": 3, "of": 1}
    assert got == {r.w: r["count"] for r in docs.selectExpr("text").select(T.F.explode(T.words(T.F.col("text"))).alias("w")).groupBy("w").count().collect()}
