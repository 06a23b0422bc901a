"""Whole texts are counted in batches."""

import math
from collections import Counter

import numpy as np

from loomline.operators import quality


def test_character_grams_are_counted_in_batches(spark):
    rng = np.random.default_rng(3)
    texts = ["", None, "short", "abcdefghij", "x" * 500, "äö😀" * 40] + ["".join(rng.choice(list("ab"), 300)) for _ in range(20)]
    found = quality.gram_repetition(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 10, characters=True)
    assert "ArrowEvalPython" in found._jdf.queryExecution().executedPlan().toString()
    for r in found.collect():
        text = texts[r.doc_id] or ""
        counts = sorted(Counter(text[i : i + 10] for i in range(len(text) - 9)).values(), reverse=True)
        k = min(math.isqrt(len(counts)), sum(c > 1 for c in counts))
        assert r.ratio == (sum(counts[:k]) / sum(counts) if counts else 0.0)
