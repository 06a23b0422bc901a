"""Neighbours, some vectors at a time."""

import numpy as np
import pyarrow as pa

from loomline.operators import scoring


def test_queries_keep_their_best_of_all_vectors_met(monkeypatch):
    monkeypatch.setattr(scoring, "STEP", 7)
    rng = np.random.default_rng(1)
    x = rng.integers(-3, 4, (200, 4)).astype(float)  # whole numbers: many scores are equal
    x[150:] = x[:50]
    x[60] = np.nan
    vectors = pa.table({"vec_id": pa.array(rng.permutation(200)), "embedding": pa.array(list(x), pa.list_(pa.float64()))})
    ids = vectors["vec_id"].to_numpy()
    best = scoring._Best(ids[:30], x[:30], 5)
    for at in (0, 90, 180):
        best.meet(vectors.slice(at, 90), "vec_id", "embedding")
    got = sorted(zip(*(c.to_pylist() for c in best.found().columns), strict=True))
    want = []
    for i in range(30):
        met = sorted((-float(x[i] @ x[j]), int(ids[j])) for j in range(200) if j != i and j != 60)
        want += [(int(ids[i]), j, -s) for s, j in met[:5]]
    assert got == sorted(want)
