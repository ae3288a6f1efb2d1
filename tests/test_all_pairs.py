"""Semantic neighbours below a threshold where cells spare nothing: blocks of queries against blocks of rows."""

import numpy as np

from sitequarry.operators import similar


def test_blocks_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK_BYTES", 8 * 16 * 70)
    monkeypatch.setattr(similar, "PRODUCT", 500)
    n, g = 400, np.random.default_rng(1)
    x = g.standard_normal((n, 16))
    x[7] = x[10]  # copies are one node
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(n, None), (n + 5, [0.0] * 16)]
    got = {r["query_id"]: r for r in similar.semantic_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.2, every=5, recall=0.99999).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -1)
    assert set(got) == set(range(0, n, 5))
    for i, r in got.items():
        assert r["similar"] == (s[i] >= 0.2).sum() and r["closest_id"] == (7 if i == 10 else s[i].argmax()) and abs(r["similarity"] - s[i].max()) < 1e-12
