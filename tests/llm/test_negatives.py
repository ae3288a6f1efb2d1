"""Hard negatives against plain loops, with repeated and broken rows, ties, long vectors and small blocks."""

import math

import numpy as np
import pytest

from sitequarry.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<double>, rank int, scores string"


def slow(rows, every=100, positives=5, k=10):
    use = {}
    for i, label, x, *_ in rows:
        if i is None or label is None or not x or any(c is None or not math.isfinite(c) for c in x) or len(x) != len(rows[0][2]):
            continue
        v = tuple(math.floor(256 * c) for c in x)
        if sum(c * c for c in v) < 2**62:
            use[i, (label + 1) % 10 if i % 7 == 0 else label, v] = None
    out = []
    for i, label, v in (r for r in use if r[0] % every == 0):
        score = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in use)
        near = [(-s, j) for s, j, m in score if m == label and j != i][:positives]
        for p, j in near:
            fit = [(-s, x) for s, x, m in score if m != label and 30 * p <= -100 * s <= 90 * p][:k]
            out += [(i, j, n + 1, x, p, s) for n, (s, x) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, negatives.mine(df, **how).collect()))


@pytest.fixture(scope="module")
def rows():
    g = np.random.default_rng(3)
    middle = g.standard_normal((10, 12))
    x = middle[g.integers(0, 10, 700)] + 0.3 * g.standard_normal((700, 12))
    return [(i, int(g.integers(0, 10)), v.tolist()) for i, v in enumerate(x)]


def test_clusters(spark, rows):
    want = slow(rows)
    assert len(want) > 200
    assert mined(spark, rows) == want
    # many small segments, slices and blocks give the same
    assert mined(spark, rows, segment=16, slice_segments=3, block_bytes=200, references=4) == want


def test_edges(spark, rows):
    bad = [(800, None, [1.0] * 12), (900, 1, None), (None, 1, [1.0] * 12), (1000, 1, []), (1100, 1, [1.0]), (1200, 2, [float("nan")] + [1.0] * 11), (1300, 2, [None] + [1.0] * 11), (1400, 3, [float("inf")] * 12), (1500, 3, [1e12] * 12)]
    zero = [(1600, 1, [0.0] * 12), (1601, 2, [0.0] * 12)]
    ties = [(2000 + i, 4 + i % 2, [0.5, -0.25] * 6) for i in range(150)]
    again = rows[:50] + [(300, 9, [0.125] * 12)]  # repeated rows, and one id with another vector
    long = [(3000, 1, [1e5, 2e5] * 6), (3001, 1, [1e5, 2.1e5] * 6), (3002, 2, [1e5, 0.5e5] * 6), (3003, 3, [5e6] * 12)]
    every = rows + bad + zero + ties + again + long
    assert mined(spark, every) == slow(every)
    assert mined(spark, bad) == [] and mined(spark, rows[:1]) == []
    df = spark.createDataFrame([], SCHEMA)
    assert negatives.mine(df).count() == 0


def test_bounds_hold():
    g = np.random.default_rng(1)
    references = negatives.fit_references(g.integers(-99, 99, (50, 6)).astype(float), 5)
    anchors, others = g.integers(-300, 300, (40, 6)), g.integers(-300, 300, (30, 6))
    others[0] = anchors[0]  # angle 0
    others[1] = -anchors[1]
    angle, norm = negatives.angles_to(others.astype(float), references), np.linalg.norm(others, axis=1)
    low, high = negatives.bounds(negatives.angles_to(anchors.astype(float), references), np.linalg.norm(anchors, axis=1), angle.min(0), angle.max(0), norm.min(), norm.max())
    score = anchors @ others.T
    assert (low <= score.min(1)).all() and (score.max(1) <= high).all()
    one = [negatives.bounds(negatives.angles_to(anchors.astype(float), references), np.linalg.norm(anchors, axis=1), a, a, n, n) for a, n in zip(angle, norm)]
    assert all((lo <= s).all() and (s <= hi).all() for (lo, hi), s in zip(one, score.T))
    skipped = sum((hi < np.quantile(score, 0.95)).sum() for _, hi in one)
    assert skipped > 0


def test_windows():
    low, high = negatives.score_windows(3, 30, 90)([[10, 7, -5], [2**61]])
    assert low.tolist()[0] == [3, 3, -1] and high.tolist()[0] == [9, 6, -5]
    assert low[1, 0] == -(-30 * 2**61 // 100) and high[1, 0] == 90 * 2**61 // 100 and (low[1, 1:] > high[1, 1:]).all()
