"""Near duplicates and semantic neighbours against brute force, with heads and without, at two sizes."""

import random

import numpy as np
import pytest

from sitequarry.operators import similar


def runs_of(text):
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    return {" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def slow(pages, least=0.9):
    """id -> (class, count, closest percent), by all pairs."""
    sets = {i: runs_of(t) for i, t in pages}
    label = {i: i for i, _ in pages}
    best = {}
    ids = sorted(sets)

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if sets[i] and sets[j]:
                s = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
                if s >= least:
                    best[i], best[j] = max(best.get(i, (0, 0)), (s, -j)), max(best.get(j, (0, 0)), (s, -i))
                    a, b = sorted((find(i), find(j)))
                    label[b] = a
    size = {}
    for i in ids:
        size[find(i)] = size.get(find(i), 0) + 1
    return {i: (find(i), size[find(i)] - 1, -best[i][1] if i in best else None, round(100 * best[i][0], 4) if i in best else None) for i in ids}


def made(seed, groups=6, copies=8):
    g = random.Random(seed)
    pages = [(0, None), (1, ""), (2, "one two"), (3, "one two"), (4, "a b c d e"), (5, " \n "), (6, "tie tie tie tie tie tie tie"), (7, "tie tie tie tie tie tie tie tie")]
    at = 10
    for _ in range(groups):
        words = [g.choice("abcdefghijklmnop") * g.randint(1, 3) + str(g.randint(0, 50)) for _ in range(g.randint(150, 300))]
        for c in range(copies):
            own = list(words)
            for _ in range(g.choice([0, 1, 1, 2, 3])):
                own[g.randrange(len(own))] = f"x{g.randint(0, 3)}"
            pages.append((at, " ".join(own + (["a b c d e"] if c % 2 else []))))
            at += 1
    return pages


@pytest.mark.parametrize(("small", "copies"), [(64, 8), (4, 8), (3, 14)])
def test_near_duplicates(spark, small, copies):
    pages = made(small, copies=copies)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in pages], "id long, text string, label string, runs int").repartition(3)
    got = {r["id"]: r for r in similar.near_duplicates(df, small=small).collect()}
    want = slow(pages)
    assert set(got) == set(want)
    for i, (label, count, closest, percent) in want.items():
        assert (got[i]["class_id"], got[i]["near_duplicate_count"]) == (label, count)
        assert (got[i]["closest_similarity"] is None) == (percent is None)
        if small >= copies and percent is not None:
            assert (got[i]["closest_id"], got[i]["closest_similarity"]) == (closest, percent)
        elif percent is not None:
            assert 90 <= got[i]["closest_similarity"] <= percent
    assert sum(w[3] is not None for w in want.values()) > 20


def test_one_large_class(spark):
    """Copies of one text, each with a word of its own: compared with heads, never with each other."""
    words = [f"w{i}" for i in range(400)]
    pages = [(i, " ".join(words[:i] + [f"own{i}"] + words[i:])) for i in range(150)] + [(1000 + i, " ".join(words)) for i in range(50)]
    got = similar.near_duplicates(spark.createDataFrame(pages, "id long, text string"), small=8).collect()
    assert {r["class_id"] for r in got} == {0} and {r["near_duplicate_count"] for r in got} == {199}
    assert all(r["closest_similarity"] == 100 for r in got if r["id"] >= 1000)


def test_large_buckets_of_unlike_pages(spark, monkeypatch):
    """Pages of two passages each, all passages shared, of many lengths: paired by length and place, with no round for each head."""
    passages = [" ".join(f"p{k}w{i}" for i in range(50 + 25 * k)) for k in range(16)]
    pages = [(16 * i + j, passages[i] + " " + passages[j]) for i in range(16) for j in range(i)]
    pages.append((999, pages[-1][1] + " x y"))
    written, write = [], similar.materialise
    monkeypatch.setattr(similar, "materialise", lambda df, name: written.append(name) or write(df, name))
    got = {r["id"]: (r["class_id"], r["near_duplicate_count"], r["closest_id"], r["closest_similarity"]) for r in similar.near_duplicates(spark.createDataFrame(pages, "id long, text string"), small=8).collect()}
    assert got == slow(pages)
    assert written.count("near_heads") <= 1


def drifting(seed, chains=2, links=20, versions=60):
    """Chains of texts in which each has one other word than the one before, with ids in random order, and versions of one text."""
    g = random.Random(seed)
    ids = iter(g.sample(range(10_000), chains * links + versions))
    pages = []
    common = " ".join(f"c{i}" for i in range(40))
    for c in range(chains):
        words = [f"w{c}x{i}" for i in range(110)]
        for _ in range(links):
            pages.append((next(ids), common + " " + " ".join(words)))
            words[g.randrange(len(words))] = f"n{g.randint(0, 10**9)}"
    words = [f"v{i}" for i in range(160)]
    for i in range(versions):
        own = words[:20] + (["other"] if i % 3 else []) + words[20:60] + [f"kind{i % 7}"] * (i % 2) + words[60:]
        own[100:100] = [f"own{i}"] * g.randint(0, 3)
        pages.append((next(ids), common + " " + " ".join(own)))
    return pages


@pytest.mark.parametrize(("seed", "small"), [(1, 3), (2, 8)])
def test_large_buckets_lose_nothing(spark, seed, small):
    """Classes, closest pages and similarities are those of all pairs, where buckets are compared with heads."""
    pages = drifting(seed)
    rows = similar.near_duplicates(spark.createDataFrame(pages, "id long, text string"), small=small).collect()
    got = {r["id"]: (r["class_id"], r["near_duplicate_count"], r["closest_id"], r["closest_similarity"]) for r in rows}
    assert got == slow(pages)
    assert len({r["class_id"] for r in rows}) < 10


def test_empty_and_repeated(spark):
    none = spark.createDataFrame([], "id long, text string")
    assert similar.near_duplicates(none).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f")], "id long, text string")
    assert [(r["near_duplicate_count"], r["closest_similarity"]) for r in similar.near_duplicates(twice).collect()] == [(1, 100.0)] * 2


def test_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    assert {(r["node"], r["label"]) for r in similar.components(edges).collect()} == {(i, 1) for i in range(1, 41)} | {(100, 100), (101, 100)}


@pytest.mark.parametrize("n", [600, 3000])
def test_semantic_neighbours(spark, n):
    g = np.random.default_rng(n)
    middle = g.standard_normal((n // 4, 24))
    x = middle[g.integers(0, len(middle), n)] + 0.32 * g.standard_normal((n, 24))
    x[5] = x[3]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(n, None, 1), (n + 1, [0.0] * 24, 1), (n + 2, [1.0], 1), (n + 3, [float("nan")] * 24, 1), (None, [1.0] * 24, 1)]
    got = {r["query_id"]: r for r in similar.semantic_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>, norm int"), 0.85, every=3).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -1)
    assert set(got) == {i for i in range(n) if i % 3 == 0}
    want, found = sum((s[i] >= 0.85).sum() for i in got), sum(r["similar"] for r in got.values())
    assert want > n // 3 and 0.98 * want <= found <= want
    assert np.mean([got[i]["closest_id"] == s[i].argmax() for i in got if s[i].max() >= 0.85]) > 0.98
    assert got[3]["closest_id"] == 5 and got[3]["similarity"] == 1.0
    assert similar.semantic_neighbours(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_tables():
    for least, n in [(0.4, 500), (0.9, 10**5), (0.95, 10**9), (-1.0, 100)]:
        bits, flips, tables = similar._tables_for(least, n, 0.999)
        assert tables <= 24 and bits <= 31
