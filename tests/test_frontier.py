"""Crawl budgets against a queue, and robots rules by their prefixes."""

import random

from sitequarry.operators import frontier, runs


def test_places_over_many_buckets(spark):
    rows = [("a" if i % 3 else "b", (i * 37) % 1000, i) for i in range(1000)] + [(None, 1, 2000)]
    got = frontier.placed(spark.createDataFrame(rows, "run string, at long, id long").repartition(5), "run", ["at", "id"]).collect()
    for run in ("a", "b", None):
        want = sorted((at, i) for r, at, i in rows if r == run)
        assert [(r["at"], r["id"]) for r in sorted((r for r in got if r["run"] == run), key=lambda r: r["place"])] == want
        assert sorted(r["place"] for r in got if r["run"] == run) == list(range(1, len(want) + 1))


def test_admitted(spark):
    found = [("r", f"https://A.test:443/{i % 7}", 1, i) for i in range(20)] + [("r", "https://a.test/s?q=x", 1, 0), ("r", "https://a.test/deep", 9, 0), ("r", None, 1, 0), (None, "https://a.test/x", 1, 0), ("r", "mailto:x", 1, 0), ("s", "https://b.test/", 2, 5), ("s", "https://b.test/", 1, 3)]
    df = spark.createDataFrame([(*f, "x") for f in found], "run string, url string, depth int, at long, place string")
    seen = spark.createDataFrame([("r", "https://a.test/1"), ("r", "https://a.test/1"), ("r", "https://a.test/old")], "run string, url string")
    got = frontier.admitted(df.select("run", "url", "depth", "at"), seen, 5, ["at"], most_depth=5)
    rows = sorted(map(tuple, got.collect()))
    assert rows == [("r", "https://a.test/0", 1, 3), ("r", "https://a.test/2", 1, 4), ("r", "https://a.test/3", 1, 5), ("s", "https://b.test/", 1, 1)]
    assert {r["run"]: r["added"] for r in frontier.added(got).collect()} == {"r": 3, "s": 1}
    assert frontier.admitted(df.limit(0), seen, 5, ["at"]).count() == 0
    only = frontier.admitted(df, seen, 50, ["at"], include=["/3"], exclude=["/4"])
    assert [r["url"] for r in only.collect()] == ["https://a.test/3"]


def queue(edges, seed, most, depth):
    seen, todo = {seed: (0, 1)}, [seed]
    while todo:
        here = todo.pop(0)
        for _, target in sorted((p, t) for s, t, p in edges if s == here):
            if target not in seen and len(seen) < most and seen[here][0] < depth:
                seen[target] = (seen[here][0] + 1, len(seen) + 1)
                todo.append(target)
    return {(i, *x) for i, x in seen.items()}


def test_crawl_order(spark):
    g = random.Random(4)
    edges = [(s, g.randrange(60), p) for s in range(60) for p in range(4)]
    df = spark.createDataFrame(edges + edges[:5], "source_id long, target_id long, pos int")
    seeds = spark.createDataFrame([("x", 0), ("y", 7), ("y", 7)], "run string, id long")
    for most, depth in ((25, 10), (1000, 2), (1, 3)):
        got = frontier.crawl_order(df, seeds, most, depth).collect()
        for run, seed in (("x", 0), ("y", 7)):
            assert {(r["id"], r["depth"], r["place"]) for r in got if r["run"] == run} == queue(edges, seed, most, depth)
    assert frontier.crawl_order(df.limit(0), seeds, 5).count() == 2


def test_robots_with_many_rules(spark):
    """A host with 100,000 rules: paths meet rules by equal prefixes, and no comparison is left over in the plan."""
    rules = spark.range(100_000).selectExpr("'h' as host", "cast(id as int) as line_no", "'*' as agent", "if(id % 2 = 0, 'allow', 'disallow') as kind", "concat('/p', id) as value")
    more = spark.createDataFrame([("g", 1, "*", "disallow", ""), ("h", 200_000, "other", "disallow", "/p7"), ("h", 200_001, "quarry", "allow", "/p70/ok")], "host string, line_no int, agent string, kind string, value string")
    urls = spark.createDataFrame([(1, "h", "/p7"), (2, "h", "/p70"), (3, "h", "/p71x"), (4, "h", "/"), (5, "g", "/x"), (6, "none", "/p7"), (7, "h", "/p9/ok"), (8, "h", "/p70/ok/1"), (9, "h", None)], "id long, run_host string, path string")
    out = runs.robots_allowed(urls, rules.unionByName(more), "quarry/1.0")
    got = {r["id"]: r["allowed"] for r in out.collect()}
    assert got == {1: False, 2: True, 3: False, 4: True, 5: False, 6: True, 7: False, 8: True, 9: True}
    assert "startswith" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
