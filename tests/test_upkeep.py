"""Findings that are kept up equal those of the batch rules, in any order of batches."""

import random

from pyspark.sql import functions as F

from sitequarry.operators import rules
from sitequarry.streaming import upkeep


def made(seed, n=60):
    g = random.Random(seed)
    at = lambda i: f"https://a{i % 3}.test/{i}" + ("?page=2" if i % 7 == 0 else "")
    out = []
    for i in range(n):
        some = lambda: g.choice([None, "", at(g.randrange(n + 5)), at(i), at(g.randrange(n)).replace("test/", "test:443/").upper().replace("HTTPS", "https") if g.random() < 0.3 else at(g.randrange(n))])  # noqa: E731, B023
        out.append((i, f"a{i % 3}.test", at(i), g.choice([200, 200, 404, 301]), g.choice([None, "A", " a ", "B", f"own {i}"]), g.choice(["", "d1", "d2"]), g.choice([None, "h", "H"]), g.choice(["x", "y", str(i)]), some(), some(), some()))
    return out


def expected(spark, rows):
    urls = spark.createDataFrame(rows, upkeep.PAGE)
    out = rules.canonical_issues(urls).unionByName(rules.pagination_issues(urls))
    for d in rules.all_duplicates(urls):
        out = out.unionByName(d)
    return sorted(map(tuple, out.select("url_id", "url", "category", "type", "priority", "value").collect()), key=repr)


def found(spark, folder):
    return sorted(map(tuple, upkeep.current_findings(spark, folder).select("url_id", "url", "category", "type", "priority", "value").collect()), key=repr)


def test_any_order(spark, tmp_path):
    seed = 1
    folder, g = str(tmp_path), random.Random(seed)
    first, last = made(seed), made(seed + 100)
    rows = [r for r in first if g.random() < 0.6]
    g.shuffle(rows)
    late = list(last)
    g.shuffle(late)
    batches = [rows[:25], rows[25:] + rows[-1:], [], late]
    for number, batch in enumerate(batches):
        upkeep.take_in(spark.createDataFrame([(*r, 1) for r in batch], upkeep.PAGE + ", bucket int"), number, folder, 8)
    # a batch that runs again replaces itself
    upkeep.take_in(spark.createDataFrame(late, upkeep.PAGE), 3, folder, 8)
    want = expected(spark, last)
    assert {r[3] for r in want} >= {"duplicate_title", "canonical_to_non_200", "missing_reciprocal_prev", "missing_canonical"}
    assert found(spark, folder) == want


def test_stream_reads_touched_buckets_only(spark, tmp_path):
    folder = str(tmp_path / "store")
    rows = spark.createDataFrame(made(5), upkeep.PAGE)
    (tmp_path / "in").mkdir()
    for i in range(3):
        rows.filter(F.col("id") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(upkeep.PAGE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    upkeep.keep_findings(stream, folder, str(tmp_path / "check"), 8).awaitTermination(300)
    assert found(spark, folder) == expected(spark, made(5))
    one = spark.createDataFrame([(3,)], "bucket int")
    plan = upkeep.read(spark, folder, "urls", 2, one)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch" in plan and "(bucket" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]
