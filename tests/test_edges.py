"""Links between pages are derived by equal keys, and crawls read them once."""

import duckdb
import pytest
from oracle import SF, compare

import __spark_entry__ as entry
from sitequarry.plans.tables import derived, duck_sql


@pytest.mark.parametrize("name", ["crawl_depth", "frontier_counts"])
def test_sides_too_large_to_broadcast(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    try:
        compare(spark, entry.queries()[name], entry.oracle_sql()[name])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_pages_of_a_host_are_not_all_paired(spark):
    pages = spark.range(30_000).selectExpr("id AS page_id", "concat('https://a.test/', id) AS url", "'' AS html")
    edges = derived(spark, SF, "edge_fx", {"pages": pages})
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "rn#" not in "".join(x for x in plan.splitlines() if "NestedLoop" in x)
    assert edges.count() == 120_000


def test_no_host_is_numbered_by_one_task(spark):
    pages = spark.range(30_000).selectExpr("id AS page_id", "concat('https://a.test/', id) AS url", "'' AS html")
    plan = derived(spark, SF, "edge_fx", {"pages": pages})._jdf.queryExecution().optimizedPlan().toString()
    numbered = [x for x in plan.splitlines() if "row_number()" in x]
    assert numbered and all("id_run#" in x.split("windowspecdefinition(")[1].split(" ASC")[0] for x in numbered)


def test_links_over_runs_of_ids_equal_sql(spark, tmp_path):
    """Hosts over several runs of ids, with gaps, ids below 0, one null, and addresses without a host."""
    rows = "SELECT CASE WHEN i = 7 THEN NULL WHEN i % 3 = 0 THEN i * 11 - 20000 ELSE i END AS page_id, concat(CASE WHEN i % 50 = 0 THEN '' WHEN i % 5 < 3 THEN 'https://A.test/' ELSE 'http://b.test/' END, i) AS url, '' AS html FROM range(9000) t(i) WHERE i % 4 <> 1"
    duckdb.sql(f"COPY (SELECT DISTINCT ON (page_id) * FROM ({rows}) ORDER BY page_id, url) TO '{tmp_path}/pages.parquet'")
    compare(spark, lambda s, sf: derived(s, sf, "edge_fx"), duck_sql("SELECT * FROM edge_fx", "edge_fx"), str(tmp_path))
