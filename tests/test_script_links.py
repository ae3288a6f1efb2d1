"""Links made by scripts."""

from sitequarry.operators import links


def test_links_are_located_once(spark):
    """Both sides of a link read written rows: what locates the links, a parser of all pages, isn't run for each."""
    urls = spark.createDataFrame([(1, "https://a.test/1", "a.test"), (2, "https://a.test/2", "a.test")], "id long, address string, run_host string")
    located = spark.createDataFrame([(1, "https://a.test/2", "a", "rendered"), (1, "https://b.test/x", "a", "rendered"), (2, "https://a.test/1", "a", "both"), (2, "https://a.test/i.png", "img", "rendered")], "source_id long, target_url string, link_type string, location string")
    counts = links.script_link_counts(urls, located)
    assert sorted(tuple(r) for r in counts.collect()) == [(1, 0, 2, 1), (2, 1, 0, 0)]
    assert "location" not in counts._jdf.queryExecution().optimizedPlan().toString()
