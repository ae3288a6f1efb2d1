"""Page facts, sources and streams."""

from pyspark.sql import functions as F

from sitequarry.operators import extract, runs
from sitequarry.sources import readers
from sitequarry.streaming import jobs

HTML = """<html lang="de"><head><title> One </title><title>Two</title><meta name="description" content="D"><meta name="robots" content="NOINDEX, x"><link rel="canonical" href="/c"><link rel="alternate" hreflang="en" href="/en">
<script type="application/ld+json">{"@type": ["A", "B"]}</script><script type="application/ld+json">{bad</script></head>
<body><nav>menu</nav><h1>H</h1><p>text <a href="/x" rel="nofollow">go</a> <a href="mailto:a@b">m</a> <a href="https://other.test/" target="_blank">o</a></p><img src="i.png" alt="x"><img src="i.png"><div itemscope itemtype="https://schema.org/Thing"></div>
<form action="http://p.test/f"><input id="q"><label for="r">R</label><input id="r"><input type="hidden"></form></body></html>"""


def facts(spark):
    return extract.extract_pages(spark.createDataFrame([(1, "https://a.test/d/p", HTML), (2, "https://a.test/", None)], "page_id long, url string, html string"))


def test_url_facts(spark):
    rows = {r["id"]: r for r in extract.url_facts(facts(spark)).collect()}
    r = rows[1]
    assert (r["title1"], r["title2"], r["h1"], r["lang"], r["noindex"], r["canonical"]) == ("One", "Two", "H", "de", True, "https://a.test/c")
    assert r["body_text"].startswith("menu H") or "menu" in r["body_text"] and "menu" not in r["main_text"]
    assert rows[2]["title1"] is None and rows[2]["word_count"] == 0


def test_links_images_blocks_controls(spark):
    f = facts(spark)
    links = {(r["link_type"], r["target_url"]): r for r in extract.link_facts(f).collect()}
    assert links["a", "https://a.test/x"]["nofollow"] and links["a", "https://a.test/x"]["anchor"] == "go"
    assert not links["a", "https://other.test/"]["is_internal"] and ("form", "http://p.test/f") in links and ("link", "https://a.test/en") in links
    assert [tuple(r)[1:3] for r in extract.image_facts(f).collect()] == [("https://a.test/d/i.png", "x")]
    assert [r["kind"] for r in extract.data_blocks(f).filter("errors is not null").collect()] == ["json-ld"]
    assert {r["schema_type"] for r in extract.data_blocks(f).filter("errors is null").collect()} == {"A, B", "Thing"}
    assert [r["control_id"] for r in extract.unlabelled_controls(f).collect()] == ["q"]


def test_readers(spark, tmp_path):
    (tmp_path / "s.xml").write_text("<urlset><url><loc>https://a.test/1</loc></url><url><loc> https://a.test/2</loc></url></urlset>")
    assert sorted(r["url"] for r in readers.sitemap_urls(spark, str(tmp_path / "s.xml")).collect()) == ["https://a.test/1", "https://a.test/2"]
    texts = spark.createDataFrame([("h", "User-agent: *\nCrawl-delay: 5\nUser-agent: openbot\nCrawl-delay: 2\nSitemap: https://h/s.xml"), ("g", "User-agent: *\nCrawl-delay: 0")], "host string, text string")
    assert {r["host"]: r["delay"] for r in readers.crawl_delays(texts, ("open", "seo")).collect()} == {"h": 2.0, "g": None}
    assert [r["url"] for r in readers.robots_sitemaps(texts).collect()] == ["https://h/s.xml"]
    (tmp_path / "m.json").write_text('{"https://old/": "https://new/"}')
    mapping = readers.url_mapping(spark, str(tmp_path / "m.json"))
    assert spark.range(1).select(runs.mapped(F.lit("https://old/x"), mapping).alias("x")).first()["x"] == "https://new/x"


def test_stream_equals_batch(spark, tmp_path):
    lines = ['1.2.3.4 - - [10/Oct/2024:%02d:55:36 +0000] "GET /%d HTTP/1.1" 200 1 "-" "Googlebot/2.1"' % (h, h % 3) for h in range(24)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.log").write_text("\n".join(lines))
    q = jobs.log_totals(jobs.log_lines(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("totals").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    got = sorted((r["url"], r["hits"]) for r in spark.table("totals").collect())
    assert got == [("/0", 8), ("/1", 8), ("/2", 8)]


def test_links_are_resolved_in_one_step(spark):
    """One step of Python behind the reader: not one for each filter and column that uses an address, each with a worker of its own."""
    pages = spark.createDataFrame([(1, "https://a.test/d/p", '<base href="/b/"><a href="x">1</a><a href="mailto:q">2</a><img src="i.png">'), (2, "https://a.test/d/p", '<a href="x">1</a>')], "page_id long, url string, html string")
    found = extract.extract_pages(pages, facts=("base", "links", "images"))
    assert found.columns == ["page_id", "url", "base", "links", "images"]
    links, images = extract.link_facts(found).filter("is_internal"), extract.image_facts(found)
    assert sorted((r["source_id"], r["pos"], r["target_url"]) for r in links.collect()) == [(1, 0, "https://a.test/b/x"), (1, 2, "https://a.test/b/i.png"), (2, 0, "https://a.test/x")]
    assert [(r["source_id"], r["url"]) for r in images.collect()] == [(1, "https://a.test/d/i.png")]
    for rows in (links, images):
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("resolve") == 1
