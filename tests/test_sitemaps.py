"""Sitemap files, address normal form, links made by scripts."""

from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from sitequarry.functions import urls as U
from sitequarry.operators import links, sitemaps

IMAGES = "image_id long, source_id long, url string"


def test_files_are_whole(spark, tmp_path):
    urls = spark.createDataFrame([(i, f"https://a.test/{i}?a=1&b='", 200 if i % 5 else 404) for i in range(100)], "id long, address string, status_code int").repartition(7)
    images = spark.createDataFrame([(1, 1, "https://a.test/i.png")], IMAGES)
    folder = str(tmp_path / "maps")
    assert sitemaps.write_sitemaps(urls, images, folder, "https://a.test/", per_file=30, lastmod="2026-01-01") == 3
    ns = {"s": "http://www.sitemaps.org/schemas/sitemap/0.9"}
    listed = [e.text for e in ElementTree.parse(f"{folder}/sitemap.xml").getroot().findall("s:sitemap/s:loc", ns)]
    assert listed == [f"https://a.test/sitemap-{i}.xml" for i in (1, 2, 3)]
    found = [[e.text for e in ElementTree.parse(f"{folder}/sitemap-{i}.xml").getroot().findall("s:url/s:loc", ns)] for i in (1, 2, 3)]
    assert [len(f) for f in found] == [30, 30, 20] and sum(found, []) == [f"https://a.test/{i}?a=1&b='" for i in range(100) if i % 5]
    dates = ElementTree.parse(f"{folder}/sitemap-1.xml").getroot().findall("s:url/s:lastmod", ns)
    assert {d.text for d in dates} == {"2026-01-01"}
    assert sorted(p.name for p in (tmp_path / "maps").iterdir() if not p.name.startswith(".")) == ["sitemap-1.xml", "sitemap-2.xml", "sitemap-3.xml", "sitemap.xml"]
    empty = str(tmp_path / "none")
    assert sitemaps.write_sitemaps(urls.limit(0), images, empty, "https://a.test") == 1
    assert not ElementTree.parse(f"{empty}/sitemap-1.xml").getroot().findall("s:url", ns)


CASES = {
    "https://A.test:443/x": "https://a.test/x", "http://a.test:8080/%7Ex#f": "http://a.test:8080/~x", "https://a.test/für": "https://a.test/f%C3%BCr", "https://a.test/f%C3%BCr": "https://a.test/f%C3%BCr", "https://a.test/a b%20c": "https://a.test/a%20b%20c", "https://a.test/100%": "https://a.test/100%", "https://a.test/%zz/ü": "https://a.test/%zz/%C3%BC",
    "https://a.test/%FF": "https://a.test/%FF", "https://a.test/a/../b/./c/..": "https://a.test/b/", "https://a.test/../x": "https://a.test/x", "https://a.test/a/%2e%2e/b": "https://a.test/b", "https://a.test/a%2Fb": "https://a.test/a/b", "https://a.test/a?q=ü x'": "https://a.test/a?q=%C3%BC%20x%27", "https://a.test/a%3Fb": "https://a.test/a%3Fb", "https://a.test/a+b": "https://a.test/a+b",
    "https://a.test/<\"`{}>": "https://a.test/%3C%22%60%7B%7D%3E", "https://a.test/a\\b": "https://a.test/a/b", "not a url": None, "https://a.test/😀": "https://a.test/%F0%9F%98%80", "https://a.test/a;b=c,d@e:f|g^h[i]~": "https://a.test/a;b=c,d@e:f|g^h[i]~",
}


def test_normal_form(spark):
    df = spark.createDataFrame([(k,) for k in CASES], "u string")
    assert {r["u"]: r["n"] for r in df.select("u", U.normalize(F.col("u")).alias("n")).collect()} == CASES


@pytest.mark.parametrize("link", [k for k, v in CASES.items() if v and "\\" not in k])
def test_resolve_agrees(link):
    assert U.resolve_text(link, "https://base.test/") == CASES[link]


def test_rendered_links(spark):
    raw = spark.createDataFrame([(1, "https://a.test/x", "a"), (1, "https://a.test/x", "a"), (1, "https://a.test/gone", "a"), (2, None, "a")], "source_id long, target_url string, link_type string")
    rendered = spark.createDataFrame([(1, "https://a.test/x", "a"), (1, "https://a.test/new", "a"), (1, "https://b.test/", "a"), (2, "https://a.test/new", "a"), (2, "https://a.test/i.png", "img")], "source_id long, target_url string, link_type string")
    located = links.rendered_links(raw, rendered)
    assert {(r["target_url"], r["location"]) for r in located.filter("source_id = 1").collect()} == {("https://a.test/x", "both"), ("https://a.test/gone", "raw"), ("https://a.test/new", "rendered"), ("https://b.test/", "rendered")}
    urls = spark.createDataFrame([(1, "https://a.test/", "a.test"), (2, "https://a.test/new", "a.test"), (3, "https://a.test/z", "a.test")], "id long, address string, run_host string")
    assert sorted(map(tuple, links.script_link_counts(urls, located).collect())) == [(1, 0, 2, 1), (2, 2, 1, 0), (3, 0, 0, 0)]
