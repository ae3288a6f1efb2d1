"""Character references without a semicolon: decoded as browsers do, or left as the SQL of the queries leaves them."""

import time

import duckdb
import pytest
from oracle import compare

import __spark_entry__ as entry
from sitequarry.operators import extract, selectors


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("a&amp;&amp", "a&amp;&amp;amp"), ("&ampx; &copy; &#38; &#x26; &#38 & &", "&amp;ampx; &copy; &#38; &#x26; &amp;#38 &amp; &amp;"), ("<!-- &amp -->&lt", "<!-- &amp -->&amp;lt"), ("<script src='?a&lt'>x &amp y</SCRIPT>&gt", "<script src='?a&amp;lt'>x &amp y</SCRIPT>&amp;gt"),
        ("<style>&amp", "<style>&amp"), ("<scripts>&amp", "<scripts>&amp;amp"), ("", ""),
    ],
)
def test_closed_references(html, want):
    assert selectors.closed_references(html) == want


def test_both_readings(spark):
    pages = spark.createDataFrame([(1, "https://a.test/", "<html><head><title>R&amp;D &amp</title></head><body><h1>x&lt</h1>"), (2, "https://a.test/", None)], "page_id long, url string, html string")
    read = lambda bare: [(r["titles"], r["h1"]) for r in extract.extract_pages(pages, bare).orderBy("page_id").collect()]
    assert read(True) == [(["R&D &"], ["x<"]), ([], [])] and read(False) == [(["R&D &amp"], ["x&lt"]), ([], [])]


@pytest.mark.parametrize("html", ["<script &" * 20_000, "<!-- &" * 20_000, "&" * 200_000])
def test_linear(html):
    began = time.time()
    selectors.closed_references(html)
    assert time.time() - began < 5


@pytest.mark.parametrize("name", ["custom_extraction", "extracted_pages", "site_findings"])
def test_cut_titles(spark, tmp_path, name):
    """Pages of the given form whose titles end within a reference."""
    page = "<html lang=\"en\"><head><title>{0}</title></head><body><nav><ul><li><a href=\"/x\">m</a></li></ul></nav><article><h1>{0}</h1><p>text &amp; more</p></article></body></html>"
    rows = [(i, f"https://a.test/en/{i}", page.format(t)) for i, t in enumerate(["one &amp;&amp", "two &l", "three &amp;", "twenty-nine letters stand &amp", "x &lt", "y &amp;lt;&gt"])]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    con.execute(f"COPY pages TO '{tmp_path}/pages.parquet'")
    compare(spark, entry.queries()[name], entry.oracle_sql()[name], str(tmp_path))
