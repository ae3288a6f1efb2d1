"""Custom extraction rules and the faults that real pages have."""

import time

import pytest

from sitequarry.operators import extract, selectors, site
from sitequarry.operators.selectors import Extraction

PAGE = """<html><body><div id="a" class="x y"><p>one <b>two</b><p>three<div class="x"><span data-k="v w">deep</span></div></div>
<ul><li>1<li>2 <a href="/q">l</a></ul><img src="i.png" class="x"><p lang="en-US">four &amp; five</p></body></html>"""


@pytest.mark.parametrize(
    ("selector", "attribute", "want"),
    [
        ("p", None, ["one two", "three", "four & five"]), ("#a > p", None, ["one two", "three"]), ("div.x span", None, ["deep"]), ("div.x.y > span", None, []), ("div div.x > span[data-k~=w]", None, ["deep"]), ("li", None, ["1", "2 l"]), ("ul > li a", "href", ["/q"]),
        (".x", "class", ["x y", "x", "x"]), ("img[src$='.png']", "src", ["i.png"]), ("p[lang^=en], span", None, ["deep", "four & five"]), ("*[data-k]", "data-k", ["v w"]), ("p[lang=en]", None, []), ("div > div > span", None, ["deep"]), ("[class]", "id", ["a"]),
    ],
)
def test_css(selector, attribute, want):
    assert selectors.css_values(PAGE, [(0, selectors.compile_selector(selector), attribute, True)])[0] == want


@pytest.mark.parametrize("bad", ["", "p >", "p:first", "a,,b", "#"])
def test_unknown_selectors(bad):
    with pytest.raises(ValueError):
        selectors.compile_selector(bad)


def test_rules(spark):
    pages = spark.createDataFrame([(1, PAGE, 7), (2, None, 7), (3, "", 7), (4, "<r><i k='1'>a</i><j><i k='2'>b<c>d</c></i></j></r>", 7), (4, "<r><i k='1'>a</i><j><i k='2'>b<c>d</c></i></j></r>", 7)], "page_id long, html string, name int")
    rules = [Extraction("first", "p"), Extraction("ks", "//i/@k", "xpath", True), Extraction("i", "/r/j/i", "xpath"), Extraction("word", r"o(n)e|t(w)o", "regex", True), Extraction("raw", r"dee.", "regex")]
    got = sorted(map(tuple, selectors.custom_extraction(pages, rules).collect()))
    four = [(4, "i", 0, "bd"), (4, "ks", 0, "1"), (4, "ks", 1, "2")]
    assert got == sorted([(1, "first", 0, "one two"), (1, "raw", 0, "deep"), (1, "word", 0, "n"), (1, "word", 1, ""), *four, *four])
    assert selectors.custom_extraction(pages.limit(0), rules).count() == 0 and selectors.custom_extraction(pages, []).count() == 0
    with pytest.raises(ValueError):
        selectors.custom_extraction(pages, [Extraction("x", "p", "jquery")])


def test_faulty_pages():
    f = extract.read_facts("""<head><title>T</title></head><body><svg><title>icon</title></svg><h1>A<h2>B</h1><script type="application/ld+json">{"@type":"X"}</script><script>var a=1</script>
    <a href="/1">one<a href="/2">two</a> rest<div style="background:url('a.png'), url(b.png)"><meta name="description" content="late"><link rel="canonical" href="/late"></body>""")
    assert f["titles"] == ["T"] and f["h1"] == ["A"] and f["h2"] == ["B"] and f["json_ld"] == ['{"@type":"X"}']
    assert [(x["href"], x["text"]) for x in f["links"] if x["kind"] == "a"] == [("/1", "one"), ("/2", "two")]
    assert [x["src"] for x in f["images"]] == ["a.png", "b.png"] and not f["descriptions"] and f["canonical"] is None
    bare = extract.read_facts("<title>No head</title><meta name=description content=d><p>text")
    assert bare["titles"] == ["No head"] and bare["descriptions"] == ["d"] and bare["body_text"] == "text"


@pytest.mark.parametrize("html", ["<a href=/x>y" * 20_000, "<div>x" * 50_000, "<p><span>" * 30_000])
def test_deep_pages(html):
    began = time.time()
    extract.read_facts(html)
    selectors.css_values(html, [(0, selectors.compile_selector("div a"), None, False)])
    assert time.time() - began < 10


def test_repeated_pages(spark):
    html = "<html lang=en><head><title>T</title></head><body><h1>H</h1><img src=/i.png></body></html>"
    pages = spark.createDataFrame([(1, "https://a.test/x", html, 200, {}, None)] * 2, "page_id long, url string, html string, status_code int, headers map<string,string>, redirect_chain array<string>")
    assert site.site_urls(extract.extract_pages(pages)).count() == 2
    found = [r["type"] for r in site.audit_site(pages).collect()]
    assert found.count("missing_canonical") == 2 and "multiple_titles" not in found
