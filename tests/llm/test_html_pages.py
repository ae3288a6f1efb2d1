"""Main text: forms and headers by what they hold, deep pages, and template counts against a plain count."""

import re
import time
from collections import defaultdict

import pandas as pd
import pytest
from oracle import SF

from sitequarry.llm import html_text


def texts(source):
    return html_text.read_page(source).texts


def test_a_form_around_the_page_stays():
    assert texts('<body><form id="aspnetForm"><div><h1>T</h1><p>real text of the page</p></div></form></body>') == ["T", "real text of the page"]
    assert texts("<body><p>an article of some length</p><form><label>Your name</label><input name=a><button>Send</button></form></body>") == ["an article of some length"]
    assert texts("<form><label>User name</label><input><label>Password</label><input><p>Sign in</p></form>") == []
    assert texts("<article><p>one two three four</p><form>Subscribe here<input></form><p>five six</p></article>") == ["one two three four", "five six"]
    assert texts("<form><nav>menu</nav><article><p>kept</p></article></form>") == ["kept"]


def test_headers():
    assert texts('<div class="page-header"><h1>T</h1></div><p>text</p>') == ["T", "text"]
    assert texts('<div class="header"><a href=/>Home</a></div><div id="site-header">x</div><header>y</header><p>text</p>') == ["text"]


@pytest.mark.parametrize("source", ["<div>x" * 50_000, "<div>" * 100_000, "<p><span>a" * 50_000, "<ul><li>x" * 40_000, "<article>" + "<i>x</p>" * 50_000, "<div>x" * 40_000 + "</article></b>" * 40_000, "<form><div>x" * 30_000])
def test_deep_pages_are_linear(source):
    began = time.time()
    read = html_text.read_page(source)
    html_text.in_gone(read, {1})
    assert time.time() - began < 6
    assert len(read.parents) < len(source)


def slow_removed(pages):
    """page_id -> blocks in template subtrees, by sets of pages per host and per section."""
    read, groups = {}, defaultdict(lambda: defaultdict(set))
    for page, url, source in pages:
        host = re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "")
        section = re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^/?#]+)/", url or "")
        host, section = host[1].lower() if host else "", section[1] if section else ""
        read[page] = html_text.read_page(source or ""), [(host,), (host, section)]
        for g in read[page][1]:
            groups[g][None].add(source)
            for h in read[page][0].hashes:
                if h is not None:
                    groups[g][h].add(source)
    out = {}
    for page, (r, keys) in read.items():
        gone = {h for g in keys for h, on in groups[g].items() if h is not None and len(on) >= 5 and len(on) >= 0.05 * len(groups[g][None])}

        def template(node):
            while node >= 0:
                if r.hashes[node] in gone:  # noqa: B023
                    return True
                node = r.parents[node]  # noqa: B023
            return False

        out[page] = sum(map(template, r.at)) + sum(map(template, r.others))
    return out


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_counts_equal_plain_counts(spark, sf):
    p = pd.read_parquet(f"{sf}/pages.parquet")
    pages = list(zip(p["page_id"], p["url"], p["html"]))
    bar = '<div class="zz"><p>Shared words</p><div>inner</div></div>'
    made = [(10**6 + i, f"https://many.test/{'a' if i < 30 else 'b'}/{i % 50}", f"<body>{bar if i % 3 else ''}<section><p>own {i % 50}</p></section><aside>all the same</aside></body>") for i in range(60)]
    every = pages + made
    df = spark.createDataFrame([(int(a), b, c) for a, b, c in every], "page_id long, url string, html string")
    got = {r["page_id"]: r["n_blocks_removed"] for r in html_text.extract(df).collect()}
    want = slow_removed(every)
    assert got == want and sum(want.values()) > 60
