"""Each rule with the smallest input that fires it and one that does not."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from sitequarry.functions import text as T
from sitequarry.functions import urls as U
from sitequarry.sources import readers
from sitequarry.operators import keywords, links, logs, rules, runs

PAGE = "id long, address string, run_host string, title1 string, title2 string, meta_description1 string, h1 string, h1_count int, h2_count int, lang string, word_count int, text_ratio double, status_code int, hash string, canonical string, rel_next string, rel_prev string"
GOOD = dict(id=1, address="https://a.test/p", run_host="a.test", title1="a" * 45, title2=None, meta_description1="a" * 120, h1="Heading", h1_count=1, h2_count=2, lang="en", word_count=400, text_ratio=20.0, status_code=200, hash="h", canonical="https://a.test/p", rel_next=None, rel_prev=None)


def page(spark, *changes):
    return spark.createDataFrame([tuple((GOOD | {"id": i + 1, "hash": f"h{i}", "title1": chr(98 + i) * 45, "h1": f"Heading {i}", "meta_description1": chr(98 + i) * 100} | c).values()) for i, c in enumerate(changes)], PAGE)


def types(df):
    return sorted(r["type"] for r in df.collect())


@pytest.mark.parametrize("change, rule_set, expected", [
    ({"title1": None}, rules.title_rules, ["missing_title"]),
    ({"title1": "b" * 60}, rules.title_rules, []),
    ({"title1": "b" * 61}, rules.title_rules, ["title_too_long"]),
    ({"title1": "b" * 29}, rules.title_rules, ["title_too_short"]),
    ({"title1": "W" * 47}, rules.title_rules, ["title_truncated"]),
    ({"title2": "x"}, lambda: rules.title_rules(second="title2"), ["multiple_titles"]),
    ({"meta_description1": None}, rules.meta_rules, ["missing_meta_description"]),
    ({"meta_description1": "a" * 156}, rules.meta_rules, ["meta_description_too_long"]),
    ({"meta_description1": "a" * 69}, rules.meta_rules, ["meta_description_too_short"]),
    ({"meta_description1": "a" * 120}, rules.meta_rules, []),
    ({"h1_count": 0, "h2_count": 0, "h1": None}, rules.heading_rules, ["missing_h1"]),
    ({"h1_count": 0, "h2_count": 3, "h1": None}, rules.heading_rules, ["missing_h1", "non_sequential_headings"]),
    ({"h1_count": 2}, rules.heading_rules, ["multiple_h1"]),
    ({"h1": "x" * 80}, rules.heading_rules, ["h1_too_long"]),
    ({"h1": "Same", "title1": " same "}, rules.heading_rules, ["h1_same_as_title"]),
    ({"word_count": None, "text_ratio": None, "h2_count": 0}, rules.content_rules, ["low_text_ratio", "missing_h2", "thin_content"]),
    ({"word_count": 299}, rules.content_rules, ["thin_content"]),
    ({"word_count": 300}, rules.content_rules, []),
    ({"status_code": 502}, rules.response_rules, ["broken_internal_page"]),
    ({"status_code": 0}, rules.response_rules, ["no_response"]),
    ({"lang": " "}, rules.language_rules, ["missing_lang_attribute"]),
    ({"address": "https://a.test/a_b//B c/a?q=1"}, rules.url_rules, ["internal_search_url", "url_contains_space", "url_contains_underscore", "url_contains_uppercase", "url_has_parameters", "url_multiple_slashes"]),
    ({"address": "https://a.test/x/y/x"}, rules.url_rules, ["url_repetitive_path"]),
])
def test_row_rule(spark, change, rule_set, expected):
    assert types(rules.apply_rules(page(spark, change), rule_set())) == expected


def test_no_pages_no_issues(spark):
    assert rules.audit_pages(page(spark, {}).filter("id < 0")).count() == 0


def test_duplicates(spark):
    rows = page(spark, {"title1": "Same title"}, {"title1": " same TITLE "}, {})
    assert types(rules.duplicates(rows, "run_host", "title1", "page-titles", "duplicate_title")) == ["duplicate_title"] * 2


def test_canonicals(spark):
    rows = page(spark, {"canonical": None}, {"address": "https://a.test/q", "canonical": "http://b.test/"}, {"address": "https://a.test/404", "canonical": "https://a.test/404", "status_code": 404})
    assert types(rules.canonical_issues(rows)) == ["canonical_to_different_domain", "canonical_to_different_url", "canonical_to_http", "canonical_to_non_200", "missing_canonical"]


def test_commerce_needs_a_shop(spark):
    schema = "id long, address string, html string, run_host string, indexable boolean, canonical string, rel_next string, rel_prev string"
    none = spark.createDataFrame([], "source_id long, schema_type string")
    shop = spark.createDataFrame([(1, "https://s.test/product/x", "<p>no</p>", "s.test", True, None, None, None), (2, "https://s.test/cart", "", "s.test", True, None, None, None), (3, "https://s.test/c?sort=a", "", "s.test", True, None, None, None)], schema)
    assert types(rules.commerce_issues(shop, none)) == ["cart_checkout_indexable", "faceted_nav_indexable", "missing_breadcrumb_schema", "missing_product_schema", "product_missing_price", "product_missing_reviews"]
    assert rules.commerce_issues(shop.filter("id = 2"), none).count() == 0


def test_local(spark):
    rows = spark.createDataFrame([(1, "https://l.test/", "l.test", "<p>call 555 123 4567 in 12345</p>"), (2, "https://l.test/contact", "l.test", "<p>+1 555 999 1111</p>")], "id long, address string, run_host string, html string")
    none = spark.createDataFrame([], "source_id long, schema_type string")
    assert types(rules.local_issues(rows, none)) == ["contact_page_missing_address", "inconsistent_nap_address", "inconsistent_nap_phone", "missing_gbp_link", "missing_google_map_embed", "missing_local_business_schema"]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("link, expected", [
    ("/b c", "https://a.test/b%20c"), ("//h.test/x#f", "https://h.test/x#f"), ("#x", None), ("mailto:a@b", None), ("http://H.test:80/", "http://h.test/"), ("", None), ("c?d=1", "https://a.test/c?d=1"),
])
def test_resolve(link, expected):
    assert U.resolve_text(link, "https://a.test/") == expected


def test_url_functions(spark):
    u = F.lit("https://User@A.test:443/x/Y.html?a=1&b=2&a=3#f")
    assert one(spark, U.host(u)) == "a.test" and one(spark, U.path(u)) == "/x/Y.html" and one(spark, U.extension(u)) == "html"
    assert one(spark, U.query_params(u)) == {"a": "3", "b": "2"}
    assert one(spark, U.normalize(u)) == "https://a.test/x/Y.html?a=1&b=2&a=3"
    assert one(spark, U.query_mode(u, "remove-except-first")) == "https://User@A.test:443/x/Y.html?a=1#f"
    assert one(spark, U.content_type(u)) == "text/html" and one(spark, U.folder_depth(u)) == 2
    assert one(spark, U.host(F.lit("no url"))) == "" and one(spark, U.is_seed(F.lit("ftp://x/"))) is False
    assert one(spark, U.matches_any(F.lit("a(b"), ["("])) is True


def test_text_functions(spark):
    assert one(spark, T.pixel_width(F.lit("a" * 120), "description")) == 607
    assert [one(spark, T.is_hreflang(F.lit(x))) for x in ("en", "de_AT", "x-default", "xx", "en-zz", "en-us-x")] == [True, True, True, False, False, False]
    assert one(spark, T.ngrams(T.tokens(F.lit("Für the quick-brown fox"), T.STOP_WORDS, 3))) == ["quick", "brown", "fox", "quick brown", "brown fox"]
    assert one(spark, T.text_list(F.lit('["a","b"]'))) == ["a", "b"] and one(spark, T.text_list(F.lit("a; b\nc"))) == ["a", "b", "c"]
    assert one(spark, T.detect_bot(F.lit("x Googlebot-Image/1"))) == "Googlebot-Image"
    assert one(spark, T.authority(F.lit("https://netflix.com/"), F.lit(False))) == 94 and one(spark, T.authority(F.lit("https://x.edu/"), F.lit(False))) == 30


def test_log_lines(spark):
    lines = spark.createDataFrame([('1.2.3.4 - - [10/Oct/2024:13:55:36 +0000] "GET /a?b=1 HTTP/1.1" 404 - "-" "Googlebot/2.1"',), ("",), ("garbage",), ('1.2.3.4 - - [bad] "GET /b" 200 12 "r" "GPTBot"',)], "value string")
    rows = sorted(logs.parse_lines(lines).collect(), key=lambda r: r["url"])
    assert [(r["url"], r["status_code"], r["bytes"], r["referrer"]) for r in rows] == [("/a?b=1", 404, None, None), ("/b", 200, 12, "r")]
    assert logs.select_entries(logs.parse_lines(lines), start="2030-01-01").count() == 1  # no readable time passes


def test_log_formats_in_one_pass(spark):
    rows = [(1, '2024-10-10T13:55:36Z edge 9.8.7.6 get /c/404?x=1 503 77 "Bing bingbot/2.0" more'), (2, '1.2.3.4 - - [10/Oct/2024:13:55:36 +0000] "GET /a HTTP/1.1" 404 - "-" "A\u0001B"'), (3, "   "), (4, '1.2.3.4 - - [cut "GET'), (5, None), (6, 'GET "x" 1.2.3'), (6, 'GET "x" 1.2.3')]
    lines = spark.createDataFrame(rows, "line_no long, value string")
    seen = Observation("log")
    got = sorted(logs.parse_lines(lines, observe=seen).collect(), key=lambda r: r["line_no"])
    assert [(r["line_no"], r["ip"], r["method"], r["url"], r["status_code"], r["bytes"], r["user_agent"]) for r in got] == [(1, "9.8.7.6", "GET", "/c/404?x=1", 503, 77, "Bing bingbot/2.0"), (2, "1.2.3.4", "GET", "/a", 404, None, "A\ufffdB")]
    assert seen.get == {"lines": 5, "combined": 1, "cdn": 1, "rejected": 3}
    assert sorted(r["line_no"] for r in logs.rejected_lines(lines).collect()) == [4, 6, 6]
    assert {r["format"]: r["lines"] for r in logs.line_formats(lines).collect()} == {"combined": 1, "cdn": 1, "rejected": 3}
    plan = logs.parse_lines(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 4


def test_line_numbers_over_split_files(spark, tmp_path):
    for name, n in (("a", 3000), ("b", 1)):
        (tmp_path / f"{name}.log").write_text("\n".join("" if i % 10 == 4 else f"{name} line {i + 1} " + "x" * (i % 50) for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = readers.log_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 2701 and all(r["value"].split()[2] == str(r["line_no"]) and f"/{r['value'][0]}.log" in r["file"] for r in rows)


def test_unique_counts_merge(spark):
    entries = spark.range(20000).selectExpr("timestamp_seconds(id * 20) as ts", "concat('/', id % 3000) as url", "concat('10.0.0.', id % 7) as ip")
    got = logs.merged_uniques(logs.unique_sketches(entries), "year").collect()
    assert len(got) == 1 and got[0]["requests"] == 20000 and got[0]["unique_visitors"] == 7 and abs(got[0]["unique_urls"] - 3000) < 90


def test_depth_equals_python(spark):
    edges = [(1, 2), (2, 3), (3, 1), (2, 4), (9, 1)]
    got = links.crawl_depth(spark.createDataFrame(edges, "source_id long, target_id long"), spark.createDataFrame([(1,)], "id long"))
    assert {r["id"]: r["depth"] for r in got.collect()} == {1: 0, 2: 1, 3: 2, 4: 2}


def test_redirects(spark):
    got = {r["src"]: (r["final"], r["hops"], r["loop"]) for r in runs.redirect_closure(spark.createDataFrame([(1, 2), (2, 3), (5, 6), (6, 5), (7, 7)], "src long, dst long")).collect()}
    assert got == {1: (3, 2, False), 2: (3, 1, False), 5: (5, 2, True), 6: (6, 2, True), 7: (7, 1, True)}


def test_rounds_of_redirects_derive_no_hops_and_take_open_chains_only(spark, monkeypatch):
    """A line of 14 pages, 50 pages that lead to themselves and 50 that lead to a page without a hop."""
    written, write = [], runs.materialise

    def watch(df, name):
        out = write(df, name)
        written.append(("Range" in df._jdf.queryExecution().optimizedPlan().toString(), out.count()))
        return out

    monkeypatch.setattr(runs, "materialise", watch)
    hops = spark.range(113).selectExpr("id AS src", "CASE WHEN id < 13 THEN id + 1 WHEN id < 63 THEN id ELSE 999 END AS dst")
    got = {r["src"]: (r["final"], r["hops"], r["loop"]) for r in runs.redirect_closure(hops).collect()}
    wanted = {i: (i + 10, 10, False) if i < 4 else (13, 14 - i, True) for i in range(13)}
    wanted |= {i: (i, 1, True) for i in range(13, 63)} | {i: (999, 1, False) for i in range(63, 113)}
    assert got == wanted
    assert [derives for derives, _ in written] == [True] + [False] * 9
    assert [n for _, n in written[1:]] == [63, 12, 11, 10, 9, 8, 7, 6, 5]


def test_diff_of_a_run_with_itself_is_empty(spark):
    rows = page(spark, {}, {"address": "https://a.test/z", "title1": None})
    assert {r["status"] for r in runs.diff_runs(rows, rows, ["title1", "status_code"]).collect()} == {"same"}


def test_robots(spark):
    texts = spark.createDataFrame([("h", "User-agent: *\nDisallow: /a\nAllow: /a/b # c\nUser-agent: bot\nDisallow:")], "host string, text string")
    urls = spark.createDataFrame([(1, "h", "/a/x"), (2, "h", "/a/b"), (3, "h", "/z"), (4, "other", "/a")], "id long, run_host string, path string")
    allowed = lambda agent: {r["id"]: r["allowed"] for r in runs.robots_allowed(urls, runs.robots_rules(texts), agent).collect()}
    assert allowed("my") == {1: False, 2: True, 3: True, 4: True}
    assert allowed("mybot") == {1: False, 2: False, 3: False, 4: True}  # the empty value is last and begins every path


def test_health_and_export(spark):
    issues = spark.createDataFrame([("headings", "high"), ("url", "low")], "category string, priority string")
    pages = spark.range(2)
    assert runs.health(pages, issues).first()["score"] == 65
    by = {r["category"]: r["score"] for r in runs.health_by_category(pages, issues).collect()}
    assert by["headings"] == 70 and by["urls"] == 100
    out = runs.export_columns(spark.createDataFrame([(None, [1, 2])], "b string, a array<int>"))
    assert out.columns == ["a", "b"] and tuple(out.first()) == ("[1,2]", "")


def test_content_score_bands(spark):
    row = spark.createDataFrame([(1, "alpha beta. alpha gamma.", None, "H", 1, 2, "H", "")], "id long, text string, word_count int, h1 string, h1_count int, h2_count int, title1 string, meta_description1 string")
    got = keywords.content_score(row, "alpha").first()
    assert got["keyword_density"] == 50.0 and got["headings"] == 100 and "add_meta_description" in got["suggestions"]


def test_alternates_in_normal_form(spark):
    urls = spark.createDataFrame([(1, "https://a.test/", 200), (2, "https://a.test/x", 404), (3, None, 500)], "id long, address string, status_code int")
    found = spark.createDataFrame([(1, "https://a.test/", "https://A.test:443/x", "en"), (1, "https://a.test/", None, "de"), (1, "https://a.test/", "https://b.test/", "fr")], "source_id long, source string, target string, hreflang string")
    got = sorted((r["type"], r["value"]) for r in rules.hreflang_issues(found, urls).collect())
    assert got == [("hreflang_to_non_200", "404"), ("missing_hreflang_return_tag", "https://A.test:443/x")]
