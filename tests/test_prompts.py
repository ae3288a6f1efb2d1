"""Request tables, listings and admission."""

from sitequarry.operators import logs, prompts


def test_requests(spark):
    urls = spark.createDataFrame([(1, "T", None), (2, "U", "h")], "id long, title1 string, h1 string")
    asked = spark.createDataFrame([("a", "{title1}/{h1}/{x}", None), ("b", "{title1}", "missing_h1")], "name string, template string, issue_type string")
    issues = spark.createDataFrame([(1, "missing_h1"), (1, "missing_h1")], "url_id long, type string")
    got = sorted(tuple(r) for r in prompts.prompt_requests(urls, asked, issues, ["title1", "h1"]).collect())
    assert got == [("a", 1, "T//{x}"), ("a", 2, "U/h/{x}"), ("b", 1, "T")]


def test_listing(spark):
    text = {"good": "# T\n\n- URL: https://a.test/\n  Title: x\n  Description: y\n# note\n\nfree text", "bad": "- URL: nope\n  more\n\n  no entry", "none": "text"}
    lines = spark.createDataFrame([(d, i + 1, x) for d, t in text.items() for i, x in enumerate(t.split("\n"))], "doc string, line_no int, line string")
    got = sorted(tuple(r) for r in prompts.validate_listing(lines).collect())
    assert got == [("bad", 0, "no header"), ("bad", 1, "bad address"), ("bad", 2, "stray line"), ("none", 0, "no addresses"), ("none", 0, "no header")]


def test_admission(spark):
    found = spark.createDataFrame([("https://A.test/x#f", 1), ("https://a.test/x", 2), ("https://a.test/?q=1", 1), ("ftp://a.test/", 1), ("https://a.test/deep", 9)], "url string, depth int")
    seen = spark.createDataFrame([("https://a.test/seen",)], "url string")
    got = [tuple(r) for r in prompts.admit(found, seen, most_depth=5, search_pages=False).collect()]
    assert got == [("https://a.test/x", 1)]


def test_reviews(spark):
    rows = spark.createDataFrame([(1, "https://a.test/", "T", None, " x" * 2000), (2, "https://a.test/b", "", "H", None)], "id long, url string, title string, h1 string, content string")
    got = {r["id"]: r["request"].split("\n") for r in prompts.review_requests(rows, "title").collect()}
    task = prompts.REVIEWS["title"][0]
    assert got[1] == ["url: https://a.test/", "title: T", "h1: (none)", "text: " + (" x" * 1000).strip() + "...", task]
    assert got[2] == ["url: https://a.test/b", "title: (none)", "h1: H", "text: ", task]
    found = spark.createDataFrame([(1, "https://a.test/", "missing_h1", None)], "id long, url string, type string, details string")
    assert "type: missing_h1\ndetails: (none)\n" in prompts.review_requests(found, "issue").first()["request"]
    assert prompts.review_requests(found.limit(0), "issue").count() == 0


def test_summary_of_an_empty_log(spark):
    none = spark.createDataFrame([], "line_no long, url string, status_code int, user_agent string")
    assert sorted((r["section"], r["key"], r["hits"]) for r in logs.summary(none).collect()) == [("total", "bot_requests", 0), ("total", "requests", 0), ("total", "unique_urls", 0)]
