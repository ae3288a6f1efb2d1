"""Derived tables."""

from sitequarry.plans import tables


def test_neighbours_take_no_texts_along(spark):
    """Next and previous pages come from a window over addresses: a host's texts don't go to one task."""
    pages = spark.createDataFrame([(i, f"https://{'ab'[i % 2]}.test/{i}#x", f"<body>text {i}</body>") for i in range(1, 8)], "page_id long, url string, html string")
    urls = tables.derived(spark, "", "url_fx", {"pages": pages})
    assert {r["id"]: (r["rel_next"], r["rel_prev"]) for r in urls.collect()} == {
        1: ("https://b.test/3", None), 2: ("https://a.test/4", None), 3: (None, "https://b.test/1"), 4: ("https://a.test/6", "https://a.test/2"), 5: ("https://b.test/7", None), 6: (None, "https://a.test/4"), 7: (None, "https://b.test/5"),
    }
    plan = urls._jdf.queryExecution().optimizedPlan().toString().splitlines()
    windows = [i for i, line in enumerate(plan) if "Window [" in line]
    assert windows and not any("html" in line or "body_text" in line for i in windows for line in plan[i : i + 2])
    alone = urls.select("id", "title1")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in alone and "Window" not in alone
