"""Keyword counts."""

from sitequarry.operators import keywords


def test_words_are_split_once(spark):
    """The pairs of neighbouring words name the words several times; the text is read for one of them only."""
    rows = spark.createDataFrame([(1, "Red apple, red apple pie", "red"), (2, None, "x")], "id long, body string, title string")
    counts = keywords.keyword_counts(rows, ["title", "body"])
    assert {(r["keyword"], r["n"]) for r in counts.collect()} == {("red", 3), ("apple", 2), ("pie", 1), ("red apple", 2), ("apple red", 1), ("apple pie", 1)}
    assert counts._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
