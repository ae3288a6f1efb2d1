"""Stored tables, reads of them, and the streaming append."""

from pyspark.sql import functions as F

from sitequarry.operators import runs, scans, store
from sitequarry.sources import readers
from sitequarry.streaming import jobs

URLS = "id long, address string, status_code int"


def _rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_batches_replace_themselves(spark, tmp_path):
    place = str(tmp_path)
    rows = spark.createDataFrame([(1, "https://a.test/", 200), (2, "https://a.test/x", 0), (3, None, None)], URLS)
    for batch in (0, 1, 1, 0):
        store.append(rows.filter(F.col("id") % 2 == batch), place, "urls", 7, batch)
    store.append(rows.limit(0), place, "urls", 7, 2)
    store.append(rows, place, "urls", 8)
    assert _rows(store.read(spark, place, "urls", 7), "id", "status_code") == [(1, 200), (2, 0), (3, None)]
    assert store.read(spark, place, "urls").count() == 6
    for version, status in enumerate(("running", "completed")):
        store.save_run(spark, place, 7, version, "a", status, "2026-01-01 00:00:00")
    store.save_run(spark, place, 9, 0, "empty", "running", "2026-01-02 00:00:00")
    got = store.all_runs(spark, place)
    assert _rows(got, "crawl_run_id", "status", "found", "crawled", "errors") == [(7, "completed", 3, 1, 1), (9, "running", 0, 0, 0)]
    assert _rows(store.totals(got), "runs", "found") == [(2, 3)]
    assert _rows(store.totals(got.limit(0)), "runs", "found") == [(0, 0)]


def test_updates(spark):
    rows = spark.createDataFrame([(1, "a", 200), (2, "b", None), (2, "b", None)], URLS)
    changes = spark.createDataFrame([(1, 404, 1), (1, 500, 2), (2, None, 1), (9, 200, 1)], "id long, status_code int, at int")
    assert _rows(store.updated(rows, changes, order="at"), "id", "address", "status_code") == [(1, "a", 500), (2, "b", None), (2, "b", None)]
    assert store.updated(rows, changes.limit(0), order="at").columns == rows.columns


def test_text_dumps(spark):
    rows = spark.createDataFrame([(1, True, ["x", "y"]), (2, None, None)], "id long, ok boolean, list array<string>")
    text = store.as_text(rows)
    assert [f.dataType.simpleString() for f in text.schema] == ["bigint", "int", "string"]
    assert _rows(store.from_text(text, rows.schema), "id", "ok", "list") == [(1, True, ["x", "y"]), (2, None, None)]
    assert _rows(store.from_text(text.withColumn("list", F.lit("{bad")), rows.schema), "list") == [(None,), (None,)]


def test_fetch_rows(spark):
    rows = spark.createDataFrame([(200, None), (418, None), (None, None), (0, "a timeout of DNS"), (0, "DNS failed"), (0, "x")], "status_code int, error string")
    got = _rows(scans.fetch_rows(rows), "status_code", "error_type", "status", "status_category")
    assert got == sorted([(200, None, "OK", "success"), (418, None, "Unknown", "client-error"), (None, None, "Unknown", "no-response"), (0, "timeout", "No Response", "no-response"), (0, "dns", "Error", "client-error"), (0, "error", "Error", "client-error")], key=repr)


def test_scans(spark):
    urls = spark.createDataFrame([(1, "https://a.test/x", 200), (2, None, 404)], URLS)
    wanted = spark.createDataFrame([("https://A.test:443/x#f",), (None,)], "url string")
    assert _rows(scans.by_address(urls, wanted), "id") == [(1,)]
    assert _rows(scans.search(urls, "A.TEST", ["address", "status_code"]), "id") == [(1,)]
    assert scans.search(urls, "", ["address"]).count() == 2
    assert _rows(scans.first_of_each(urls.withColumn("k", F.lit(1)), ["k"], ["id"], 1), "id") == [(1,)]
    dated = urls.withColumns({"last_modified": F.lit(""), "is_internal": F.lit(True), "indexable": F.col("id") == 2})
    assert runs.listed(dated).count() == 0
    assert _rows(dated.select(runs.last_modified(dated, "2026-01-01").alias("d")), "d") == [("2026-01-01",)] * 2


def test_page_speed(spark):
    rows = spark.createDataFrame([("u", "m", None), ("v", "m", "no json"), ("w", "m", '{"lighthouseResult": {"audits": {"speed-index": {"numericValue": 2.5}, "a": {"displayValue": "1", "details": {"overallSavingsMs": 12.5}}}}}')], "url string, strategy string, body string")
    got = readers.page_speed(rows)
    assert _rows(got, "url", "speed_index", "opportunities", "diagnostics") == [("u", None, [], []), ("v", None, [], []), ("w", 2.5, ["a: save 13ms"], [])]
    assert _rows(store.metric_rows("psi", got, "url"), "url", "name", "value") == [("w", "speed_index", 2.5)]


def test_append_pages(spark, tmp_path):
    feed, place = str(tmp_path / "feed"), str(tmp_path / "store")
    schema = "id long, address string, run_host string, title1 string"
    for n, rows in enumerate(([(1, "https://a.test/1", "a.test", "T"), (2, "https://a.test/2", "a.test", "U")], [(3, "https://a.test/3", "a.test", "t "), (4, "https://b.test/4", "b.test", "T")], [(5, "https://a.test/5", "a.test", "T")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(feed)
        jobs.append_pages(spark.readStream.schema(schema).json(feed), place, str(tmp_path / "log"), 3).awaitTermination()
        assert store.read(spark, place, "urls", 3).count() == (2, 4, 5)[n]
    assert _rows(jobs.duplicate_titles(spark, place, 3), "url_id", "value") == [(1, "3"), (3, "3"), (5, "3")]
