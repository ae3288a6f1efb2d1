"""Sources: runs, pages, logs, sitemaps, robots texts, mappings and external metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitequarry.functions import urls as U


def pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan_urls(urls: DataFrame, run: int | None = None, status: str | None = None, content_type: str | None = None, limit: int | None = None, offset: int = 0, internal: bool | None = None) -> DataFrame:
    """Pages by run, place (inside the site or not), status category and content type, in the order of their ids."""
    for column, value in (("crawl_run_id", run), ("is_internal", internal), ("status_category", status), ("content_type", content_type)):
        if value is not None:
            urls = urls.filter(F.col(column) == value)
    out = urls.orderBy("id").offset(offset)
    return out.limit(limit) if limit else out


def newest_run(runs: DataFrame) -> DataFrame:
    """Of each store the newest completed run, or else the newest."""
    w = Window.partitionBy("store").orderBy(F.desc(F.col("status") == "completed"), F.desc("started_at"))
    return runs.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of log files with the file they come from and their number in it, from 1; blank lines are counted and dropped.

    A file is read in blocks by many tasks. The lines of each block are counted first; a line's number is the sum of the
    blocks before it, a table of one row per block, and its place in its own.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("lines"))
    before = F.coalesce(F.sum("lines").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.join(blocks.select("file", "block", "first", before.alias("before")), ["file", "block"])
    return placed.filter(F.trim("value") != "").select("value", "file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line_no"))


def sitemap_urls(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit("<loc>([^<]+)</loc>"), F.lit(1))).alias("url")).select(F.trim("url").alias("url"))


def robots_sitemaps(texts: DataFrame) -> DataFrame:
    return texts.select("host", F.explode(F.regexp_extract_all("text", F.lit("(?im)^Sitemap:[ \\t]*(\\S+)"), F.lit(1))).alias("url"))


def crawl_delays(texts: DataFrame, agents: tuple[str, ...]) -> DataFrame:
    """host, delay: of the last named agent that contains one of `agents`, or else of *; 0 counts as unset."""
    lines = texts.select("host", F.posexplode(F.split("text", "\\r?\\n")).alias("line_no", "line"))
    key, value = F.lower(F.trim(F.split_part("line", F.lit(":"), F.lit(1)))), F.trim(F.expr("substring(line, instr(line, ':') + 1)"))
    rows = lines.filter(F.col("line").contains(":")).select("host", "line_no", key.alias("k"), value.alias("v"))
    w = Window.partitionBy("host").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("agent", F.last(F.when(F.col("k") == "user-agent", F.lower("v")), ignorenulls=True).over(w)).filter("k = 'crawl-delay'")
    number = F.nullif(F.expr("try_cast(v as double)"), F.lit(0.0))
    ours = F.lit(False)
    for a in agents:
        ours = ours | F.col("agent").contains(a)
    return rows.groupBy("host").agg(F.max_by(number, F.when(ours & number.isNotNull(), F.col("line_no"))).alias("own"), F.max_by(number, F.when((F.col("agent") == "*") & number.isNotNull(), F.col("line_no"))).alias("all")).select("host", F.coalesce("own", "all").alias("delay"))


def seeds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(U.normalize(F.trim("value")).alias("url")).filter("url is not null").distinct()


def url_mapping(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Ordered (old, new) prefixes of a JSON object; a handful, written by hand."""
    import json

    text = spark.read.text(path, wholetext=True).first()
    return list(json.loads(text["value"]).items()) if text else []


def search_metrics(rows: DataFrame) -> DataFrame:
    """Search-console rows (keys, clicks, impressions, ctr, position) by page; rows without a page are dropped."""
    zero = F.lit(0.0)
    return rows.select(F.get("keys", F.lit(0)).alias("page"), *[F.coalesce(F.col(c).cast("double"), zero).alias(c) for c in ("clicks", "impressions", "ctr", "position")]).filter("page <> ''")


def analytics_metrics(rows: DataFrame) -> DataFrame:
    """Analytics rows (headers, values) by path."""
    m = F.map_from_arrays("headers", "values")
    number = lambda *names: F.coalesce(*[F.try_element_at(m, F.lit(n)).cast("double") for n in names], F.lit(0.0))
    return rows.select(F.try_element_at(m, F.lit("pagePath")).alias("path"), number("screenPageViews", "pageviews").alias("views"), number("sessions").alias("sessions"))


_SPEED = """lighthouseResult STRUCT<categories: STRUCT<performance: STRUCT<score: DOUBLE>>, audits: MAP<STRING, STRUCT<numericValue: DOUBLE, displayValue: STRING, details: STRUCT<overallSavingsMs: DOUBLE>>>>,
loadingExperience STRUCT<metrics: MAP<STRING, STRUCT<percentile: DOUBLE>>, originLoadingExperience: STRUCT<metrics: MAP<STRING, STRUCT<percentile: DOUBLE>>>>"""
# Columns and the names of the measures that fill them.
AUDITS = {"first_contentful_paint": "first-contentful-paint", "largest_contentful_paint": "largest-contentful-paint", "time_to_interactive": "interactive", "total_blocking_time": "total-blocking-time", "cumulative_layout_shift": "cumulative-layout-shift", "speed_index": "speed-index"}
FIELD = {"lcp": "LARGEST_CONTENTFUL_PAINT_MS", "inp": "INTERACTION_TO_NEXT_PAINT_MS", "cls": "CUMULATIVE_LAYOUT_SHIFT_SCORE"}


def page_speed(reports: DataFrame) -> DataFrame:
    """Page-speed reports (url, strategy, body as JSON text) as metrics, with savings and diagnostics in the report's order.

    What a report lacks is null; a body that is no JSON gives a row of nulls and empty lists.
    """
    rows = reports.select("url", "strategy", F.from_json("body", _SPEED).alias("r"))
    audits, near, origin = F.col("r.lighthouseResult.audits"), F.col("r.loadingExperience.metrics"), F.col("r.loadingExperience.originLoadingExperience.metrics")
    saves = lambda a: F.coalesce(a["value"]["details"]["overallSavingsMs"] > 0, F.lit(False))
    shown = lambda a: (F.coalesce(a["value"]["displayValue"], F.lit("")) != "") & ~a["key"].isin("first-contentful-paint", "largest-contentful-paint")
    entries = F.coalesce(F.map_entries(audits), F.expr("CAST(array() AS ARRAY<STRUCT<key: STRING, value: STRUCT<numericValue: DOUBLE, displayValue: STRING, details: STRUCT<overallSavingsMs: DOUBLE>>>>)"))
    savings = F.transform(F.filter(entries, saves), lambda a: F.concat(a["key"], F.lit(": save "), F.format_string("%.0fms", a["value"]["details"]["overallSavingsMs"])))
    diagnostics = F.transform(F.filter(entries, lambda a: ~saves(a) & shown(a)), lambda a: F.concat(a["key"], F.lit(": "), a["value"]["displayValue"]))
    return rows.select(
        "url", "strategy", (F.col("r.lighthouseResult.categories.performance.score") * 100).alias("performance_score"),
        *[audits[name]["numericValue"].alias(c) for c, name in AUDITS.items()],
        *[near[name]["percentile"].alias(f"crux_{c}") for c, name in FIELD.items()],
        *[origin[name]["percentile"].alias(f"crux_origin_{c}") for c, name in FIELD.items()],
        savings.alias("opportunities"), diagnostics.alias("diagnostics"),
    )


def recent(metrics: DataFrame, date: str, lag_days: int, span_days: int = 30) -> DataFrame:
    """The window of metric rows that ends lag_days before today."""
    end = F.date_sub(F.current_date(), lag_days)
    return metrics.filter(F.col(date).between(F.date_sub(end, span_days), end))


def enrich(urls: DataFrame, by_page: DataFrame, by_path: DataFrame) -> DataFrame:
    """Pages with search metrics by normalised URL and analytics by path."""
    return urls.withColumn("page", U.normalize(F.col("address"))).withColumn("path", U.path(F.col("address"))).join(by_page, "page", "left").join(by_path, "path", "left")
