"""Streaming jobs: access logs and run events with bounded state, page rules on arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sitequarry.operators import logs, rules, store

EVENT = "run string, ts timestamp, done long, total long, status string"


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.text(folder)


def hourly_log(lines: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Requests by hour of a stream of log lines; an hour is final when the watermark has passed it."""
    return logs.by_hour(logs.parse_lines(lines), watermark)


def log_totals(lines: DataFrame) -> DataFrame:
    """Hits by URL and status, for update or complete mode."""
    return logs.parse_lines(lines).groupBy("url", "status_code").agg(F.count("*").alias("hits"))


def latest_event(events: DataFrame) -> DataFrame:
    """The latest event of each run: one row of state per run."""
    return events.groupBy("run").agg(F.max_by(F.struct("done", "total", "status"), "ts").alias("e"), F.max("ts").alias("ts")).select("run", "ts", "e.*")


def new_addresses(pages: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Pages whose address did not arrive within the watermark before."""
    return pages.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["address"])


def page_issues(pages: DataFrame) -> DataFrame:
    """Row rules run on a stream of page facts as they do on a table."""
    return rules.apply_rules(pages, rules.title_rules() + rules.meta_rules() + rules.url_rules())


def append_pages(pages: DataFrame, folder: str, checkpoint: str, run: int = 0) -> StreamingQuery:
    """Each micro-batch appends its pages and the duplicate titles that it touches, against what is stored.

    Both are stored under the batch's number, so a batch that runs again replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        store.append(batch, folder, "urls", run, number)
        stored = store.read(batch.sparkSession, folder, "urls", run).filter(F.col("batch") <= number)
        title = F.lower(F.trim("title1"))
        touched = stored.filter(F.col("batch") == number).select("run_host", title.alias("title_key")).distinct()
        rows = stored.withColumn("title_key", title).join(touched, ["run_host", "title_key"], "left_semi")
        store.append(rules.duplicates(rows, "run_host", "title1", "page-titles", "duplicate_title"), folder, "duplicates", run, number)

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def duplicate_titles(spark: SparkSession, folder: str, run: int = 0) -> DataFrame:
    """The newest duplicate finding of each page."""
    return store.newest(store.read(spark, folder, "duplicates", run), "url_id")
