"""Server access logs: parsing, filters and summaries, for batches and streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from sitequarry.functions import text as T
from sitequarry.operators.scratch import materialise

# The combined format, and the looser format of delivery networks.
COMBINED = '^(\\S+)\\s+(\\S+)\\s+(\\S+)\\s+\\[([^\\]]+)\\]\\s+"([^"]+)"\\s+(\\d{3})\\s+(\\S+)\\s+"([^"]*)"\\s+"([^"]*)"$'
CDN = '(?i)^([^\\s,]+).*?(\\d+\\.\\d+\\.\\d+\\.\\d+).*?(GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH).*?(\\S+).*?(\\d{3}).*?(\\d+|-).*?"([^"]*)"'


#: What every line of the second format holds: tested first, since the pattern is slow to fail.
CDN_SIGNS = ['\\d+\\.\\d+\\.\\d+\\.\\d+', '(?i)GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH', '"[^"]*"']
_MARK = "\u0001"


def _groups(line: Column, pattern: str, groups: list[int]) -> Column:
    """The groups of a pattern that takes the whole line, by one match; a line that doesn't match is one piece."""
    return F.split(F.regexp_replace(line, pattern, "".join(f"{_MARK}${g}" for g in groups)), _MARK)


def _matched(lines: DataFrame, column: str) -> DataFrame:
    """The lines that aren't blank, with the pieces of each format; the second is tried where the first fails."""
    line = F.translate(F.trim(F.col(column)), _MARK, "\ufffd")
    rows = lines.filter(F.trim(F.col(column)) != "").withColumn("_line", line).withColumn("_first", _groups(F.col("_line"), COMBINED, [1, 4, 5, 6, 7, 8, 9]))
    likely = F.lit(True)
    for sign in CDN_SIGNS:
        likely = likely & F.col("_line").rlike(sign)
    return rows.withColumn("_second", F.when((F.size("_first") == 1) & likely, _groups(F.col("_line"), CDN + ".*$", [2, 1, 3, 4, 5, 6, 7])).otherwise(F.array().cast("array<string>")))


def parse_lines(lines: DataFrame, column: str = "value", observe: Observation | str | None = None) -> DataFrame:
    """ip, ts, method, url, status_code, bytes, referrer, user_agent of log lines, with the other columns of the lines.

    Lines of neither format make no entry; `observe` counts them in the same pass: lines, combined, cdn, rejected (an
    Observation for a batch, a name for a stream's progress). Each pattern is matched once for a line. A control
    character U+0001 in a line reads as U+FFFD.
    """
    rows = _matched(lines, column)
    combined, cdn = F.size("_first") == 8, F.size("_second") == 8
    if observe is not None:
        rows = rows.observe(observe, F.count("*").alias("lines"), F.count_if(combined).alias("combined"), F.count_if(cdn).alias("cdn"), F.count_if(~combined & ~cdn).alias("rejected"))
    rest = [c for c in lines.columns if c != column]
    one, two = (lambda i: F.col("_first")[i]), (lambda i: F.col("_second")[i])
    request = F.split(one(3), "\\s+")
    number = lambda c: F.nullif(c, F.lit("-")).try_cast("long")
    first = F.struct(one(1).alias("ip"), one(2).alias("time"), F.get(request, F.lit(0)).alias("method"), F.coalesce(F.get(request, F.lit(1)), F.lit("")).alias("target"), one(4).cast("int").alias("status_code"), number(one(5)).alias("bytes"), one(6).alias("referrer"), one(7).alias("user_agent"))
    second = F.struct(two(1).alias("ip"), two(2).alias("time"), F.upper(two(3)).alias("method"), two(4).alias("target"), two(5).cast("int").alias("status_code"), number(two(6)).alias("bytes"), F.lit("").alias("referrer"), two(7).alias("user_agent"))
    entries = rows.select(*rest, F.inline(F.array_compact(F.array(F.when(combined, first).when(cdn, second)))))
    return entries.select(*rest, "ip", T.log_time(F.col("time")).alias("ts"), "method", F.regexp_replace("target", "^[a-zA-Z]+://[^/?#]+", "").alias("url"), "status_code", "bytes", F.nullif(F.col("referrer"), F.lit("-")).alias("referrer"), "user_agent")


def rejected_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """The lines of neither format, as they came. Blank lines are none."""
    return _matched(lines, column).filter((F.size("_first") != 8) & (F.size("_second") != 8)).select(*lines.columns)


def line_formats(lines: DataFrame, column: str = "value") -> DataFrame:
    """format, lines: how many lines each format has, `rejected` among them."""
    kind = F.when(F.size("_first") == 8, "combined").when(F.size("_second") == 8, "cdn").otherwise("rejected")
    return _matched(lines, column).groupBy(kind.alias("format")).agg(F.count("*").alias("lines"))


def select_entries(entries: DataFrame, start: str | None = None, end: str | None = None, bot: str | None = None) -> DataFrame:
    """Entries of a time range and bot; entries without a readable time pass every range."""
    keep = F.lit(True)
    if start:
        keep = keep & ~F.coalesce(F.col("ts") < F.lit(start).cast("timestamp"), F.lit(False))
    if end:
        keep = keep & ~F.coalesce(F.col("ts") > F.lit(end).cast("timestamp"), F.lit(False))
    if bot:
        keep = keep & (T.detect_bot(F.col("user_agent")) == bot)
    return entries.filter(keep)


def _bot() -> Column:
    return T.detect_bot(F.col("user_agent"))


def totals(entries: DataFrame) -> DataFrame:
    """One row: requests, bot requests and distinct URLs; zeros for an empty log."""
    return entries.agg(F.count("*").alias("total_requests"), F.count(_bot()).alias("bot_requests"), F.count_distinct("url").alias("unique_urls"))


def by_status(entries: DataFrame) -> DataFrame:
    return entries.groupBy("status_code").agg(F.count("*").alias("hits"))


def by_bot(entries: DataFrame) -> DataFrame:
    return entries.withColumn("bot", _bot()).filter("bot is not null").groupBy("bot").agg(F.count("*").alias("hits"))


def per_url(entries: DataFrame) -> DataFrame:
    """url, hits, bot_hits, wasted (bot hits with a status outside 200-299) and the first such status by line."""
    waste = _bot().isNotNull() & ~F.col("status_code").between(200, 299)
    return entries.groupBy("url").agg(F.count("*").alias("hits"), F.count(_bot()).alias("bot_hits"), F.count_if(waste).alias("wasted"), F.min_by("status_code", F.when(waste, F.col("line_no"))).alias("first_status"))


def top_urls(entries: DataFrame, k: int = 20) -> DataFrame:
    return per_url(entries).orderBy(F.desc("hits"), "url").limit(k).select("url", "hits", "bot_hits")


def wasted_urls(entries: DataFrame, k: int = 20) -> DataFrame:
    return per_url(entries).filter("wasted > 0").orderBy(F.desc("wasted"), "url").limit(k).select("url", F.col("wasted").alias("hits"), F.col("first_status").alias("status_code"))


def orphan_urls(entries: DataFrame, least: int = 3) -> DataFrame:
    return per_url(entries).filter(F.col("wasted") >= least).select("url", F.col("wasted").alias("hits"))


def summary(entries: DataFrame, k: int = 20, least: int = 3) -> DataFrame:
    """The whole summary of a log as rows (section, rank, key, hits, status_code), for any writer.

    Sections: total (requests, bot_requests, unique_urls: zeros for an empty log), status, bot, top_url (rank 1 to k),
    waste (rank 1 to k, with the first failing status by line) and orphan. Entries are read once: counts by URL, status and
    bot are written, and all sections come from these.
    """
    entries = entries.withColumn("bot", _bot())
    cells = materialise(entries.groupBy("url", "status_code", "bot").agg(F.count("*").alias("n"), F.min("line_no").alias("line_no")), "log_cells")
    hits, none = F.sum("n"), F.lit(None).cast("int")
    bots = F.sum(F.when(F.col("bot").isNotNull(), F.col("n")))
    waste = F.col("bot").isNotNull() & ~F.col("status_code").between(200, 299)
    urls = cells.groupBy("url").agg(hits.alias("hits"), F.sum(F.when(waste, F.col("n"))).alias("wasted"), F.min_by("status_code", F.when(waste, F.col("line_no"))).alias("first_status"))
    row = lambda section, key, n, rank=none, status=none: (F.lit(section).alias("section"), rank.cast("int").alias("rank"), key.cast("string").alias("key"), n.cast("long").alias("hits"), status.cast("int").alias("status_code"))

    def ranked(section: str, df: DataFrame, column: str, status: Column = none) -> DataFrame:
        rank = F.row_number().over(Window.orderBy(F.desc(column), "url"))  # over k rows
        return df.orderBy(F.desc(column), "url").limit(k).select(*row(section, F.col("url"), F.col(column), rank, status))

    totals_ = cells.agg(F.coalesce(hits, F.lit(0)).alias("requests"), F.coalesce(bots, F.lit(0)).alias("bot_requests"), F.count_distinct("url").alias("unique_urls"))
    failing = urls.filter("wasted > 0")
    parts = [
        totals_.unpivot([], ["requests", "bot_requests", "unique_urls"], "name", "n").select(*row("total", F.col("name"), F.col("n"))),
        cells.groupBy("status_code").agg(hits.alias("n")).select(*row("status", F.col("status_code"), F.col("n"))),
        cells.filter("bot IS NOT NULL").groupBy("bot").agg(hits.alias("n")).select(*row("bot", F.col("bot"), F.col("n"))),
        ranked("top_url", urls, "hits"),
        ranked("waste", failing, "wasted", F.col("first_status")),
        failing.filter(F.col("wasted") >= least).select(*row("orphan", F.col("url"), F.col("wasted"))),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def by_hour(entries: DataFrame, watermark: str | None = None) -> DataFrame:
    """Requests and bot requests of each hour; with a watermark the same works on a stream with bounded state."""
    rows = entries.withWatermark("ts", watermark) if watermark else entries
    return rows.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("hits"), F.count(_bot()).alias("bot_hits")).select(F.col("w.start").alias("hour"), "hits", "bot_hits")


def unique_sketches(entries: DataFrame, precision: int = 14) -> DataFrame:
    """hour, requests, urls, visitors: a row per hour whose sketches of distinct URLs and addresses can be merged."""
    return entries.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("requests"), F.hll_sketch_agg("url", precision).alias("urls"), F.hll_sketch_agg("ip", precision).alias("visitors"))


def merged_uniques(sketches: DataFrame, period: str = "day") -> DataFrame:
    """period, requests, unique_urls, unique_visitors over any longer period, from the stored hours alone."""
    return sketches.groupBy(F.date_trunc(period, "hour").alias("period")).agg(F.sum("requests").alias("requests"), F.hll_sketch_estimate(F.hll_union_agg("urls")).alias("unique_urls"), F.hll_sketch_estimate(F.hll_union_agg("visitors")).alias("unique_visitors"))
