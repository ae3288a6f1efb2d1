"""Reads of audit tables: look-ups, findings, links both ways, first rows of groups, searches, fetch results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitequarry.functions import urls as U

# Texts of status codes, and marks of errors with the class that each tells, the first that is found.
STATUS_TEXTS = {200: "OK", 201: "Created", 204: "No Content", 301: "Moved Permanently", 302: "Found", 303: "See Other", 304: "Not Modified", 307: "Temporary Redirect", 308: "Permanent Redirect", 400: "Bad Request", 401: "Unauthorized", 403: "Forbidden", 404: "Not Found", 410: "Gone", 429: "Too Many Requests", 500: "Internal Server Error", 502: "Bad Gateway", 503: "Service Unavailable", 504: "Gateway Timeout"}
ERROR_MARKS = [("timeout", "timeout"), ("ECONNREFUSED", "refused"), ("Connection refused", "refused"), ("ENOTFOUND", "dns"), ("DNS", "dns"), ("EINVAL", "malformed"), ("Invalid URL", "malformed")]
#: Kinds of links that a crawl follows.
FOLLOWED = ("a", "link", "iframe")


def by_address(urls: DataFrame, wanted: DataFrame) -> DataFrame:
    """Pages at the wanted addresses (column url), compared in normal form."""
    keys = wanted.select(U.normalize(F.col("url")).alias("normal")).distinct()
    return urls.withColumn("normal", U.normalize(F.col("address"))).join(keys, "normal", "left_semi").drop("normal")


def issues(found: DataFrame, kind: str | None = None, priority: str | None = None) -> DataFrame:
    """Findings by type and priority, in the order of priority, page and type."""
    if kind is not None:
        found = found.filter(F.col("type") == kind)
    if priority is not None:
        found = found.filter(F.col("priority") == priority)
    return found.orderBy("priority", "url_id", "type")


def images(all_images: DataFrame, page: int | None = None) -> DataFrame:
    """Images, or those of a page; `oversized` marks files over 100 KiB."""
    rows = all_images if page is None else all_images.filter(F.col("source_id") == page)
    return rows.withColumn("oversized", F.coalesce(F.col("size") > 102400, F.lit(False)))


def named_links(edges: DataFrame, urls: DataFrame) -> DataFrame:
    """source_id, source_url, target_id, target_url of links between known pages."""
    s, t = (urls.select(F.col("id").alias(f"{x}_id"), F.col("address").alias(f"{x}_url")) for x in ("source", "target"))
    return edges.select("source_id", "target_id").join(s, "source_id").join(t, "target_id")


def inlinks(links: DataFrame, target: str | None = None) -> DataFrame:
    """Links to an address (or all), ordered by target and source."""
    rows = links if target is None else links.filter(F.col("target_url") == target)
    return rows.orderBy("target_url", "source_url").select("target_url", "source_id", "source_url")


def outlinks(links: DataFrame, page: int | None = None) -> DataFrame:
    """Links of a page (or all), ordered by source and target."""
    rows = links if page is None else links.filter(F.col("source_id") == page)
    return rows.orderBy("source_id", "target_url").select("source_id", "target_url")


def crawlable(links: DataFrame, html_only: bool = True) -> DataFrame:
    """Links inside the site that a crawl follows. links: link_type, is_internal, target_url."""
    rows = links.filter(F.col("link_type").isin(*FOLLOWED) & F.col("is_internal"))
    return rows.filter(U.is_html_url(F.col("target_url"))) if html_only else rows


def first_of_each(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group: tasks keep n rows of a group before the shuffle, so a hot group stays small."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def search(rows: DataFrame, term: str, columns: list[str]) -> DataFrame:
    """Rows that hold the term in one of the columns, whatever the case; an empty term finds all."""
    if not term:
        return rows
    hits = [F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(term.lower())), F.lit(False)) for c in columns]
    return rows.filter(reduce(lambda a, b: a | b, hits))


def status_text(code: Column) -> Column:
    out = F.when(F.lit(False), "")
    for number, text in STATUS_TEXTS.items():
        out = out.when(code == number, text)
    return out.otherwise("Unknown")


def status_category(code: Column) -> Column:
    ranges = [(200, "success"), (300, "redirect"), (400, "client-error"), (500, "server-error")]
    return reduce(lambda out, r: out.when((code >= r[0]) & (code < r[0] + 100), r[1]), ranges, F.when(F.lit(False), "")).otherwise("no-response")


def error_class(message: Column) -> Column:
    return reduce(lambda out, m: out.when(F.contains(message, F.lit(m[0])), m[1]), ERROR_MARKS, F.when(F.lit(False), "")).otherwise("error")


def fetch_rows(fetched: DataFrame) -> DataFrame:
    """Fetch results (status_code, error) with status text and category; a failed fetch has code 0 and the class of its error."""
    kind = F.when(F.col("error").isNotNull(), error_class(F.col("error")))
    late = kind == "timeout"
    code = F.when(kind.isNotNull(), 0).otherwise(F.col("status_code"))
    text = F.when(late, "No Response").when(kind.isNotNull(), "Error").otherwise(status_text(F.col("status_code")))
    category = F.when(late, "no-response").when(kind.isNotNull(), "client-error").otherwise(status_category(F.col("status_code")))
    return fetched.withColumns({"error_type": kind, "status": text, "status_category": category, "status_code": code})


def frontier(depths: DataFrame, urls: DataFrame) -> DataFrame:
    """One row: addresses seen by the crawl, of these crawled (status over 0), and queued."""
    known = depths.select("id").join(urls.select("id", "status_code"), "id", "left")
    done = F.coalesce(F.col("status_code") > 0, F.lit(False))
    return known.agg(F.count("*").alias("seen"), F.count_if(done).alias("crawled"), F.count_if(~done).alias("queued"))
