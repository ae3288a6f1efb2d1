"""Request tables for text models, listing validation, and admission of new addresses. Nothing here calls a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitequarry.functions import urls as U


def substitute(template: str, columns: list[str]) -> Column:
    """{name} replaced by the row's column; unknown names stay as they are, nulls become empty."""
    out = F.lit(template)
    for c in columns:
        out = F.replace(out, F.lit("{" + c + "}"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return out


def truncated(c: Column, most: int) -> Column:
    """The first characters, trimmed, and three dots where text is left out; null is empty."""
    return F.when(F.length(c) > most, F.concat(F.btrim(F.substring(c, 1, most), F.lit(" \t\r\n")), F.lit("..."))).otherwise(F.coalesce(c, F.lit("")))


#: What is asked, the facts given with it, and how much of the page's text.
REVIEWS = {
    "title": ("Propose a better title of at most 60 characters and say why.", ["url", "title", "h1"], 2000),
    "description": ("Propose a better description of 120 to 158 characters and say why.", ["url", "title", "description"], 2000),
    "content": ("Rate the text from 1 to 10 for the keyword and name 3 to 5 improvements.", ["url", "keyword"], 3000),
    "issue": ("Say step by step how to mend this finding and which files to look at.", ["url", "type", "details"], 0),
}


def review_requests(rows: DataFrame, kind: str) -> DataFrame:
    """kind, id, request: one request per row, of its facts (blank ones are '(none)') and the beginning of its `content`."""
    task, facts, most = REVIEWS[kind]
    shown = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("(none)"))
    lines = [F.concat(F.lit(f"{c}: "), shown(c)) for c in facts]
    if most:
        lines.append(F.concat(F.lit("text: "), truncated(F.col("content"), most)))
    return rows.select(F.lit(kind).alias("kind"), "id", F.concat_ws("\n", *lines, F.lit(task)).alias("request"))


def prompt_requests(urls: DataFrame, prompts: DataFrame, issues: DataFrame, columns: list[str]) -> DataFrame:
    """prompt, id, request: each prompt (name, template, issue_type) for its pages: all, or those with that issue."""
    templates = [(r["name"], r["template"], r["issue_type"]) for r in prompts.orderBy("name").collect()]  # written by hand, a handful
    out = None
    for name, template, issue in templates:
        pages = urls if issue is None else urls.join(issues.filter(F.col("type") == issue).select(F.col("url_id").alias("id")).distinct(), "id", "left_semi")
        part = pages.select(F.lit(name).alias("prompt"), "id", substitute(template, columns).alias("request"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else urls.select(F.lit("").alias("prompt"), "id", F.lit("").alias("request")).limit(0)


def issues_without_advice(issues: DataFrame, urls: DataFrame) -> DataFrame:
    """Findings whose advice is blank, with their page."""
    return issues.filter(F.trim(F.coalesce("advice", F.lit(""))) == "").join(urls.withColumnRenamed("id", "url_id"), "url_id")


def validate_listing(lines: DataFrame) -> DataFrame:
    """doc, line_no, error of listing texts (doc, line_no, line); line_no 0 is about the whole text.

    A text needs a header line (#) and an entry (- URL: address); addresses are absolute; lines of an entry up to the next
    blank one are its title or description. A text without a line has no rows.
    """
    line = F.trim(F.coalesce("line", F.lit("")))
    entry, head = F.startswith(line, F.lit("- URL:")), F.startswith(line, F.lit("#"))
    w = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    state = F.last(F.when(line == "", False).when(entry, True), ignorenulls=True).over(w)
    rows = lines.select("doc", "line_no", line.alias("line"), entry.alias("entry"), head.alias("head"), F.coalesce(state, F.lit(False)).alias("inside"))
    known = F.startswith("line", F.lit("Title:")) | F.startswith("line", F.lit("Description:"))
    error = F.when(F.col("entry") & ~U.is_seed(F.trim(F.substring("line", 7, 1 << 30))), "bad address").when(F.col("inside") & ~F.col("entry") & ~F.col("head") & ~known & (F.col("line") != ""), "stray line")
    bad = rows.select("doc", "line_no", error.alias("error")).filter("error IS NOT NULL")
    totals = rows.groupBy("doc").agg(F.bool_or("head").alias("header"), F.bool_or("entry").alias("entries"))
    whole = totals.select("doc", F.lit(0).alias("line_no"), F.explode(F.array_compact(F.array(F.when(~F.col("header"), "no header"), F.when(~F.col("entries"), "no addresses")))).alias("error"))
    return bad.unionByName(whole)


def admit(found: DataFrame, seen: DataFrame, most_depth: int | None = None, include: list[str] | None = None, exclude: list[str] | None = None, search_pages: bool = True) -> DataFrame:
    """Addresses (url, depth) that a crawl would take next: normalised, new, within depth and patterns."""
    rows = found.withColumn("url", U.normalize(F.col("url"))).filter(U.is_seed(F.col("url")))
    if most_depth is not None:
        rows = rows.filter(F.col("depth") <= most_depth)
    if include:
        rows = rows.filter(U.matches_any(F.col("url"), include))
    if exclude:
        rows = rows.filter(~U.matches_any(F.col("url"), exclude))
    if not search_pages:
        rows = rows.filter(~U.has_search_parameter(F.col("url")))
    return rows.groupBy("url").agg(F.min("depth").alias("depth")).join(seen.select("url"), "url", "left_anti")
