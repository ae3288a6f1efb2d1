"""Runs of an audit: comparison, health, counts, search, paging, robots rules, redirects and exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitequarry.functions import text as T
from sitequarry.operators.scratch import materialise

# Penalties of priorities, and the categories that have a score of their own.
PENALTIES = {"critical": 10.0, "high": 6.0, "medium": 3.0, "low": 1.0, "opportunity": 0.5}
CATEGORIES = "response-codes page-titles meta-descriptions headings content links images canonicals redirects structured-data security accessibility local-seo ecommerce urls hreflang pagination duplicates".split()


#: Fields that a comparison of runs reads.
COMPARED = "status_code status status_category indexability indexability_status title1 title_length meta_description1 description_length h1 h1_count h2_count canonical canonical_header meta_robots x_robots word_count content_length response_time is_secure mixed_content".split()


def counters(urls: DataFrame) -> DataFrame:
    """Of each site: pages found, errors, redirects, and pages read."""
    s = F.col("status_code")
    return urls.groupBy("run_host").agg(F.count("*").alias("found"), F.count_if((s >= 400) | (s == 0)).alias("errors"), F.count_if(s.between(300, 399)).alias("redirects"), F.count_if(s == 200).alias("crawled"))


def mapped(address: Column, mapping: list[tuple[str, str]]) -> Column:
    """The first mapping whose old text begins the address is applied once."""
    out = F.when(F.lit(False), address)
    for old, new in mapping:
        out = out.when(address.startswith(old), F.concat(F.lit(new), F.substring(address, len(old) + 1, 1 << 30)))
    return out.otherwise(address)


def diff_runs(a: DataFrame, b: DataFrame, fields: list[str] = COMPARED, mapping: list[tuple[str, str]] | None = None) -> DataFrame:
    """address, status (added, removed, changed, same), changes (field, old, new). Of repeated addresses the last id counts."""
    own = lambda df, address: df.groupBy(address.alias("address")).agg(F.max_by(F.struct(*fields), "id").alias("v"))
    x, y = own(a, mapped(F.col("address"), mapping or [])).withColumnRenamed("v", "x"), own(b, F.col("address")).withColumnRenamed("v", "y")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    changes = F.filter(F.array(*[F.struct(F.lit(f).alias("field"), text(F.col(f"x.{f}")).alias("old"), text(F.col(f"y.{f}")).alias("new")) for f in fields]), lambda c: c["old"] != c["new"])
    both = x.join(y, "address", "full")
    status = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(F.size("changes") > 0, "changed").otherwise("same")
    return both.withColumn("changes", changes).select("address", status.alias("status"), F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.col("changes")).alias("changes"))


def changed_fields(diff: DataFrame) -> DataFrame:
    return diff.filter("status = 'changed'").select("address", F.inline("changes"))


def penalty(priority: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0.0))
    for name, value in PENALTIES.items():
        out = out.when(priority == name, value)
    return out.otherwise(0.0)


def _score(total: Column, pages: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), T.half_up(100 - F.coalesce(total, F.lit(0.0)) / F.greatest(pages, F.lit(1)) * 10))).cast("long")


def health(urls: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: pages, issues, score from 0 to 100."""
    found = issues.agg(F.count("*").alias("issues"), F.sum(penalty(F.col("priority"))).alias("total"))
    return found.join(urls.agg(F.count("*").alias("pages"))).select("pages", "issues", _score(F.col("total"), F.col("pages")).alias("score"))


def health_by_category(urls: DataFrame, issues: DataFrame) -> DataFrame:
    """A score for each of the fixed categories; 100 where nothing was found under exactly that name."""
    spark = urls.sparkSession
    names = spark.createDataFrame([(c,) for c in CATEGORIES], "category string")
    found = issues.groupBy("category").agg(F.sum(penalty(F.col("priority"))).alias("total"), F.count("*").alias("issues"))
    rows = names.join(found, "category", "left").join(urls.agg(F.count("*").alias("pages")))
    return rows.select("category", F.coalesce("issues", F.lit(0)).alias("issues"), _score(F.col("total"), F.col("pages")).alias("score"))


def issue_counts(issues: DataFrame) -> DataFrame:
    """kind (priority or category), name, n: both groupings in one pass."""
    both = issues.groupingSets([[F.col("priority")], [F.col("category")]], "priority", "category").agg(F.count("*").alias("n"), F.grouping("priority").alias("g"))
    return both.select(F.when(F.col("g") == 0, "priority").otherwise("category").alias("kind"), F.when(F.col("g") == 0, F.col("priority")).otherwise(F.col("category")).alias("name"), "n")


def severity(priority: Column) -> Column:
    return F.array_position(F.array(*[F.lit(p) for p in PENALTIES]), priority)


def issue_groups(issues: DataFrame) -> DataFrame:
    """category, type, priority, n and the pages concerned."""
    return issues.groupBy("category", "type", "priority").agg(F.count("*").alias("n"), F.count_distinct("url_id").alias("pages"), F.min(severity(F.col("priority"))).alias("severity"))


def search_issues(issues: DataFrame, term: str) -> DataFrame:
    t, hit = term.lower(), F.lit(False)
    for c in ("url", "type", "category", "priority", "value"):
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(t)), F.lit(False))
    return issues.filter(hit)


def url_page(urls: DataFrame, by: str = "id", limit: int = 25, offset: int = 0, descending: bool = False) -> DataFrame:
    return urls.orderBy(F.desc(by) if descending else F.asc(by), "id").offset(offset).limit(limit)


def url_detail(urls: DataFrame, edges: DataFrame) -> DataFrame:
    """id, address, title1, direction (in, out), other: one row per neighbour of a page, one with nulls where there is none."""
    ways = [edges.select(F.col(a).alias("id"), F.lit(way).alias("direction"), F.col(b).alias("other")) for way, a, b in (("in", "target_id", "source_id"), ("out", "source_id", "target_id"))]
    return urls.select("id", "address", "title1").join(ways[0].unionByName(ways[1]).distinct(), "id", "left")


def robots_rules(texts: DataFrame) -> DataFrame:
    """host, line_no, agent, kind (allow, disallow), value of robots texts (host, text). Each line belongs to the last agent above it."""
    lines = texts.select("host", F.posexplode(F.split("text", "\\r?\\n")).alias("line_no", "line")).withColumn("line", F.trim(F.regexp_replace("line", "#.*$", "")))
    key, value = F.lower(F.trim(F.split_part("line", F.lit(":"), F.lit(1)))), F.trim(F.expr("substring(line, instr(line, ':') + 1)"))
    rows = lines.filter(F.col("line").contains(":")).select("host", "line_no", key.alias("kind"), value.alias("value"))
    w = Window.partitionBy("host").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("agent", F.last(F.when(F.col("kind") == "user-agent", F.lower("value")), ignorenulls=True).over(w)).filter(F.col("kind").isin("allow", "disallow") & F.col("agent").isNotNull())


def robots_allowed(urls: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """id, allowed: the last rule in file order whose agent is part of ours and whose value begins the path decides.

    A path is cut to the lengths that the values of its host have, and these prefixes meet equal values, so a host's rules
    are never held against a path one by one. An empty path or value matches as a prefix like any other; a null path meets
    no rule. Ids should be distinct.
    """
    ours = rules.filter((F.col("agent") == "*") | F.lit(agent.lower()).contains(F.col("agent")))
    decides = ours.groupBy("host", "value").agg(F.max_by(F.struct("line_no", (F.col("kind") == "allow").alias("allowed")), "line_no").alias("rule"))
    lengths = ours.groupBy("host").agg(F.collect_set(F.length("value")).alias("lengths"))
    rows = urls.select("id", F.col("run_host").alias("host"), "path").join(lengths, "host", "left")
    rows = rows.select("id", "host", F.explode_outer(F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))).alias("value"))
    return rows.join(decides, ["host", "value"], "left").groupBy("id").agg(F.coalesce(F.max("rule")["allowed"], F.lit(True)).alias("allowed"))


def redirect_closure(hops: DataFrame, most: int = 10) -> DataFrame:
    """src, final, hops, loop: chains of (src, dst) followed up to `most` hops; every hop is one join.

    The hops are written once, so that no round derives them anew, and a round takes only the chains that may go on.
    """
    hops = materialise(hops.select("src", "dst"), "hops")
    step = hops.select(F.col("src").alias("at"), F.col("dst").alias("next"))
    rows = hops.select("src", F.array("src", "dst").alias("chain"), (F.col("src") == F.col("dst")).alias("loop"), F.lit(True).alias("moved"))
    ended, still = [], F.col("moved") & F.coalesce(~F.col("loop"), F.lit(False))
    for _ in range(most - 1):
        joined = rows.filter(still).withColumn("at", F.element_at("chain", -1)).join(step, "at", "left")
        go = F.col("next").isNotNull()
        ended.append(rows.filter(~still))
        rows = materialise(joined.select("src", F.when(go, F.concat("chain", F.array("next"))).otherwise(F.col("chain")).alias("chain"), (go & F.array_contains("chain", F.col("next"))).alias("loop"), go.alias("moved")), "redirects")
        if rows.filter(still).isEmpty():
            break
    rows = reduce(DataFrame.unionByName, ended, rows)
    return rows.select("src", F.element_at("chain", -1).alias("final"), (F.size("chain") - 1).alias("hops"), "loop")


def escape_xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def listed(urls: DataFrame) -> DataFrame:
    """Pages with status 200; where the table says so, only those inside the site that may be indexed."""
    rows = urls.filter("status_code = 200")
    for flag in {"is_internal", "indexable"} & set(urls.columns):
        rows = rows.filter(F.col(flag))
    return rows


def last_modified(urls: DataFrame, default: str | None = None) -> Column:
    """The page's own date, or else the crawl's, the given one, or today."""
    own = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("last_modified", "crawled_at") if c in urls.columns]
    return F.coalesce(*own, F.lit(default), F.current_date().cast("string"))


def sitemap_rows(urls: DataFrame, images: DataFrame, dated: bool = False, lastmod: str | None = None) -> DataFrame:
    """id and one <url> element of each listed page, with its images in order, and its date if `dated`."""
    per_page = images.groupBy(F.col("source_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("image_id", "url"))).alias("images"))
    image = F.transform(F.coalesce("images", F.array().cast("array<struct<image_id:bigint,url:string>>")), lambda i: F.concat(F.lit("<image:image><image:loc>"), escape_xml(i["url"]), F.lit("</image:loc></image:image>")))
    date = F.concat(F.lit("<lastmod>"), escape_xml(last_modified(urls, lastmod)), F.lit("</lastmod>")) if dated else F.lit("")
    return listed(urls).join(per_page, "id", "left").select("id", F.concat(F.lit("<url><loc>"), escape_xml(F.col("address")), F.lit("</loc>"), date, F.array_join(image, ""), F.lit("</url>")).alias("xml"))


def llms_rows(urls: DataFrame) -> DataFrame:
    """id and one list line of each listed page."""
    title = F.coalesce(F.nullif(F.trim("title1"), F.lit("")), F.col("address"))
    about = F.when(F.coalesce(F.trim("meta_description1"), F.lit("")) != "", F.concat(F.lit(": "), F.trim("meta_description1"))).otherwise("")
    return listed(urls).select("id", F.concat(F.lit("- ["), title, F.lit("]("), "address", F.lit(")"), about).alias("line"))


def llms_listing(urls: DataFrame) -> DataFrame:
    """id, text: an entry of each listed page with title and description where it has them; the row without id is the head."""
    rows = listed(urls)
    field = lambda label, c: F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.concat(F.lit(f"\n  {label}: "), F.trim(c))).otherwise("")
    entries = rows.select(F.col("id").cast("long").alias("id"), F.concat(F.lit("- URL: "), "address", field("Title", "title1"), field("Description", "meta_description1")).alias("text"))
    head = rows.agg(F.count("*").alias("n")).select(F.lit(None).cast("long").alias("id"), F.concat(F.lit("# LLMs.txt - AI Search Visibility\n# Total pages: "), F.col("n").cast("string")).alias("text"))
    return head.unionByName(entries)


def export_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Chosen columns, or all by name; nested ones as JSON, null as empty text."""
    out = []
    for c in columns or sorted(df.columns):
        kind = df.schema[c].dataType.simpleString()
        out.append(F.coalesce((F.to_json(c) if kind.startswith(("array", "map", "struct")) else F.col(c).cast("string")), F.lit("")).alias(c))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, rows_per_file: int = 1_048_575) -> None:
    export_columns(df, columns).write.option("header", True).option("maxRecordsPerFile", rows_per_file).mode("overwrite").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
