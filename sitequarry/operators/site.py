"""The audit of whole sites from raw pages: extraction, indexability, and the findings of every rule family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitequarry.functions import urls as U
from sitequarry.operators import extract, rules
from sitequarry.operators.scratch import materialise

# Names of statuses that keep a page out of an index, the others go by range.
STATUS_NAMES = {404: "404 Page Not Found", 410: "410 Gone", 403: "403 Forbidden", 500: "500 Server Error", 503: "503 Service Unavailable", 429: "429 Too Many Requests", 0: "No Response"}


def _forbids(robots: Column) -> Column:
    words = F.transform(F.split(F.lower(F.coalesce(robots, F.lit(""))), ","), lambda w: F.trim(w))
    return F.arrays_overlap(words, F.array(F.lit("noindex"), F.lit("none")))


def header(name: str, headers: str = "headers") -> Column:
    """A header of a map, whatever the case of its name."""
    held = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name.lower())
    return F.get(held, F.lit(0))["value"]


def header_link(rel: str, link: Column) -> Column:
    """The first address of a Link header that has this rel."""
    parts = F.transform(F.split(link, ","), lambda p: F.struct(F.regexp_extract(p, '<([^>]+)>;\\s*rel="([^"]+)"', 1).alias("url"), F.regexp_extract(p, '<([^>]+)>;\\s*rel="([^"]+)"', 2).alias("rel")))
    return F.get(F.filter(parts, lambda p: p["rel"] == rel), F.lit(0))["url"]


def indexability_status(status: Column, robots: Column, x_robots: Column, canonical: Column, canonical_header: Column, address: Column) -> Column:
    """Why a page stays out of an index; null for pages that may be indexed. Every status over 399 without a name of its own counts as the client's."""
    out = F.when(status.isNull(), "No Response")
    for code, name in STATUS_NAMES.items():
        out = out.when(status == code, name)
    out = out.when(status >= 400, "Client Error").when(status.between(300, 399), "Redirected").when(status != 200, "Non-200 Status")
    out = out.when(_forbids(robots), "Blocked by Meta Robots").when(_forbids(x_robots), "Blocked by X-Robots-Tag")
    other = lambda c: F.coalesce(c, F.lit("")).isin("") | (c == address)
    return out.when(~other(canonical), F.concat(F.lit("Canonicalised to "), canonical)).when(~other(canonical_header), F.concat(F.lit("Canonicalised (HTTP Header) to "), canonical_header))


def site_urls(facts: DataFrame) -> DataFrame:
    """The page table of extracted facts that carry status_code, headers (map) and redirect_chain: headers, indexability, sites.

    Facts of the page itself hold for status 200 only; others keep their address and status.
    """
    own = extract.url_facts(facts)
    ok = F.col("status_code").eqNullSafe(200)
    keep = {"id", "url", "status_code", "headers", "redirect_chain"}
    rows = own.select("id", F.split_part("url", F.lit("#"), F.lit(1)).alias("address"), *[F.when(ok, F.col(c)).alias(c) for c in own.columns if c not in keep], "status_code", "headers", "redirect_chain")
    rows = rows.withColumn("run_host", U.host(F.col("address"))).withColumn("x_robots", header("x-robots-tag")).withColumn("canonical_header", F.when(ok, header_link("canonical", header("link"))))
    why = indexability_status(F.col("status_code"), F.col("robots"), F.col("x_robots"), F.col("canonical"), F.col("canonical_header"), F.col("address"))
    return rows.withColumn("indexability_status", why).withColumn("indexable", F.col("indexability_status").isNull())


def _page(url: Column) -> Column:
    return F.split_part(url, F.lit("#"), F.lit(1))


def index_rules() -> list[rules.Rule]:
    both = ~rules._blank("canonical") & ~rules._blank("canonical_header")
    chain = F.coalesce("redirect_chain", F.array().cast("array<string>"))
    return [
        rules.Rule("response-codes", "non_indexable", "medium", ~F.col("indexable"), F.col("indexability_status")),
        rules.Rule("canonicals", "multiple_canonicals", "high", both & (F.col("canonical") != F.col("canonical_header")), F.col("canonical_header")),
        rules.Rule("canonicals", "canonical_chain_loop", "critical", ~rules._blank("canonical") & (F.col("canonical") != F.col("address")) & F.array_contains(chain, F.col("canonical")), F.col("canonical")),
    ]


def label_issues(facts: DataFrame) -> DataFrame:
    """One finding per form control that nothing names."""
    controls = extract.unlabelled_controls(facts)
    return rules.apply_rules(controls, [rules.Rule("accessibility", "missing_form_label", "medium", F.lit(True), F.col("tag"))], "id", "url")


def audit_site(pages: DataFrame, bare_references: bool = True) -> DataFrame:
    """All findings on raw pages: page_id, url, html, status_code, headers map<string,string>, redirect_chain array<string>.

    Pages are parsed once and their facts written; every family reads those. Null html gives no facts; an empty table
    gives no findings. bare_references is extract_pages' own.
    """
    facts = materialise(extract.extract_pages(pages, bare_references), "page_facts")
    urls = materialise(site_urls(facts), "site_urls")
    ok = facts.filter("status_code = 200")
    links = materialise(extract.link_facts(ok), "site_links")
    images = extract.image_facts(ok).withColumn("size", F.lit(None).cast("long")).withColumn("status_code", F.lit(None).cast("int"))
    alternates = links.filter("link_type = 'link' AND lower(rel) = 'alternate'").select("source_id", F.col("source_url").alias("source"), F.col("target_url").alias("target"), "hreflang")
    blocks = extract.data_blocks(ok).withColumn("address", _page(F.col("source_url")))
    secured = urls.withColumn("header_names", F.map_keys("headers")).withColumn("content_type", F.trim(F.split_part(header("content-type"), F.lit(";"), F.lit(1))))
    row_rules = rules.response_rules() + rules.title_rules("title1", "title2") + rules.meta_rules("meta_description1", "meta_description2") + rules.heading_rules() + rules.url_rules() + rules.content_rules() + rules.language_rules() + rules.redirect_rules() + index_rules() + rules.security_rules()
    parts = [
        rules.apply_rules(secured, row_rules),
        *rules.all_duplicates(urls),
        rules.canonical_issues(urls),
        rules.pagination_issues(urls),
        rules.hreflang_issues(alternates, urls),
        rules.apply_rules(images.join(urls.select(F.col("id").alias("source_id"), "address").distinct(), "source_id"), rules.image_rules(), "source_id"),
        rules.apply_rules(links.filter("link_type = 'a'").withColumn("address", _page(F.col("source_url"))), rules.link_rules(), "source_id"),
        rules.unsafe_link_issues(links),
        rules.apply_rules(blocks, rules.structured_rules(), "source_id"),
        label_issues(ok),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
