"""Audit rules: issues of pages, links, images and structured data.

A rule is a condition over a row. All rules of a table become one array of structs, filtered and exploded, so that the
table is read once however many rules there are. Duplicates are window counts, references are joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitequarry.functions import text as T
from sitequarry.functions import urls as U

ISSUE = ["url_id", "url", "category", "type", "priority", "value"]


@dataclass(frozen=True)
class Rule:
    """An issue type with its category, priority, condition, and the value that it reports (null: none)."""

    category: str
    type: str
    priority: str | Column
    when: Column
    value: Column | None = None


def apply_rules(rows: DataFrame, rules: list[Rule], url_id: str = "id", url: str = "address") -> DataFrame:
    made = [
        F.when(r.when, F.struct(F.lit(r.category).alias("category"), F.lit(r.type).alias("type"), (F.lit(r.priority) if isinstance(r.priority, str) else r.priority).alias("priority"), (F.lit(None) if r.value is None else r.value).cast("string").alias("value")))
        for r in rules
    ]
    return rows.select(F.col(url_id).alias("url_id"), F.col(url).alias("url"), F.inline(F.array_compact(F.array(*made))))


def _blank(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | (c == "")


def response_rules() -> list[Rule]:
    s = F.col("status_code")
    return [
        Rule("response-codes", "broken_internal_page", F.when(s >= 500, "critical").otherwise("high"), s >= 400, s),
        Rule("response-codes", "no_response", "critical", s == 0),
    ]


def title_rules(title: str = "title1", second: str | None = None) -> list[Rule]:
    t, has = F.col(title), ~_blank(title)
    width = T.pixel_width(t)
    rules = [
        Rule("page-titles", "missing_title", "high", ~has),
        Rule("page-titles", "title_too_long", "medium", has & (F.length(t) > 60), F.length(t)),
        Rule("page-titles", "title_too_short", "medium", has & (F.length(t) < 30), F.length(t)),
        Rule("page-titles", "title_truncated", "medium", has & (width > T.TITLE_PIXELS), width),
    ]
    return rules + ([Rule("page-titles", "multiple_titles", "high", has & ~_blank(second))] if second else [])


def meta_rules(meta: str = "meta_description1", second: str | None = None) -> list[Rule]:
    m, has = F.col(meta), ~_blank(meta)
    width = T.pixel_width(m, "description")
    rules = [
        Rule("meta-description", "missing_meta_description", "high", ~has),
        Rule("meta-description", "meta_description_too_long", "medium", has & (F.length(m) > 155), F.length(m)),
        Rule("meta-description", "meta_description_too_short", "medium", has & (F.length(m) < 70), F.length(m)),
        Rule("meta-description", "meta_description_truncated", "medium", has & (width > T.DESCRIPTION_PIXELS), width),
    ]
    return rules + ([Rule("meta-description", "multiple_meta_descriptions", "high", has & ~_blank(second))] if second else [])


def heading_rules() -> list[Rule]:
    h1, n1, n2 = F.col("h1"), F.coalesce("h1_count", F.lit(0)), F.coalesce("h2_count", F.lit(0))
    same = F.lower(F.trim(h1)) == F.lower(F.trim("title1"))
    return [
        Rule("headings", "missing_h1", "high", n1 == 0),
        Rule("headings", "multiple_h1", "medium", n1 > 1, n1),
        Rule("headings", "h1_too_long", "medium", F.length(h1) > 70, F.length(h1)),
        Rule("headings", "h1_same_as_title", "low", ~_blank("h1") & ~_blank("title1") & same),
        Rule("headings", "non_sequential_headings", "medium", (n1 == 0) & (n2 > 0)),
    ]


def url_rules(address: str = "address") -> list[Rule]:
    u = F.col(address)
    return [
        Rule("url", "non_ascii_url", "medium", U.has_non_ascii(u)),
        Rule("url", "url_contains_underscore", "low", U.has_underscore(u)),
        Rule("url", "url_contains_uppercase", "low", U.has_uppercase(u)),
        Rule("url", "url_multiple_slashes", "medium", U.has_multiple_slashes(u)),
        Rule("url", "url_repetitive_path", "low", U.has_repetitive_path(u)),
        Rule("url", "url_contains_space", "medium", U.has_space(u)),
        Rule("url", "internal_search_url", "medium", U.has_search_parameter(u)),
        Rule("url", "url_has_parameters", "low", U.has_parameters(u)),
        Rule("url", "url_too_long", "medium", U.is_over_length(u), F.length(u)),
    ]


def content_rules() -> list[Rule]:
    """Null counts as 0: pages without a word count or ratio are thin."""
    words, ratio = F.coalesce("word_count", F.lit(0)), F.coalesce("text_ratio", F.lit(0.0))
    return [
        Rule("content", "thin_content", "medium", words < 300, F.col("word_count")),
        Rule("content", "low_text_ratio", "low", ratio < 5, F.col("text_ratio")),
        Rule("content", "missing_h2", "low", F.coalesce("h2_count", F.lit(0)) == 0),
    ]


def redirect_rules() -> list[Rule]:
    """For rows with redirect_chain, an array of URLs."""
    chain = F.coalesce("redirect_chain", F.array().cast("array<string>"))
    return [
        Rule("redirects", "redirect_chain", "medium", F.size(chain) > 1, F.size(chain)),
        Rule("redirects", "redirect_loop", "critical", F.size(chain) != F.size(F.array_distinct(chain))),
        Rule("redirects", "temporary_redirect", "medium", F.col("status_code").isin(302, 307), F.col("status_code")),
    ]


#: Response headers that every page should send, and the issues of their absence.
HEADERS = {"strict-transport-security": "missing_hsts", "content-security-policy": "missing_csp", "x-content-type-options": "missing_x_content_type_options", "x-frame-options": "missing_x_frame_options", "referrer-policy": "missing_referrer_policy"}


def security_rules() -> list[Rule]:
    """For rows with header_names (array), content_type and mixed_content."""
    names = F.transform(F.coalesce("header_names", F.array().cast("array<string>")), F.lower)
    kind, html = F.col("content_type"), U.is_html_path(U.path(F.col("address")))
    return [
        Rule("security", "insecure_http", "high", U.is_http(F.col("address"))),
        Rule("security", "mixed_content", "high", F.coalesce("mixed_content", F.lit(False))),
        *[Rule("security", kind_, "medium", ~F.array_contains(names, name)) for name, kind_ in HEADERS.items()],
        Rule("security", "missing_content_type", "medium", kind.isNull() & html),
        Rule("security", "bad_content_type", "medium", ~F.lower(kind).contains("text/html") & html),
    ]


def language_rules() -> list[Rule]:
    return [Rule("accessibility", "missing_lang_attribute", "medium", _blank(F.trim("lang")))]


def structured_rules(errors: str = "errors", warnings: str = "warnings", eligible: str = "eligible") -> list[Rule]:
    bad, warned = ~_blank(errors), ~_blank(warnings)
    return [
        Rule("structured-data", "structured_data_error", "high", bad, F.substring(errors, 1, 200)),
        Rule("structured-data", "structured_data_warning", "medium", warned, F.col(warnings)),
        Rule("structured-data", "not_rich_result_eligible", "low", ~F.coalesce(eligible, F.lit(False)) & ~bad & ~warned),
    ]


def image_rules() -> list[Rule]:
    return [
        Rule("images", "missing_alt_text", "high", _blank(F.trim("alt"))),
        Rule("images", "oversized_image", "medium", F.col("size") > 102400, F.col("size")),
        Rule("images", "missing_image_dimensions", "low", F.col("width").isNull() | F.col("height").isNull()),
        Rule("images", "broken_image", "high", F.col("status_code") >= 400, F.col("status_code")),
    ]


def duplicates(urls: DataFrame, run: str, column: str, category: str, kind: str, priority: str = "medium", exact: bool = False) -> DataFrame:
    """Pages of a run that share a value: the value's count, attached to each of them.

    Counts are aggregated and joined, not windowed: one value may hold a third of all pages.
    """
    key = F.col(column) if exact else F.lower(F.trim(F.col(column)))
    rows = urls.filter(~_blank(column)).select("id", "address", F.col(run).alias("run"), key.alias("key"))
    counts = rows.groupBy("run", "key").agg(F.count("*").alias("pages")).filter("pages > 1")
    return rows.join(counts, ["run", "key"]).select(F.col("id").alias("url_id"), F.col("address").alias("url"), F.lit(category).alias("category"), F.lit(kind).alias("type"), F.lit(priority).alias("priority"), F.col("pages").cast("string").alias("value"))


def _issue(category: str, kind: str, priority: str, value: Column) -> list[Column]:
    return [F.lit(category).alias("category"), F.lit(kind).alias("type"), F.lit(priority).alias("priority"), value.cast("string").alias("value")]


def canonical_rules() -> list[Rule]:
    """Rules of one declared canonical (`target`, its normal form `resolved`) against what is known of it."""
    c, a, normal = F.col("target"), F.col("address"), F.coalesce("resolved", "target")
    return [
        Rule("canonicals", "canonical_to_non_200", "high", F.col("crawled") & ~F.col("target_status").eqNullSafe(200), F.col("target_status")),
        Rule("canonicals", "canonical_to_different_url", "medium", normal != F.coalesce(U.normalize(a), a), c),
        Rule("canonicals", "canonical_to_http", "high", U.is_https(a) & U.is_http(normal), c),
        Rule("canonicals", "canonical_to_different_domain", "high", U.host(normal) != U.host(a), U.host(normal)),
    ]


def canonical_issues(urls: DataFrame) -> DataFrame:
    """Canonical findings of pages with address, canonical and perhaps canonical_header.

    A page without either lacks one; each distinct one is held against the crawled pages in normal form, so a default port
    or the case of a host makes no difference. Of pages that share a normal form the one with the greatest id counts.
    """
    both = F.array("canonical", "canonical_header") if "canonical_header" in urls.columns else F.array("canonical")
    declared = F.array_distinct(F.filter(F.transform(both, lambda c: F.trim(c)), lambda c: ~_blank(c)))
    rows = urls.select("id", "address", declared.alias("declared"))
    normal = lambda c: F.coalesce(U.normalize(F.col(c)), F.col(c))
    statuses = urls.groupBy(normal("address").alias("resolved")).agg(F.max_by(F.struct("status_code"), "id")["status_code"].alias("target_status"), F.lit(True).alias("crawled"))
    links = rows.select("id", "address", F.explode("declared").alias("target")).withColumn("resolved", normal("target")).join(statuses, "resolved", "left")
    missing = apply_rules(rows, [Rule("canonicals", "missing_canonical", "medium", F.size("declared") == 0)])
    return missing.unionByName(apply_rules(links.withColumn("crawled", F.coalesce("crawled", F.lit(False))), canonical_rules()))


def next_rules() -> list[Rule]:
    """Rules of rel_next (`target`) against the page at it (`page`: status_code, rel_next, rel_prev; null if unknown)."""
    page, known, ok = F.col("page"), F.col("page").isNotNull(), F.col("page.status_code").eqNullSafe(200)
    return [
        Rule("pagination", "last_page_with_next", "medium", ~known, F.col("target")),
        Rule("pagination", "broken_pagination_next", "high", known & ~ok, page["status_code"]),
        Rule("pagination", "missing_reciprocal_prev", "medium", known & ok & ~page["rel_prev"].eqNullSafe(F.col("address")), F.col("target")),
    ]


def prev_rules() -> list[Rule]:
    """Rules of rel_prev, likewise."""
    page, known, ok = F.col("page"), F.col("page").isNotNull(), F.col("page.status_code").eqNullSafe(200)
    return [
        Rule("pagination", "broken_pagination_prev", "high", ~known | ~ok, F.col("target")),
        Rule("pagination", "missing_reciprocal_next", "medium", known & ok & ~page["rel_next"].eqNullSafe(F.col("address")), F.col("target")),
        Rule("pagination", "first_page_with_prev", "medium", U.is_first_page(F.col("address")), F.col("target")),
    ]


def pagination_issues(urls: DataFrame) -> DataFrame:
    """Findings of rel=next and rel=prev: both neighbours are joined by address."""
    page = urls.groupBy(F.col("address").alias("target")).agg(F.max_by(F.struct("status_code", "rel_next", "rel_prev"), "id").alias("page"))
    of = lambda c, rules: apply_rules(urls.filter(~_blank(c)).select("id", "address", F.col(c).alias("target")).join(page, "target", "left"), rules)
    return of("rel_next", next_rules()).unionByName(of("rel_prev", prev_rules()))


def hreflang_issues(alternates: DataFrame, urls: DataFrame) -> DataFrame:
    """Findings of alternate links (source_id, source, target, hreflang): targets, by address or else in normal form, and return links are joined."""
    pages = urls.groupBy(F.col("address").alias("target")).agg(F.max_by("status_code", "id").alias("target_status")).withColumn("crawled", F.lit(True))
    back = alternates.select(F.col("target").alias("source"), F.col("source").alias("target")).distinct().withColumn("returns", F.lit(True))
    normal = urls.groupBy(U.normalize(F.col("address")).alias("normal")).agg(F.max_by("status_code", "id").alias("normal_status")).filter("normal IS NOT NULL").withColumn("known", F.lit(True))
    rows = alternates.withColumn("normal", U.normalize(F.col("target"))).join(pages, "target", "left").join(normal, "normal", "left").join(back, ["source", "target"], "left")
    rows = rows.withColumns({"target_status": F.when(F.col("crawled"), F.col("target_status")).otherwise(F.col("normal_status")), "crawled": F.coalesce("crawled", "known")})
    tagged = ~_blank(F.trim("hreflang"))
    per_link = apply_rules(rows, [
        Rule("hreflang", "missing_hreflang", "high", ~tagged, F.col("target")),
        Rule("hreflang", "invalid_hreflang", "high", tagged & ~T.is_hreflang(F.col("hreflang")), F.col("hreflang")),
        Rule("hreflang", "hreflang_to_non_200", "high", tagged & F.col("crawled").isNotNull() & (F.col("target_status") != 200), F.col("target_status")),
        Rule("hreflang", "missing_hreflang_return_tag", "medium", tagged & F.col("crawled").isNotNull() & F.col("returns").isNull(), F.col("target")),
    ], "source_id", "source")
    several = alternates.filter(tagged).groupBy("source_id", "source", F.lower("hreflang").alias("lang")).agg(F.count("*").alias("n")).filter("n > 1")
    return per_link.unionByName(several.select(F.col("source_id").alias("url_id"), F.col("source").alias("url"), *_issue("hreflang", "inconsistent_hreflang", "medium", F.col("lang"))))


def link_rules() -> list[Rule]:
    return [
        Rule("links", "non_descriptive_anchor", "medium", T.is_empty_anchor(F.col("anchor")), F.col("anchor")),
        Rule("links", "nofollow_internal_link", "low", F.col("nofollow") & F.col("is_internal"), F.col("target_url")),
    ]


def link_issues(links: DataFrame, urls: DataFrame) -> DataFrame:
    """One finding per link of a known page: anchors that say nothing, and nofollow inside the site."""
    rows = links.join(urls.select("id", "address"), links["source_id"] == F.col("id"))
    return apply_rules(rows, link_rules())


def unsafe_link_issues(links: DataFrame) -> DataFrame:
    """External links that open a window without noopener or noreferrer, and forms of secure pages with plain targets."""
    external = F.col("link_type").isin("a") & ~F.col("is_internal") & (F.lower("target_attr") == "_blank") & (~F.col("noopener") | ~F.col("noreferrer"))
    form = (F.col("link_type") == "form") & U.is_https(F.col("source_url")) & U.is_http(F.col("target_url"))
    return apply_rules(links, [Rule("security", "unsafe_cross_origin_link", "high", external, F.col("target_url")), Rule("security", "insecure_form", "high", form, F.col("target_url"))], "source_id", "source_url")


def image_issues(images: DataFrame, urls: DataFrame) -> DataFrame:
    rows = images.join(urls.select(F.col("id").alias("source_id"), "address"), "source_id")
    return apply_rules(rows, image_rules(), "source_id")


def commerce_issues(urls: DataFrame, schema_types: DataFrame) -> DataFrame:
    """Shop findings. Nothing is reported for a site (run_host) without any product page.

    urls: id, address, html, run_host, indexable, canonical, rel_next, rel_prev; schema_types: source_id, schema_type.
    """
    a = F.col("address")
    types = schema_types.groupBy(F.col("source_id").alias("id")).agg(F.collect_set("schema_type").alias("types"))
    shops = urls.groupBy("run_host").agg(F.bool_or(U.is_product_page(a)).alias("shop")).filter("shop").select("run_host")
    rows = urls.join(shops, "run_host", "left_semi").join(types, "id", "left").withColumn("types", F.coalesce("types", F.array().cast("array<string>")))
    product, html = U.is_product_page(a), F.coalesce("html", F.lit(""))
    paged = a.rlike("(?i)[?&](page|p)=[0-9]+|/(page|p)/[0-9]+")
    return apply_rules(rows, [
        Rule("ecommerce", "missing_product_schema", "high", product & ~F.array_contains("types", "Product")),
        Rule("ecommerce", "missing_breadcrumb_schema", "medium", product & ~F.array_contains("types", "BreadcrumbList")),
        Rule("ecommerce", "product_missing_price", "high", product & ~html.rlike("price|Price|offers")),
        Rule("ecommerce", "product_missing_reviews", "low", product & ~html.rlike("(?i)review|rating")),
        Rule("ecommerce", "faceted_nav_indexable", "medium", U.has_facet_parameter(a) & F.col("indexable") & _blank("canonical")),
        Rule("ecommerce", "pagination_missing_rel", "low", paged & _blank("rel_next") & _blank("rel_prev")),
        Rule("ecommerce", "cart_checkout_indexable", "high", U.is_cart(a) & F.col("indexable")),
    ])


def local_issues(pages: DataFrame, schema_types: DataFrame) -> DataFrame:
    """Local-business findings of each site, attached to its home page (path /, else the first page).

    pages: id, address, run_host, html; schema_types: source_id, schema_type.
    """
    a, html = F.col("address"), F.coalesce("html", F.lit(""))
    # Schema types of local businesses, map and profile links.
    business = ["LocalBusiness", "Store", "Restaurant", "ProfessionalService"]
    map_embed, profile = "(?i)google[.]com/maps/embed|maps[.]google[.]com", "(?i)business[.]google[.]com|g[.]page|goo[.]gl/maps"
    typed = schema_types.filter(F.col("schema_type").isin(business)).select(F.col("source_id").alias("id")).distinct().withColumn("local", F.lit(True))
    text = T.stripped_html(html)
    facts = pages.join(typed, "id", "left").select("run_host", "id", "address", F.coalesce("local", F.lit(False)).alias("local"), T.phone(text).alias("phone"), T.zip_code(text).alias("zip"), F.lower(U.path(a)).contains("contact").alias("contact"), html.rlike(map_embed).alias("map"), html.rlike(profile).alias("profile"), (U.path(a) == "/").alias("home"))
    snapshot = (F.col("phone") != "") | (F.col("zip") != "")
    site = facts.groupBy("run_host").agg(
        F.min_by(F.struct("id", "address"), F.struct((~F.col("home")).alias("h"), F.col("id").alias("i"))).alias("at"), F.bool_or("local").alias("local"), F.count_if(snapshot).alias("snapshots"), F.count_distinct(F.when(snapshot, F.col("phone"))).alias("phones"), F.count_distinct(F.when(snapshot, F.col("zip"))).alias("zips"),
        F.bool_or("map").alias("map"), F.bool_or("profile").alias("profile"), F.min_by(F.struct("id", "address", "phone", "zip"), F.when(F.col("contact"), F.col("id"))).alias("c"), F.bool_or("contact").alias("has_contact"),
    )
    site = site.select("*", F.col("at.id").alias("id"), F.col("at.address").alias("address"))
    contact = F.col("has_contact")
    home = apply_rules(site, [
        Rule("local-seo", "missing_local_business_schema", "high", ~F.col("local")),
        Rule("local-seo", "inconsistent_nap_phone", "high", (F.col("snapshots") > 1) & (F.col("phones") > 1), F.col("phones")),
        Rule("local-seo", "inconsistent_nap_address", "high", (F.col("snapshots") > 1) & (F.col("zips") > 1), F.col("zips")),
        Rule("local-seo", "missing_nap", "high", F.col("snapshots") == 0),
        Rule("local-seo", "missing_contact_page", "medium", ~contact),
        Rule("local-seo", "missing_google_map_embed", "low", ~F.col("map")),
        Rule("local-seo", "missing_gbp_link", "low", ~F.col("profile")),
    ])
    of_contact = site.filter(contact).select(F.col("c.id").alias("id"), F.col("c.address").alias("address"), F.col("c.phone").alias("phone"), F.col("c.zip").alias("zip"))
    return home.unionByName(apply_rules(of_contact, [Rule("local-seo", "contact_page_missing_phone", "medium", F.col("phone") == ""), Rule("local-seo", "contact_page_missing_address", "medium", F.col("zip") == "")]))


def all_duplicates(urls: DataFrame) -> list[DataFrame]:
    return [
        duplicates(urls, "run_host", "title1", "page-titles", "duplicate_title"),
        duplicates(urls, "run_host", "meta_description1", "meta-description", "duplicate_meta_description"),
        duplicates(urls, "run_host", "h1", "headings", "duplicate_h1"),
        duplicates(urls, "run_host", "hash", "content", "exact_duplicate_content", "high", exact=True),
    ]


def audit_pages(urls: DataFrame, extra: list[Rule] | None = None) -> DataFrame:
    """All findings that need pages only: one pass of row rules, duplicates, canonicals and pagination."""
    rules = response_rules() + title_rules() + meta_rules() + heading_rules() + url_rules() + content_rules() + language_rules() + (extra or [])
    parts = [
        apply_rules(urls, rules),
        *all_duplicates(urls),
        canonical_issues(urls),
        pagination_issues(urls),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
