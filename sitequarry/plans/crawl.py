"""Registered queries on crawl budgets, addresses of links, links made by scripts, sitemap files, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitequarry.functions import urls as U
from sitequarry.operators import extract, frontier, links, sitemaps
from sitequarry.operators.scratch import folder
from sitequarry.plans.audit import query
from sitequarry.plans.tables import derived

#: Addresses that a run takes in these queries; the sites of the given tables are small.
BUDGET = 12

#: An href as a path, encoded once.
_ENCODED = "url_encode(h)"
for _c in "!$&'()*+,/:;=@":
    _ENCODED = f"replace({_ENCODED}, '%{ord(_c):02X}', '{_c.replace(chr(39), chr(39) * 2)}')"

_FOUND = f"""WITH a AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS run, lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) AS site, regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1) AS hrefs FROM pages),
f AS (SELECT run, page_id, unnest(range(len(hrefs))) AS pos, site || unnest(list_transform(hrefs, lambda h: {_ENCODED})) AS url FROM a),
s AS (SELECT DISTINCT run, site || list_transform(hrefs[1:1], lambda h: {_ENCODED})[1] AS url FROM a WHERE page_id % 5 = 0 AND len(hrefs) > 0),
n AS (SELECT run, url, min(struct_pack(p := page_id, q := pos)) AS first FROM f WHERE (run, url) NOT IN (SELECT (run, url) FROM s) GROUP BY 1, 2),
t AS (SELECT run, count(*) AS taken FROM s GROUP BY 1),
r AS (SELECT n.run, url, 1 AS depth, row_number() OVER (PARTITION BY n.run ORDER BY first, url) + coalesce(taken, 0) AS place FROM n LEFT JOIN t ON t.run = n.run) """


def _admitted(spark, sf):
    """Links of the given pages in order of page and position; a first link of every fifth page was seen before."""
    pages = derived(spark, sf, "pages")
    site = F.lower(F.regexp_extract("url", "^(https?://[^/?#]+)", 1))
    hosts = pages.select(F.col("page_id").alias("source_id"), F.lower(F.regexp_extract("url", "^https?://([^/?#]+)", 1)).alias("run"), site.alias("site"))
    found = links.anchor_links(pages).join(hosts, "source_id").select("run", "source_id", "pos", F.concat("site", "href").alias("url"), F.lit(1).alias("depth"))
    seen = found.filter("source_id % 5 = 0 and pos = 0").select("run", U.normalize(F.col("url")).alias("url"))
    return frontier.admitted(found, seen, BUDGET, ["source_id", "pos"])


@query(_FOUND + f"SELECT run, url, depth, place FROM r WHERE place <= {BUDGET}")
def admitted(spark, sf):
    return _admitted(spark, sf)


@query(_FOUND + f"SELECT run, count(*) AS added FROM r WHERE place <= {BUDGET} GROUP BY 1")
def newly_added(spark, sf):
    return frontier.added(_admitted(spark, sf))


def _levels(depth: int = 10) -> str:
    """The crawl level by level: seen so far, new pages by their first link, places counted on, cut at the budget."""
    parts = ["WITH s0 AS MATERIALIZED (SELECT run_host AS run, min(id) AS id, 0 AS depth, 1::BIGINT AS place FROM url_fx GROUP BY 1), f0 AS (SELECT * FROM s0)"]
    for i in range(1, depth + 1):
        parts.append(f"l{i} AS (SELECT f.run, e.target_id AS id, min(struct_pack(p := f.place, q := e.pos)) AS by_ FROM f{i - 1} f JOIN edge_fx e ON e.source_id = f.id AND e.source_host = e.target_host GROUP BY 1, 2)")
        parts.append(f"f{i} AS MATERIALIZED (SELECT run, id, {i} AS depth, place FROM (SELECT l.run, l.id, row_number() OVER (PARTITION BY l.run ORDER BY by_, l.id) + n AS place FROM l{i} l JOIN (SELECT run, count(*) AS n FROM s{i - 1} GROUP BY 1) n ON n.run = l.run WHERE NOT EXISTS (SELECT 1 FROM s{i - 1} s WHERE s.run = l.run AND s.id = l.id)) WHERE place <= {BUDGET})")
        parts.append(f"s{i} AS MATERIALIZED (SELECT * FROM s{i - 1} UNION ALL SELECT * FROM f{i})")
    return ", ".join(parts) + f" SELECT run, id, depth, place FROM s{depth}"


@query(_levels(), "url_fx", "edge_fx")
def bfs_budget(spark, sf):
    """Pages in the order in which a crawl of each site takes them, from its page of least id, within the budget."""
    seeds = derived(spark, sf, "url_fx").groupBy(F.col("run_host").alias("run")).agg(F.min("id").alias("id"))
    return frontier.crawl_order(derived(spark, sf, "edge_fx").filter("source_host = target_host"), seeds, BUDGET)


@query(f"SELECT page_id AS source_id, unnest(range(len(hrefs))) AS pos, site || unnest(list_transform(hrefs, lambda h: {_ENCODED})) AS url FROM (SELECT page_id, lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) AS site, regexp_extract_all(html, '<a href=\"([^\"]*)\">[^<]*</a>', 1) AS hrefs FROM pages)")
def normalized_links(spark, sf):
    """Every href of the given pages as a normalised address."""
    pages = derived(spark, sf, "pages")
    site = pages.select(F.col("page_id").alias("source_id"), F.lower(F.regexp_extract("url", "^(https?://[^/?#]+)", 1)).alias("site"))
    return links.anchor_links(pages).join(site, "source_id").select("source_id", "pos", U.normalize(F.concat("site", "href")).alias("url"))


def _located(spark, sf):
    """Links of the given pages, and of the same pages after a script put two links in and took the menu's first away."""
    pages = derived(spark, sf, "pages")
    more = F.concat(F.lit('<a href="https://scripts.example.com/'), F.col("page_id") % 7, F.lit('">x</a><a href="'), F.split_part("url", F.lit("#"), F.lit(1)), F.lit('">self</a></body>'))
    html = F.regexp_replace(F.replace("html", F.lit("</body>"), more), '(?s)^(.*?)<li><a href="[^"]*">[^<]*</a></li>', "$1")
    raw, rendered = (extract.link_facts(extract.extract_pages(p, facts=("base", "links"))) for p in (pages, pages.withColumn("html", html)))
    return links.rendered_links(raw, rendered)


@query("SELECT page_id AS id, count(*) FILTER (whole) OVER (PARTITION BY split_part(url, '#', 1)) AS unique_js_inlinks, 2 * whole::INTEGER AS unique_js_outlinks, whole::INTEGER AS unique_external_js_outlinks FROM (SELECT page_id, url, contains(html, '</body>') AS whole FROM pages)")
def script_links(spark, sf):
    urls = derived(spark, sf, "pages").select(F.col("page_id").alias("id"), F.split_part("url", F.lit("#"), F.lit(1)).alias("address"), U.host(F.col("url")).alias("run_host"))
    return links.script_link_counts(urls, _located(spark, sf))


@query("SELECT ((row_number() OVER (ORDER BY id) - 1) // 100 + 1)::INTEGER AS file, replace(address, '&', '&amp;') AS loc FROM url_fx WHERE status_code = 200", "url_fx")
def sitemap_files(spark, sf):
    """What files of 100 addresses list, written and read again."""
    place = folder(spark, "sitemaps")
    sitemaps.write_sitemaps(derived(spark, sf, "url_fx"), derived(spark, sf, "image_fx"), place, "https://a.test", per_file=100)
    return sitemaps.read_sitemaps(spark, place)
