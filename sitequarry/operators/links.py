"""Link graph: counts, profile, backlinks, crawl depth and page rank. Edges are (source_id, target_id) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitequarry.functions import text as T
from sitequarry.functions import urls as U
from sitequarry.operators.scratch import discard, materialise


def link_counts(urls: DataFrame, edges: DataFrame) -> DataFrame:
    """Inlinks and outlinks of every page, all and unique, and external outlinks; 0 where there are none."""
    external = F.col("source_host") != F.col("target_host")
    inside = edges.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("inlinks"), F.count_distinct("source_id").alias("unique_inlinks"))
    outside = edges.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("outlinks"), F.count_distinct("target_id").alias("unique_outlinks"), F.count_if(external).alias("external_outlinks"), F.count_distinct(F.when(external, F.col("target_id"))).alias("unique_external_outlinks"))
    rows = urls.select("id").join(inside, "id", "left").join(outside, "id", "left")
    return rows.select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("inlinks", "unique_inlinks", "outlinks", "unique_outlinks", "external_outlinks", "unique_external_outlinks")])


def rendered_links(raw: DataFrame, rendered: DataFrame) -> DataFrame:
    """source_id, target_url, link_type, location: links of pages as they came and after scripts ran.

    A link that only the rendered page has is `rendered`, one that only the raw page has is `raw`, others are `both`. Links
    that repeat on a page are one. Both sides: source_id, target_url, link_type.
    """
    key = ["source_id", "target_url", "link_type"]
    sides = raw.select(*key, F.lit(1).alias("side")).unionByName(rendered.select(*key, F.lit(2).alias("side")))
    seen = sides.groupBy(*key).agg(F.bit_or("side").alias("sides"))
    return seen.select(*key, F.when(F.col("sides") == 3, "both").when(F.col("sides") == 2, "rendered").otherwise("raw").alias("location"))


def script_link_counts(urls: DataFrame, located: DataFrame) -> DataFrame:
    """id, unique_js_inlinks, unique_js_outlinks, unique_external_js_outlinks of anchors that only rendered pages have.

    urls: id, address in normal form, run_host; links of other kinds don't count. The links that count are written, so that
    both sides of a link read them and no page is parsed for each.
    """
    js = materialise(located.filter("location = 'rendered' and link_type = 'a'").select("source_id", "target_url", U.host(F.col("target_url")).alias("host")), "script_links")
    out = js.join(urls.select(F.col("id").alias("source_id"), "run_host"), "source_id").groupBy(F.col("source_id").alias("id")).agg(F.count_distinct("target_url").alias("outlinks"), F.count_distinct(F.when(F.col("host") != F.col("run_host"), F.col("target_url"))).alias("external"))
    into = js.join(urls.select(F.col("id"), U.normalize(F.col("address")).alias("target_url")), "target_url").groupBy("id").agg(F.count_distinct("source_id").alias("inlinks"))
    rows = urls.select("id").join(into, "id", "left").join(out, "id", "left")
    return rows.select("id", *[F.coalesce(a, F.lit(0)).alias(b) for a, b in (("inlinks", "unique_js_inlinks"), ("outlinks", "unique_js_outlinks"), ("external", "unique_external_js_outlinks"))])


def percent_of_total(urls: DataFrame, edges: DataFrame) -> DataFrame:
    """Each page's share of the unique inlinks of its site, in percent; 0 for a site without links."""
    counts = edges.groupBy(F.col("target_id").alias("id")).agg(F.count_distinct("source_id").alias("unique_inlinks"))
    rows = urls.select("id", "run_host").join(counts, "id", "left").withColumn("unique_inlinks", F.coalesce("unique_inlinks", F.lit(0)))
    total = rows.groupBy("run_host").agg(F.sum("unique_inlinks").alias("total"))
    return rows.join(total, "run_host").select("id", F.when(F.col("total") > 0, F.round(100.0 * F.col("unique_inlinks") / F.col("total"), 4)).otherwise(0.0).alias("percent_of_total"))


def link_profile(links: DataFrame) -> DataFrame:
    """Internal, external and nofollow links of each site. links: source_host, is_internal, nofollow."""
    return links.groupBy(F.col("source_host").alias("run_host")).agg(F.count_if("is_internal").alias("internal_links"), F.count_if(~F.col("is_internal")).alias("external_links"), F.count_if("nofollow").alias("nofollow_links"))


def outgoing_domains(edges: DataFrame) -> DataFrame:
    """Hosts that each site links to, with counts."""
    return edges.filter("source_host <> target_host").groupBy("source_host", "target_host").agg(F.count("*").alias("links"))


def referring_pages(edges: DataFrame, urls: DataFrame) -> DataFrame:
    """Pages of other hosts that link to a page, and how many hosts refer to each target host."""
    rows = edges.filter("source_host <> target_host").join(urls.select(F.col("id").alias("source_id"), F.col("address").alias("source_url")), "source_id").join(urls.select(F.col("id").alias("target_id"), F.col("address").alias("target_url")), "target_id")
    return rows.select("target_host", "source_url", "target_url", "source_host").distinct()


def referring_domains(referring: DataFrame) -> DataFrame:
    """target_host, domains, pages: distinct hosts that refer to a host, and referring links between pages."""
    return referring.groupBy("target_host").agg(F.count_distinct("source_host").alias("domains"), F.count("*").alias("pages"))


def backlinks(edges: DataFrame, urls: DataFrame) -> DataFrame:
    """Links from other hosts, one per (source, target), with authority and toxicity of the source. edges: with nofollow."""
    rows = edges.filter("source_host <> target_host")
    first = rows.groupBy("source_id", "target_id").agg(F.min_by("nofollow", "pos").alias("nofollow"))
    named = first.join(urls.select(F.col("id").alias("source_id"), F.col("address").alias("source_url")), "source_id").join(urls.select(F.col("id").alias("target_id"), F.col("address").alias("target_url")), "target_id")
    return named.select("source_url", "target_url", "nofollow", T.authority(F.col("source_url"), F.col("nofollow")).alias("authority"), T.is_toxic_domain(F.col("source_url")).alias("toxic"))


def crawl_depth(edges: DataFrame, seeds: DataFrame, most: int = 10) -> DataFrame:
    """id, depth: least number of links from the seeds, up to `most`; one join per level, each level written.

    The links are written first: a level reads them, and doesn't derive them anew or plan what derives them.
    """
    seen = materialise(seeds.select("id", F.lit(0).alias("depth")).distinct(), "depth")
    front = seen
    steps = materialise(edges.select(F.col("source_id").alias("id"), "target_id").distinct(), "steps")
    for depth in range(1, most + 1):
        reached = front.join(steps, "id").select(F.col("target_id").alias("id")).distinct()
        front = materialise(reached.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)), "depth")
        if front.isEmpty():
            break
        seen = materialise(seen.unionByName(front), "depth")
    return seen


def page_rank(urls: DataFrame, edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """id, link_score: page rank over the links inside each site, scaled so that the site's best page has 100.

    Pages without links out give their rank to all pages of the site. Each round is written, the one before deleted.
    """
    pages = materialise(urls.select("id", F.col("run_host").alias("host")), "rank_pages")
    inner = edges.filter("source_host = target_host").select("source_id", "target_id").distinct()
    fan = inner.groupBy("source_id").agg(F.count("*").alias("fan"))
    inner = materialise(inner.join(fan, "source_id"), "rank_edges")
    sizes = pages.groupBy("host").agg(F.count("*").alias("n"))
    ranks = pages.join(sizes, "host").select("id", "host", (1.0 / F.col("n")).alias("rank"), "n")
    out = inner.select(F.col("source_id").alias("id"), F.lit(True).alias("links")).distinct()
    for i in range(rounds):
        given = inner.join(ranks.select(F.col("id").alias("source_id"), "rank"), "source_id").groupBy(F.col("target_id").alias("id")).agg(F.sum(F.col("rank") / F.col("fan")).alias("got"))
        stuck = ranks.join(out, "id", "left_anti").groupBy("host").agg(F.sum("rank").alias("stuck"))
        ranks = ranks.join(given, "id", "left").join(stuck, "host", "left").select("id", "host", ((1 - damping) / F.col("n") + damping * (F.coalesce("got", F.lit(0.0)) + F.coalesce("stuck", F.lit(0.0)) / F.col("n"))).alias("rank"), "n")
        new = materialise(ranks, "ranks")
        if i:
            discard(old)
        ranks = old = new
    best = ranks.groupBy("host").agg(F.max("rank").alias("best"))
    return ranks.join(best, "host").select("id", F.round(100 * F.col("rank") / F.col("best"), 4).alias("link_score"))


def dedup_links(links: DataFrame) -> DataFrame:
    """The first of links that agree in source, target, type, anchor and rel."""
    key = ["source_id", "target_url", "link_type", "anchor", "rel"]
    have = [c for c in key if c in links.columns]
    rest = [c for c in links.columns if c not in have]
    return links.groupBy(*have).agg(F.min_by(F.struct(*rest), "pos").alias("r")).select(*have, *[F.col(f"r.{c}").alias(c) for c in rest])


def anchor_links(pages: DataFrame) -> DataFrame:
    """Anchors by pattern alone: source_id, pos, href, anchor. For pages whose anchors are plain; others need link_facts."""
    pairs = F.arrays_zip(F.regexp_extract_all("html", F.lit('<a href="([^"]*)">[^<]*</a>'), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit('<a href="[^"]*">([^<]*)</a>'), F.lit(1)).alias("anchor"))
    return pages.select(F.col("page_id").alias("source_id"), F.posexplode(pairs).alias("pos", "a")).select("source_id", "pos", "a.href", "a.anchor")
