"""Registered queries on stored runs, reads of audit tables, listings and external metrics, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitequarry.operators import links, prompts, runs, scans, store
from sitequarry.operators.scratch import folder
from sitequarry.plans import audit
from sitequarry.plans.audit import query
from sitequarry.plans.tables import derived
from sitequarry.sources import readers


def _over(name: str, sql: str) -> str:
    """SQL over the rows of another query, named q."""
    return sql.replace("{q}", f"({audit.ORACLES[name]}) q")


def _pages(spark, sf):
    return derived(spark, sf, "url_fx")


def _named(spark, sf):
    return scans.named_links(derived(spark, sf, "edge_fx"), _pages(spark, sf))


@query("SELECT id, address FROM run_a_fx WHERE status_category = 'client-error' AND address LIKE 'https:%'", "run_a_fx")
def url_scan(spark, sf):
    rows = derived(spark, sf, "run_a_fx").withColumn("is_internal", F.col("is_secure"))
    return readers.scan_urls(rows, status="client-error", internal=True).select("id", "address")


@query("SELECT id, address FROM url_fx WHERE address IN (SELECT address FROM run_b_fx)", "url_fx", "run_b_fx")
def url_lookup(spark, sf):
    wanted = derived(spark, sf, "run_b_fx").select(F.concat("address", F.lit("#part")).alias("url"))
    return scans.by_address(_pages(spark, sf), wanted).select("id", "address")


@query("SELECT id, address, word_count FROM url_fx ORDER BY word_count DESC, id LIMIT 25 OFFSET 50", "url_fx")
def url_grid(spark, sf):
    return runs.url_page(_pages(spark, sf), "word_count", 25, 50, descending=True).select("id", "address", "word_count")


_FIELDS = ["address", "title1", "meta_description1", "h1", "status_code"]


@query("SELECT id, address FROM url_fx WHERE " + " OR ".join(f"contains(lower({c}::VARCHAR), '404')" for c in _FIELDS), "url_fx")
def url_search(spark, sf):
    return scans.search(_pages(spark, sf), "404", _FIELDS).select("id", "address")


@query(_over("keywords_per_url", "SELECT id, keyword, count, rank FROM {q} WHERE contains(keyword, 'an')"))
def keyword_search(spark, sf):
    return scans.search(audit.keywords_per_url(spark, sf), "AN", ["keyword"])


@query(_over("audit_issues", "SELECT url_id, type, priority FROM {q} WHERE priority = 'high' AND type = 'missing_title' UNION ALL SELECT url_id, type, priority FROM {q} WHERE priority = 'critical'"))
def issue_scan(spark, sf):
    found = audit.audit_issues(spark, sf)
    return scans.issues(found, "missing_title", "high").unionByName(scans.issues(found, priority="critical")).select("url_id", "type", "priority")


@query(_over("audit_issues", "SELECT category, type, url_id, coalesce(value, '') AS value FROM {q} QUALIFY row_number() OVER (PARTITION BY category, type ORDER BY url_id, coalesce(value, '')) <= 50"))
def issues_first(spark, sf):
    found = audit.audit_issues(spark, sf).select("category", "type", "url_id", F.coalesce("value", F.lit("")).alias("value"))
    return scans.first_of_each(found, ["category", "type"], ["url_id", "value"], 50).drop("place")


@query(_over("issue_counts", "SELECT name, n FROM {q} WHERE kind = 'category' ORDER BY n DESC, name LIMIT 8"))
def categories_top(spark, sf):
    return audit.issue_counts(spark, sf).filter("kind = 'category' AND n > 0").select("name", "n").orderBy(F.desc("n"), "name").limit(8)


@query(_over("health_by_category", "SELECT category, score FROM {q} WHERE score > 0"))
def health_breakdown(spark, sf):
    return audit.health_by_category(spark, sf).filter("score > 0").orderBy("score", "category").select("category", "score")


@query("SELECT image_id, source_id, url, coalesce(size > 102400, false) AS oversized FROM image_fx", "image_fx")
def image_flags(spark, sf):
    return scans.images(derived(spark, sf, "image_fx")).select("image_id", "source_id", "url", "oversized")


@query("SELECT t.address AS target_url, e.source_id, s.address AS source_url FROM edge_fx e JOIN url_fx s ON s.id = e.source_id JOIN url_fx t ON t.id = e.target_id", "url_fx", "edge_fx")
def inlinks(spark, sf):
    return scans.inlinks(_named(spark, sf))


@query("SELECT e.source_id, t.address AS target_url FROM edge_fx e JOIN url_fx t ON t.id = e.target_id", "url_fx", "edge_fx")
def outlinks(spark, sf):
    return scans.outlinks(_named(spark, sf))


@query("SELECT e.source_id, t.address AS target_url FROM edge_fx e JOIN url_fx t ON t.id = e.target_id WHERE (e.source_id + e.pos) % 4 <> 1 AND e.source_host = e.target_host", "url_fx", "edge_fx")
def crawlable_links(spark, sf):
    kind = F.element_at(F.array(*[F.lit(k) for k in ("a", "img", "link", "iframe")]), (F.expr("(source_id + pos) % 4") + 1).cast("int"))
    t = _pages(spark, sf).select(F.col("id").alias("target_id"), F.col("address").alias("target_url"))
    rows = derived(spark, sf, "edge_fx").withColumns({"link_type": kind, "is_internal": F.expr("source_host = target_host")}).join(t, "target_id")
    return scans.crawlable(rows).select("source_id", "target_url")


@query(_over("referring_pages", "SELECT target_host, source_url, target_url FROM {q} QUALIFY row_number() OVER (PARTITION BY target_host ORDER BY source_url, target_url) <= 200"))
def referring_first(spark, sf):
    rows = audit.referring_pages(spark, sf).select("target_host", "source_url", "target_url")
    return scans.first_of_each(rows, ["target_host"], ["source_url", "target_url"], 200).drop("place")


@query(_over("referring_pages", "SELECT target_host, count(DISTINCT source_host) AS domains, count(*) AS pages FROM {q} GROUP BY 1"))
def referring_domains(spark, sf):
    return links.referring_domains(audit.referring_pages(spark, sf))


@query(_over("backlinks", "SELECT source_url, target_url, authority FROM {q} ORDER BY authority DESC, source_url, target_url LIMIT 100"))
def backlinks_top(spark, sf):
    return audit.backlinks(spark, sf).select("source_url", "target_url", "authority").orderBy(F.desc("authority"), "source_url", "target_url").limit(100)


@query(_over("crawl_depth", "SELECT count(*) AS seen, count(*) FILTER (p.page_id % 20 <> 17) AS crawled, count(*) FILTER (p.page_id % 20 = 17) AS queued FROM {q} JOIN pages p ON p.page_id = q.id"))
def frontier_counts(spark, sf):
    return scans.frontier(audit.crawl_depth(spark, sf), _pages(spark, sf))


def _runs(spark, sf):
    """Two runs stored as a crawl stores them: pages in two batches, of which one is written twice, then the final version."""
    place = folder(spark, "store")
    for run, table in ((1, "run_a_fx"), (2, "run_b_fx")):
        rows = derived(spark, sf, table)
        store.save_run(spark, place, run, 0, table, "running", f"2026-01-0{run} 00:00:00")
        for batch in (0, 1, 1):
            store.append(rows.filter(F.pmod("id", F.lit(2)) == batch), place, "urls", run, batch)
        store.save_run(spark, place, run, 1, table, "completed", f"2026-01-0{run} 00:00:00")
    return store.all_runs(spark, place)


_COUNTED = "count(*) AS found, count(*) FILTER (status_code = 200) AS crawled, count(*) FILTER (status_code >= 400 OR status_code = 0) AS errors, count(*) FILTER (status_code BETWEEN 300 AND 399) AS redirects"
_RUNS = f"SELECT 1 AS crawl_run_id, 'run_a_fx' AS name, 'completed' AS status, {_COUNTED} FROM run_a_fx UNION ALL SELECT 2, 'run_b_fx', 'completed', {_COUNTED} FROM run_b_fx"


@query(_RUNS, "run_a_fx", "run_b_fx")
def stored_runs(spark, sf):
    return _runs(spark, sf).orderBy(F.desc("started_at")).limit(6).select("crawl_run_id", "name", "status", *store.COUNTERS)


@query(f"SELECT count(*) AS runs, sum(found)::BIGINT AS found, sum(crawled)::BIGINT AS crawled, sum(errors)::BIGINT AS errors, sum(redirects)::BIGINT AS redirects FROM ({_RUNS})", "run_a_fx", "run_b_fx")
def run_totals(spark, sf):
    return store.totals(_runs(spark, sf))


@query("SELECT a.id, a.address, coalesce(b.status_code, a.status_code) AS status_code, coalesce(b.h1, a.h1) AS h1 FROM run_a_fx a LEFT JOIN run_b_fx b USING (id)", "run_a_fx", "run_b_fx")
def updated_urls(spark, sf):
    changes = derived(spark, sf, "run_b_fx").select("id", "status_code", "h1")
    return store.updated(derived(spark, sf, "run_a_fx").select("id", "address", "status_code", "h1"), changes)


@query("SELECT block_id, source_id, eligible, schema_type, coalesce(errors, '') AS errors, CASE WHEN errors IS NULL THEN 0 ELSE len(string_split(errors, ' ')) END::INTEGER AS words FROM block_fx", "block_fx")
def decoded_blocks(spark, sf):
    """Data blocks with lists of errors, written as text and typed again."""
    rows = derived(spark, sf, "block_fx").withColumn("errors", F.split("errors", " "))
    back = store.from_text(store.as_text(rows), rows.schema)
    return back.select("block_id", "source_id", "eligible", "schema_type", F.coalesce(F.array_join("errors", " "), F.lit("")).alias("errors"), F.coalesce(F.array_size("errors"), F.lit(0)).alias("words"))


def _listable(spark, sf):
    dates = {"last_modified": F.expr("CASE WHEN id % 3 = 0 THEN '2026-01-05' WHEN id % 3 = 1 THEN '' END"), "crawled_at": F.expr("CASE WHEN id % 2 = 0 THEN '2026-02-06' END")}
    return derived(spark, sf, "run_a_fx").withColumns({"is_internal": F.expr("id % 19 <> 5"), "indexable": F.expr("indexability = 'indexable' AND id % 10 <> 1")} | dates)


_LISTED = "status_code = 200 AND id % 19 <> 5 AND id % 10 <> 1"


@query(f"SELECT id, '<url><loc>' || {audit._XML.format('address')} || '</loc><lastmod>' || CASE WHEN id % 3 = 0 THEN '2026-01-05' WHEN id % 2 = 0 THEN '2026-02-06' ELSE '2026-03-07' END || '</lastmod></url>' AS xml FROM run_a_fx WHERE {_LISTED}", "run_a_fx")
def sitemap_dated(spark, sf):
    none = derived(spark, sf, "image_fx").limit(0)
    return runs.sitemap_rows(_listable(spark, sf), none, dated=True, lastmod="2026-03-07")


_ENTRY = "'- URL: ' || address || CASE WHEN coalesce(trim(title1), '') <> '' THEN chr(10) || '  Title: ' || trim(title1) ELSE '' END || CASE WHEN coalesce(trim(meta_description1), '') <> '' THEN chr(10) || '  Description: ' || trim(meta_description1) ELSE '' END"


@query(f"SELECT id, {_ENTRY} AS text FROM run_a_fx WHERE {_LISTED} UNION ALL SELECT NULL, '# LLMs.txt - AI Search Visibility' || chr(10) || '# Total pages: ' || count(*) FROM run_a_fx WHERE {_LISTED}", "run_a_fx")
def llms_listing(spark, sf):
    return runs.llms_listing(_listable(spark, sf))


@query("""SELECT id AS doc, 2 AS line_no, 'bad address' AS error FROM url_fx WHERE id % 4 = 0 UNION ALL SELECT id, 4, 'stray line' FROM url_fx WHERE id % 5 = 0 AND id % 7 <> 0
UNION ALL SELECT id, 0, 'no header' FROM url_fx WHERE id % 3 = 0 UNION ALL SELECT id, 0, 'no addresses' FROM url_fx WHERE id % 7 = 0 AND id % 4 <> 0""", "url_fx")
def listing_errors(spark, sf):
    """Errors of one listing of four lines per page, into which some were put."""
    lines = ["CASE WHEN id % 3 = 0 THEN '' ELSE '# head' END", "CASE WHEN id % 4 = 0 THEN '- URL: nowhere' WHEN id % 7 = 0 THEN '' ELSE concat('- URL: ', address) END", "CASE WHEN id % 7 = 0 THEN '' ELSE '  Title: x' END", "CASE WHEN id % 5 = 0 THEN '  Stray: x' ELSE '' END"]
    rows = _pages(spark, sf).select(F.col("id").alias("doc"), F.posexplode(F.array(*[F.expr(x) for x in lines])).alias("at", "line"))
    return prompts.validate_listing(rows.select("doc", (F.col("at") + 1).alias("line_no"), "line"))


_ERROR = "CASE id % 9 WHEN 1 THEN 'request timeout' WHEN 2 THEN 'connect ECONNREFUSED' WHEN 3 THEN 'getaddrinfo ENOTFOUND' WHEN 4 THEN 'Invalid URL' WHEN 5 THEN 'socket closed' END"


@query("""SELECT id, CASE id % 9 WHEN 1 THEN 'timeout' WHEN 2 THEN 'refused' WHEN 3 THEN 'dns' WHEN 4 THEN 'malformed' WHEN 5 THEN 'error' END AS error_type, CASE WHEN id % 9 BETWEEN 1 AND 5 THEN 0 ELSE status_code END AS status_code,
CASE WHEN id % 9 = 1 THEN 'No Response' WHEN id % 9 BETWEEN 2 AND 5 THEN 'Error' WHEN status_code = 200 THEN 'OK' WHEN status_code = 302 THEN 'Found' WHEN status_code = 404 THEN 'Not Found' WHEN status_code = 500 THEN 'Internal Server Error' ELSE 'Unknown' END AS status,
CASE WHEN id % 9 = 1 THEN 'no-response' WHEN id % 9 BETWEEN 2 AND 5 THEN 'client-error' WHEN status_code = 200 THEN 'success' WHEN status_code = 302 THEN 'redirect' WHEN status_code = 404 THEN 'client-error' WHEN status_code = 500 THEN 'server-error' ELSE 'no-response' END AS status_category FROM url_fx""", "url_fx")
def fetch_results(spark, sf):
    rows = _pages(spark, sf).select("id", "status_code", F.expr(_ERROR).alias("error"))
    return scans.fetch_rows(rows).select("id", "error_type", "status_code", "status", "status_category")


def _reports(spark, sf):
    body = """concat('{"lighthouseResult": {"categories": {"performance": {"score": 0.5}}, "audits": {"first-contentful-paint": {"numericValue": ', CAST(id AS STRING), ', "displayValue": "x"}, "interactive": {"numericValue": ', CAST(id % 50 AS STRING), '.5, "displayValue": "',
      CAST(id AS STRING), ' s"}, "unused-css": {"displayValue": "big", "details": {"overallSavingsMs": ', CAST(id % 4 AS STRING), '}}}}, "loadingExperience": {"metrics": {"LARGEST_CONTENTFUL_PAINT_MS": {"percentile": ', CAST(id AS STRING), '}}}}')"""
    return _pages(spark, sf).select(F.col("address").alias("url"), F.lit("mobile").alias("strategy"), F.expr(f"CASE WHEN id % 11 = 0 THEN 'no report' ELSE {body} END").alias("body"))


_SEEN = "CASE WHEN id % 11 <> 0 THEN {} END"


@query(f"""SELECT address AS url, 'mobile' AS strategy, {_SEEN.format('50.0::DOUBLE')} AS performance_score, {_SEEN.format('id::DOUBLE')} AS first_contentful_paint, {_SEEN.format('(id % 50 + 0.5)::DOUBLE')} AS time_to_interactive, {_SEEN.format('id::DOUBLE')} AS crux_lcp,
CASE WHEN id % 11 = 0 OR id % 4 = 0 THEN '' ELSE 'unused-css: save ' || id % 4 || 'ms' END AS opportunities, CASE WHEN id % 11 = 0 THEN '' ELSE 'interactive: ' || id || ' s' || CASE WHEN id % 4 = 0 THEN '|unused-css: big' ELSE '' END END AS diagnostics FROM url_fx""", "url_fx")
def page_speed(spark, sf):
    rows = readers.page_speed(_reports(spark, sf))
    joined = {c: F.array_join(c, "|") for c in ("opportunities", "diagnostics")}
    return rows.withColumns(joined).select("url", "strategy", "performance_score", "first_contentful_paint", "time_to_interactive", "crux_lcp", "opportunities", "diagnostics")


@query("""SELECT address AS url, 'psi' AS source, 'performance_score' AS name, 50.0::DOUBLE AS value FROM url_fx WHERE id % 11 <> 0 UNION ALL SELECT address, 'psi', 'first_contentful_paint', id::DOUBLE FROM url_fx WHERE id % 11 <> 0
UNION ALL SELECT address, 'psi', 'time_to_interactive', (id % 50 + 0.5)::DOUBLE FROM url_fx WHERE id % 11 <> 0 UNION ALL SELECT address, 'psi', 'crux_lcp', id::DOUBLE FROM url_fx WHERE id % 11 <> 0""", "url_fx")
def metric_rows(spark, sf):
    return store.metric_rows("psi", readers.page_speed(_reports(spark, sf)), "url")
