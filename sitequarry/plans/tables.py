"""Audit tables derived from the given parquet tables, as SQL that Spark and DuckDB both run.

The given pages lack descriptions, canonicals, images and statuses; deterministic stand-ins fill these columns, so that
every rule has rows to work on and work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

URLS = """
SELECT page_id AS id, host AS run_host, concat(scheme, '://', host, '/') AS start_url, address, path, query, title1, h1, h1_count, h2_count, lang, body_text,
  length(body_text) - length(replace(body_text, ' ', '')) + 1 AS word_count,
  round(CAST(100 AS DOUBLE) * length(body_text) / length(html), 2) AS text_ratio, md5(CASE WHEN page_id % 10 = 4 THEN host ELSE html END) AS hash,
  CASE page_id % 20 WHEN 7 THEN 404 WHEN 11 THEN 500 WHEN 13 THEN 302 WHEN 17 THEN 0 ELSE 200 END AS status_code,
  CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN title1 ELSE trim(substr(body_text, 1, CAST(40 + page_id % 150 AS INT))) END AS meta_description1,
  CASE page_id % 6 WHEN 0 THEN NULL WHEN 1 THEN concat('http://', host, path) WHEN 2 THEN concat('https://other.example.com', path) ELSE address END AS canonical,
  CASE WHEN page_id % 3 <> 0 THEN lead(address) OVER (PARTITION BY host ORDER BY page_id) END AS rel_next,
  CASE WHEN page_id % 5 <> 0 THEN lag(address) OVER (PARTITION BY host ORDER BY page_id) END AS rel_prev,
  CASE page_id % 9 WHEN 3 THEN 1 WHEN 6 THEN 2 ELSE 0 END AS redirect_hops
FROM (SELECT page_id, html, regexp_extract(url, '^(https?)://', 1) AS scheme, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, split_part(url, '#', 1) AS address,
  regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '[?]([^#]*)', 1) AS query,
  nullif(trim(UNESC(regexp_extract(html, '<title>([^<]*)</title>', 1))), '') AS title1, nullif(trim(UNESC(regexp_extract(html, '<h1>([^<]*)</h1>', 1))), '') AS h1,
  CAST((length(html) - length(replace(html, '<h1>', ''))) / 4 AS INT) AS h1_count, CAST((length(html) - length(replace(html, '<h2>', ''))) / 4 AS INT) AS h2_count,
  CASE WHEN page_id % 25 = 6 THEN '' ELSE regexp_extract(html, '<html lang="([^"]*)"', 1) END AS lang,
  trim(RX(UNESC(RX(split_part(html, '<body>', 2), '<[^>]+>', '')), '[ \t\r\n]+', ' ')) AS body_text FROM pages) p
"""
#: The stand-in facts written into the pages, for extraction to find: descriptions, canonicals, neighbours, images, data, forms.
RENDERED = """
SELECT p.page_id, p.url, u.status_code,
  replace(replace(CASE WHEN u.id % 25 = 6 THEN replace(p.html, '<html lang=', '<html data-lang=') ELSE p.html END, '</head>', concat(
    CASE WHEN u.meta_description1 IS NULL THEN '' ELSE concat('<META NAME="Description" content="', ESC(u.meta_description1), '">') END,
    CASE WHEN u.canonical IS NULL THEN '' ELSE concat('<link rel="canonical" href="', ESC(u.canonical), '">') END,
    CASE WHEN u.rel_next IS NULL THEN '' ELSE concat('<link rel=next href="', ESC(u.rel_next), '">') END,
    CASE WHEN u.rel_prev IS NULL THEN '' ELSE concat('<link href="', ESC(u.rel_prev), '" rel="prev">') END,
    CASE WHEN u.id % 10 = 1 THEN '<meta name="robots" content="NOINDEX, follow">' ELSE '' END,
    CASE u.id % 5 WHEN 0 THEN '<script type="application/ld+json">{bad</script>' WHEN 1 THEN '<script type="application/ld+json">{"@type": "Product"}</script>' ELSE '' END, '</head>')),
  '<body>', concat('<body><img src="/a.png"', CASE WHEN u.id % 3 = 0 THEN '' ELSE ' alt="x"' END, CASE WHEN u.id % 4 = 0 THEN '' ELSE ' width=640 height="480"' END, '>',
    CASE WHEN u.id % 2 = 0 THEN concat('<label for="c', CAST(u.id AS VARCHAR(20)), '"></label>') ELSE '' END, '<input id="c', CAST(u.id AS VARCHAR(20)), '">')) AS html
FROM pages p JOIN url_fx u ON u.id = p.page_id
"""
#: Text of a page without menus, footers and the like: SQL's side of what the parser's main_text is.
MAIN = """
SELECT page_id AS id, trim(RX(UNESC(RX(RX(RX(RX(RX(RX(split_part(split_part(html, '<body>', 2), '</body>', 1), '(?s)<nav>.*?</nav>', ''), '(?s)<footer>.*?</footer>', ''), '(?s)<header>.*?</header>', ''), '(?s)<aside>.*?</aside>', ''), '(?s)<(script|style)>.*?</(script|style)>', ''), '<[^>]+>', '')), '[ \t\r\n]+', ' ')) AS main_text FROM pages
"""
#: What an audit of the rendered pages sees: facts of pages with status 200, addresses and statuses of all.
SITE = """
SELECT u.id, u.run_host, u.address, u.path, u.query, u.status_code, CASE WHEN u.status_code = 200 THEN u.title1 END AS title1,
  CASE WHEN u.status_code = 200 THEN u.meta_description1 END AS meta_description1, CASE WHEN u.status_code = 200 THEN u.h1 END AS h1,
  CASE WHEN u.status_code = 200 THEN u.h1_count ELSE 0 END AS h1_count, CASE WHEN u.status_code = 200 THEN u.h2_count ELSE 0 END AS h2_count,
  CASE WHEN u.status_code = 200 THEN u.lang END AS lang, CASE WHEN u.status_code = 200 THEN u.word_count ELSE 0 END AS word_count,
  CASE WHEN u.status_code = 200 THEN 100.0 * length(u.body_text) / length(r.html) ELSE 0 END AS text_ratio, CASE WHEN u.status_code = 200 THEN md5(r.html) END AS hash,
  CASE WHEN u.status_code = 200 THEN u.canonical END AS canonical, CASE WHEN u.status_code = 200 AND u.id % 7 = 2 THEN u.address END AS canonical_header,
  CASE WHEN u.status_code = 200 THEN u.rel_next END AS rel_next, CASE WHEN u.status_code = 200 THEN u.rel_prev END AS rel_prev
FROM url_fx u JOIN rendered_fx r ON r.page_id = u.id
"""
EDGES = """
SELECT s.id AS source_id, t.id AS target_id, s.run_host AS source_host, t.run_host AS target_host, k.pos AS pos
FROM (SELECT id, run_host, row_number() OVER (PARTITION BY run_host ORDER BY id) - 1 AS rn, count(*) OVER (PARTITION BY run_host) AS cnt FROM url_fx) s
JOIN (SELECT 0 AS pos UNION ALL SELECT 1 UNION ALL SELECT 2) k ON true
JOIN (SELECT id, run_host, row_number() OVER (PARTITION BY run_host ORDER BY id) - 1 AS rn FROM url_fx) t ON t.run_host = s.run_host AND t.rn = (s.rn * 3 + k.pos * 2 + 1) % s.cnt
UNION ALL
SELECT s.id, t.id, s.run_host, t.run_host, 3 FROM url_fx s JOIN url_fx t ON t.id = (s.id * 7 + 5) % (SELECT count(*) FROM url_fx)
"""
LOGS = """
SELECT event_id AS line_no, concat('10.0.', CAST(user_id % 256 AS VARCHAR(9)), '.1') AS ip, ts, 'GET' AS method, concat('/p/', regexp_extract(props, '([0-9]+)', 1)) AS url,
  CASE event_type WHEN 'error' THEN CASE WHEN user_id % 2 = 0 THEN 404 ELSE 500 END WHEN 'signup' THEN 302 ELSE 200 END AS status_code,
  CASE user_id % 8 WHEN 0 THEN 'Mozilla/5.0 (compatible; Googlebot/2.1)' WHEN 1 THEN 'Mozilla/5.0 (compatible; bingbot/2.0)' WHEN 2 THEN 'GPTBot/1.0' WHEN 3 THEN 'ClaudeBot/1.0' WHEN 4 THEN 'Googlebot-Image/1.0' ELSE 'Mozilla/5.0 (X11)' END AS user_agent
FROM events
"""
#: Two runs with all the fields that a comparison reads.
RUN_A = """
SELECT id, address, status_code, CASE status_code WHEN 200 THEN 'OK' WHEN 404 THEN 'Not Found' WHEN 500 THEN 'Internal Server Error' WHEN 302 THEN 'Found' ELSE 'No Response' END AS status,
  CASE status_code WHEN 200 THEN 'success' WHEN 404 THEN 'client-error' WHEN 500 THEN 'server-error' WHEN 302 THEN 'redirect' ELSE 'no-response' END AS status_category,
  CASE WHEN status_code = 200 THEN 'indexable' ELSE 'non-indexable' END AS indexability, CASE WHEN status_code <> 200 THEN concat('status ', CAST(status_code AS VARCHAR(9))) END AS indexability_status,
  title1, length(title1) AS title_length, meta_description1, length(meta_description1) AS description_length, h1, h1_count, h2_count, canonical,
  CASE WHEN id % 7 = 2 THEN address END AS canonical_header, CASE WHEN id % 10 = 1 THEN 'noindex' END AS meta_robots, CASE WHEN id % 8 = 3 THEN 'none' END AS x_robots, word_count, word_count * 7 AS content_length,
  id % 700 AS response_time, address LIKE 'https:%' AS is_secure, id % 9 = 4 AS mixed_content
FROM url_fx
"""
RUN_B = """
SELECT id, CASE WHEN id % 11 = 3 THEN concat(address, '-new') ELSE address END AS address, CASE WHEN id % 13 = 4 THEN 404 ELSE status_code END AS status_code, status, status_category, indexability,
  CASE WHEN id % 13 = 4 THEN 'status 404' ELSE indexability_status END AS indexability_status, CASE WHEN id % 5 = 2 THEN concat(title1, ' v2') ELSE title1 END AS title1, CASE WHEN id % 5 = 2 THEN title_length + 3 ELSE title_length END AS title_length,
  meta_description1, description_length, CASE WHEN id % 6 = 1 THEN NULL ELSE h1 END AS h1, h1_count, h2_count + CAST(id % 3 AS INT) AS h2_count, canonical, CASE WHEN id % 7 = 2 THEN '' ELSE canonical_header END AS canonical_header, CASE WHEN id % 20 = 1 THEN 'none' ELSE meta_robots END AS meta_robots,
  x_robots, word_count, content_length, response_time + 1 AS response_time, is_secure, id % 9 = 5 AS mixed_content
FROM run_a_fx WHERE id % 7 <> 6
"""
IMAGES = """
SELECT id * 2 + k.pos AS image_id, id AS source_id, concat(start_url, 'img/', CAST(id % 40 AS VARCHAR(9)), '.png') AS url,
  CASE WHEN (id + k.pos) % 3 = 0 THEN NULL WHEN (id + k.pos) % 3 = 1 THEN ' ' ELSE title1 END AS alt, CASE WHEN id % 4 = 0 THEN NULL ELSE 640 END AS width, CASE WHEN id % 5 = 0 THEN NULL ELSE 480 END AS height,
  id * 997 % 200000 AS size, CASE WHEN id % 17 = 0 THEN 404 ELSE 200 END AS status_code
FROM url_fx JOIN (SELECT 0 AS pos UNION ALL SELECT 1) k ON true
"""
ALTERNATES = """
SELECT e.source_id, s.address AS source, t.address AS target, t.id AS target_id,
  CASE (e.source_id + e.pos) % 6 WHEN 0 THEN '' WHEN 1 THEN 'en' WHEN 2 THEN 'xx-yy' WHEN 3 THEN 'de-DE' WHEN 4 THEN 'en' ELSE 'x-default' END AS hreflang
FROM edge_fx e JOIN url_fx s ON s.id = e.source_id JOIN url_fx t ON t.id = e.target_id WHERE e.pos < 3
"""
BLOCKS = """
SELECT id * 2 AS block_id, id AS source_id, CASE id % 5 WHEN 0 THEN 'bad json' WHEN 1 THEN NULL ELSE '' END AS errors, CASE id % 3 WHEN 0 THEN 'no fields' ELSE '' END AS warnings, id % 7 = 0 AS eligible,
  CASE id % 4 WHEN 0 THEN 'Product' WHEN 1 THEN 'BreadcrumbList' WHEN 2 THEN 'LocalBusiness' ELSE 'Article' END AS schema_type FROM url_fx
"""
#: Ids that are numbered together in a host.
ID_RUN = 4096
#: Names in the order in which they build on each other.
DERIVED = {"url_fx": URLS, "rendered_fx": RENDERED, "main_fx": MAIN, "site_fx": SITE, "edge_fx": EDGES, "log_fx": LOGS, "run_a_fx": RUN_A, "run_b_fx": RUN_B, "image_fx": IMAGES, "alternate_fx": ALTERNATES, "block_fx": BLOCKS}
_NEEDS = {"url_fx": ["pages"], "rendered_fx": ["pages", "url_fx"], "main_fx": ["pages"], "site_fx": ["url_fx", "rendered_fx"], "edge_fx": ["url_fx"], "log_fx": ["events"], "run_a_fx": ["url_fx"], "run_b_fx": ["run_a_fx"], "image_fx": ["url_fx"], "alternate_fx": ["edge_fx", "url_fx"], "block_fx": ["url_fx"]}


def _call(sql: str, name: str, put) -> str:
    """Replace name(argument) by put(argument), innermost last."""
    while (i := sql.find(name + "(")) >= 0:
        depth, j = 0, i + len(name)
        while True:
            depth += {"(": 1, ")": -1}.get(sql[j], 0) if not _in_string(sql, j) else 0
            if depth == 0:
                break
            j += 1
        sql = sql[:i] + put(sql[i + len(name) + 1 : j]) + sql[j + 1 :]
    return sql


#: Entities of the given pages, and what an attribute value needs.
ENTITIES = [("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")]


def _replaces(sql: str, pairs: list[tuple[str, str]]) -> str:
    for a, b in pairs:
        sql = f"replace({sql}, '{a}', '{b}')"
    return sql


def _common(name: str) -> str:
    sql = _call(DERIVED[name], "UNESC", lambda x: _replaces(x, ENTITIES))
    return _call(sql, "ESC", lambda x: _replaces(x, [("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;")]))


def spark_sql(name: str) -> str:
    return _common(name).replace("RX(", "regexp_replace(").replace("{", "{{").replace("}", "}}")  # spark.sql() formats its text


def derived(spark: SparkSession, sf_dir: str, name: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
    """A derived table as a DataFrame; given tables are read as they are, `given` ones taken as they come."""
    if given and name in given:
        return given[name]
    if name not in DERIVED:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "edge_fx":
        return _edges(derived(spark, sf_dir, "url_fx", given).select("id", "run_host"))
    sql = spark_sql(name)
    if name == "url_fx":
        return _urls(spark, sql, derived(spark, sf_dir, "pages", given))
    for need in _NEEDS[name]:
        sql = _named(sql, need)
    return spark.sql(sql, **{need: derived(spark, sf_dir, need, given) for need in _NEEDS[name]})


def _urls(spark: SparkSession, sql: str, pages: DataFrame) -> DataFrame:
    """URLS with its neighbours from a window over addresses alone. Its own would take whole pages, texts too, of a host to one task."""
    host, address = F.lower(F.regexp_extract("url", "^https?://([^/?#]+)", 1)), F.split_part("url", F.lit("#"), F.lit(1))
    order = Window.partitionBy("host_").orderBy("id_")
    rows = pages.select(F.col("page_id").alias("id_"), host.alias("host_"), address.alias("address_"))
    rows = rows.select("id_", "host_", F.lead("address_").over(order).alias("next_"), F.lag("address_").over(order).alias("prev_"))
    beside = rows.groupBy("id_", "host_").agg(F.min("next_").alias("next_"), F.min("prev_").alias("prev_"))  # one row a key, so that where no one asks for neighbours the join is dropped
    for way, name in (("lead", "next_"), ("lag", "prev_")):
        sql = sql.replace(f"{way}(address) OVER (PARTITION BY host ORDER BY page_id)", name)
    sql = _named(sql, "pages") + "LEFT JOIN {beside} ON id_ = page_id AND host_ = host"
    return spark.sql(sql, pages=pages, beside=beside)


def _placed(urls: DataFrame) -> DataFrame:
    """urls with rn, the place of a page in its host by id, from 0, and cnt, the pages of the host.

    Runs of ids are numbered each for itself and the counts of a host's runs before are added, so no host's pages go to one task.
    """
    host, run = Window.partitionBy("run_host"), F.coalesce(F.expr(f"id div {ID_RUN}"), F.lit(2**63 - 1))  # nulls last, as in DuckDB
    rows = urls.withColumn("id_run", run)
    before = F.sum("n").over(host.orderBy("id_run").rowsBetween(Window.unboundedPreceding, -1))
    runs = rows.groupBy("run_host", "id_run").agg(F.count("*").alias("n")).select("run_host", "id_run", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(host).alias("cnt"))
    inside = F.row_number().over(Window.partitionBy("run_host", "id_run").orderBy(F.asc_nulls_last("id"))).cast("long")
    return rows.withColumn("inside", inside).join(runs, ["run_host", "id_run"]).select("id", "run_host", (F.col("before") + F.col("inside") - 1).alias("rn"), "cnt")


def _edges(urls: DataFrame) -> DataFrame:
    """EDGES as joins by all their keys. Of its text Spark would join all pages of a host with each other, three times over."""
    placed = _placed(urls)
    sides = [F.col("s.id").alias("source_id"), F.col("t.id").alias("target_id"), F.col("s.run_host").alias("source_host"), F.col("t.run_host").alias("target_host")]
    asked = placed.withColumn("pos", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("to", (F.col("rn") * 3 + F.col("pos") * 2 + 1) % F.col("cnt"))
    near = asked.alias("s").join(placed.alias("t"), (F.col("t.run_host") == F.col("s.run_host")) & (F.col("t.rn") == F.col("s.to"))).select(*sides, F.col("s.pos").alias("pos"))
    size = urls.groupBy().agg(F.count("*").alias("pages"))  # a join: a subquery in a join's keys may be asked for before it is done
    far = urls.crossJoin(F.broadcast(size)).withColumn("to", (F.col("id") * 7 + 5) % F.col("pages"))
    return near.unionByName(far.alias("s").join(urls.alias("t"), F.col("t.id") == F.col("s.to")).select(*sides, F.lit(3).alias("pos")))


def _named(sql: str, table: str) -> str:
    import re

    return re.sub(rf"\b(FROM|JOIN) {table}\b", rf"\1 {{{table}}}", sql)


def duck_sql(query: str, *names: str) -> str:
    """A DuckDB query with the derived tables that it names in front."""
    import re

    wanted, todo = [], list(names)
    while todo:
        n = todo.pop()
        if n in DERIVED and n not in wanted:
            wanted.append(n)
            todo += _NEEDS[n]
    parts = []
    for n in DERIVED:
        if n in wanted:
            # RX(x, pattern, to) replaces all matches
            sql = _call(_common(n), "RX", lambda x: f"regexp_replace({x}, 'g')")
            parts.append(f"{n} AS MATERIALIZED ({sql})")
    recursive = "RECURSIVE " if re.match(r"\s*WITH\s+RECURSIVE\s", query) else ""
    body = re.sub(r"^\s*WITH\s+(RECURSIVE\s+)?", ", ", query, count=1) if re.match(r"\s*WITH\s", query) else query
    return f"WITH {recursive}{', '.join(parts)}{body if body.startswith(', ') else ' ' + body}"


def _in_string(sql: str, at: int) -> bool:
    return sql[:at].count("'") % 2 == 1
