"""Page facts from raw HTML: one pass by Python workers, then Columns and explodes.

`extract_pages` gives one row per page with nested lists; the functions below it turn them into the fact tables.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitequarry.functions import text as T
from sitequarry.functions import urls as U
from sitequarry.operators.selectors import VOID, closed_references

LINK, IMAGE, CONTROL = ("kind", "href", "text", "rel", "target", "hreflang", "pos"), ("src", "alt", "width", "height", "kind", "pos"), ("tag", "id", "labelled")
#: Columns of extract_pages: texts, lists of texts, lists of structs.
FACT_TYPES = {
    "titles": "array<string>", "descriptions": "array<string>", "keywords": "array<string>", "robots": "string", "h1": "array<string>", "h2": "array<string>", "canonical": "string", "rel_next": "string", "rel_prev": "string", "base": "string", "lang": "string", "body_text": "string", "main_text": "string",
    "links": "array<struct<kind:string,href:string,text:string,rel:string,target:string,hreflang:string,pos:int>>", "images": "array<struct<src:string,alt:string,width:string,height:string,kind:string,pos:int>>",
    "json_ld": "array<string>", "microdata": "array<string>", "controls": "array<struct<tag:string,id:string,labelled:boolean>>", "labels": "array<string>", "resources": "array<string>",
}
FACT_NAMES = list(FACT_TYPES)
#: Elements that main_text leaves out, and inputs that need no label.
ASIDE = {"script", "style", "nav", "footer", "header", "aside"}
UNLABELLED_TYPES = {"hidden", "submit", "button", "image", "reset"}

#: Elements that may stand before a page's body; any other start tag, or text, begins it.
HEAD = {"html", "head", "title", "meta", "link", "script", "style", "base", "noscript", "template"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


class _Reader(HTMLParser):
    """Facts of one page in one pass. Open elements are counted by name, so a tag costs no walk through those around it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.f: dict = {k: [] for k in "titles descriptions keywords h1 h2 links images json_ld microdata controls labels resources".split()}
        self.f |= dict.fromkeys("robots canonical rel_next rel_prev base lang".split())
        self.open: list[str] = []
        self.count: Counter[str] = Counter()
        self.aside = 0
        self.in_body = False
        self.anchor: list | None = None  # the texts of the open link
        self.heading: list | None = None  # the texts of the open heading
        self.title: list | None = None
        self.data: list | None = None  # the texts of the open data block
        self.body: list[str] = []
        self.main: list[str] = []

    def _add_link(self, kind, href, a, text=None):
        if href:
            self.f["links"].append([kind, href, text, a.get("rel"), a.get("target"), a.get("hreflang"), len(self.f["links"])])

    def handle_starttag(self, tag, attrs):
        a = {}
        for k, v in attrs:
            a.setdefault(k, v or "")
        f = self.f
        if tag == "a" and self.count["a"]:  # a link ends the one before
            self.handle_endtag("a")
        if tag in HEADINGS and self.open and self.open[-1] in HEADINGS:
            self.handle_endtag(self.open[-1])
        self.in_body = self.in_body or tag not in HEAD
        if tag not in VOID:
            self.open.append(tag)
            self.count[tag] += 1
            self.aside += tag in ASIDE
        if tag == "html" and f["lang"] is None:
            f["lang"] = a.get("lang")
        if "itemscope" in a:
            f["microdata"].append(a.get("itemtype", ""))
        for src in re.findall(r"url\(\s*[\"']?([^)\"']*)", a.get("style", "")):
            self._add_link("css", src.strip(), a)
            f["images"].append((src.strip(), None, None, None, "background", len(f["images"])))
        if tag == "meta" and not self.in_body:
            name, content = a.get("name", "").lower(), a.get("content")
            if name in ("description", "keywords") and content is not None:
                f["descriptions" if name == "description" else "keywords"].append(content)
            elif name in ("robots", "googlebot", "bingbot") and f["robots"] is None:
                f["robots"] = content
        elif tag == "base" and f["base"] is None:
            f["base"] = a.get("href")
        elif tag == "link":
            rel = a.get("rel", "").lower()
            for word, key in (("canonical", "canonical"), ("next", "rel_next"), ("prev", "rel_prev")):
                if word == rel and f[key] is None and not self.in_body:
                    f[key] = a.get("href")
            if rel in ("stylesheet", "alternate"):
                self._add_link("css" if rel == "stylesheet" else "link", a.get("href"), a)
            f["resources"].append(a.get("href", ""))
        elif tag == "img":
            if a.get("src"):
                f["images"].append((a["src"], a.get("alt"), a.get("width"), a.get("height"), "img", len(f["images"])))
                self._add_link("img", a["src"], a, a.get("alt"))
                f["resources"].append(a["src"])
        elif tag == "source":
            first = a.get("srcset", "").split(",")[0].split()
            if first:
                f["images"].append((first[0], None, None, None, "source", len(f["images"])))
            f["resources"].append(a.get("src", ""))
        elif tag == "a":
            self._add_link("a", a.get("href"), a)
            if a.get("href"):
                self.anchor = f["links"][-1][2] = []
        elif tag in ("iframe", "script"):
            self._add_link(tag, a.get("src"), a)
            if tag == "script":
                f["resources"].append(a.get("src", ""))
                if a.get("type", "").lower() == "application/ld+json":
                    self.data = []
                    f["json_ld"].append(self.data)
        elif tag == "form":
            self._add_link("form", a.get("action"), a)
        elif tag == "label" and a.get("for"):
            f["labels"].append(a["for"])
        elif tag == "title" and not self.in_body:
            self.title = []
            f["titles"].append(self.title)
        elif tag in ("h1", "h2"):
            self.heading = []
            f[tag].append(self.heading)
        if tag in ("input", "select", "textarea") and a.get("type", "").lower() not in UNLABELLED_TYPES:
            f["controls"].append((tag, a.get("id", ""), any(a.get(k) for k in ("aria-label", "aria-labelledby", "title", "placeholder"))))

    def handle_endtag(self, tag):
        if tag == "head":
            self.title = None
        if tag in HEADINGS and not self.count[tag]:  # any heading's end tag ends the open one
            tag = next((h for h in HEADINGS if self.count[h]), tag)
        if not self.count[tag]:
            return
        while self.open:
            name = self.open.pop()
            self.count[name] -= 1
            self.aside -= name in ASIDE
            if name == "a":
                self.anchor = None
            elif name in HEADINGS:
                self.heading = None
            elif name == "title":
                self.title = None
            elif name == "script":
                self.data = None
            if name == tag:
                return

    def handle_data(self, data):
        if self.data is not None:
            self.data.append(data)
        if self.title is not None:
            self.title.append(data)
            return
        if not self.in_body and not data.isspace() and not (self.open and self.open[-1] in ("script", "style", "title", "noscript", "template")):
            self.in_body = True
        if not self.in_body:
            return
        for to in (self.anchor, self.heading):
            if to is not None:
                to.append(data)
        self.body.append(data)
        if not self.aside:
            self.main.append(data)


def read_facts(html: str | None) -> dict:
    r = _Reader()
    r.feed(html or "")
    r.close()
    f = r.f
    f["links"] = [dict(zip(LINK, [*x[:2], "".join(x[2]) if isinstance(x[2], list) else x[2], *x[3:]])) for x in f["links"]]
    f["images"] = [dict(zip(IMAGE, x)) for x in f["images"]]
    f["controls"] = [dict(zip(CONTROL, x)) for x in f["controls"]]
    for k in ("titles", "h1", "h2", "json_ld"):
        f[k] = ["".join(x) for x in f[k]]
    return f | {"body_text": " ".join("".join(r.body).split()), "main_text": " ".join("".join(r.main).split())}


def extract_pages(pages: DataFrame, bare_references: bool = True, facts: Sequence[str] | None = None) -> DataFrame:
    """The pages with the facts of each: one row for each row, repeated ones too. Null html gives empty lists and texts.

    Columns besides page_id, url and html come along, but those named like a fact. Character references without a semicolon
    (&amp at the end of a cut title) are decoded as browsers do; with bare_references false they stay as they stand.
    Where `facts` names the facts that are wanted, only they leave the workers, and html doesn't.
    """
    wanted = FACT_NAMES if facts is None else list(facts)
    more = [c for c in pages.columns if c not in ("page_id", "url", "html") and c.lower() not in FACT_NAMES]
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, texts = pa.string(), pa.list_(pa.string())
        kinds = dict.fromkeys("robots canonical rel_next rel_prev base lang body_text main_text".split(), s)
        link = pa.list_(pa.struct([(c, pa.int32() if c == "pos" else s) for c in LINK]))
        image = pa.list_(pa.struct([(c, pa.int32() if c == "pos" else s) for c in IMAGE]))
        kinds |= {"links": link, "images": image, "controls": pa.list_(pa.struct([("tag", s), ("id", s), ("labelled", pa.bool_())]))}
        for batch in batches:
            for at in range(0, batch.num_rows, 200):  # only so many pages are Python objects at once
                part = batch.slice(at, 200)
                found = [read_facts(h if bare_references or not h else closed_references(h)) for h in part.column("html").to_pylist()]
                columns = [pa.array([f[n] for f in found], kinds.get(n, texts)) for n in wanted]
                given = [n for n in part.schema.names if facts is None or n != "html"]
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in given], *columns], names=[*given, *wanted])

    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if facts is None or f.name != "html"]
    return rows.mapInArrow(run, ", ".join(own + [f"{n} {FACT_TYPES[n]}" for n in wanted]))


def url_facts(facts: DataFrame) -> DataFrame:
    """The wide page table: titles, descriptions, headings, canonicals, text measures, and the columns that came with the pages."""
    more = [c for c in facts.columns if c not in ("page_id", "url", "html", *FACT_NAMES)]
    at = lambda c, i: T.clean(F.get(c, F.lit(i)))
    robots = F.transform(F.split(F.lower(F.coalesce("robots", F.lit(""))), ","), lambda x: F.trim(x))
    out = facts.select(
        F.col("page_id").alias("id"), "url", at("titles", 0).alias("title1"), at("titles", 1).alias("title2"), at("descriptions", 0).alias("meta_description1"), at("descriptions", 1).alias("meta_description2"), at("keywords", 0).alias("meta_keywords1"),
        at("h1", 0).alias("h1"), F.size("h1").alias("h1_count"), at("h2", 0).alias("h2"), F.size("h2").alias("h2_count"), "robots", F.arrays_overlap(robots, F.array(F.lit("noindex"), F.lit("none"))).alias("noindex"), F.arrays_overlap(robots, F.array(F.lit("nofollow"), F.lit("none"))).alias("nofollow"),
        U.resolve("canonical", "url").alias("canonical"), U.resolve("rel_next", "url").alias("rel_next"), U.resolve("rel_prev", "url").alias("rel_prev"), "lang", "body_text", "main_text",
        F.size(F.filter(F.split("body_text", " "), lambda w: w != "")).alias("word_count"), F.when(F.length("html") > 0, F.round(100.0 * F.length("body_text") / F.length("html"), 2)).alias("text_ratio"), F.md5("html").alias("hash"), F.octet_length("html").alias("content_length"),
        (U.is_https(F.col("url")) & F.exists("resources", lambda r: r.startswith("http:"))).alias("mixed_content"), *more,
    )
    return out


def link_facts(facts: DataFrame, resolve_against: str = "start") -> DataFrame:
    """Links of pages, resolved against the base, which counts from the site's start page or (`page`) the page itself."""
    start = F.concat(U.scheme(F.col("url")), F.lit("://"), U.host(F.col("url")), F.lit("/")) if resolve_against == "start" else F.col("url")
    rows = facts.select(F.col("page_id").alias("source_id"), F.col("url").alias("source_url"), F.explode(F.arrays_zip(F.col("links").alias("l"), U.resolve_all("links.href", "base", start).alias("to"))).alias("x")).select("source_id", "source_url", "x.l", "x.to")
    rel = F.lower(F.coalesce("l.rel", F.lit("")))
    out = rows.select("source_id", "source_url", F.col("to").alias("target_url"), F.col("l.kind").alias("link_type"), T.clean(F.col("l.text")).alias("anchor"), F.col("l.rel").alias("rel"), rel.contains("nofollow").alias("nofollow"), rel.contains("noopener").alias("noopener"), rel.contains("noreferrer").alias("noreferrer"), F.col("l.target").alias("target_attr"), F.col("l.hreflang").alias("hreflang"), F.col("l.pos").alias("pos"))
    return out.filter("target_url is not null").withColumn("is_internal", U.same_host(F.col("target_url"), F.col("source_url")))


def image_facts(facts: DataFrame) -> DataFrame:
    """Images of pages; of one URL on a page the first counts."""
    to = U.resolve_all("images.src", F.lit(None).cast("string"), "url")
    rows = facts.select(F.col("page_id").alias("source_id"), F.explode(F.arrays_zip(F.col("images").alias("i"), to.alias("to"))).alias("x")).select("source_id", "x.i", F.col("x.to").alias("image_url")).select("source_id", "image_url", F.col("i.alt").alias("alt"), F.expr("try_cast(i.width as int)").alias("width"), F.expr("try_cast(i.height as int)").alias("height"), F.col("i.kind").alias("kind"), F.col("i.pos").alias("pos"))
    first = rows.filter("image_url is not null").groupBy("source_id", "image_url").agg(F.min_by(F.struct("alt", "width", "height", "kind", "pos"), "pos").alias("i"))
    return first.select("source_id", F.col("image_url").alias("url"), "i.*", U.extension(F.col("image_url")).alias("format"))


def data_blocks(facts: DataFrame) -> DataFrame:
    """Structured data: kind, type label, errors and warnings."""
    ld = facts.select(F.col("page_id").alias("source_id"), F.col("url").alias("source_url"), F.posexplode("json_ld").alias("pos", "data"))
    parsed = F.try_parse_json("data")
    listed = F.array_join(F.expr("try_variant_get(try_parse_json(data), '$[\\'@type\\']', 'array<string>')"), ", ")
    label = F.coalesce(listed, F.try_variant_get(parsed, "$['@type']", "string"), F.regexp_extract("data", '"@type"\\s*:\\s*"([^"]*)"', 1))
    ld = ld.select("source_id", "source_url", "pos", F.lit("json-ld").alias("kind"), F.nullif(label, F.lit("")).alias("schema_type"), F.when(parsed.isNull(), "invalid JSON").alias("errors"), F.lit(None).cast("string").alias("warnings"), F.lit(False).alias("eligible"))
    micro = facts.select(F.col("page_id").alias("source_id"), F.col("url").alias("source_url"), F.posexplode("microdata").alias("pos", "type")).select("source_id", "source_url", "pos", F.lit("microdata").alias("kind"), F.element_at(F.split("type", "/"), -1).alias("schema_type"), F.lit(None).cast("string").alias("errors"), F.lit("microdata is not checked").alias("warnings"), F.lit(False).alias("eligible"))
    return ld.unionByName(micro)


def unlabelled_controls(facts: DataFrame) -> DataFrame:
    """One row per form control without label, title, placeholder or aria name."""
    bad = F.filter("controls", lambda c: ~c["labelled"] & ~(F.array_contains("labels", c["id"]) & (c["id"] != "")))
    return facts.select(F.col("page_id").alias("id"), "url", F.explode(bad).alias("c")).select("id", "url", "c.tag", F.col("c.id").alias("control_id"))


def search_rule(pattern: str, column: str = "html", regex: bool = True) -> Column:
    """How often a custom pattern or plain text occurs."""
    c = F.col(column)
    return F.regexp_count(c, F.lit(pattern)) if regex else F.when(c.contains(pattern), (F.length(c) - F.length(F.replace(c, F.lit(pattern), F.lit("")))) / len(pattern)).otherwise(0).cast("int")


def extraction_rule(pattern: str, column: str = "html", group: int = 1) -> Column:
    """All matches of a custom pattern."""
    return F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(group))


def status_category(code: Column) -> Column:
    return F.when(code.between(200, 299), "success").when(code.between(300, 399), "redirect").when(code.between(400, 499), "client-error").when(code >= 500, "server-error").otherwise("no-response")
