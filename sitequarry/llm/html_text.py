"""Main text of web pages, with site templates removed.

Each page is read once into blocks of text and hashes of its element subtrees (a subtree's hash covers its tag, class,
texts and its children's hashes). Spark counts, per host and per section of a host, the distinct pages on which a subtree
recurs; subtrees found on many are deleted, whatever their tags say. What a page alone shows to be a menu, footer, form or
the like, by tag, role and class, goes as well: a host's only page has nothing to be compared with.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitequarry.llm.common import attach, materialise
from sitequarry.llm.words import text_slices

#: A subtree is template when it recurs on at least so many distinct pages of its host, and on this share of them; or
#: likewise of its section (the first folder of the path), so a section's own blocks don't depend on the host's size.
LEAST_PAGES, SHARE = 5, 0.05
#: Fixed values of HTML: elements without end tags, elements of raw text, and elements that end a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split())
#: Elements and roles that never hold main text, and words of class and id that mark such elements.
UNSEEN = frozenset("script style noscript iframe head template title xmp noembed noframes svg canvas object audio video".split())
DROPPED = frozenset("nav footer aside button select option textarea dialog menu search".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar form".split())
MARKS = frozenset("ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu navbar nav navigation breadcrumb breadcrumbs masthead footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments disqus replies respond".split())
#: "header" marks a site's head only alone or beside these: a page's or a card's header holds its title.
HEADER_WORDS = frozenset("header site top global bar wrap wrapper container".split())
CONTENT_WORDS = frozenset("article post entry content main story body title headline".split())
#: Inside the article, plain prose stays however often it recurs; only these may be template there.
CONTAINERS = frozenset("div section ul ol table figure details dl header".split())
LANDMARKS = frozenset(("article", "main"))
#: Elements whose text belongs to the fields of a form, and the characters that a field counts for.
LABELS = frozenset(("label", "legend"))
FIELD = 20

#: As HTML has it, quotes delimit only right after "="; elsewhere they belong to a name or a bare value, and a quote that is
#: never closed delimits nothing.
_TOKEN = re.compile(r"<!--|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*+)?+)?+)*+)>|<(?=/?[a-zA-Z])")
_ATTR = re.compile(r"([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PARTS = re.compile(r"[^a-z0-9]+")


def _marked(attrs: str) -> tuple[bool, str]:
    """Whether class, id or role mark an element as no main text; its class, for the hash."""
    if not attrs or attrs.isspace():
        return False, ""
    bad, own = False, ""
    for key, *values in _ATTR.findall(attrs):
        key = key.lower()
        if key not in ("class", "id", "role"):
            continue
        value = next((v for v in values if v), "").lower()
        if key == "role":
            bad |= value in ROLES
            continue
        if key == "class":
            own = value
        for token in value.split():
            parts = set(_PARTS.split(token))
            bad |= (bool(parts & MARKS) or "header" in parts and parts <= HEADER_WORDS) and not parts & CONTENT_WORDS
    return bad, own


class _Page:
    """One pass over a page: blocks of text and subtree hashes.

    A block knows the innermost subtree that holds it, a subtree the one around it, so depth costs nothing. Blocks that the
    lists drop are `listed` by their subtree; they are counted like all others. Open elements are counted by name since the
    last landmark, so that end tags need no search.
    """

    def __init__(self, source: str, lists: bool = True):
        self.lists = lists
        self.blocks: list[tuple[str, int, bool, int]] = []  # text, subtree, within a landmark, form
        self.listed: list[int] = []
        self.gone: list[str] = []
        self.parents: list[int] = [-1]  # subtree -> the one around it; 0 is the page
        self.hashes: list[int | None] = [None]
        self.stack: list[list] = []  # tag, subtree, drops, landmark, candidate, hasher, form
        self.counts: list[Counter[str]] = [Counter()]
        self.dropping = self.landmarks = self.labels = 0
        self.controls: Counter[int] = Counter()  # form -> characters of labels, and what its fields count for
        self.forms = 0
        self.text: list[str] = []
        at, end = 0, len(source)
        find = _TOKEN.search
        while at < end:
            m = find(source, at)
            if m is None:
                self.words(source[at:])
                break
            if m.start() > at:
                self.words(source[at : m.start()])
            at = m.end()
            token = m.group()
            if token == "<!--":
                stop = source.find("-->", at)
                at = end if stop < 0 else stop + 3
            elif m.group(2):
                tag = m.group(2).lower()
                if m.group(1):
                    self.close(tag)
                else:
                    self.open(tag, m.group(3))
                    if tag in RAW:
                        stop = re.compile(f"</{re.escape(tag)}(?=[\\s/>]|$)", re.I).search(source, at)
                        at = stop.start() if stop else end
            elif token == "<":  # a tag that the page's end cuts off
                break
        self.flush()
        while self.stack:
            self.pop()

    def words(self, raw: str) -> None:
        (self.gone if self.dropping else self.text).append(raw)
        if self.stack:
            self.stack[-1][5].append(raw)
            if self.labels and self.stack[-1][6]:
                self.controls[self.stack[-1][6]] += len(raw)

    def flush(self) -> None:
        node, form = (self.stack[-1][1], self.stack[-1][6]) if self.stack else (0, 0)
        if self.text:
            line = " ".join(html.unescape("".join(self.text)).split())
            if line:
                self.blocks.append((line, node, self.landmarks > 0, form))
            self.text.clear()
        if self.gone:
            if not all(x.isspace() for x in self.gone):
                self.listed.append(node)
            self.gone.clear()

    def open(self, tag: str, attrs: str) -> None:
        if tag in ("br", "td", "th", "hr"):
            self.words(" ")
        if tag in LANDMARKS and self.dropping:  # a menu or form that was never closed
            while self.dropping:
                self.pop()
        if tag in BLOCKS:
            self.flush()
            if tag == "li":
                self.close_within("li", ("ul", "ol", "menu"))
            elif tag in ("dt", "dd"):
                self.close_within("dt", ("dl",))
                self.close_within("dd", ("dl",))
            elif tag == "tr":
                self.close_within("tr", ("table",))
            self.close_within("p", ("div", "article", "main", "section", "td", "li"))
        elif tag == "option":
            self.close_within("option", ("select",))
        if tag == "input" and self.stack and self.stack[-1][6]:
            self.controls[self.stack[-1][6]] += FIELD
        if tag in VOID:
            return
        bad, name = _marked(attrs)
        drops = tag in UNSEEN or self.lists and (bad or tag in DROPPED or tag == "header" and not self.landmarks)
        candidate = tag in CONTAINERS or tag in BLOCKS and not self.landmarks and tag not in ("html", "body") and tag not in LANDMARKS
        node, form = (self.stack[-1][1], self.stack[-1][6]) if self.stack else (0, 0)
        if candidate and tag not in UNSEEN:
            self.parents.append(node)
            self.hashes.append(None)
            node = len(self.parents) - 1
        if tag == "form":
            self.forms += 1
            form = self.forms
        elif tag in LANDMARKS:
            form = 0
        if tag in LANDMARKS:
            self.counts.append(Counter())
        self.stack.append([tag, node, drops, tag in LANDMARKS, candidate, [f"<{tag} {name}>"], form])
        self.counts[-1][tag] += 1
        self.dropping += drops
        self.landmarks += tag in LANDMARKS
        self.labels += tag in LABELS

    def close_within(self, tag: str, limits: tuple[str, ...]) -> None:
        if not any(c[tag] for c in self.counts):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                while len(self.stack) > i:
                    self.pop()
                return
            if self.stack[i][0] in limits:
                return

    def close(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        # a stray end tag doesn't end the article
        if not (any(c[tag] for c in self.counts) if tag in ("body", "html") else self.counts[-1][tag]):
            return
        while self.stack:
            if self.pop() == tag:
                return

    def pop(self) -> str:
        if self.stack[-1][0] in BLOCKS:
            self.flush()
        tag, node, drops, landmark, candidate, parts, _ = self.stack.pop()
        self.counts[-1][tag] -= 1
        if landmark:
            self.counts.pop()
        self.dropping -= drops
        self.landmarks -= landmark
        self.labels -= tag in LABELS
        digest = hashlib.blake2b(" ".join("".join(parts).split()).encode("utf-8", "surrogatepass"), digest_size=8).digest()
        if candidate and tag not in UNSEEN:
            self.hashes[node] = int.from_bytes(digest, "little", signed=True)
        if self.stack:
            self.stack[-1][5].append(f"[{digest.hex()}]")
        return tag


class Read(NamedTuple):
    """Texts of a page in order and the subtree of each; subtrees of other blocks; hash and parent of each subtree."""

    texts: list[str]
    at: list[int]
    others: list[int]
    hashes: list[int | None]
    parents: list[int]


def read_page(source: str, lists: bool = True) -> Read:
    """Blocks of a page.

    If an article or main element holds text, only blocks in such elements count; the others, and what the lists drop,
    are the other blocks. A form goes unless it holds at least half of the page's text and more text than labels and
    fields: some sites put whole pages into one. Subtrees without text have no hash.
    """
    page = _Page(source, lists)
    blocks, others = page.blocks, list(page.listed)
    if lists and page.forms:
        sizes: Counter[int] = Counter()
        for text, _, _, form in blocks:
            sizes[form] += len(text)
        total = sum(sizes.values())
        dropped = {f for f in sizes if f and not (2 * sizes[f] >= total and sizes[f] > 2 * page.controls[f])}
        others += [b[1] for b in blocks if b[3] in dropped]
        blocks = [b for b in blocks if b[3] not in dropped]
    within = [b for b in blocks if b[2]]
    if within:
        others += [b[1] for b in blocks if not b[2]]
        blocks = within
    used = [False] * len(page.parents)
    for node in [b[1] for b in blocks] + others:
        while node > 0 and not used[node]:
            used[node] = True
            node = page.parents[node]
    return Read([b[0] for b in blocks], [b[1] for b in blocks], others, [h if u else None for h, u in zip(page.hashes, used)], page.parents)


def in_gone(read: Read, gone: set[int]) -> list[bool]:
    """Of each subtree whether it or one around it is template; parents come before what they hold."""
    out = [False] * len(read.parents)
    for i, (h, parent) in enumerate(zip(read.hashes, read.parents)):
        out[i] = h in gone or parent >= 0 and out[parent]
    return out


PAGE = "page_id long, url string, digest long, texts array<string>, at array<int>, others array<int>, hashes array<long>, parents array<int>"


def _reader(lists: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, sources in text_slices(batch.column(3)):
                pages = [read_page(s, lists) for s in sources]
                own = [batch.column(i).slice(at, len(sources)) for i in range(3)]
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([*own, *(pa.array([p[i] for p in pages], pa.list_(k)) for i, k in enumerate(kinds))], names=["page_id", "url", "digest", *Read._fields])

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the blocks in template subtrees, and how many blocks were in such."""
    for batch in batches:
        texts, removed = [], []
        for *fields, gone in zip(*(batch.column(n).to_pylist() for n in (*Read._fields, "gone"))):
            read = Read(*fields)
            out = in_gone(read, set(gone)) if gone else [False] * len(read.parents)
            stay = [t for t, node in zip(read.texts, read.at) if not out[node]]
            texts.append("\n\n".join(stay))
            removed.append(len(read.texts) - len(stay) + sum(out[n] for n in read.others))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(removed, pa.int32())], names=["page_id", "url", "text", "n_blocks_removed"])


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, share: float = SHARE, lists: bool = True) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks_removed (blocks in template subtrees): one row per page row.

    Without `lists` only templates are removed, nothing by tag, role or class.

    Null html is empty; a page without main text has an empty text. Pages without a host share one nameless host.
    Equal pages of a host or section count once, so copies of a page do not make it template. Repeated rows give equal rows. An
    empty table gives no rows; other columns are not read. Very long and deeply nested pages take time and memory in
    proportion to their length.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.xxhash64("html").alias("digest"), "html")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    section = F.regexp_extract(F.coalesce("url", F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^/?#]+)/", 1)
    read = materialise(own.mapInArrow(_reader(lists), PAGE).withColumn("uid", F.monotonically_increasing_id()).withColumn("host", host).withColumn("section", section), "page_blocks")
    nodes = F.array_distinct(F.array_compact("hashes"))
    held, n_pages = read, read.count()
    for i, keys in enumerate((["host"], ["host", "section"])):
        distinct = read.groupBy(*keys, "digest").agg(F.min("uid").alias("uid"))
        sizes = distinct.groupBy(*keys).agg(F.count("*").alias("pages"))
        counts = read.join(distinct.select("uid"), "uid", "left_semi").select(*keys, F.explode(nodes).alias("node")).groupBy(*keys, "node").agg(F.count("*").alias("on_pages")).filter(F.col("on_pages") >= least_pages)
        # each node is on that share of the pages, so a list has at most 1 / share times the nodes of a mean page
        lists = counts.join(sizes, keys).filter(F.col("on_pages") >= share * F.col("pages")).groupBy(*keys).agg(F.collect_list("node").alias(f"gone{i}"))
        rows = read.groupBy(*keys).agg(F.count("*").alias(f"rows{i}"))
        template = materialise(lists.join(rows, keys), "template_nodes")
        held = attach(held, template, keys, n_pages, f"rows{i}").drop(f"rows{i}")
    listed = F.concat(*[F.coalesce(f"gone{i}", F.array().cast("array<long>")) for i in range(2)])
    found = held.select("page_id", "url", *Read._fields, F.array_intersect(nodes, listed).alias("gone")).mapInArrow(_kept, "page_id long, url string, text string, n_blocks_removed int")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks_removed")
