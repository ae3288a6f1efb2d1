"""Custom extraction rules: selectors that follow the open elements of a page, simple paths in well-formed markup, patterns.

A selector is compiled once into steps. While a page is read, every open element holds the set of steps that it or an
element around it has reached, as bits of one number, so a start tag costs one test for each step whatever the depth.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.entities import html5
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without an end tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements that end an open one of their own kind, and those that end a paragraph.
REPEATED = {"p", "li", "a", "tr", "td", "th", "option", "dt", "dd"}
BLOCKS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "pre", "section", "table", "ul"}
_NAME = r"[A-Za-z0-9_-]+"
_PART = re.compile(rf"""\*|(?P<tag>{_NAME})|\#(?P<id>{_NAME})|\.(?P<cls>{_NAME})|\[\s*(?P<attr>[A-Za-z0-9_:-]+)\s*(?:(?P<op>[~^$*]?=)\s*(?:"(?P<a>[^"]*)"|'(?P<b>[^']*)'|(?P<c>[^\]\s]+))\s*)?\]""")
#: A sign and the reference that it begins; also comments, and scripts and styles, in whose texts references aren't read.
_SIGN = r"&(?P<ref>#[0-9]+;|#x[0-9a-f]+;|[a-z][a-z0-9]*;)?"
_TAG_SIGNS = re.compile(_SIGN, re.I)
_SIGNS = re.compile(rf"<!--.*?(?:-->|\Z)|<(?:(script)|style)\b.*?(?:</(?(1)script|style)|\Z)|{_SIGN}", re.S | re.I)


def _closed(m: re.Match) -> str:
    if m[0].startswith("<!"):
        return m[0]
    if m[0][0] == "<":
        tag, end, text = m[0].partition(">")
        return _TAG_SIGNS.sub(_closed, tag) + end + text
    return m[0] if m["ref"] and (m["ref"][0] == "#" or m["ref"] in html5) else "&amp;" + m[0][1:]


def closed_references(html: str) -> str:
    """html that a reader decodes only where a character reference has its semicolon; others, as in cut titles, stay as they stand."""
    return _SIGNS.sub(_closed, html) if "&" in html else html


@dataclass(frozen=True)
class Extraction:
    """A rule: name, selector, its kind (css, xpath, regex), all values or the first, and the attribute to take (none: text)."""

    name: str
    selector: str
    kind: str = "css"
    multiple: bool = False
    attribute: str | None = None


class Step:
    """Tests of one element: tag, id, classes, attributes; `child` says that its parent must match the step before."""

    def __init__(self, source: str, child: bool):
        self.child, self.tag, self.tests = child, None, []
        at = 0
        while at < len(source):
            m = _PART.match(source, at)
            if not m or m.end() == at:
                raise ValueError(f"selector {source!r} has a part that isn't known: {source[at:]!r}")
            at = m.end()
            value = next((x for x in (m["a"], m["b"], m["c"]) if x is not None), None)
            if m["tag"]:
                self.tag = m["tag"].lower()
            elif m["id"]:
                self.tests.append(("id", "=", m["id"]))
            elif m["cls"]:
                self.tests.append(("class", "~=", m["cls"]))
            elif m["attr"]:
                self.tests.append((m["attr"].lower(), m["op"] or "", value))

    def fits(self, tag: str, attrs: dict[str, str]) -> bool:
        if self.tag and self.tag != tag:
            return False
        for name, op, value in self.tests:
            have = attrs.get(name)
            if have is None or (op == "=" and have != value) or (op == "~=" and value not in have.split()) or (op == "^=" and not (value and have.startswith(value))) or (op == "$=" and not (value and have.endswith(value))) or (op == "*=" and not (value and value in have)):
                return False
        return True


def compile_selector(selector: str) -> list[list[Step]]:
    """Alternatives (comma), each a list of steps joined by blanks (any depth) or > (child)."""
    out = []
    for alternative in re.split(r""",(?=(?:[^"']|"[^"]*"|'[^']*')*$)""", selector):
        tokens = re.findall(r"""\[[^\]]*\]|>|\s+|[^\s>\[]+""", alternative.strip())
        steps, compound, child = [], "", False
        for t in [*tokens, " "]:
            if t == ">" or t.isspace():
                if compound:
                    steps.append(Step(compound, child))
                    compound, child = "", False
                child = child or t == ">"
            else:
                compound += t
        if not steps or child:
            raise ValueError(f"selector {selector!r} has an empty part")
        out.append(steps)
    return out


class Selection(HTMLParser):
    """Reads a page once and lists the values of all css rules."""

    def __init__(self, rules: list[tuple[int, list[list[Step]], str | None, bool]]):
        super().__init__(convert_charrefs=True)
        self.rules = rules
        self.steps: list[tuple[int, int, Step, int | None]] = []  # bit, bit of the step before, step, rule that it completes
        for number, alternatives, _, _ in rules:
            for steps in alternatives:
                for i, step in enumerate(steps):
                    bit = len(self.steps)
                    self.steps.append((1 << bit, 1 << (bit - 1) if i else 0, step, number if i == len(steps) - 1 else None))
        self.attribute = {number: attribute for number, _, attribute, _ in rules}
        self.open: list[tuple[str, int, int, list]] = []  # tag, own bits, bits of it and those around it, values begun
        self.count: dict[str, int] = {}
        self.text: list[str] = []
        self.values: dict[int, list] = {number: [] for number, *_ in rules}
        self.first = {number for number, _, _, multiple in rules if not multiple}

    def handle_starttag(self, tag, attrs):
        a: dict[str, str] = {}
        for k, v in attrs:
            a.setdefault(k, v or "")
        last = self.open[-1][0] if self.open else None
        if last and (tag == last and tag in REPEATED or last == "p" and tag in BLOCKS):
            self._close(last)
        parent, around = (self.open[-1][1], self.open[-1][2]) if self.open else (0, 0)
        own, hits = 0, []
        for bit, before, step, number in self.steps:
            if (not before or (parent if step.child else around) & before) and step.fits(tag, a):
                own |= bit
                if number is not None and number not in hits and not (number in self.first and self.values[number]):
                    hits.append(number)
        begun = []
        for number in hits:
            attribute = self.attribute[number]
            if attribute:
                if attribute in a:
                    self.values[number].append(a[attribute])
            else:
                slot = [len(self.text), None]
                self.values[number].append(slot)
                begun.append(slot)
        if tag in VOID:
            for slot in begun:
                slot[1] = slot[0]
        else:
            self.open.append((tag, own, around | own, begun))
            self.count[tag] = self.count.get(tag, 0) + 1

    def handle_endtag(self, tag):
        if self.count.get(tag):
            self._close(tag)

    def _close(self, tag):
        while self.open:
            name, _, _, begun = self.open.pop()
            self.count[name] -= 1
            for slot in begun:
                slot[1] = len(self.text)
            if name == tag:
                return

    def handle_data(self, data):
        self.text.append(data)

    def found(self) -> dict[int, list[str]]:
        read = lambda v: v if isinstance(v, str) else " ".join("".join(self.text[v[0] : v[1]]).split())
        return {number: [read(v) for v in values] for number, values in self.values.items()}


def css_values(html: str, rules: list[tuple[int, list[list[Step]], str | None, bool]]) -> dict[int, list[str]]:
    reader = Selection(rules)
    reader.feed(html)
    reader.close()
    return reader.found()


def xpath_values(root: ElementTree.Element | None, path: str, attribute: str | None) -> list[str]:
    """Values of a simple path; markup that isn't well-formed has none."""
    if root is None:
        return []
    end = re.search(r"/(?:@([\w:-]+)|text\(\))$", path)
    if end:
        path, attribute = path[: end.start()], end[1] or attribute
    if path.startswith("//"):
        path = "." + path
    elif path.startswith("/"):
        name, _, rest = path[1:].partition("/")
        if name not in (root.tag, "*"):
            return []
        path = f"./{rest}" if rest else "."
    found = root.findall(path or ".")
    if attribute:
        return [e.get(attribute) for e in found if e.get(attribute) is not None]
    return [" ".join("".join(e.itertext()).split()) for e in found]


def custom_extraction(pages: DataFrame, rules: list[Extraction], bare_references: bool = True) -> DataFrame:
    """page_id, name, pos, value: the values of each rule in the order of the page; the first alone unless `multiple`.

    css knows tag, *, #id, .class, [attr] with =, ~=, ^=, $=, *=, blanks, > and commas; xpath knows the paths of
    ElementTree, and a last /@name or /text(); regex takes group 1, or the whole match where there is no group. A page is
    read once for all rules. Rules that can't be read raise at once. Null and empty pages have no values; an empty table
    or list of rules gives no rows; repeated pages give repeated rows. Values of css have references decoded, also those
    without a semicolon, as browsers do, unless bare_references is false.
    """
    for r in rules:
        if r.kind not in ("css", "xpath", "regex"):
            raise ValueError(f"rule {r.name!r} has an unknown kind {r.kind!r}")
    css = [(i, compile_selector(r.selector), r.attribute, r.multiple) for i, r in enumerate(rules) if r.kind == "css"]
    paths = [(i, r) for i, r in enumerate(rules) if r.kind == "xpath"]
    patterns = [(i, re.compile(r.selector)) for i, r in enumerate(rules) if r.kind == "regex"]
    for _, r in paths:
        xpath_values(ElementTree.Element("x"), r.selector, r.attribute)

    def of_page(html: str) -> dict[int, list[str]]:
        out = css_values(html if bare_references else closed_references(html), css) if css else {}
        if paths:
            try:
                root = ElementTree.fromstring(html)
            except ElementTree.ParseError:
                root = None
            out |= {i: xpath_values(root, r.selector, r.attribute) for i, r in paths}
        return out | {i: [m[1] or "" if p.groups else m[0] for m in p.finditer(html)] for i, p in patterns}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i, values in sorted(of_page(html or "").items()):
                    rows += [(page, rules[i].name, at, v) for at, v in enumerate(values if rules[i].multiple else values[:1])]
            columns = zip(*rows) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.string()))], names=["page_id", "name", "pos", "value"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, "page_id long, name string, pos int, value string")
