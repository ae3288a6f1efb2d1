"""Secrets in texts: plain patterns, and credentials whose parts stand apart.

Plain patterns (assignments, access ids, hex runs) are reported wherever they match. Weaker candidates, such as a user
name, a random-looking string or an address of a service, mean nothing alone: they are reported only where complementary
parts stand in one scope. Candidates become rows with the interval of text in which a partner may stand, and an interval
join by cells of that text finds the partners; a cell holds a bounded number of candidates however long the text is.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitequarry.llm.common import materialise
from sitequarry.llm.words import text_slices

# The base patterns and the least length of a match or of its group. A run of one class is matched whole, so
# its least length can stand in the pattern; an assignment that is too short still uses up its text.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
BASE = [("assign", ASSIGN, 1, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24)]

#: Kinds in the order in which spans of one start are listed.
KINDS = ["assign", "access", "hex", "identifier", "key", "endpoint"]
#: Weak candidate -> kinds that complete it. A hex run near an address is as likely a version as a secret.
PARTNERS = {"identifier": ["assign", "hex", "key"], "key": ["access", "identifier", "endpoint"], "endpoint": ["assign", "key"]}
#: A partner stands at most so many characters away and in the same paragraph (no empty line between).
REACH = 400

_SET = r"""["']?[ \t]*(?:[:=]|=>)[ \t]*["']?"""
IDENTIFIER = re.compile(rf"(?<![A-Za-z0-9])(?:access_?key_?id|client_?id|tenant_?id|account(?:_?(?:id|name))?|user(?:_?(?:id|name))?|login|key_?id|app_?id){_SET}([A-Za-z0-9@._+-]{{3,}})", re.IGNORECASE | re.ASCII)
NAMED_KEY = re.compile(rf"(?<![A-Za-z0-9])(?:pwd|pass|passphrase|secret_?key|private_?key|access_?key|auth_?key|signing_?key|credentials?){_SET}([^\s\"'<>,;]{{6,}})", re.IGNORECASE | re.ASCII)
RANDOM_KEY = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/=_-])")
ENDPOINT = re.compile(rf"(?<![A-Za-z0-9])[a-z][a-z0-9+.-]{{1,20}}://[^\s\"'<>]+|(?<![A-Za-z0-9])(?:host(?:name)?|server|endpoint|database_?url|base_?url){_SET}[A-Za-z0-9._:/-]{{4,}}", re.ASCII)
EMPTY_LINE = re.compile(r"\n[ \t\r]*\n")

SPAN = "struct<kind:int,start:long,end:long,low:long,high:long,weak:boolean>"
FOUND = f"uid long, doc_id long, counts array<long>, spans array<{SPAN}>"


def _random(token: str) -> bool:
    """Whether a token mixes cases and digits as random strings do, changing class often."""
    kinds = ["a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "" for c in token]
    return len({k for k in kinds if k}) == 3 and sum(a != b for a, b in zip(kinds, kinds[1:])) * 3 > len(kinds)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the plain patterns, kind as its place in KINDS."""
    out = []
    for kind, (_, pattern, group, least) in enumerate(BASE):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return out


def weak_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates outside the base spans; of overlapping ones the first, named before random."""
    found = [(KINDS.index("identifier"), *m.span()) for m in IDENTIFIER.finditer(text)]
    found += [(KINDS.index("key"), *m.span()) for m in NAMED_KEY.finditer(text)]
    found += [(KINDS.index("endpoint"), *m.span()) for m in ENDPOINT.finditer(text)]
    found += [(KINDS.index("key"), *m.span()) for m in RANDOM_KEY.finditer(text) if _random(m.group())]
    taken = sorted((a, b) for _, a, b in base)
    starts, ends = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    out, end = [], 0
    for kind, a, b in sorted(found, key=lambda x: (x[1], x[0], -x[2])):
        before = bisect_left(starts, b)  # base spans that begin before this one ends
        if a >= end and (not before or ends[before - 1] <= a):
            out.append((kind, a, b))
            end = b
    return out


def candidates(text: str) -> tuple[list[int], list[tuple]]:
    """Counts of the base kinds, and all spans with the scope of each: REACH around it, cut at empty lines."""
    base = base_spans(text)
    spans = [(*s, False) for s in base] + [(*s, True) for s in weak_spans(text, base)]
    counts = [sum(k == kind for k, _, _ in base) for kind in range(len(BASE))]
    if not any(weak for *_, weak in spans):
        return counts, [(k, a, b, a, b, weak) for k, a, b, weak in sorted(spans, key=lambda x: (x[1], x[0]))]
    out = []
    for kind, a, b, weak in sorted(spans, key=lambda x: (x[1], x[0])):
        before, after = text[max(0, a - REACH) : a], text[b : b + REACH]
        cut = max((m.end() for m in EMPTY_LINE.finditer(before)), default=0)
        stop = EMPTY_LINE.search(after)
        out.append((kind, a, b, a - len(before) + cut, b + (stop.start() if stop else len(after)), weak))
    return counts, out


def spans_of(docs: DataFrame) -> DataFrame:
    """uid, doc_id, counts, spans: what one pass over the whole texts finds. uid tells repeated rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("weak", pa.bool_())]))
        names = ["kind", "start", "end", "low", "high", "weak"]
        for batch in batches:
            for start, texts in text_slices(batch.column(2)):
                counts, spans = zip(*map(candidates, texts))
                part = lambda i: batch.column(i).slice(start, len(texts))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([part(0), part(1), pa.array(counts, pa.list_(pa.int64())), pa.array([[dict(zip(names, s)) for s in row] for row in spans], kind)], names=["uid", "doc_id", "counts", "spans"])

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, FOUND)


def linked(found: DataFrame) -> DataFrame:
    """uid, kind, start, end of the weak candidates that a complementary part completes.

    Both intervals, the scope of the candidate and the place of the partner, are cut into cells of REACH characters; equal
    cells of a text join. The scope spans at most four cells unless the candidate itself is longer, and a cell holds at
    most REACH / 3 candidates, so pairs grow with the candidates, not with their square.
    """
    spans = found.filter(F.exists("spans", lambda s: s["weak"])).select("uid", F.explode("spans").alias("s")).select("uid", "s.*")
    index = {k: i for i, k in enumerate(KINDS)}
    wanted = F.map_from_arrays(F.array(*[F.lit(index[k]) for k in PARTNERS]), F.array(*[F.array(*[F.lit(index[p]) for p in v]) for v in PARTNERS.values()]))
    weak = spans.filter("weak").select("uid", "kind", "start", "end", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / REACH), F.floor(F.col("high") / REACH))).alias("cell"))
    parts = spans.select(F.col("uid").alias("uid2"), F.col("kind").alias("kind2"), F.col("start").alias("start2"), F.col("end").alias("end2"), F.floor(F.col("start") / REACH).alias("cell2"))
    inside = (F.col("start2") >= F.col("low")) & (F.col("end2") <= F.col("high"))
    match = (F.col("uid") == F.col("uid2")) & (F.col("cell") == F.col("cell2")) & inside & F.array_contains(wanted[F.col("kind")], F.col("kind2"))
    return weak.join(parts, match, "left_semi").select("uid", "kind", "start", "end").distinct()


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base, spans: one row for each row of docs, repeated rows too.

    base and spans are arrays of (kind, start, end) by start and kind, in code points, end exclusive; spans hold the base
    ones and the linked ones. Null and empty texts have none, null ids are kept, an empty table gives none, other columns
    are not read. Whole texts are searched, however long; a long text's candidates are spread by cells of it. The spans of
    all rows are written once, without texts, so that uid stays the same when an executor is lost.
    """
    found = materialise(spans_of(docs), "spans")
    named = lambda s: F.struct(F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    base = F.transform(F.filter("spans", lambda s: ~s["weak"]), named)
    more = linked(found).groupBy("uid").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
    order = lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(F.when(a["kind"] < b["kind"], -1).when(a["kind"] > b["kind"], 1).otherwise(0))
    plain = F.transform(F.filter("spans", lambda s: ~s["weak"]), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    both = F.array_sort(F.concat(plain, "more"), order)
    rows = found.join(more, "uid", "left")
    return rows.select("doc_id", *[F.col("counts")[i].alias(f"n_{k}") for i, (k, *_) in enumerate(BASE)], base.alias("base"), F.when(F.col("more").isNull(), base).otherwise(F.transform(both, named)).alias("spans"))


def digests(docs: DataFrame) -> DataFrame:
    """The scan with spans as text: kind:start:end, comma-joined."""
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scan(docs).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))
