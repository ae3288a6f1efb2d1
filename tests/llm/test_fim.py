"""Fill-in-the-middle against a plain loop over lines, with the edges of texts, ids and tables."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sitequarry.llm import fim

TEXTS = [None, "", "\n", "\n\n\n", "one line", "a\nb", "a\nb\n", "ä\r\n😀\n\nß", "has <P> in it\nb", "x <", "<\nS>\n<P", "w\n" * 40_000 + "end", "y" * 300_000, "tie\ntie\ntie\n"]


def plain_lines(text):
    out, line = [], ""
    for c in text:
        line += c
        if c == "\n":
            out.append(line)
            line = ""
    return out + ([line] if line else [])


def slow(text, doc_id, seed=7, rate=100, spm_rate=50):
    lines = plain_lines(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(lines), "plain", None, None, text
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    if h4 % 100 < spm_rate:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a<PSM>\né😀\r ", max_size=40), st.integers(-5, 10**12))
def test_one_text(text, doc_id):
    assert fim.rearranged(text, doc_id, 7, 100, 50) == slow(text, doc_id)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "psm", 3, 7) for i, t in enumerate(TEXTS)] + [(None, "no id\nhere", "x", 1, 1), (5, TEXTS[5], "psm", 3, 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, form string, n long, output long").repartition(3)


def test_table(spark, docs):
    rows = fim.transform(docs).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    want = sorted([(i, *slow(t or "", i)) for i, t in [*enumerate(TEXTS), (None, "no id\nhere"), (5, TEXTS[5])]], key=key)
    assert sorted(map(tuple, rows), key=key) == want
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}
    assert fim.transform(docs.filter("doc_id < 0")).count() == 0


def test_restored(docs):
    for r in fim.digests(docs).collect():
        text = "no id\nhere" if r["doc_id"] is None else TEXTS[r["doc_id"]] or ""
        assert r["restored_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_rates(docs):
    assert {r["form"] for r in fim.transform(docs, rate=0).collect()} == {"plain"}
    assert {r["form"] for r in fim.transform(docs, spm_rate=100).collect()} == {"plain", "spm"}


def test_fixed_digest():
    """A value worked out by hand: sha256 of 7:1."""
    assert fim.draws(1, 7)[0] == 3617640167
