"""Fill-in-the-middle: texts cut at two line ends and put into the order in which a model is to learn the gap.

One `fullmatch` of repeated lines keeps every repetition of its group: the ends of the captures count the lines and hold
both offsets at which the text is cut. Where to cut and how to order depend on the document's id alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitequarry.llm.words import text_slices

#: Lines with their ends. Each line and the whole run are matched without going back, so a text costs one pass.
LINES = regex.compile(r"((?>[^\n]*\n|[^\n]+))*+")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
COLUMNS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers of a document: two cuts, whether it is cut at all, which order. A null id is empty."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def rearranged(text: str, doc_id: int | None, seed: int, rate: int, spm_rate: int) -> tuple[int, str, int | None, int | None, str]:
    """Lines, form, characters of prefix and middle, and output of one text."""
    ends = LINES.fullmatch(text).ends(1)
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = (ends[cut - 1] if cut else 0 for cut in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_rate:
        return n, "spm", a, b - a, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", a, b - a, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: one row for each row of docs, repeated rows too.

    `rate` percent of the documents are cut, `spm_rate` percent of these start with the suffix. Null and empty texts and
    texts that hold a mark stay plain; their lines are counted all the same. Null ids draw as the empty id. Very long texts
    are matched whole: the ends of a text's lines are its only extra memory. An empty table gives none; other columns are
    not read, whatever their names. No row moves between tasks, so a lost executor costs its own tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for start, texts in text_slices(batch.column(1)):
                rows = [rearranged(t, i, seed, rate, spm_rate) for t, i in zip(texts, ids[start : start + len(texts)])]
                n, form, prefix, middle, output = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(ids[start : start + len(texts)], pa.int64()), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, COLUMNS)


def restored(output: Column, form: Column) -> Column:
    """The text from output and form, by the marks alone: no text that is cut holds one, so each occurs once."""
    part = lambda text, mark, i: F.split_part(text, F.lit(mark), F.lit(i))
    psm = F.concat(part(part(output, SUFFIX, 1), PREFIX, 2), part(output, MIDDLE, 2), part(part(output, SUFFIX, 2), MIDDLE, 1))
    spm = F.concat(part(part(output, PREFIX, 2), MIDDLE, 1), part(output, MIDDLE, 2), part(part(output, PREFIX, 1), SUFFIX, 2))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digests(docs: DataFrame, **how) -> DataFrame:
    """The transformation with digests in place of texts; the second one is of the text that the output gives back."""
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    rows = transform(docs, **how)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


#: A line feed splits the text; unit k ends after the k-th of them, or with the text.
ORACLE = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, string_split(t, chr(10)) AS parts, ends_with(t, chr(10)) AS closed, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM t),
n AS (SELECT *, CASE WHEN t = '' THEN 0 WHEN closed THEN len(parts) - 1 ELSE len(parts) END AS n FROM u),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS plain FROM n),
e AS (SELECT *, CASE WHEN a = 0 THEN 0 WHEN a = n THEN length(t) ELSE length(array_to_string(parts[1:a], chr(10))) + 1 END AS x, CASE WHEN b = 0 THEN 0 WHEN b = n THEN length(t) ELSE length(array_to_string(parts[1:b], chr(10))) + 1 END AS y FROM c),
f AS (SELECT *, CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form, substr(t, 1, x) AS p, substr(t, x + 1, y - x) AS m, substr(t, y + 1) AS s FROM e)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN NOT plain THEN x::BIGINT END AS prefix_chars, CASE WHEN NOT plain THEN (y - x)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM f
"""
