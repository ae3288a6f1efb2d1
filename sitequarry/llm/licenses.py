"""License scan: base phrases, and an exact set-similarity join of text blocks with license notices.

Blocks are overlapping runs of words: for notices of up to L words the 2 L words from every L-th word on, so that a notice
lies whole within a block wherever it stands and however its lines are wrapped. A notice T matches a block B if at least
THRESHOLD of T's distinct words are among B's, and with them the words that tell T from its kin; of matches whose words
include each other's, the largest holds. Words of notices are ordered by their frequency over all documents, rarest
first. Then (prefix) T and B must share one of T's first |T| - need + 1 words; (length) B must hold `need` words of
notices; (positions) the words that follow the shared one in T and in B must suffice. What passes is counted exactly.
Everything runs in DataFrame operations.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitequarry.llm.common import materialise

THRESHOLD = 0.8
#: Phrases whose places are counted, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices (words as the scan sees them), their labels, and words that must be there.
NOTICES = [
    ("apache-2.0", "apache 2", "licensed under the apache license version 2 0"),
    ("apache-2.0", "apache 2 compliance", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3.0", "gnu general 3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-or-later", "gnu general redistribute", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-2.1", "gnu lesser 2 1", "this library is licensed under the gnu lesser general public license version 2 1"),
    ("cc-by-4.0", "cc by 4", "licensed under cc by 4 0"),
    ("cc-by-sa-4.0", "cc by sa 4", "licensed under cc by sa 4 0"),
    ("cc-by-nc-4.0", "cc by nc 4", "licensed under cc by nc 4 0"),
    ("cc-by-4.0", "creative commons attribution 4", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa-4.0", "creative commons attribution sharealike 4", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("mit-notice", "mit", "released under the mit license"),
    ("mit-text", "permission granted charge obtaining", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit-text", "permission granted sublicense", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("isc", "permission granted purpose fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "redistribution binary forms permitted", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "mozilla 2", "this source code form is subject to the terms of the mozilla public license version 2 0"),
]
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Words of the shortest blocks' stride; longer notices take the next power of two that holds them.
LEAST_STRIDE = 8


def lowered(text: Column) -> Column:
    """A-Z in lower case, as far as words of a-z are concerned: the Kelvin sign, the one other letter that lower()
    turns into a-z, is replaced by another non-ASCII letter first."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("é")))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def stride(notice: str) -> int:
    return max(LEAST_STRIDE, 1 << (len(notice.split()) - 1).bit_length())


def notices(order: dict[str, int]) -> list[dict]:
    """Notices with their distinct words in global order, how many must be shared, and the notices that include them."""
    out = []
    for i, (label, must, text) in enumerate(NOTICES):
        tokens = sorted(set(text.split()), key=order.get)
        need = math.ceil(THRESHOLD * len(tokens) - 1e-9)
        larger = [j for j, (_, _, other) in enumerate(NOTICES) if set(tokens) < set(other.split()) and stride(other) == stride(text)]
        out.append({"notice": i, "label": label, "stride": stride(text), "must": must.split(), "tokens": tokens, "need": need, "prefix": tokens[: len(tokens) - need + 1], "larger": larger})
    return out


def _spaces(c: Column) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))) / 2


def _base(joined: Column, n: Column) -> list[Column]:
    """n_base, first_word, last_word, base labels of a text whose every word stands between two blanks of its own."""
    marks = {p: "".join(f" {w} " for w in p.split()) for p in PHRASES}
    has = {p: joined.contains(m) for p, m in marks.items()}
    any_ = F.lit(False)
    for h in has.values():
        any_ = any_ | h
    count = sum((((F.length(joined) - F.length(F.replace(joined, F.lit(m), F.lit("")))) / len(m)).cast("long") for m in marks.values()), F.lit(0))
    back = F.reverse(joined)
    starts = [F.when(has[p], _spaces(F.substring(joined, F.lit(1), F.locate(m, joined) - 1))) for p, m in marks.items()]
    ends = [F.when(has[p], n - len(p.split()) - _spaces(F.substring(back, F.lit(1), F.locate(m[::-1], back) - 1))) for p, m in marks.items()]
    labels = F.array_compact(F.array(*[F.when(has[p], F.lit(label)) for p, label in PHRASES.items()]))
    return [F.when(any_, count).otherwise(0).cast("long").alias("n_base"), F.when(any_, F.least(*starts)).cast("long").alias("first_word"), F.when(any_, F.greatest(*ends)).cast("long").alias("last_word"), F.when(any_, labels).otherwise(F.array().cast("array<string>")).alias("base")]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row per input row.

    Null is empty text: no words, empty labels, score 0. score is 1 with a base phrase, else the largest share of a
    matched notice. Repeated rows are scanned alike. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), lowered(F.col(text_col)).alias("text"))
    vocabulary = sorted({w for _, _, t in NOTICES for w in t.split()})
    # as many rows as notices have words
    frequency = {r["w"]: r["count"] for r in own.select(F.explode(words(F.col("text"))).alias("w")).filter(F.col("w").isin(vocabulary)).groupBy("w").count().collect()}
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
    table = notices(order)
    listed_words = lambda ws: F.array(*[F.lit(w) for w in ws])
    parsed = own.select("doc_id", F.xxhash64("text").alias("h"), words(F.col("text")).alias("words"))
    parsed = parsed.withColumn("joined", F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" "))).withColumn("n_words", F.size("words").cast("long"))
    # a document's words of notices, found in one pass: what they rule out needs no blocks
    parsed = parsed.withColumn("mine", F.array_intersect(listed_words(vocabulary), F.col("words")))
    blocks = []
    for size in sorted({t["stride"] for t in table}):
        group = [t for t in table if t["stride"] == size]
        known = listed_words(sorted({w for t in group for w in t["tokens"]}, key=order.get))
        possible = F.lit(False)
        for t in group:
            possible = possible | ((F.size(F.array_intersect(listed_words(t["tokens"]), F.col("mine"))) >= t["need"]) & (F.size(F.array_intersect(listed_words(t["must"]), F.col("mine"))) == len(t["must"])))
        # array_intersect keeps the order of its first argument: a block's words of notices, in global order
        cut = F.transform(F.sequence(F.lit(1), F.size("words"), F.lit(size)), lambda i: F.array_intersect(known, F.slice("words", i, F.lit(2 * size))))  # noqa: B023
        least = min(t["need"] for t in group)
        own_blocks = F.transform(F.array_distinct(F.filter(cut, lambda t: F.size(t) >= least)), lambda t: F.struct(F.lit(size).alias("stride"), t.alias("block")))  # noqa: B023
        blocks.append(F.when((F.size("mine") >= least) & possible, own_blocks).otherwise(F.array().cast("array<struct<stride:int,block:array<string>>>")))
    rows = materialise(parsed.select("doc_id", "h", "n_words", *_base(F.col("joined"), F.col("n_words")), F.concat(*blocks).alias("blocks")), "license_rows")
    # the notices are a constant of this module
    templates = spark.createDataFrame([(w, p, *(t[c] for c in ("stride", "notice", "label", "tokens", "must", "need", "larger"))) for t in table for p, w in enumerate(t["prefix"])], "token string, p int, stride int, notice int, label string, tokens array<string>, must array<string>, need int, larger array<int>")
    pairs = rows.filter(F.size("blocks") > 0).select("doc_id", "h", F.inline("blocks")).select("doc_id", "h", "stride", "block", F.posexplode("block").alias("q", "token"))
    follow = 1 + F.least(F.size("tokens") - F.col("p") - 1, F.size("block") - F.col("q") - 1)
    near = pairs.join(F.broadcast(templates), ["stride", "token"]).filter((F.size("block") >= F.col("need")) & (follow >= F.col("need")))
    shared = F.size(F.array_intersect("tokens", "block"))
    matched = near.filter((shared >= F.col("need")) & (F.size(F.array_intersect("must", "block")) == F.size("must")))
    per_block = matched.groupBy("doc_id", "h", "stride", "block").agg(F.collect_set(F.struct("notice", "label", "larger", (shared / F.size("tokens")).alias("share"))).alias("m"))
    holds = F.filter("m", lambda x: ~F.arrays_overlap(x["larger"], F.transform("m", lambda y: y["notice"])))
    found = per_block.select("doc_id", "h", F.inline(holds)).groupBy("doc_id", "h").agg(F.collect_set("label").alias("found"), F.max("share").alias("share"))
    has = F.size("base") > 0
    found = found.withColumnsRenamed({"doc_id": "found_id", "h": "found_h"})
    joined = rows.drop("blocks").join(found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("h") == F.col("found_h")), "left")
    listed = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", listed(F.col("base")).alias("base_labels"), listed(F.concat("base", F.coalesce("found", F.array().cast("array<string>")))).alias("labels"),
        F.when(has, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def oracle() -> str:
    """DuckDB SQL for scan() over `documents`: every block is compared with every notice of its size."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    word = "'[0-9a-z\\x{80}-\\x{10FFFF}]+'"
    table = notices({w: i for i, w in enumerate(sorted({w for _, _, t in NOTICES for w in t.split()}))})
    notice_rows = ", ".join(f"({t['notice']}, '{t['label']}', {t['stride']}, {t['tokens']}, {t['must']}, {t['larger']}::INTEGER[])" for t in table)
    strides = sorted({t["stride"] for t in table})
    phrase_rows = ", ".join(f"('{label}', '{''.join(f' {w} ' for w in p.split())}', {len(p.split())})" for p, label in PHRASES.items())
    return f"""
WITH t AS (SELECT doc_id, {lower} AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, {word}) AS words, ' ' || array_to_string(regexp_extract_all(text, {word}), '  ') || ' ' AS joined FROM t),
phrases(label, mark, size) AS (VALUES {phrase_rows}),
places AS (SELECT doc_id, label, string_split(joined, mark) AS parts, size, len(words) AS n FROM w JOIN phrases ON contains(joined, mark)),
base AS (SELECT doc_id, sum(len(parts) - 1) AS n_base, min((length(parts[1]) - length(replace(parts[1], ' ', ''))) // 2) AS first_word,
  max(n - size - (length(parts[-1]) - length(replace(parts[-1], ' ', ''))) // 2) AS last_word, list(label) AS labels FROM places GROUP BY doc_id),
notices(notice, label, stride, tokens, must, larger) AS (VALUES {notice_rows}),
starts AS (SELECT doc_id, words, stride, unnest(range(0, len(words), stride)) AS i FROM w, (SELECT unnest({strides}) AS stride)),
blocks AS (SELECT doc_id, stride, i, list_distinct(words[i + 1:i + 2 * stride]) AS have FROM starts),
hits AS (SELECT doc_id, b.stride, i, notice, label, larger, len(list_intersect(tokens, have)) / len(tokens)::DOUBLE AS share FROM blocks b JOIN notices n ON n.stride = b.stride
  WHERE len(list_intersect(tokens, have)) >= ceil(0.8 * len(tokens) - 1e-9) AND list_has_all(have, must)),
best AS (SELECT doc_id, label, share FROM (SELECT *, list(notice) OVER (PARTITION BY doc_id, stride, i) AS others FROM hits) WHERE NOT list_has_any(larger, others)),
found AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS share FROM best GROUP BY doc_id)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(base.n_base, 0)::BIGINT AS n_base, base.first_word::BIGINT AS first_word, base.last_word::BIGINT AS last_word,
  array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ',') AS labels,
  CASE WHEN base.doc_id IS NOT NULL THEN 1.0::DOUBLE ELSE coalesce(found.share, 0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)
"""
