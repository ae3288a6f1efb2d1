"""Operators against brute force on small inputs, with nulls, empties, repeated rows, extra columns and empty tables."""

import hashlib
import zlib

import numpy as np
import pandas as pd
import pytest
from oracle import SF, compare

from sitequarry.llm import exact_dedup, html_text, licenses, near_dedup, neighbours, packing, pieces, quality, queries, sharding, toxicity

LONG = "word another third fourth fifth sixth seventh " * 3000
TEXTS = [None, "", " ", "Hello World", "hello world", "HELLO WORLD!", "Ünï Ä", "ünï Ä", "one two three four five six seven", LONG, LONG + " tail", "Released under the MIT License.", "a b", "a b"]


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns clash with names that operators use inside; the last row occurs twice."""
    rows = [(i, t, "x", 1, i % 3, None) for i, t in enumerate(TEXTS)] + [(len(TEXTS) - 1, TEXTS[-1], "x", 1, 0, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, size long, shard int, node string").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("doc_id < 0")


def sf_documents():
    return pd.read_parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    compare(spark, queries.queries()[name], queries.oracle_sql()[name])


def test_fingerprints_compose():
    a, b = b"abc" * 5000, b"xyz" * 3000
    whole, x, y = exact_dedup.fingerprints([a + b, a, b])
    assert exact_dedup.compose(x, y, len(b)) == whole
    value = [0, 0]
    for byte in b"short text":
        value = [(v * r + byte) % p for v, r, p in zip(value, exact_dedup.BASES, exact_dedup.PRIMES)]
    assert tuple(value) == exact_dedup.fingerprints([b"short text"])[0]
    assert exact_dedup.same(a, a) and not exact_dedup.same(a, a[:-1] + b"!")


def test_exact_groups(docs, none):
    rows = exact_dedup.exact_groups(docs).collect()
    assert len(rows) == len(TEXTS) + 1 and exact_dedup.exact_groups(none).count() == 0
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["keep_id"] == 1 and by[3]["keep_id"] == 4 and by[5]["group_size"] == 1 and by[6]["keep_id"] == 6
    assert by[3]["text_sha256"] == hashlib.sha256(b"hello world").hexdigest()
    assert sum(r["kept"] for r in rows if r["keep_id"] == len(TEXTS) - 1) == 1 and by[12]["group_size"] == 3


def test_collision_is_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "same", lambda a, b: False)
    schema = "doc_id long, fp1 long, fp2 long, n_bytes long, salt int, body binary"
    rows = spark.createDataFrame([(1, 5, 5, 1, -1, b"a"), (2, 5, 5, 1, -1, b"b")], schema).coalesce(1)
    batches = rows.toArrow().to_batches()
    out = [r for b in exact_dedup._compare(iter(batches)) for r in b.to_pylist()]
    assert [r["differs"] for r in out] == [False, True]


def test_sharding(docs, none):
    rows = sharding.shard(docs, n_shards=4).collect()
    assert len(rows) == len(TEXTS) + 1 and sharding.shard(none, n_shards=4).count() == 0
    counts = pd.Series([r["shard"] for r in rows]).value_counts().reindex(range(4), fill_value=0)
    assert counts.max() - counts.min() <= 1
    for s in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    for r in rows:
        t = (TEXTS[r["doc_id"]] or "").encode()
        assert r["size"] == len(t) + 1 and r["text_crc32"] == zlib.crc32(t)


def test_sharding_keeps_groups_together(spark):
    rows = sharding.shard(spark.read.parquet(f"{SF}/documents.parquet")).toPandas()
    text = sf_documents().set_index("doc_id").text
    shards = rows.assign(t=rows.doc_id.map(text)).groupby("t").shard.nunique()
    assert (shards == 1).mean() > 0.95


MIT_TEXT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
BSD_TEXT = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""


def test_licenses_edges(spark, docs, none):
    by = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert licenses.scan(none).count() == 0
    assert (by[0]["n_words"], by[0]["labels"], by[0]["score"]) == (0, "", 0.0)
    assert (by[11]["base_labels"], by[11]["labels"], by[11]["first_word"], by[11]["last_word"]) == ("mit", "mit,mit-notice", 3, 3)
    filler = "some other words of a file " * 30
    cases = {
        "The code was released under the Apache license.": "apache", "Licensed under CC BY 4.0": "cc-by,cc-by-4.0", "licensed under cc by sa 4.0": "cc-by,cc-by-sa-4.0", "licensed under CC BY-NC 4.0": "cc-by,cc-by-nc-4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa-4.0",
        "This library is licensed under the GNU Lesser General Public License version 2.1": "lgpl-2.1", "Licensed under the Apache License,\nVersion 2.0": "apache,apache-2.0",
        MIT_TEXT: "mit-text", filler + MIT_TEXT + filler: "mit-text", BSD_TEXT: "bsd", filler + BSD_TEXT: "bsd", filler: "", "": "",
    }
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(cases.values()))


def test_toxicity(spark, docs, none):
    words = [f"w{i}" for i in range(40)]
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(words, 60).tolist() + (["vile"] if i % 4 == 0 else [])), int(i % 4 == 0)) for i in range(160)]
    table = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = toxicity.score(table, labels).toPandas().merge(pd.DataFrame(rows, columns=["doc_id", "t", "y"]))
    assert (got.predicted == got.y).mean() > 0.95
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    edge = toxicity.score(docs, labels).toPandas()
    assert len(edge) == len(TEXTS) + 1 and edge.score.between(0, 1).all()
    assert toxicity.score(none, labels).count() == 0 and toxicity.score(docs, labels.filter("doc_id < 0")).count() == len(TEXTS) + 1
    assert toxicity.keep_clean(docs, labels).columns == docs.columns


def test_gradients_agree_with_differences():
    net = toxicity.Network(5, 1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(2)
    words, chars, mask = rng.integers(0, 5, (3, 6)), rng.standard_normal((3, 6, toxicity.CHAR_DIM)), np.ones((3, 6))
    mask[0, 4:] = 0
    target = np.array([1.0, 0.0, 1.0])

    def loss():
        x = np.concatenate([net.p["word"][words], chars], 2)
        z = net.run({k: x @ net.p[f"w_{k}"] + net.p[f"b_{k}"] for k in "fb"}, mask)
        return -(target * np.log(toxicity._sigmoid(z)) + (1 - target) * np.log(1 - toxicity._sigmoid(z))).mean()

    g, _ = net.gradients(words, chars, mask, target)
    for k in ("u_f", "u_b", "w_f", "att", "att_v", "out"):
        at = (0,) * net.p[k].ndim
        net.p[k][at] += 1e-5
        up = loss()
        net.p[k][at] -= 2e-5
        assert abs((up - loss()) / 2e-5 - g[k][at]) < 1e-3
        net.p[k][at] += 1e-5


def test_packing(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = packing.pack(docs, window=64).toPandas()
    assert packing.pack(none).count() == 0
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4") for i, x in enumerate(TEXTS)}
    for r in rows.itertuples():
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
    assert rows.length.sum() == sum(map(len, ids.values())) + len(ids[len(TEXTS) - 1])
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 64


def test_encoder_equals_tokenizer():
    import public_tokenizers

    e = packing._Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = [t for t in TEXTS if t] + ["it's I'LL 12345 a1b2", "ΣΑΣ Σ", "a\x1cb \x85 c\xa0d", "İ ŉ ǅ 日本語", "<|endoftext|>a", "é ́x"]
    assert list(e.batch(texts)) == [e.whole(t) for t in texts]


def test_differencing_is_balanced():
    sizes = np.random.default_rng(0).integers(1, 4000, 500).tolist()
    out = packing.windows(sizes, 4096)
    fill = np.bincount(out, weights=sizes)
    assert fill.max() <= 4096 and fill.sum() == sum(sizes) and fill.mean() > 0.9 * 4096
    assert packing.difference([8, 7, 6, 5, 4], 2) in ([0, 1, 1, 0, 0], [1, 0, 0, 1, 1], [0, 0, 1, 1, 1], [1, 1, 0, 0, 0]) or sorted(np.bincount(packing.difference([8, 7, 6, 5, 4], 2), weights=[8, 7, 6, 5, 4])) == [14, 16]


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 16)).astype(np.float32)
    x[5] = x[100]
    x[7] = x[100]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(1000, None, 0), (1100, [0.0] * 16, 0), (1200, [float("nan")] + [1.0] * 15, 0), (1300, [None] + [1.0] * 15, 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node int")
    got = neighbours.search(table).toPandas()
    assert sorted(got.query_id.unique()) == [0, 100, 200, 300, 400, 500]
    hits = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x.astype(float) - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hits += len(set(np.lexsort((np.arange(600), d))[:10]) & set(g.vec_id))
    assert hits >= 0.9 * 60
    assert got[got.query_id == 100].sort_values("rank").vec_id.tolist()[:2] == [5, 7]
    few = neighbours.search(table.filter("vec_id in (0, 1, 2)")).toPandas()
    assert sorted(few.vec_id) == [1, 2]
    assert neighbours.search(table.filter("vec_id < 0")).count() == 0


def test_pieces(spark, docs, none):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, coder = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Lattice(path)
    worth = {i: -np.log(min(-library.get_score(i), 31740) + pieces.MANDELBROT) for i in range(32000) if not library.is_byte(i) and not library.is_control(i)}

    def every(text):
        """All segmentations of a text into pieces, by plain recursion."""
        text = pieces.SPACE + text.replace(" ", pieces.SPACE)

        def rec(at):
            if at == len(text):
                yield 0.0, ()
            for e in range(at + 1, len(text) + 1):
                i = library.piece_to_id(text[at:e])
                if i and not (set(text[at:e]) == {pieces.SPACE} and e - at > 1):
                    for s, rest in rec(e):
                        yield worth[i] + s, (i, *rest)

        return sorted(rec(0), key=lambda x: -x[0])

    texts = ["the cat", "hello world", "abc de", "to to to", "an apple", "", None]
    small = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pieces.encode_documents(small, n_best=4, with_ids=True).collect():
        all_ = every(texts[r["doc_id"]]) if texts[r["doc_id"]] else [(0.0, ())]
        assert np.allclose(r["n_best"], [s for s, _ in all_[:4]])
        by_ids = {x: s for s, x in all_}
        assert np.allclose(r["n_best"], [by_ids[tuple(x)] for x in r["n_best_ids"]]) and len({tuple(x) for x in r["n_best_ids"]}) == len(r["n_best_ids"])
        assert [zlib.crc32(np.array(x, "<u4").tobytes()) for x in r["n_best_ids"]] == r["n_best_crc32"] and r["n_best_ids"][0] == r["ids"]
    out = pieces.encode_documents(docs, with_ids=True).cache()
    assert out.count() == len(TEXTS) + 1 and out.filter("not round_trip").count() == 0 and pieces.encode_documents(none).count() == 0
    back = {r["doc_id"]: r["text"] for r in pieces.decode_documents(out).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    whole = pieces.encode_documents(spark.read.parquet(f"{SF}/documents.parquet"), with_ids=True).toPandas().set_index("doc_id")
    text = sf_documents().set_index("doc_id").text
    assert all(library.encode(text[i] or "") == list(whole.merge_ids[i]) for i in whole.index)
    assert all(library.decode([int(x) for x in whole.ids[i]]) == text[i] for i in whole.index if text[i])


def test_html(spark):
    shell = '<html><body><header>Top</header><div class="bar"><p>Same bar</p></div><article><h1>T{0}</h1><p>a &amp; b<br>c<p>x{0}<p>shared line</p><div class="promo">buy</div><script>var t="</p>";</script></article><div class="comments">no</div><footer>f'
    plain = '<html><body><div class="bar"><p>Same bar</p></div><div><p>own {0}</p></div></body></html>'
    rows = [(i, f"https://h.test/{i}", shell.format(i)) for i in range(8)] + [(i, f"http://p.test/{i}", plain.format(i)) for i in range(10, 20)] + [(30, None, None), (31, "u", ""), (32, "http://q.test/", "<p>unclosed <b>x"), (33, "http://q.test/", "a &lt; b <")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("x", "x")
    got = {r["page_id"]: r["text"] for r in html_text.extract(table).collect()}
    assert got[3] == "T3\n\na & b c\n\nx3\n\nshared line"
    assert got[12] == "own 12"
    assert (got[30], got[31], got[32], got[33]) == ("", "", "unclosed x", "a < b <")
    assert html_text.extract(table.filter("page_id < 0")).count() == 0


@pytest.mark.parametrize("tag", ['<a href="/x?id=login">', '<p data-id="share-3">', '<p title="see class=menu">', '<div data-role="banner" data-class="footer">', "<p title='id=\"nav\"'>"])
def test_html_attribute_names_are_whole(tag):
    assert html_text.read_page(f"<article>{tag}words</article>")[0] == ["words"]
    assert html_text.read_page(f'<article data-role="banner">{tag}words</article>')[0] == ["words"]
    assert html_text.read_page('<div class="x menu"><p>a</p></div><p id=login>b</p><p>c</p>')[0] == ["c"]


def test_html_templates_go_without_lists(spark):
    page = '<html><body><nav><a href="/">Home</a></nav><div class="zz"><p>Follow us</p></div><p>own {0}</p><p>more {0} <b>x</b></p><footer>All rights</footer></body></html>'
    rows = [(i, f"https://h.test/{i}", page.format(i)) for i in range(12)] + [(12, "https://h.test/0", page.format(0)), (13, "https://one.test/", page.format(13))]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, uid long")
    got = {r["page_id"]: r for r in html_text.extract(table, lists=False).collect()}
    assert all(got[i]["text"] == f"own {i}\n\nmore {i} x" and got[i]["n_blocks_removed"] == 3 for i in range(12))
    assert got[12]["text"] == got[0]["text"] and got[13]["text"].startswith("Home") and got[13]["n_blocks_removed"] == 0
    long = "<p>" + "word " * 200_000 + "</p>"
    assert html_text.extract(spark.createDataFrame([(1, "u", long)], "page_id long, url string, html string")).first()["n_chars"] == 999_999


@pytest.mark.parametrize("tag", ['<p title="5" tall">', "<p title=don't>", "<p title=\"don't>", "<p don't>", '<p title="a>b" x=\'c>d\'/>'])
def test_html_stray_quotes(tag):
    assert html_text.read_page(f"<article><p>one</p>{tag}two</p><p>three</p></article>")[0] == ["one", "two", "three"]
    if tag != "<p title=\"don't>":  # by HTML's rules a later quote closes this one
        assert html_text.read_page(f"<article><p>one</p>{tag}two</p><p class=\"c\" id='d'>three</p></article>")[0] == ["one", "two", "three"]
    assert html_text.read_page("<p>one</p><p title=")[0] == ["one"]


def test_html_section_template(spark):
    page = "<html><body>{}<div><p>own {}</p></div></body></html>"
    rows = [(i, f"https://h.test/{'news' if i < 8 else 'shop'}/{i}", page.format("<div><p>News advert</p></div>" if i < 8 else "", i)) for i in range(300)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"own {i}" for i in range(300)}


def components_by_force(texts):
    words = [near_dedup.words_of(t or "") for t in texts]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None for w in words]
    label = list(range(len(texts)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            same = (texts[i] or "") == (texts[j] or "")
            if sets[i] and sets[j]:
                same |= len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8
            if same:
                label[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def test_near_groups(spark, docs, none):
    d = sf_documents()
    rng = np.random.default_rng(0)
    base = [f"b{i}" for i in range(150)]
    copies = []
    for _ in range(60):  # copies of one text: many pairs of them are no links, their common source is
        w = list(base)
        for at in rng.choice(150, rng.integers(0, 6), replace=False):
            w[at] = f"n{rng.integers(1 << 30)}"
        copies.append(" ".join(w))
    texts = d.text.tolist() + copies
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = near_dedup.near_groups(table).toPandas().sort_values("doc_id")
    assert got.class_id.tolist() == components_by_force(texts)
    assert got.groupby("class_id").kept.sum().eq(1).all()
    edge = near_dedup.near_groups(docs).toPandas()
    assert len(edge) == len(TEXTS) + 1 and near_dedup.near_groups(none).count() == 0
    assert edge.set_index("doc_id").class_id.to_dict()[5] == 3 and edge.kept.sum() == edge.class_id.nunique()


def test_near_groups_by_repeated_lines(spark):
    texts = []
    for i in range(80):  # pairs of similarity 86 / 106, whose own lines are repeated
        base = " ".join(f"b{i}x{k}" for k in range(90))
        texts += [base + "\n" + "\n".join([" ".join(f"{own}{i}x{k}" for k in range(6))] * 200) for own in "lr"]
    assert components_by_force(texts) == [i - i % 2 for i in range(160)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = near_dedup.near_groups(table).toPandas().sort_values("doc_id")
    assert got.class_id.tolist() == [i - i % 2 for i in range(160)]


def test_probminhash_estimates_similarity():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 1 << 32, 300).astype(np.uint64), rng.integers(0, 1 << 32, 100).astype(np.uint64)
    owner = np.repeat([0, 1], [400, 300])
    element = np.concatenate([a, b, a])
    s = near_dedup.probminhash(owner, element, np.ones(700), 2, 2048)
    assert abs((s[0] == s[1]).mean() - 0.75) < 0.05


def test_quality(spark, docs, none):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    got = quality.score(table).toPandas().merge(pd.read_parquet(f"{SF}/labels.parquet"))
    assert (got.predicted == got.quality).mean() > 0.9
    edge = quality.score(docs).toPandas()
    assert len(edge) == len(TEXTS) + 1 and edge.score.between(0, 1).all() and quality.score(none).count() == 0
    assert quality.keep_good(docs).columns == docs.columns


def test_quality_of_repeated_text(spark):
    folder = f"{SF}/../sf0.01"  # enough rows to learn from
    table = spark.read.parquet(f"{folder}/documents.parquet")
    d = pd.read_parquet(f"{folder}/documents.parquet").merge(pd.read_parquet(f"{folder}/labels.parquet")[["doc_id", "quality"]].rename(columns={"quality": "keep"}), on="doc_id")
    good = [" ".join(t.split()) for t in d[(d.keep == 1) & d.text.str.len().gt(600)].text[:20]]
    model = quality.fit(table)
    phrases = [" ".join(t.split()[:12] * 400) for t in good]
    lines = ["\n".join([" ".join(t.split()[:40])] * 100) for t in good]
    assert len(good) == 20 and (quality.score_texts(good, model) >= 0.5).all()
    assert (quality.score_texts(phrases, model) < 0.5).all() and (quality.score_texts(lines, model) < 0.5).all()
    alone = [quality.score_texts([t], model)[0] for t in good + phrases]
    assert np.allclose(alone, quality.score_texts(good + phrases, model), atol=1e-5)
    assert quality.votes(np.ones((1, 10))).shape[1] == len(quality.LABELLERS)


def test_expectation_maximisation_finds_the_bad_labeller():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.8
    accuracy = [0.9, 0.85, 0.95, 0.55]
    v = np.stack([np.where(rng.random(4000) < a, truth, ~truth) * 2 - 1 for a in accuracy], 1).astype(np.int8)
    patterns, counts = np.unique(v, axis=0, return_counts=True)
    _, good, table = quality.expectation_maximisation(patterns, counts.astype(float))
    assert abs(good - 0.8) < 0.05 and table[1, 2, 2] > 0.9 and table[1, 3, 2] < 0.7
