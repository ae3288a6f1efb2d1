"""The pipeline's stages on the small tables: columns stay, decisions take effect, the last stage packs what is left."""

import pandas as pd
from oracle import SF
from test_operators import components_by_force

import corpus_pipeline


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs.toPandas()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert docs.columns == columns
        kept.append(docs.toPandas())
    sizes = [len(k) for k in kept]
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > sizes[1] and sizes[-1] > 0
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    good = labels[(labels.quality == 1)]
    assert good.doc_id.isin(kept[1].doc_id).mean() > 0.9
    assert not kept[3].text.str.lower().duplicated().any()
    before = kept[3].sort_values("doc_id")
    assert len(kept[4]) == len(set(components_by_force(before.text.tolist())))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert set(packed.doc_id) == set(kept[4].doc_id)


def test_repeated_rows_are_kept_once(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, "a b c d e f g", "en", "s", 13)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.without_copies(spark, docs, SF)
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 2] and out.columns == docs.columns


def test_names_that_clash_and_ties(spark):
    rows = [(1, "a b c d e f", 7, "y"), (1, "a b c d e f", 7, "x"), (2, None, 7, "z"), (3, "", 7, "z"), (None, "g h i j k l", 7, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _raw long, key_id0 string")
    for stage in (corpus_pipeline.without_copies, corpus_pipeline.without_near_copies):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        got = sorted((r["doc_id"] or 0, r["key_id0"]) for r in out.collect())
        assert (1, "x") in got and (0, "z") in got and len(got) == 3
    assert corpus_pipeline.without_copies(spark, docs.filter("doc_id = 9"), SF).count() == 0
