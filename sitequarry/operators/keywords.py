"""Keyword counts, TF-IDF and content scores of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitequarry.functions import text as T


def keyword_counts(urls: DataFrame, sources: list[str]) -> DataFrame:
    """id, keyword, n: words and neighbouring pairs of each text source; pairs don't cross sources."""
    texts = urls.select("id", F.explode(F.array_compact(F.array(*sources))).alias("t"))
    words = texts.select("id", T.tokens(F.col("t"), T.STOP_WORDS, 3).alias("words"))  # a column of its own: pairs name it six times
    grams = words.select("id", F.explode(T.ngrams(F.col("words"))).alias("keyword"))
    return grams.groupBy("id", "keyword").agg(F.count("*").alias("n"))


def top_keywords(counts: DataFrame, k: int = 50) -> DataFrame:
    """The k keywords of the highest counts, then of most pages, then by name."""
    total = counts.groupBy("keyword").agg(F.sum("n").alias("count"), F.count("*").alias("urls"))
    return total.orderBy(F.desc("count"), F.desc("urls"), "keyword").limit(k)


def keywords_per_url(counts: DataFrame, k: int = 10) -> DataFrame:
    w = Window.partitionBy("id").orderBy(F.desc("n"), "keyword")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("id", "keyword", F.col("n").alias("count"), "rank")


def tfidf(urls: DataFrame, sources: list[str], k: int = 100, least: int = 2) -> DataFrame:
    """keyword, count, tfidf of the k most frequent terms: round(tf * (ln(N / df) + 1) * 1000, 4)."""
    text = F.concat_ws(" ", *sources)
    words = urls.select("id", F.explode(F.filter(T.tokens(text, T.SITE_WORDS, 3, "'-"), lambda w: ~w.rlike("^[0-9]+$"))).alias("keyword"))
    per_page = words.groupBy("id", "keyword").agg(F.count("*").alias("n"))
    terms = per_page.groupBy("keyword").agg(F.sum("n").alias("count"), F.count("*").alias("df"))
    totals = terms.agg(F.sum("count").alias("all")).join(urls.agg(F.count("*").alias("docs")))  # one row
    score = F.round(F.col("count") / F.col("all") * (F.log(F.col("docs") / F.col("df")) + 1) * 1000, 4)
    return terms.join(F.broadcast(totals)).select("keyword", "count", score.alias("tfidf")).filter(F.col("count") >= least).orderBy(F.desc("count"), F.desc("tfidf"), "keyword").limit(k)


def word_count_score(n: Column) -> Column:
    return F.when(n >= 1200, 100).when(n >= 900, 90).when(n >= 600, 80).when(n >= 300, 65).when(n >= 150, 40).when(n > 0, 20).otherwise(0)


def density_score(d: Column) -> Column:
    return F.when((d >= 1) & (d <= 2.5), 100).when((d > 2.5) & (d <= 4), 70).when(d > 4, 40).when(d > 0, 50).otherwise(30)


def content_score(pages: DataFrame, keyword: str | None = None) -> DataFrame:
    """id, score, keyword_density, headings, readability, suggestions.

    pages: id, text, word_count, h1, h1_count, h2_count, title1, meta_description1. Without a keyword its part is 0.
    """
    rows = pages.withColumn("words", T.tokens(F.col("text"), T.COMMON_WORDS, 2, "'-")).withColumn("n", F.size("words"))
    h1, h2, count = F.coalesce("h1_count", F.lit(0)), F.coalesce("h2_count", F.lit(0)), F.coalesce("word_count", F.lit(0))
    wanted = (keyword or "").lower().strip()
    hits = F.size(F.filter("words", lambda w: w.contains(wanted)))
    density = F.when(F.col("n") > 0, F.round(100 * hits / F.col("n"), 2)).otherwise(0.0) if wanted else F.lit(0.0)
    density_part = density_score(density) if keyword else F.lit(0)
    begins = F.lower("h1").contains(F.substring(F.lower("title1"), 1, 20))
    headings = F.least(F.lit(100), F.when(h1 > 0, 35).otherwise(0) + F.when(h1 == 1, 15).otherwise(0) + F.when(h2 >= 2, 30).otherwise(0) + F.when(h2 >= 1, 10).otherwise(0) + F.when((F.length("h1") > 0) & (F.length("title1") > 0) & begins, 10).otherwise(0))
    sentences = F.greatest(F.lit(1), F.size(F.filter(F.split("text", "[.!?]+"), lambda s: F.length(F.trim(s)) > 0)))
    letters = F.length(F.array_join("words", ""))
    ease = 100 - (F.col("n") / sentences - 10) * 3 - (letters / F.col("n") - 4.5) * 10
    readability = F.when(F.col("n") == 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), T.half_up(ease))))
    rows = rows.select("id", count.alias("count"), density.alias("keyword_density"), density_part.alias("dp"), headings.alias("headings"), readability.cast("long").alias("readability"), h1.alias("n1"), h2.alias("n2"), F.col("meta_description1").alias("meta"))
    score = T.half_up(word_count_score(F.col("count")) * 0.35 + F.col("dp") * 0.25 + F.col("headings") * 0.25 + F.col("readability") * 0.15)
    advice = [
        ("more_content", F.col("count") < 300), ("longer_content", (F.col("count") >= 300) & (F.col("count") < 600)), ("raise_density", F.lit(bool(keyword)) & (F.col("keyword_density") < 0.5)), ("lower_density", F.lit(bool(keyword)) & (F.col("keyword_density") > 4)),
        ("add_h1", F.col("n1") == 0), ("single_h1", F.col("n1") > 1), ("add_h2", F.col("n2") == 0), ("better_headings", F.col("headings") < 60), ("simpler_language", F.col("readability") < 50), ("add_meta_description", F.coalesce("meta", F.lit("")) == ""),
    ]
    return rows.select("id", score.cast("long").alias("score"), "keyword_density", F.col("headings").cast("long").alias("headings"), "readability", F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(a)) for a, c in advice])), ",").alias("suggestions"))
