"""Findings kept up to date page by page: what a page that arrives changes in the findings of others.

The store holds page versions, counts of shared values, references from page to page, and findings of references. Each is
parted by a bucket of its key and by batch, and a batch reads the buckets of the keys that it touches only. Shared values
are counted by what a batch adds and takes away, so a value that a third of all pages hold costs one row. A reference is
judged again when its source or what is known of its target changes. Nothing is updated in place: newer rows hold, and a
batch that runs again replaces its own rows and reads older ones only, so a retried batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sitequarry.functions import urls as U
from sitequarry.operators import rules
from sitequarry.operators.scratch import discard, materialise

PAGE = "id long, run_host string, address string, status_code int, title1 string, meta_description1 string, h1 string, hash string, canonical string, rel_next string, rel_prev string"
COLUMNS = [c.split()[0] for c in PAGE.split(", ")]
TABLES = {
    "urls": f"{PAGE}, bucket int, batch long",
    "counts": "kind string, run_host string, value string, pages long, bucket int, batch long",
    "refs": "kind string, target string, id long, address string, live boolean, bucket int, batch long",
    "findings": "kind string, target string, id long, address string, issues array<struct<category:string,type:string,priority:string,value:string>>, bucket int, batch long",
}
#: Shared values: column -> category, type, priority, and whether case and blanks count.
SHARED = {"title1": ("page-titles", "duplicate_title", "medium", False), "meta_description1": ("meta-description", "duplicate_meta_description", "medium", False), "h1": ("headings", "duplicate_h1", "medium", False), "hash": ("content", "exact_duplicate_content", "high", True)}
#: Buckets of every table: a batch reads at most so many folders of each.
BUCKETS = 64


def _bucket(buckets: int, *keys: str | Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _exists(spark: SparkSession, place: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _write(rows: DataFrame, folder: str, table: str, batch: int) -> None:
    names = [f.split()[0] for f in TABLES[table].replace("array<struct<category:string,type:string,priority:string,value:string>>", "x").split(", ")]
    rows.withColumn("batch", F.lit(batch).cast("long")).select(*names).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{folder}/{table}")


def read(spark: SparkSession, folder: str, table: str, before: int | None = None, touched: DataFrame | None = None) -> DataFrame:
    """Rows of a table, of batches before one, in the buckets that another table's rows have (at most BUCKETS numbers)."""
    place = f"{folder}/{table}"
    if not _exists(spark, place):
        return spark.createDataFrame([], TABLES[table])
    rows = spark.read.schema(TABLES[table]).parquet(place)
    if before is not None:
        rows = rows.filter(F.col("batch") < before)
    if touched is not None:
        rows = rows.filter(F.col("bucket").isin([r[0] for r in touched.select("bucket").distinct().collect()]))
    return rows


def _newest(rows: DataFrame, *keys: str) -> DataFrame:
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("v")).select(*keys, "v.*")


def shared_values(pages: DataFrame, buckets: int) -> DataFrame:
    """id, kind, run_host, value, bucket: what pages could share with others of their site."""
    made = [F.when(~rules._blank(c), F.struct(F.lit(c).alias("kind"), (F.col(c) if exact else F.lower(F.trim(c))).alias("value"))) for c, (*_, exact) in SHARED.items()]
    rows = pages.select("id", "address", "run_host", F.inline(F.array_compact(F.array(*made))))
    return rows.withColumn("bucket", _bucket(buckets, "kind", "run_host", "value"))


def references(pages: DataFrame, buckets: int) -> DataFrame:
    """kind, target, id, address, bucket: references of pages. A page without canonical refers to itself as `none`."""
    kinds = {"canonical": "canonical", "next": "rel_next", "prev": "rel_prev"}
    made = [F.when(~rules._blank(c), F.struct(F.lit(k).alias("kind"), F.trim(c).alias("target"))) for k, c in kinds.items()]
    made.append(F.when(rules._blank("canonical"), F.struct(F.lit("none").alias("kind"), F.col("address").alias("target"))))
    rows = pages.select("id", "address", F.inline(F.array_compact(F.array(*made))))
    return rows.withColumn("bucket", _bucket(buckets, _place("target", F.col("kind"))))


def _place(c: str, kind: Column) -> Column:
    """What a reference of a kind is looked up by: canonicals in normal form, neighbours as they are."""
    return F.when(kind.isin("canonical", "none"), F.coalesce(U.normalize(F.col(c)), F.col(c))).otherwise(F.col(c))


def _judged(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """References with the issues that follow from the newest known pages (`targets`)."""
    known = F.max_by(F.struct("status_code", "rel_next", "rel_prev"), "id").alias("page")
    normal = targets.groupBy(F.coalesce(U.normalize(F.col("address")), F.col("address")).alias("place")).agg(known).select("place", F.lit(True).alias("normal"), "page")
    plain = targets.groupBy(F.col("address").alias("place")).agg(known).select("place", F.lit(False).alias("normal"), "page")
    rows = refs.withColumns({"place": _place("target", F.col("kind")), "normal": F.col("kind").isin("canonical", "none")}).join(normal.unionByName(plain), ["place", "normal"], "left")
    rows = rows.withColumns({"resolved": F.col("place"), "crawled": F.col("page").isNotNull(), "target_status": F.col("page.status_code")})
    by_kind = {"canonical": rules.canonical_rules(), "next": rules.next_rules(), "prev": rules.prev_rules(), "none": [rules.Rule("canonicals", "missing_canonical", "medium", F.lit(True))]}
    made = [
        F.when((F.col("kind") == k) & r.when, F.struct(F.lit(r.category).alias("category"), F.lit(r.type).alias("type"), F.lit(r.priority).alias("priority"), (F.lit(None) if r.value is None else r.value).cast("string").alias("value")))
        for k, some in by_kind.items() for r in some
    ]
    return rows.select("kind", "target", "id", "address", "bucket", F.array_compact(F.array(*made)).alias("issues"))


def take_in(batch: DataFrame, number: int, folder: str, buckets: int = BUCKETS) -> None:
    """Store a batch of pages and bring the findings that it touches up to date.

    Of rows of one id in a batch the greatest by all columns in order counts; a later batch replaces an earlier version of
    a page. An id keeps its address. Other columns are not read; an empty batch changes nothing.
    """
    spark = batch.sparkSession
    rows = batch.select(*[F.col(c).cast(f.split()[1]).alias(c) for c, f in zip(COLUMNS, PAGE.split(", "))]).filter("id is not null and address is not null")
    pages = rows.groupBy("id").agg(F.max(F.struct(*COLUMNS[1:])).alias("v")).select("id", "v.*").withColumn("bucket", _bucket(buckets, F.coalesce(U.normalize(F.col("address")), F.col("address"))))
    pages = materialise(pages, "batch_pages")
    older = read(spark, folder, "urls", number, pages).join(pages.select("id"), "id", "left_semi")
    old = materialise(_newest(older, "id").select(*COLUMNS, "bucket"), "old_pages")

    have, had = shared_values(pages, buckets), shared_values(old, buckets)
    key = ["id", "kind", "run_host", "value"]
    delta = have.join(had, key, "left_anti").withColumn("more", F.lit(1)).unionByName(had.join(have, key, "left_anti").withColumn("more", F.lit(-1)))
    delta = materialise(delta.groupBy("kind", "run_host", "value", "bucket").agg(F.sum("more").alias("more")), "count_changes")
    before = _newest(read(spark, folder, "counts", number, delta), "kind", "run_host", "value").select("kind", "run_host", "value", "pages")
    _write(delta.join(before, ["kind", "run_host", "value"], "left").withColumn("pages", F.coalesce("pages", F.lit(0)) + F.col("more")), folder, "counts", number)

    key = ["kind", "target", "id"]
    now, was = references(pages, buckets), references(old, buckets)
    gone = was.join(now, key, "left_anti")
    own = materialise(now.withColumn("live", F.lit(True)).unionByName(gone.withColumn("live", F.lit(False))), "own_refs")
    # targets whose status or neighbours are new: by both names under which references look them up
    seen = ["id", "address", "status_code", "rel_next", "rel_prev"]
    same = F.col("p.id") == F.col("o.id")
    for c in seen[1:]:
        same = same & F.col(f"p.{c}").eqNullSafe(F.col(f"o.{c}"))
    changed = pages.select(*seen).alias("p").join(old.select(*seen).alias("o"), same, "left_anti")
    names = materialise(changed.select(F.explode(F.array_distinct(F.array("address", F.coalesce(U.normalize(F.col("address")), F.col("address"))))).alias("place")).distinct().withColumn("bucket", _bucket(buckets, "place")), "changed_targets")
    others = read(spark, folder, "refs", number, names)
    others = others.withColumn("place", _place("target", F.col("kind"))).join(names.select("place"), "place", "left_semi")
    others = _newest(others, *key).filter("live").select(*key, "address", "bucket").join(own, key, "left_anti")
    again = materialise(own.filter("live").select(*key, "address", "bucket").unionByName(others), "refs_to_judge")
    # what is known of their targets: stored pages lie in the bucket of the normal form of their address
    wanted = again.select(F.coalesce(U.normalize(F.col("target")), F.col("target")).alias("place")).distinct().withColumn("bucket", _bucket(buckets, "place"))
    known = read(spark, folder, "urls", number, wanted).select(*COLUMNS, "batch").unionByName(pages.select(*COLUMNS, F.lit(number).cast("long").alias("batch")))
    judged = _judged(again, _newest(known, "id"))
    _write(own, folder, "refs", number)
    _write(judged.unionByName(gone.withColumn("issues", F.expr("cast(array() as array<struct<category:string,type:string,priority:string,value:string>>)"))), folder, "findings", number)
    _write(pages, folder, "urls", number)
    for t in (pages, old, delta, own, names, again):
        discard(t)


def current_pages(spark: SparkSession, folder: str) -> DataFrame:
    return _newest(read(spark, folder, "urls"), "id").select(*COLUMNS)


def current_findings(spark: SparkSession, folder: str, buckets: int = BUCKETS) -> DataFrame:
    """All findings that hold now: of shared values and of references."""
    counts = _newest(read(spark, folder, "counts"), "kind", "run_host", "value").filter("pages > 1").select("kind", "run_host", "value", "pages")
    about = F.create_map(*[F.lit(x) for c, (category, kind, priority, _) in SHARED.items() for x in (c, f"{category} {kind} {priority}")])
    words = F.split(about[F.col("kind")], " ")
    shared = shared_values(current_pages(spark, folder), buckets).join(counts, ["kind", "run_host", "value"])
    shared = shared.select(F.col("id").alias("url_id"), F.col("address").alias("url"), words[0].alias("category"), words[1].alias("type"), words[2].alias("priority"), F.col("pages").cast("string").alias("value"))
    judged = _newest(read(spark, folder, "findings"), "kind", "target", "id")
    return shared.unionByName(judged.select(F.col("id").alias("url_id"), F.col("address").alias("url"), F.inline("issues")))


def keep_findings(pages: DataFrame, folder: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """A stream of pages into the store; current_findings() is then what the batch rules find on the newest pages."""
    return pages.writeStream.foreachBatch(lambda batch, number: take_in(batch, number, folder, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
