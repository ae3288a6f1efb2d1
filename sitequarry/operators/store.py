"""Stored tables of audits: appends by run and batch, versions of runs, keyed updates, text dumps.

A store is a folder with one Parquet table for each kind of row, parted by run and batch. A batch that is written again
replaces itself, so a job that is retried changes nothing. Nothing is updated in place: a newer version is appended, and
readers take the newest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, MapType, StructType

from sitequarry.operators import runs

COUNTERS = ("found", "crawled", "errors", "redirects")


def append(rows: DataFrame, store: str, table: str, run: int, batch: int = 0) -> None:
    """Add the rows of one batch of a run; extra columns are kept, own columns named like the two keys are replaced."""
    keyed = rows.withColumn("crawl_run_id", F.lit(run).cast("long")).withColumn("batch", F.lit(batch).cast("long"))
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("crawl_run_id", "batch").parquet(f"{store}/{table}")


def read(spark: SparkSession, store: str, table: str, run: int | None = None) -> DataFrame:
    """All rows of a table, or those of one run: a partition filter."""
    rows = spark.read.parquet(f"{store}/{table}").withColumn("crawl_run_id", F.col("crawl_run_id").cast("long")).withColumn("batch", F.col("batch").cast("long"))
    return rows if run is None else rows.filter(F.col("crawl_run_id") == run)


def newest(rows: DataFrame, *keys: str) -> DataFrame:
    """Of each key the row of the highest batch."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("v")).select(*keys, "v.*")


def save_run(spark: SparkSession, store: str, run: int, version: int, name: str, status: str, started_at: str) -> None:
    """A version of a run's own row, with counters taken from its stored pages (0 before there are any)."""
    row = spark.createDataFrame([(name, status, started_at)], "name string, status string, started_at string").withColumn("started_at", F.col("started_at").cast("timestamp"))
    if version == 0:
        counted = row.withColumns({c: F.lit(0).cast("long") for c in COUNTERS})
    else:
        urls = read(spark, store, "urls", run)
        found = urls.withColumn("run_host", F.lit(name)).transform(runs.counters)
        counted = row.join(found.drop("run_host"), F.lit(True), "left").na.fill(0, list(COUNTERS))
    append(counted, store, "runs", run, version)


def all_runs(spark: SparkSession, *stores: str) -> DataFrame:
    """The newest version of every run of all stores, with its store; order by started_at for the newest first."""
    out = None
    for s in stores:
        part = newest(read(spark, s, "runs"), "crawl_run_id").withColumn("store", F.lit(s))
        out = part if out is None else out.unionByName(part)
    return out


def totals(found: DataFrame) -> DataFrame:
    """One row: runs, and the sums of their counters."""
    return found.agg(F.count("*").alias("runs"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS])


def updated(rows: DataFrame, changes: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """A new version of the rows: values that a change (key, some columns) holds replace the old, null ones don't.

    Of several changes of one key the last by `order` counts; without it, changes must have distinct keys. Changes
    without a row are ignored.
    """
    fields = [c for c in changes.columns if c not in (key, order)]
    if order is not None:
        changes = changes.groupBy(key).agg(F.max_by(F.struct(*fields), order).alias("new"))
    else:
        changes = changes.select(key, F.struct(*fields).alias("new"))
    both = rows.alias("r").join(changes.alias("c"), F.col(f"r.{key}") == F.col(f"c.{key}"), "left")
    return both.select(*[F.coalesce(F.col(f"c.new.{c}"), F.col(f"r.{c}")).alias(c) if c in fields else F.col(f"r.{c}") for c in rows.columns])


def as_text(rows: DataFrame) -> DataFrame:
    """Rows for stores without nested types: lists, maps and structs as JSON, truth as 0 or 1."""
    out = []
    for f in rows.schema:
        if isinstance(f.dataType, (ArrayType, MapType, StructType)):
            out.append(F.to_json(f.name).alias(f.name))
        else:
            out.append(F.col(f.name).cast("int").alias(f.name) if isinstance(f.dataType, BooleanType) else F.col(f.name))
    return rows.select(*out)


def from_text(rows: DataFrame, schema: StructType) -> DataFrame:
    """Typed rows of such a dump; JSON that can't be read is null."""
    out = []
    for f in schema:
        if isinstance(f.dataType, (ArrayType, MapType, StructType)):
            out.append(F.from_json(f.name, f.dataType).alias(f.name))
        else:
            c = F.col(f.name).cast("int") if isinstance(f.dataType, BooleanType) else F.col(f.name)
            out.append(c.cast(f.dataType).alias(f.name))
    return rows.select(*out)


def metric_rows(source: str, metrics: DataFrame, key: str) -> DataFrame:
    """url, source, name, value: one row per metric of an external source; what is missing makes no row."""
    names = [f.name for f in metrics.schema if f.name != key and f.dataType.typeName() in ("double", "float", "long", "integer", "decimal")]
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names])
    return metrics.select(F.col(key).alias("url"), F.lit(source).alias("source"), F.inline(pairs)).filter("value IS NOT NULL")
