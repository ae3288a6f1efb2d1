"""Helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key is hot when it holds more than one row in this many; so there are at most this many hot keys.
HOT_SHARE = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where it is unset, as in tests, a new temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of materialised tables that nothing reads any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def buckets_for(n_rows: int, per_bucket: int = 50_000, least: int = 16) -> int:
    return max(least, -(-n_rows // per_bucket))


def attach(rows: DataFrame, totals: DataFrame, keys: Sequence[str], n_rows: int, size: str) -> DataFrame:
    """Left join of per-key totals to rows of which one key may hold a third.

    Totals of hot keys, at most HOT_SHARE rows whatever the input, are broadcast; no other key is heavy.
    `size` names the column of totals that has the number of rows of the key.
    """
    least = max(1000, n_rows // HOT_SHARE)
    extra = [c for c in totals.columns if c not in keys]
    hot = totals.filter(F.col(size) > least).select(*keys, *[F.col(c).alias(f"_hot_{c}") for c in extra])
    cold = totals.filter(F.col(size) <= least)
    joined = rows.join(F.broadcast(hot), list(keys), "left")
    own = F.col(f"_hot_{size}").isNotNull()
    done = joined.filter(own).select(*rows.columns, *[F.col(f"_hot_{c}").alias(c) for c in extra])
    rest = joined.filter(~own).select(*rows.columns).join(cold, list(keys), "left")
    return done.unionByName(rest.select(*done.columns))


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[Column], spread: Column, n_buckets: int, name: str) -> DataFrame:
    """Gapless numbers from 0 within each group, without one task per group.

    Rows go to n_buckets by `spread`; a window numbers each (group, bucket), and the running sum of the bucket
    counts, a small table, gives each bucket its first number.
    """
    keys = [*group, "_bucket"]
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(spread), F.lit(n_buckets)).cast("int"))
    first = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = first.select(*keys, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("_inside", inside).join(first, keys).withColumn(name, F.col("_first") + F.col("_inside")).drop("_bucket", "_inside", "_first")


def keep_rows(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of docs, with their own columns, whose decision (doc_id, raw = xxhash64 of the text, kept) is true.

    Of rows that repeat an id and a text one stays, the least by its columns in order; texts move for such rows only.
    """
    at, raw = (next(n for i in range(len(docs.columns) + 1) if (n := f"{name}{i}") not in docs.columns) for name in ("key_id", "key_raw"))
    decisions = materialise(decisions.select(F.col("doc_id").alias(at), F.col("raw").alias(raw), "kept"), "decisions")
    kept = decisions.filter("kept").select(at, raw)
    dropped = decisions.filter("not kept").select(at, raw).distinct()
    match = F.col("doc_id").cast("long").eqNullSafe(F.col(at)) & (F.xxhash64("text") == F.col(raw))
    twins = dropped.join(kept.withColumnsRenamed({at: "x", raw: "y"}), F.col(at).eqNullSafe(F.col("x")) & (F.col(raw) == F.col("y")), "left_semi")
    out = docs.join(dropped, match, "left_anti")
    if twins.isEmpty():
        return out
    again = docs.join(twins, match, "left_semi").groupBy(F.col("doc_id").alias(at), F.xxhash64("text").alias(raw)).agg(F.min(F.struct(*docs.columns)).alias("row"))
    return out.unionByName(again.select("row.*"))
