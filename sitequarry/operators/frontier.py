"""What a crawl takes next, under a budget of addresses per run, in the order of discovery.

A budget needs the place of each new address among all of its run. Places come from bucket prefix sums: rows are dealt by
ranges of (run, order), each bucket numbers its own rows of a run, and the counts of the buckets before, a small table, are
added. So a run with a third of all addresses is numbered by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitequarry.functions import urls as U
from sitequarry.operators.scratch import discard, materialise


def placed(rows: DataFrame, run: str, order: list[str], name: str = "place") -> DataFrame:
    """rows with the place of each in its run, from 1, by the order columns; ties must not matter to the caller."""
    dealt = rows.repartitionByRange(run, *order).withColumn("_bucket", F.spark_partition_id())
    dealt = materialise(dealt, "placed")  # the buckets must not be dealt anew between counting and numbering
    counts = dealt.groupBy(run, "_bucket").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(run).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = counts.select(F.col(run).alias("_run"), F.col("_bucket").alias("_b"), before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy(run, "_bucket").orderBy(*order))
    numbered = dealt.withColumn("_inside", inside).join(first, F.col(run).eqNullSafe(F.col("_run")) & (F.col("_bucket") == F.col("_b")))
    return numbered.withColumn(name, F.col("_before") + F.col("_inside")).drop("_bucket", "_inside", "_run", "_b", "_before")


def wanted(found: DataFrame, most_depth: int | None = None, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """found with normalised addresses, without those that a crawl never takes.

    Pages of internal searches are left out unless patterns to exclude are given.
    """
    rows = found.withColumn("url", U.normalize(F.col("url"))).filter(U.is_seed(F.col("url")))
    keep: Column = F.lit(True)
    if most_depth is not None:
        keep = keep & (F.col("depth") <= most_depth)
    if include:
        keep = keep & U.matches_any(F.col("url"), include)
    keep = keep & (~U.matches_any(F.col("url"), exclude) if exclude else ~U.has_search_parameter(F.col("url")))
    return rows.filter(keep)


def admitted(found: DataFrame, seen: DataFrame, most_urls: int, order: list[str], **rules) -> DataFrame:
    """run, url, depth, place: the new addresses of each run that its budget still takes.

    found (run, url, depth and the order columns) are links as they were discovered; of several links to one address the
    first counts, with its depth. seen (run, url) are addresses taken before, in normal form; place counts on from them.
    The budget is exact: a run has most_urls addresses at most, and fewer only where no more were found. Null addresses
    and runs are left out; rows may repeat; empty tables give none.
    """
    rows = wanted(found, **rules).filter("run is not null")
    first = rows.groupBy("run", "url").agg(F.min(F.struct(*order, "depth")).alias("first"))
    known = seen.select("run", "url").distinct()
    new = first.join(known, ["run", "url"], "left_anti").select("run", "url", *[F.col(f"first.{c}").alias(c) for c in [*order, "depth"] if c != "url"])
    taken = known.groupBy("run").agg(F.count("*").alias("taken"))
    ranked = placed(new, "run", [*order, "url"]).join(taken, "run", "left").withColumn("place", F.col("place") + F.coalesce("taken", F.lit(0)))
    return ranked.filter(F.col("place") <= most_urls).select("run", "url", "depth", "place")


def added(taken: DataFrame) -> DataFrame:
    """run, added: how many addresses of each run are new."""
    return taken.groupBy("run").agg(F.count("*").alias("added"))


def crawl_order(edges: DataFrame, seeds: DataFrame, most_urls: int, most_depth: int = 10) -> DataFrame:
    """run, id, depth, place: pages in the order in which a crawl of each run takes them, most_urls at most.

    edges: source_id, target_id, pos (order of the links of a page); seeds: run, id, taken in order of id at depth 0. A
    page is found by the first link to it, from the page that was taken first. The links are written once. Each level is one join of its
    front, and only fronts are written: what was seen is all fronts together. Links of a run stay in it; a page may be in several runs.
    """
    front = placed(seeds.select("run", "id").distinct(), "run", ["id"]).filter(F.col("place") <= most_urls).withColumn("depth", F.lit(0))
    front = materialise(front.select("run", "id", "depth", "place"), "front")
    fronts, seen = [front], front
    steps = materialise(edges.select(F.col("source_id").alias("id"), "target_id", "pos"), "steps")
    for depth in range(1, most_depth + 1):
        links = front.join(steps, "id").groupBy("run", F.col("target_id").alias("id")).agg(F.min(F.struct("place", "pos")).alias("by"))
        new = links.join(seen.select("run", "id"), ["run", "id"], "left_anti").select("run", "id", F.col("by.place").alias("parent"), F.col("by.pos").alias("pos"))
        taken = seen.groupBy("run").agg(F.count("*").alias("taken"))
        open_ = new.join(taken.filter(F.col("taken") < most_urls), "run")
        ranked = placed(open_, "run", ["parent", "pos", "id"]).withColumn("place", F.col("place") + F.col("taken"))
        front = materialise(ranked.filter(F.col("place") <= most_urls).withColumn("depth", F.lit(depth)).select("run", "id", "depth", "place"), "front")
        if front.isEmpty():
            discard(front)
            break
        fronts.append(front)
        seen = seen.unionByName(front)
    return seen
