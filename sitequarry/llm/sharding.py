"""Sharding by balanced label propagation, in DataFrame operations only.

Documents linked to one hub (here: those with equal texts) should share a shard. The state is a cell table
(hub, shard, n): documents of a hub in one shard are interchangeable. In each round every cell asks to move to the
shard that holds most of its hub; requests between each pair of shards are granted up to what the way back and the
free quota allow, large hubs first. At the end documents take the places of their hub's cells, documents without links
fill what is free, and all shards have equal numbers of rows, or one more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitequarry.llm.common import buckets_for, discard, materialise, numbered

SHARDS = 16
ROUNDS = 4
#: Bins for the order in which requests of one size class between two shards are granted.
BINS = 16


def label_round(cells: DataFrame, loads: dict[int, int], quota: int, n_shards: int, turn: int) -> tuple[DataFrame, bool]:
    """One round: the new cells, and whether anything asked to move."""
    spark = cells.sparkSession
    hub = Window.partitionBy("hub")
    open_shards = [s for s in range(n_shards) if loads.get(s, 0) < quota]
    room = F.create_map(*[x for s in range(n_shards) for x in (F.lit(s), F.lit(max(0, quota - loads.get(s, 0))))])
    # the strongest shard of the hub; hubs over a quota aim for the strongest one that still has room
    large = F.col("total") > quota
    aim = F.struct(F.when(large & ~F.col("shard").isin(open_shards or [-1]), 0).otherwise(F.col("n")).alias("n"), F.xxhash64("hub", "shard", F.lit(turn)).alias("tie"), F.col("shard").alias("shard"))
    asked = cells.withColumn("total", F.sum("n").over(hub)).withColumn("to", F.max(aim).over(hub)["shard"])
    asked = asked.withColumn("class", F.floor(F.log2("total")).cast("int")).withColumn("bin", F.pmod(F.xxhash64("hub", F.lit(turn)), F.lit(BINS)).cast("int"))
    asked = materialise(asked, "asked")
    moves = asked.filter(F.col("to") != F.col("shard"))
    bins = moves.groupBy("shard", "to", "class", "bin").agg(F.sum("n").alias("want"))
    # at most shards^2 * 60 * BINS rows, whatever the input
    demand = {(r["shard"], r["to"]): r["want"] for r in bins.groupBy("shard", "to").agg(F.sum("want").alias("want")).collect()}
    if not demand:
        return asked.select("hub", "shard", "n"), False
    grant = {}
    free = {s: max(0, quota - loads.get(s, 0)) for s in range(n_shards)}
    for (i, j), want in sorted(demand.items(), key=lambda x: (-x[1], x[0])):
        swap = min(want, demand.get((j, i), 0))
        more = min(want - swap, free[j])
        free[j] -= more
        grant[i, j] = swap + more
    granted = spark.createDataFrame([(i, j, int(g)) for (i, j), g in grant.items()], "shard int, to int, granted long")
    order = Window.partitionBy("shard", "to").orderBy(F.desc("class"), "bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.join(F.broadcast(granted), ["shard", "to"]).withColumn("left", F.col("granted") - F.coalesce(F.sum("want").over(order), F.lit(0)))
    # whole bins that fit move; of the bin that does not fit, each cell moves its part; the rest waits
    share = bins.filter("left > 0").select("shard", "to", "class", "bin", F.least(F.lit(1.0), F.col("left") / F.col("want")).alias("share"))
    moved = asked.join(F.broadcast(share), ["shard", "to", "class", "bin"], "left").withColumn("go", F.when(F.col("to") == F.col("shard"), F.lit(0)).otherwise(F.floor(F.col("n") * F.coalesce("share", F.lit(0.0)))).cast("long"))
    both = F.array(F.struct("shard", (F.col("n") - F.col("go")).alias("n")), F.struct(F.col("to").alias("shard"), F.col("go").alias("n")))
    parts = moved.select("hub", F.explode(both).alias("c")).select("hub", "c.shard", "c.n").filter("n > 0")
    new = materialise(parts.groupBy("hub", "shard").agg(F.sum("n").alias("n")), "cells")
    discard(asked)
    return new, True


def shard(docs: DataFrame, n_shards: int = SHARDS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, group_rows: one row per input row.

    Null text has size 1 and the crc32 of no bytes, and counts as an empty text. Hubs are equal texts. Row counts of
    shards differ by one at most (law `rows`); a hub is split when it is larger than a shard, or where the counts
    leave no room. Repeated rows are rows like any other. An empty table gives no rows; other columns aren't read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.xxhash64(text).alias("h"))
    rows = materialise(narrow.withColumn("hub", F.xxhash64("h", "text_crc32", "size")).drop("h"), "shard_rows")
    n = rows.count()
    n_buckets = buckets_for(n)
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(n_buckets)).cast("int")
    # documents by (hub, salt), so that no hub is one task's; a hub has at most n_buckets salts
    salted = materialise(rows.withColumn("salt", salt).groupBy("hub", "salt").agg(F.count("*").alias("here")), "hub_salts")
    by_hub = Window.partitionBy("hub")
    ahead = by_hub.orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    salted_total = salted.select("hub", "salt", F.sum("here").over(by_hub).alias("group_rows"), F.coalesce(F.sum("here").over(ahead), F.lit(0)).alias("before"))
    linked = materialise(salted_total.filter("group_rows > 1"), "linked_salts")
    # first labels: by the row's salt
    cells = materialise(salted.join(linked.select("hub", "salt"), ["hub", "salt"], "left_semi").groupBy("hub", F.pmod(F.xxhash64("salt", "hub"), F.lit(n_shards)).cast("int").alias("shard")).agg(F.sum("here").alias("n")), "cells")
    quota = max(1, n // n_shards)
    for turn in range(rounds):
        loads = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        new, asked = label_round(cells, loads, quota, n_shards, turn)
        cells = new
        if not asked:
            break
    return _places(rows, linked, cells, n, n_shards, n_buckets)


def _places(rows: DataFrame, linked: DataFrame, cells: DataFrame, n: int, n_shards: int, n_buckets: int) -> DataFrame:
    """Exact shards and slots from the cells."""
    spark = rows.sparkSession
    # a hub's cells as intervals of the numbers of its documents; at most n_shards in each array
    ends = Window.partitionBy("hub").orderBy(F.desc("n"), "shard")
    intervals = cells.withColumn("end", F.sum("n").over(ends)).groupBy("hub").agg(F.array_sort(F.collect_list(F.struct("end", "shard"))).alias("cells"), F.count("*").alias("n_shards_of_group"))
    plan = linked.join(intervals, "hub")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(n_buckets)).cast("int")).join(plan, ["hub", "salt"], "left")
    inside = F.row_number().over(Window.partitionBy("hub", "salt").orderBy("doc_id", "size"))
    number = F.col("before") + inside - 1
    label = F.when(F.col("cells").isNotNull(), F.filter("cells", lambda c: c["end"] > F.col("number"))[0]["shard"])
    rows = rows.withColumn("number", number).withColumn("label", label).select("doc_id", "size", "text_crc32", "hub", "label", F.coalesce("group_rows", F.lit(1)).alias("group_rows"))
    rows = materialise(rows, "labelled")
    # a hub takes as many neighbouring buckets as it has 1000 rows: few are parted where a shard overflows, none is one task's
    spread = F.xxhash64("hub", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("group_rows") / 1000)))
    quotas = [n // n_shards + (s < n % n_shards) for s in range(n_shards)]
    settled = numbered(rows.filter("label is not null"), ["label"], [F.col("hub"), F.col("doc_id")], spread, n_buckets, "slot")
    quota = F.element_at(F.array(*[F.lit(q).cast("long") for q in quotas]), F.col("label") + 1)
    settled = materialise(settled.withColumn("fits", F.col("slot") < quota), "settled")
    loads = {r["label"]: r["n"] for r in settled.filter("fits").groupBy("label").agg(F.count("*").alias("n")).collect()}
    gaps, at = [], 0
    for s, q in enumerate(quotas):
        gap = q - loads.get(s, 0)
        if gap:
            gaps.append((s, at, at + gap, loads.get(s, 0)))
            at += gap
    names = ["doc_id", "size", "text_crc32", "group_rows", "hub"]
    pool = rows.filter("label is null").select(*names).unionByName(settled.filter("not fits").select(*names))
    pool = numbered(pool, [], [F.col("hub"), F.col("doc_id")], spread, n_buckets, "number")
    place = F.filter(F.array(*[F.struct(F.lit(s).alias("shard"), F.lit(b).cast("long").alias("end"), F.lit(f - a).cast("long").alias("shift")) for s, a, b, f in gaps]), lambda g: g["end"] > F.col("number"))[0] if gaps else None
    fitting = settled.filter("fits").select(*names, F.col("label").alias("shard"), "slot")
    if place is not None:
        fitting = fitting.unionByName(pool.withColumn("p", place).select(*names, F.col("p.shard").alias("shard"), (F.col("number") + F.col("p.shift")).alias("slot")))
    return fitting.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("group_rows").cast("long").alias("group_rows"))
