"""Near-duplicate pages by exact set similarity of word runs, and semantically similar rows by random projections.

Near duplicates: a page is the set of its five-word runs; equal sets are one node. Two sets of at least the wanted Jaccard
similarity share one of the rarest runs of each (prefix filter), so nodes meet in the buckets of those runs only, and
length and position bounds drop most pairs before they are compared. Large buckets in which these bounds leave many pairs
are not paired: all their nodes are compared with one head, and those that the triangle inequality of the Jaccard distance
leaves open go on with a next head. Nodes near one head are linked by it; the nearest of each comes from their differences
from the head, which are few. So classes are whole and closest pages exact in all buckets.
All of it is DataFrame operations; nothing is sampled or capped.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitequarry.operators import rules
from sitequarry.operators.scratch import discard, materialise

#: Nodes of a bucket up to which all its pairs are compared; half as many pairs a node are compared in larger ones.
SMALL = 64
#: Of a large bucket a round must take one node in so many for the next to be worth it.
PAYS = 32
#: Bytes of the vectors of one side of a block, where all rows are compared, and numbers of one product.
BLOCK_BYTES = 4_000_000
PRODUCT = 2_000_000


def word_runs(rows: DataFrame, text: str, run: int = 5) -> DataFrame:
    """rows with `runs` in place of the text: distinct runs of so many words as sorted 64-bit hashes.

    A shorter text is one run, an empty one has none. The words are a column of their own, so they are split once.
    """
    words = F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t\\r\\n]+"), lambda w: w != "")
    rows = rows.withColumn(text, words)
    count = F.greatest(F.size(text) - run + 1, F.lit(1))
    runs = F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(F.array_join(F.slice(text, i, F.lit(run)), " ")))
    found = F.when(F.size(text) > 0, F.array_sort(F.array_distinct(runs))).otherwise(F.array().cast("array<long>"))
    return rows.withColumn("runs", found).drop(text)


def _verified(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b, similarity of pairs of nodes, with the other columns of the pairs."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("runs").alias(f"runs_{x}"))
    both = F.size(F.array_intersect("runs_a", "runs_b"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("both", both)
    return rows.withColumn("similarity", F.col("both") / (F.size("runs_a") + F.size("runs_b") - F.col("both"))).drop("runs_a", "runs_b", "both")


def prefixes(nodes: DataFrame, least: float) -> DataFrame:
    """run, node, n, place: of each node its rarest runs, as many as a similar set must share one of, with their order.

    Runs of one node only come first and make no bucket: a page whose prefix holds nothing else has no partner.
    """
    runs = nodes.select("node", "n", F.explode("runs").alias("run"))
    held = runs.groupBy("run").agg(F.count("*").alias("nodes")).filter("nodes > 1")
    shared = runs.join(held, "run").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("nodes", "run"))).alias("shared"))
    single = F.col("n") - F.size("shared")
    length = F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1 - single
    rows = shared.filter(length > 0).select("node", "n", single.alias("single"), F.posexplode(F.slice("shared", F.lit(1), length.cast("int"))).alias("i", "s"))
    return rows.select("s.run", "node", "n", (F.col("single") + F.col("i") + 1).alias("place"))


def _band(least: float) -> Column:
    """Number of the length band of n: similar sets are in one band or in neighbouring ones."""
    return F.floor(F.log("n") / (math.log(1 / least) + 1e-9))


def _near_places(rows: DataFrame, least: float) -> DataFrame:
    """run, a, b: pairs of a bucket that length and position allow."""
    a, b = (rows.select("run", _band(least).alias("band"), *[F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "place")]) for x in "ab")
    b = b.withColumn("band", F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)])))
    enough = F.ceil(F.lit(least / (1 + least)) * (F.col("n_a") + F.col("n_b")) - 1e-9)
    left = 1 + F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    near = (F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b") - 1e-9) & (left >= enough)
    return a.join(b, ["run", "band"]).filter((F.col("node_a") < F.col("node_b")) & near).select("run", F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def _sparse(rows: DataFrame, least: float, small: int) -> DataFrame:
    """run of the large buckets that can be paired: length and position leave as few pairs a node as a small bucket may have.

    They are counted where the bands of length have at most the square of `small` pairs a node.
    """
    bands = rows.groupBy("run", _band(least).alias("band")).agg(F.count("*").alias("size"))
    light = bands.groupBy("run").agg(F.sum("size").alias("nodes"), F.sum(F.col("size") * F.col("size")).alias("looks")).filter(F.col("looks") <= small * small * F.col("nodes"))
    pairs = _near_places(rows.join(light.select("run"), "run", "left_semi"), least).groupBy("run").agg(F.count("*").alias("pairs"))
    return light.join(pairs, "run", "left").filter(F.coalesce("pairs", F.lit(0)) <= small * F.col("nodes") / 2).select("run")


def _differences(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """a and b with their similarity as head, node, similarity, base and n (sizes), lost and added (runs), differs: the two as hashes."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("runs").alias(f"runs_{x}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").withColumns({"lost": F.array_except("runs_a", "runs_b"), "added": F.array_except("runs_b", "runs_a")})
    sizes = [F.size(c).alias(x) for c, x in (("runs_a", "base"), ("runs_b", "n"), ("lost", "lost"), ("added", "added"))]
    return rows.select(F.col("a").alias("head"), F.col("b").alias("node"), "similarity", *sizes, F.concat("lost", "added").alias("differs"))


def _plain(near: DataFrame) -> DataFrame:
    """head, node, known: the nearest other node of the head, as if no two nodes shared a difference from it, and that similarity.

    Shared differences only bring two nodes nearer, so this is never too much, and right where the nearest shares none. It
    follows from the numbers of lost and added runs; with as many lost, only those with the fewest added can be nearest.
    """
    kind = ["head", "base", "lost", "added"]
    first = near.groupBy(*kind).agg(F.min("node").alias("first"))
    second = near.join(first, kind).filter("node <> first").groupBy(*kind).agg(F.min("node").alias("second"))
    kinds = first.join(second, kind, "left")
    fewest = kinds.withColumn("r", F.row_number().over(Window.partitionBy("head", "lost").orderBy("added"))).filter("r <= 2")
    fewest = fewest.select("head", F.col("lost").alias("l"), F.col("added").alias("d"), F.col("first").alias("o"))
    value = lambda lost, added: (F.col("base") - F.col("lost") - F.col(lost)) / (F.col("base") + F.col("added") + F.col(added))
    found = lambda similarity, other: F.struct(similarity.alias("similarity"), (-other).alias("other"))
    others = kinds.join(fewest, "head").filter("lost <> l or added <> d").groupBy(*kind).agg(F.max(found(value("l", "d"), F.col("o"))).alias("others"))
    twin = F.when(F.col("node") == F.col("first"), F.col("second")).otherwise(F.col("first"))
    rows = near.join(kinds.join(others, kind, "left"), kind)
    known = F.greatest(found(F.col("similarity"), F.col("head")), F.col("others"), F.when(twin.isNotNull(), found(value("lost", "added"), twin)))
    return rows.select("head", "node", known.alias("known"))


def _meet(pairs: DataFrame, near: DataFrame) -> DataFrame:
    """head, a, b, similarity of pairs of nodes near one head, from their differences."""
    side = lambda x: near.select("head", "base", *[F.col(c).alias(y) for c, y in (("node", x), ("n", f"n_{x}"), ("lost", f"lost_{x}"), ("differs", f"differs_{x}"))])
    rows = pairs.join(side("a"), ["head", "a"]).join(side("b").drop("base"), ["head", "b"])
    rows = rows.withColumn("both", F.col("base") - F.col("lost_a") - F.col("lost_b") + F.size(F.array_intersect("differs_a", "differs_b")))
    return rows.select("head", "a", "b", (F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))).alias("similarity"))


def _among(held: DataFrame, least: float, small: int) -> DataFrame:
    """a, b, similarity from rows of _differences: of each node near a head its nearest other node there, the least of them too, and some more links.

    Pairs that share no difference from the head are settled by their numbers of differences. The others meet at the
    differences they share; where many do, at the one with the fewest first, so that most know a similarity that the rest can't
    reach. A pair is compared if number and places of its differences allow that it is nearer than one of them knows.
    """
    each = held.select("head", "node", F.explode("differs").alias("run"))
    met = each.groupBy("head", "run").agg(F.count("*").alias("nodes")).filter("nodes > 1")
    shared = each.join(met, ["head", "run"]).groupBy("head", "node").agg(F.array_sort(F.collect_list(F.struct("nodes", "run"))).alias("shared"))
    rows = shared.join(held.select("head", "base", "node", "n", "lost", F.size("differs").alias("d")), ["head", "node"])
    rows = rows.select("head", "base", "node", "n", "lost", "d", (F.col("d") - F.size("shared")).alias("single"), F.posexplode("shared").alias("i", "s"))
    rows = materialise(rows.select("head", "base", "s.run", "s.nodes", "node", "n", "lost", "d", (F.col("single") + F.col("i") + 1).alias("place")), "near_places")
    known = _plain(held)
    large = rows.filter(F.col("nodes") > small)
    leads = large.groupBy("head", "run").agg(F.min(F.struct("d", "node")).alias("lead")).select("head", "run", F.col("lead.node").alias("a"))
    led = large.join(leads, ["head", "run"]).filter("node <> a").select("head", "a", F.col("node").alias("b")).distinct()
    led = materialise(_meet(led, held), "near_leads")
    both = lambda links: links.select("head", F.col("a").alias("node"), F.struct("similarity", (-F.col("b")).alias("other")).alias("known")).unionByName(links.select("head", F.col("b").alias("node"), F.struct("similarity", (-F.col("a")).alias("other")).alias("known")))
    known = materialise(known.unionByName(both(led)).groupBy("head", "node").agg(F.max("known").alias("known")), "near_known")
    side = rows.join(known, ["head", "node"])
    a, b = (side.select("head", "run", *(["base"] if x == "a" else []), *[F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "lost", "d", "place", "known")]) for x in "ab")
    left = 1 + F.least(F.col("d_a") - F.col("place_a"), F.col("d_b") - F.col("place_b"))

    def nearer(x: str, y: str) -> Column:
        """Whether enough differences may be shared for y to be nearer x than what x knows, or as near and less."""
        similarity = F.col(f"known_{x}.similarity")
        wanted = similarity / (1 + similarity) * (F.col("n_a") + F.col("n_b")) - F.col("base") + F.col("lost_a") + F.col("lost_b")
        return left >= wanted + F.when(F.col(f"node_{y}") < -F.col(f"known_{x}.other"), -1e-8).otherwise(1e-8)

    pairs = a.join(b, ["head", "run"]).filter((F.col("node_a") < F.col("node_b")) & (nearer("a", "b") | nearer("b", "a")))
    found = _meet(pairs.select("head", F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct(), held)
    nearest = known.select(F.col("node").alias("a"), (-F.col("known.other")).alias("b"), "known.similarity")
    out = found.select("a", "b", "similarity").unionByName(nearest).filter(F.col("similarity") >= least - 1e-12)
    out = materialise(out.distinct(), "near_among")
    for done in (rows, led, known):
        discard(done)
    return out


def _by_heads(rows: DataFrame, nodes: DataFrame, least: float, small: int) -> tuple[list[DataFrame], DataFrame | None]:
    """Links of large buckets, and the rest of those buckets, to be paired, once it is small.

    A round compares all nodes of a bucket with its head, the least open node; in the first one all are open. Two nodes in
    reach of the head are linked through it, and _among finds the nearest of each. A pair with one node out of reach may be a
    link if their distances to the head differ by no more than a link allows. So nodes out of reach are open in the next
    round if they were before, or may be near an open node that is in reach; nodes that may be near an open one stay too.
    A bucket of which a round takes less than one node in PAYS, or than half of `small`, is rest, whatever its size, so rounds are few.
    """
    reach = 1 - least + 1e-9
    near: list[DataFrame] = []
    rest: DataFrame | None = None
    rows = rows.withColumns({"open": F.lit(True), "before": F.lit(None).cast("long")})
    while True:
        heads = rows.groupBy("run").agg(F.min(F.when(F.col("open"), F.col("node"))).alias("head"), F.count("*").alias("size"), F.max("before").alias("last"))
        heads = heads.filter("head is not null").withColumn("done", (F.col("size") <= small) | F.coalesce(F.col("last") - F.col("size") < F.greatest(F.col("last") / PAYS, F.lit(small / 2)), F.lit(False)))
        few = rows.join(heads.filter("done").select("run"), "run", "left_semi")
        rest = few.select("run", "node", "n", "place") if rest is None else rest.unionByName(few.select("run", "node", "n", "place"))
        many = rows.join(heads.filter("not done").select("run", "head", "size"), "run").filter("node <> head")
        pairs = many.select("run", "n", "place", "open", "size", F.col("head").alias("a"), F.col("node").alias("b"))
        seen = materialise(pairs.join(_verified(pairs.select("a", "b").distinct(), nodes), ["a", "b"]), "near_heads")
        if seen.isEmpty():
            discard(seen)
            break
        away = 1 - F.col("similarity")
        near.append(seen.filter(away <= reach).select("a", "b", "similarity"))
        edges = seen.groupBy("run").agg(F.max(F.when(F.col("open") & (away <= reach), away)).alias("edge"))
        still = (away > reach) & (F.col("open") | F.coalesce(away <= F.col("edge") + reach, F.lit(False)))
        marked = seen.join(edges, "run").withColumn("open", still)
        nearest = marked.filter("open").groupBy("run").agg(F.min(away).alias("nearest"))
        rows = marked.join(nearest, "run").filter(F.col("open") | (away >= F.col("nearest") - reach))
        rows = rows.select("run", F.col("b").alias("node"), "n", "place", "open", F.col("size").alias("before"))
    if not near:
        return [], rest
    linked = materialise(_differences(functools.reduce(DataFrame.unionByName, near).distinct(), nodes), "near_differences")
    links = linked.filter(F.col("similarity") >= least - 1e-12).select(F.col("head").alias("a"), F.col("node").alias("b"), "similarity")
    return [links, _among(linked, least, small)], rest


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node that edges (a, b) connect each node with. Labels spread to neighbours and then jump."""
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    labels = materialise(least.select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        spread = labels.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        jump = spread.join(labels.select(F.col("node").alias("label"), F.col("label").alias("far")), "label", "left")
        new = materialise(jump.select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
        discard(labels)
        labels = new
        if labels.filter("label <> old").isEmpty():
            discard(both)
            return labels.select("node", "label")


def near_duplicates(pages: DataFrame, least: float = 0.9, text: str = "text", key: str = "id", small: int = SMALL) -> DataFrame:
    """id, class_id, near_duplicate_count, closest_id, closest_similarity: one row for each page, repeated rows too.

    A class are pages that links of at least `least` Jaccard similarity of five-word runs connect; class_id is its least
    id, near_duplicate_count its other pages. closest_similarity (percent) is the greatest similarity to another page of at
    least `least`, closest_id the least id among such pages; both are null without one. Pages of equal runs have 100. `small`
    changes how pairs are found, not what is found. Null and empty texts have no partner; a text under five words is one run. Ids should be distinct; an empty table gives none, other columns are not read.
    """
    rows = materialise(word_runs(pages.select(F.col(key).cast("long").alias("id"), F.col(text).alias("words")), "words"), "word_runs")
    digest = [F.xxhash64("runs").alias("d1"), F.size("runs").alias("n"), F.hash("runs", F.lit(1)).alias("d2")]
    keyed = rows.filter(F.size("runs") > 0).select("id", *digest, "runs")
    nodes = materialise(keyed.groupBy("d1", "n", "d2").agg(F.min("id").alias("node"), F.count("*").alias("copies"), F.any_value("runs").alias("runs")), "page_nodes")
    parts = materialise(prefixes(nodes, least), "prefixes")
    sizes = materialise(parts.groupBy("run").agg(F.count("*").alias("size")).filter("size > 1"), "bucket_sizes")
    large = materialise(parts.join(sizes.filter(f"size > {small}").select("run"), "run", "left_semi"), "large_buckets")
    sparse = materialise(_sparse(large, least, small), "sparse_buckets")
    dense = materialise(large.join(sparse, "run", "left_anti"), "dense_buckets")
    # rounds and comparisons join the runs of the nodes that they compare, not those of all pages
    held = lambda named: materialise(nodes.join(named.distinct(), "node", "left_semi").select("node", "runs"), "held_nodes")
    linked, rest = _by_heads(dense, held(dense.select("node")), least, small)
    few = parts.join(sizes.filter(f"size <= {small}").select("run"), "run", "left_semi").unionByName(large.join(sparse, "run", "left_semi"))
    pairs = materialise(_near_places(few.unionByName(rest), least).select("a", "b").distinct(), "near_pairs")
    found = _verified(pairs, held(pairs.select(F.explode(F.array("a", "b")).alias("node")))).filter(F.col("similarity") >= least - 1e-12)
    for part in linked:
        found = found.unionByName(part)
    links = materialise(found.select("a", "b", "similarity").distinct(), "near_links")
    labels = components(links)
    best = links.select(F.col("a").alias("node"), F.col("b").alias("other"), "similarity").unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other"), "similarity"))
    best = best.groupBy("node").agg(F.max(F.struct("similarity", (-F.col("other")).alias("o"))).alias("best")).select("node", F.col("best.similarity").alias("similarity"), (-F.col("best.o")).alias("other"))
    known = nodes.drop("runs").join(labels, "node", "left").join(best, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = known.groupBy("label").agg(F.sum("copies").alias("pages"))
    known = known.join(classes, "label")
    of_page = keyed.drop("runs").join(known, ["d1", "n", "d2"])
    second = of_page.filter("copies > 1 and id <> node").groupBy("node").agg(F.min("id").alias("second"))
    of_page = of_page.join(second, "node", "left")
    copied = F.col("copies") > 1
    closest = F.when(copied, F.when(F.col("id") == F.col("node"), F.coalesce("second", "node")).otherwise(F.col("node"))).otherwise(F.col("other"))
    out = of_page.select("id", F.col("label").alias("class_id"), (F.col("pages") - 1).alias("near_duplicate_count"), closest.alias("closest_id"), F.when(copied, F.lit(100.0)).otherwise(F.round(100 * F.col("similarity"), 4)).alias("closest_similarity"))
    alone = rows.filter(F.size("runs") == 0).select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("near_duplicate_count"), F.lit(None).cast("long").alias("closest_id"), F.lit(None).cast("double").alias("closest_similarity"))
    return out.unionByName(alone)


def _tables_for(least: float, n: int, recall: float) -> tuple[int, int, int]:
    """Bits of a code, bits that may differ, and tables, so that a pair of just `least` cosine is met with `recall`.

    Bits grow with the rows, so that cells stay of a size; of the choices that reach the recall with 24 tables at most the
    one that compares the fewest rows.
    """
    agree = 1 - math.acos(max(-1.0, min(1.0, least))) / math.pi
    best = None
    for bits in range(2, max(3, math.ceil(math.log2(max(n, 4)))) + 1):
        for flips in range(min(3, bits) + 1):
            met = sum(math.comb(bits, i) * agree ** (bits - i) * (1 - agree) ** i for i in range(flips + 1))
            probes = sum(math.comb(bits, i) for i in range(flips + 1))
            if met <= 0:
                continue
            tables = 1 if met >= recall else math.ceil(math.log(1 - recall) / math.log(1 - met))
            cost = tables * (probes * n / 2**bits + probes + 20)
            if tables <= 24 and (best is None or cost < best[0]):
                best = (cost, bits, flips, tables)
    return best[1:]  # two bits that may both differ reach every row, so there is one


def _planes(count: int, width: int) -> list[list[float]]:
    """Directions of pseudo-random signs and sizes, from a fixed linear congruence."""
    state, out = 12345, []
    for _ in range(count):
        row = []
        for _ in range(width):
            total = 0.0
            for _ in range(6):  # a sum of uniform numbers is nearly normal
                state = (6364136223846793005 * state + 1442695040888963407) % 2**64
                total += (state >> 11) / 2**53
            row.append(round(total - 3.0, 6))
        out.append(row)
    return out


def _all_pairs(wanted: DataFrame, nodes: DataFrame, least: float, width: int, n: int) -> DataFrame:
    """query, others, best: copies of the nodes of at least `least` cosine, and the nearest, of all nodes.

    Blocks of queries meet blocks of nodes; one product finds the pairs that may be near enough, and their cosine is summed
    component by component, as Columns sum it. A block gives one row for a query, whatever its pairs.
    """
    size = max(1, BLOCK_BYTES // (8 * width))
    across, down = (max(1, math.ceil(k / size)) for k in (wanted.count(), n))
    block = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    asked = wanted.select("query", "qx", "qnorm", block("query", across).alias("a")).withColumn("d", each(down))
    held = nodes.select("node", "x", "norm", "copies", block("node", down).alias("d")).withColumn("a", each(across))

    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(c):
            x, node, norm, copies = np.stack(c["x"].to_numpy()), c["node"].to_numpy(), c["norm"].to_numpy(), c["copies"].to_numpy()
            step, few = max(1, PRODUCT // len(c)), max(1, PRODUCT // width)
            for at in range(0, len(q), step):
                part = q.iloc[at : at + step]
                v, query, qnorm = np.stack(part["qx"].to_numpy()), part["query"].to_numpy(), part["qnorm"].to_numpy()
                i, j = np.nonzero((v @ x.T >= (least - 1e-6) * np.outer(qnorm, norm)) & (query[:, None] != node[None, :]))
                dots = [np.cumsum(v[i[k : k + few]] * x[j[k : k + few]], axis=1)[:, -1] for k in range(0, len(i), few)]
                if dots:
                    pairs = pd.DataFrame({"query": query[i], "others": copies[j], "similarity": np.concatenate(dots) / (qnorm[i] * norm[j]), "node": node[j]})
                    pairs = pairs[pairs["similarity"] >= least].sort_values(["similarity", "node"], ascending=[False, True])
                    out.append(pairs.groupby("query", as_index=False).agg({"others": "sum", "similarity": "first", "node": "first"}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "others": [], "similarity": [], "node": []})

    met = asked.groupBy("a", "d").cogroup(held.groupBy("a", "d")).applyInPandas(meet, "query long, others long, similarity double, node long")
    return met.groupBy("query").agg(F.sum("others").alias("others"), F.max(F.struct("similarity", (-F.col("node")).alias("o"))).alias("best"))


def semantic_neighbours(rows: DataFrame, least: float = 0.9, every: int = 1, key: str = "vec_id", vector: str = "embedding", recall: float = 0.999) -> DataFrame:
    """query_id, similar, closest_id, similarity: for each row whose id is divisible by `every`.

    `similar` counts the other rows of at least `least` cosine, closest_id is the nearest (ties: smaller id), similarity
    its cosine; both are null without one. Signs of projections on random directions are codes in several tables; a query
    looks into the cells whose codes differ from its own in a few bits, and the cosine of all it meets is exact. Bits,
    differing bits and tables follow from the threshold, the number of rows and the wanted recall at the threshold (above
    it recall is greater). Where cells would spare nothing, blocks of queries are compared with blocks of all rows. Equal vectors are one node, so copies cost one comparison. Null, empty and zero vectors and
    those with null or non-finite components or of another length than the first by id take no part, nor do null ids.
    """
    x = F.col(vector).cast("array<double>")
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("x", lambda c: c != 0)
    used = rows.select(F.col(key).cast("long").alias("id"), x.alias("x")).filter("id is not null and size(x) > 0").filter(fine)
    about = used.agg(F.min_by(F.size("x"), "id").alias("width"), F.count("*").alias("n")).first()
    if not about["n"]:
        return rows.sparkSession.createDataFrame([], "query_id long, similar long, closest_id long, similarity double")
    width = about["width"]
    bits, flips, tables = _tables_for(least, about["n"], recall)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, c: s + c)
    members = materialise(used.filter(F.size("x") == width).select("id", "x", F.xxhash64("x").alias("digest")), "vectors")
    nodes = members.groupBy("digest", "x").agg(F.min("id").alias("node"), F.count("*").alias("copies"))
    planes = F.lit(_planes(tables * bits, width))
    signs = F.transform(planes, lambda p: (dot(p, F.col("x")) > 0).cast("int"))
    code = lambda t: F.aggregate(F.slice("signs", F.lit(t * bits + 1), F.lit(bits)), F.lit(0), lambda s, b: s * 2 + b)
    nodes = nodes.withColumns({"signs": signs, "norm": F.sqrt(dot(F.col("x"), F.col("x")))}).withColumn("codes", F.array(*[code(t) for t in range(tables)]))
    nodes = materialise(nodes.drop("signs"), "vector_nodes")
    masks = [0]
    for i in range(1, flips + 1):
        masks += [m for m in range(2**bits) if m.bit_count() == i]
    asked = members.filter(F.col("id") % every == 0).select("id", "digest", "x")
    wanted = asked.select("digest", "x").distinct().join(nodes, ["digest", "x"]).select(F.col("node").alias("query"), F.col("x").alias("qx"), F.col("norm").alias("qnorm"), F.col("codes").alias("qcodes"))
    if flips >= bits:  # every row is in reach
        others = _all_pairs(wanted, nodes, least, width, about["n"])
    else:
        probes = wanted.select("*", F.posexplode("qcodes").alias("t", "own")).select("*", F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask")).select("query", "qx", "qnorm", "qcodes", "t", F.col("own").bitwiseXOR(F.col("mask")).alias("code"))
        cells = nodes.select("node", "x", "norm", "codes", "copies", F.posexplode("codes").alias("t", "code"))
        # a pair that meets in several tables counts in the first of them
        earlier = F.exists(F.slice(F.zip_with("qcodes", "codes", lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= flips), F.lit(1), F.col("t")), lambda met: met)
        met = probes.join(cells, ["t", "code"]).filter(~earlier)
        met = met.withColumn("similarity", dot(F.col("qx"), F.col("x")) / (F.col("qnorm") * F.col("norm"))).filter((F.col("similarity") >= least) | (F.col("query") == F.col("node")))
        others = met.filter("query <> node").groupBy("query").agg(F.sum("copies").alias("others"), F.max(F.struct("similarity", (-F.col("node")).alias("o"))).alias("best"))
    of_id = asked.join(nodes.select("digest", "x", "node", "copies"), ["digest", "x"]).select("id", "node", "copies")
    second = members.join(nodes.filter("copies > 1").select("digest", "x", "node"), ["digest", "x"]).filter("id <> node").groupBy("node").agg(F.min("id").alias("second"))
    out = of_id.join(others, of_id["node"] == others["query"], "left").join(second, "node", "left")
    copied = F.col("copies") > 1
    closest = F.when(copied, F.when(F.col("id") == F.col("node"), F.coalesce("second", "node")).otherwise(F.col("node"))).otherwise(-F.col("best.o"))
    return out.select(F.col("id").alias("query_id"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("similar"), closest.alias("closest_id"), F.when(copied, F.lit(1.0)).otherwise(F.col("best.similarity")).alias("similarity"))


def near_duplicate_issues(urls: DataFrame, near: DataFrame, above: float = 90.0) -> DataFrame:
    """One finding per page whose closest other page of the crawl is more than `above` percent similar."""
    rows = urls.select("id", "address").join(near.filter(F.col("closest_similarity") > above).select("id", "closest_similarity"), "id")
    return rules.apply_rules(rows, [rules.Rule("content", "near_duplicate_content", "medium", F.lit(True), F.round("closest_similarity", 1))])
