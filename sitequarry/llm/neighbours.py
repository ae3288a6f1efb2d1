"""Approximate nearest neighbours: a graph by NN-descent, queries by greedy search on it.

Equal vectors are one node. Nodes are numbered along an order of random hyperplane codes, so that near nodes often have
near numbers; a block is a run of numbers. A first graph comes from several such orders, by comparing runs of LEAF
neighbours. NN-descent then lets nodes that share a neighbour meet: every node sends its vector once to each block that
holds neighbours on its list, those that meet at a node are compared with each other where one of the two is new there,
and each node keeps the nearest it has heard of. Rounds go on until few lists change. A query walks the graph: the
nearest nodes that it has not expanded name their neighbours, these are joined with their vectors, and the query keeps
the nearest. All queries walk together, a join for each round. How many nodes a query keeps is measured, not fixed:
a sample of queries is compared with all rows, and the number is doubled until enough of their nearest are found.

Vectors keep the precision they come with, distances are differences in double, so near copies are told apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitequarry.llm.common import discard, materialise

#: Sorted orders for the first graph, nodes compared in each run of them, neighbours of a list.
ORDERS, LEAF, DEGREE = 8, 64, 40
#: NN-descent ends when under this share of list entries is new in a round, or after so many rounds.
CHANGED, MOST_ROUNDS = 0.02, 12
#: Of the nodes that have a node on their lists so many meet there in one round, as in the paper chosen at random anew
#: each time; each hears of so many nearer ones from one meeting; so many reverse edges serve the search (the nearest).
MEET, HEAR, BACK = 80, 8, 40
#: Nodes that a query keeps at first (it expands half of them in a round); the share of the nearest that must be found for a
#: sample of so many queries before all walk; the gain in that share under which a larger number is given up.
BEAM, RECALL, CHECKED, GAIN = 96, 0.96, 200, 0.002
#: Bytes of the vectors that meet in a block at most, and the nodes of a block at least.
BLOCK_BYTES, LEAST_BLOCK = 256 << 20, 1024
#: Nodes whose in-degree the driver knows at most (numbers only): those on more than one in so many of all list entries.
HUBS = 100_000
#: Pairs of a task that are merged together before they are sent.
AT_ONCE = 1_000_000
#: Bytes of the vectors that a task sends in one batch, and rows that it unpacks at a time; both whatever batches it gets.
SEND_BYTES, UNPACKED = 4 << 20, 256
LISTS = "node long, vector binary, near binary, away binary, fresh binary"


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold all rows of their keys, from batches in which rows of a key follow each other."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = len(keys) - int(np.argmax(keys[::-1] != keys[-1])) if keys[0] != keys[-1] else 0
        if cut or held and held[-1].column(key)[-1].as_py() != keys[0]:
            table = pa.Table.from_batches(held + ([batch.slice(0, cut)] if cut else []))
            if table.num_rows:
                yield table
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _matrix(rows: list, dtype, width: int = 0) -> np.ndarray:
    """Rows of equal length from binary values."""
    return np.frombuffer(b"".join(rows), dtype).reshape(len(rows), -1) if rows else np.zeros((0, width), dtype)


def _bytes(array: pa.Array) -> np.ndarray:
    """The bytes of binary values of equal length as rows, not copied."""
    ends = np.frombuffer(array.buffers()[1], np.int64 if pa.types.is_large_binary(array.type) else np.int32)[array.offset : array.offset + len(array) + 1]
    return np.frombuffer(array.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(array), -1)


def _binary(rows) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _squares(x: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs of rows [.., n, d]. Rows are first moved to their mean, so near copies don't cancel."""
    x = x - x.mean(-2, keepdims=True)
    s = (x * x).sum(-1)
    return np.maximum(s[..., :, None] + s[..., None, :] - 2 * x @ np.swapaxes(x, -1, -2), 0)


def _merge(owner: np.ndarray, near: np.ndarray, away: np.ndarray, fresh: np.ndarray, k: int):
    """For each owner its k nearest distinct nodes, padded with -1. An entry that was on the list before isn't new."""
    order = np.lexsort((fresh, near, away, owner))  # copies of a pair have one distance: old ones come first
    owner, near, away, fresh = owner[order], near[order], away[order], fresh[order]
    first = np.ones(len(owner), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (near[1:] != near[:-1])
    owner, near, away, fresh = owner[first], near[first], away[first], fresh[first]
    heads, start = np.unique(owner, return_index=True)
    rank = np.arange(len(owner)) - np.repeat(start, np.diff(np.append(start, len(owner))))
    row, use = np.searchsorted(heads, owner), rank < k
    out, d, f = np.full((len(heads), k), -1, np.int64), np.full((len(heads), k), np.inf, np.float32), np.zeros((len(heads), k), bool)
    at = row[use], rank[use]
    out[at], d[at], f[at] = near[use], away[use], fresh[use]
    return heads, out, d, f


def _lists(heads: np.ndarray, vectors: pa.Array, out: np.ndarray, d: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
    """Rows of LISTS without the padding."""
    ends = (out >= 0).sum(1).tolist()
    near, away, fresh = out, d.astype(np.float32), f
    cut = lambda x: pa.array([row[:e].tobytes() for row, e in zip(x, ends)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(heads, pa.int64()), vectors, cut(near), cut(away), cut(fresh)], names=["node", "vector", "near", "away", "fresh"])


class _Heard:
    """Pairs (owner, other, distance) of a task, merged into lists of the k nearest and sent when there are many."""

    def __init__(self, k: int):
        self.k, self.size, self.parts = k, 0, []

    def add(self, owner: np.ndarray, near: np.ndarray, away: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((owner, near, away.astype(np.float32)))
        self.size += len(owner)
        if self.size >= AT_ONCE:
            yield from self.send()

    def send(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            owner, near, away = (np.concatenate(c) for c in zip(*self.parts))
            self.parts, self.size = [], 0
            most = int(np.unique(owner, return_counts=True)[1].max())  # no padding that nothing needs
            heads, out, d, f = _merge(owner, near, away, np.ones(len(owner), bool), min(self.k, most))
            yield _lists(heads, pa.nulls(len(heads), pa.binary()), out, d, f & (out >= 0))


def merged(lists: DataFrame, k: int) -> DataFrame:
    """One list for each node, with its vector, from all lists that name it as owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "node"):
            near, away, fresh, vectors = (t[c].to_pylist() for c in ("near", "away", "fresh", "vector"))
            node = t["node"].to_numpy()
            n, d, f = np.frombuffer(b"".join(near), np.int64), np.frombuffer(b"".join(away), np.float32), np.frombuffer(b"".join(fresh), bool)
            owner = np.repeat(node, [len(x) // 8 for x in near])
            own = {i: v for i, v in zip(node.tolist(), vectors) if v is not None}
            heads, n, d, f = _merge(owner, n, d, f, k)
            at = np.searchsorted(heads, np.array(list(own), np.int64))
            alone = np.array([i >= len(heads) or heads[i] != h for i, h in zip(at.tolist(), own)], bool)
            at[alone] = len(heads)  # a row of padding: a node that has heard of none
            n, d, f = np.vstack([n, np.full((1, k), -1)]), np.vstack([d, np.full((1, k), np.inf, np.float32)]), np.vstack([f, np.zeros((1, k), bool)])
            yield _lists(np.array(list(own), np.int64), pa.array(list(own.values()), pa.binary()), n[at], d[at], f[at])

    return lists.repartition("node").sortWithinPartitions("node").mapInArrow(run, LISTS)


def centre(rows: DataFrame, n: int, kind: str) -> np.ndarray:
    """The mean of n vectors, where the planes meet: a row of sums from each task."""
    width = len(rows.select("vector").first()["vector"]) // np.dtype(kind).itemsize

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            total += (_matrix(batch.column(0).to_pylist(), kind, width).astype(np.float64) / n).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], names=["i", "v"])

    mean = np.zeros(width)
    for r in rows.select("vector").mapInArrow(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        mean[r["i"]] = r["v"]
    return mean


def in_order(rows: DataFrame, n: int, kind: str, mean: np.ndarray, orders: int, leaf: int, seed: int) -> DataFrame:
    """The rows, once for each order, sorted within it.

    An order goes by the signs of the vector on random directions, so many that a cell of equal signs holds about one run,
    and within a cell by one more direction: large cells, as of near copies, are sorted too.
    """
    bits = max(1, math.ceil(math.log2(max(2, n / leaf))))
    planes = np.random.default_rng(seed).standard_normal((orders, bits + 1, len(mean)))
    names = rows.columns
    at = names.index("vector")

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(at).to_pylist(), kind, len(mean)) - mean
            for t in range(orders):
                p = x @ planes[t].T
                gray = p[:, :bits] > 0
                gray = np.bitwise_xor.accumulate(gray, 1) @ (1 << np.arange(bits - 1, -1, -1))  # neighbours in Gray code are near
                own = [pa.array(np.full(len(x), t, np.int32)), pa.array(gray.astype(np.int64)), pa.array(p[:, bits])]
                yield pa.RecordBatch.from_arrays(own + batch.columns, names=["t", "code", "place", *names])

    schema = ", ".join(["t int, code long, place double", *(f"{name} {kind_}" for name, kind_ in rows.dtypes)])
    placed = rows.mapInArrow(codes, schema)
    return placed.repartitionByRange("t", "code", "place").sortWithinPartitions("t", "code", "place").select(*names)


def numbered_nodes(rows: DataFrame, n: int, kind: str, mean: np.ndarray, leaf: int = LEAF) -> DataFrame:
    """The rows with gapless numbers `node` along one order."""
    high = materialise(in_order(rows, n, kind, mean, 1, leaf, 1).withColumn("high", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("high", 33)
    sizes = high.groupBy(part.alias("part")).agg(F.count("*").alias("rows"), F.min("high").alias("first"))  # a row for each partition
    before = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", (before - F.col("first")).alias("shift"))
    out = high.withColumn("part", part).join(F.broadcast(starts), "part").select(*rows.columns, (F.col("high") + F.col("shift")).alias("node"))
    out = materialise(out, "nodes")
    discard(high)
    return out


def first_graph(nodes: DataFrame, n: int, kind: str, mean: np.ndarray, k: int, orders: int, leaf: int) -> DataFrame:
    """Lists from runs of `leaf` nodes in `orders` sorted orders."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        heard = _Heard(k)

        def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
            node, x = t["node"].to_numpy(), _matrix(t["vector"].to_pylist(), kind, len(mean)).astype(np.float64)
            for lo in range(0, len(node), leaf):
                d = _squares(x[lo : lo + leaf])
                i, j = np.nonzero(~np.eye(len(d), dtype=bool))
                own = node[lo : lo + leaf]
                yield from heard.add(own[i], own[j], d[i, j])

        for batch in batches:
            held.append(batch)
            if (rows := sum(b.num_rows for b in held)) >= leaf:
                t = pa.Table.from_batches(held)
                yield from compare(t.slice(0, rows // leaf * leaf))
                held = t.slice(rows // leaf * leaf).combine_chunks().to_batches()
        if held:
            yield from compare(pa.Table.from_batches(held))
        yield from heard.send()

    lists = in_order(nodes.select("node", "vector"), n, kind, mean, orders, leaf, 0).mapInArrow(runs, LISTS)
    empty = F.lit(b"").cast("binary")
    own = nodes.select("node", "vector", empty.alias("near"), empty.alias("away"), empty.alias("fresh"))
    return materialise(merged(own.unionByName(lists), k), "graph")


def _flat(near: list, away: list, fresh: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, node, distance and newness of each entry of some lists."""
    rows = np.repeat(np.arange(len(near)), [len(x) // 8 for x in near])
    return rows, np.frombuffer(b"".join(near), np.int64), np.frombuffer(b"".join(away), np.float32), np.frombuffer(b"".join(fresh), bool)


def _entries(lists: DataFrame) -> DataFrame:
    """node, other, away: a row for each entry of each list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, near, away, _ = _flat(*(batch.column(i).to_pylist() for i in (1, 2, 3)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(near), pa.array(away)], names=["node", "other", "away"])

    return lists.select("node", "near", "away", "fresh").mapInArrow(run, "node long, other long, away float")


class _Inbox:
    """Who meets at the nodes of a block: at each the node itself and at most MEET of those that list it, as they come."""

    def __init__(self, block: int, size: int):
        self.first, self.size, self.count = block * size, size, 0
        self.taken = np.zeros(size, np.int64)
        self.visitors: list[tuple] = []
        self.entries: list[tuple] = []

    def add(self, t: pa.RecordBatch) -> None:
        node, targets, fresh = t["node"].to_numpy(), t["targets"], t["fresh"].flatten().to_numpy(zero_copy_only=False)
        to = targets.flatten().to_numpy() - self.first
        row = np.repeat(np.arange(len(node)), targets.value_lengths().to_numpy())
        own = to + self.first == node[row]
        others = np.flatnonzero(~own)
        others = others[np.argsort(to[others], kind="stable")]
        place = to[others]
        rank = np.arange(len(place)) - np.searchsorted(place, place)
        others = others[rank + self.taken[place] < MEET]
        self.taken += np.bincount(to[others], minlength=self.size)
        keep = np.concatenate([np.flatnonzero(own), others])
        used, at = np.unique(row[keep], return_inverse=True)
        self.visitors.append((node[used], t["worst"].to_numpy()[used], _bytes(t["vector"])[used]))
        self.entries.append((to[keep], at + self.count, fresh[keep]))
        self.count += len(used)

    def meetings(self) -> tuple[np.ndarray, ...]:
        """Place, visitor and newness of each entry by place, then numbers, worst distances and vectors of the visitors.

        The inbox is empty then: vectors leave it as they are copied, so they are held once.
        """
        place, visitor, fresh = (np.concatenate(c) for c in zip(*self.entries))
        order = np.argsort(place, kind="stable")
        self.entries = []
        node, worst = (np.concatenate([v[i] for v in self.visitors]) for i in (0, 1))
        vectors = np.empty((len(node), self.visitors[0][2].shape[1]), np.uint8)
        at = len(node)
        while self.visitors:
            part = self.visitors.pop()[2]
            vectors[at - len(part) : at] = part
            at -= len(part)
        return place[order], visitor[order], fresh[order], node, worst, vectors


def block_size(n: int, width: int, parallel: int) -> int:
    """Nodes of a block, a power of two: a block for each core, in the bounds of memory, and not too small."""
    most = BLOCK_BYTES // ((MEET + 1) * width)
    return 1 << max(4, int(math.log2(max(1, min(most, max(LEAST_BLOCK, n // parallel))))))


def _pieces(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Few enough rows that their vectors, once for each entry and the node itself, are one batch."""
    for batch in batches:
        if batch.num_rows:
            few = max(1, SEND_BYTES // ((k + 1) * len(batch.column(1)[0].as_py())))
            yield from (batch.slice(lo, few) for lo in range(0, batch.num_rows, few))


def descend(lists: DataFrame, n: int, kind: str, k: int, turn: int, block: int) -> DataFrame:
    """A round of NN-descent: nodes that share a neighbour meet there and become neighbours where they are nearer.

    Of the vectors sent to a node MEET are used, chosen at random anew in each round; so a block holds a bounded number,
    however many lists hold one of its nodes. Fewer are sent to nodes that very many lists hold: a random share that still
    gives MEET.
    """
    hubs = _entries(lists).groupBy("other").agg(F.count("*").alias("lists")).filter(F.col("lists") > max(10 * MEET, n * k // HUBS)).orderBy("other").collect()
    hub, share = np.array([r["other"] for r in hubs], np.int64), np.array([4 * MEET / r["lists"] for r in hubs])

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, k):
            node = batch.column(0).to_numpy()
            rows, to, away, new = _flat(*(batch.column(i).to_pylist() for i in (2, 3, 4)))
            count = np.bincount(rows, minlength=len(node))
            worst = np.where(count >= k, np.append(away, 0)[np.maximum(np.cumsum(count) - 1, 0)], np.inf).astype(np.float32)
            rng = np.random.default_rng([turn, int(node[0])])
            if len(hub):
                at = np.minimum(np.searchsorted(hub, to), len(hub) - 1)
                keep = (hub[at] != to) | (rng.random(len(to)) < share[at])
                rows, to, new = rows[keep], to[keep], new[keep]
            # the node itself meets those who list it
            rows, to, new = np.concatenate([rows, np.arange(len(node))]), np.concatenate([to, node]), np.concatenate([new, np.zeros(len(node), bool)])
            order = np.lexsort((to, rows))
            rows, to, new = rows[order], to[order], new[order]
            start = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (to[1:] // block != to[:-1] // block)))
            ends = pa.array(np.append(start, len(rows)).astype(np.int32))
            r = rows[start]
            yield pa.RecordBatch.from_arrays([pa.array((to[start] // block).astype(np.int32)), pa.array(node[r]), pa.array(rng.random(len(node), np.float32)[r]), pa.array(worst[r]), pa.ListArray.from_arrays(ends, pa.array(to)), pa.ListArray.from_arrays(ends, pa.array(new)), batch.column(1).take(pa.array(r))], names=["block", "node", "luck", "worst", "targets", "fresh", "vector"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heard = _Heard(k)
        held: _Inbox | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            number = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(number)]
            for lo, hi in zip(cuts, cuts[1:]):
                if held is not None and held.first != number[lo] * block:
                    yield from compared(held, heard)
                    held = None
                held = held or _Inbox(int(number[lo]), block)
                held.add(batch.slice(lo, hi - lo))
        if held is not None:
            yield from compared(held, heard)
        yield from heard.send()

    def compared(held: _Inbox, heard: _Heard) -> Iterator[pa.RecordBatch]:
        place, visitor, fresh, node, worst, vectors = held.meetings()
        x = vectors.view(kind)
        start, count = np.unique(place, return_index=True, return_counts=True)[1:]
        few = max(1, min(200, 2 * SEND_BYTES // ((MEET + 1) * 8 * max(x.shape[1], MEET + 1))))
        for lo in range(0, len(start), few):
            s, c = start[lo : lo + few], count[lo : lo + few]
            width = int(c.max())
            e = np.minimum(s[:, None] + np.arange(width), len(place) - 1)
            i, real, new = visitor[e], np.arange(width) < c[:, None], fresh[e]
            d = _squares(x[i].astype(np.float64))
            d[~(real[:, :, None] & real[:, None] & (new[:, :, None] | new[:, None]) & (d < worst[i][:, :, None]) & (i[:, :, None] != i[:, None]))] = np.inf
            if width > HEAR:
                b = np.argpartition(d, HEAR, 2)[:, :, :HEAR]
                d = np.take_along_axis(d, b, 2)
            else:
                b = np.broadcast_to(np.arange(width), d.shape)
            g, a, h = np.nonzero(np.isfinite(d))
            yield from heard.add(node[i[g, a]], node[i[g, b[g, a, h]]], d[g, a, h])

    schema = "block int, node long, luck float, worst float, targets array<long>, fresh array<boolean>, vector binary"
    messages = lists.select("node", "vector", "near", "away", "fresh").mapInArrow(sent, schema)
    blocks = -(-n // block)
    found = messages.repartitionById(min(blocks, 10_000), F.col("block")).sortWithinPartitions("block", "luck", "node").mapInArrow(meet, LISTS)
    old = lists.withColumn("fresh", F.expr("unhex(repeat('00', length(fresh)))"))
    return materialise(merged(old.unionByName(found), k), "graph")


def build(nodes: DataFrame, n: int, kind: str, mean: np.ndarray, k: int = DEGREE, orders: int = ORDERS, leaf: int = LEAF, changed: float = CHANGED, most_rounds: int = MOST_ROUNDS) -> tuple[DataFrame, int]:
    """The graph, and the rounds it took."""
    lists = first_graph(nodes, n, kind, mean, k, orders, leaf)
    block = block_size(n, len(mean) * np.dtype(kind).itemsize, nodes.sparkSession.sparkContext.defaultParallelism)
    for turn in range(1, most_rounds + 1):
        new = descend(lists, n, kind, k, turn, block)
        discard(lists)
        lists = new
        moved = lists.agg(F.sum(F.regexp_count(F.hex("fresh"), F.lit("01"))).alias("n")).first()["n"] or 0  # bytes 00 or 01, so hex digits pair up
        if moved <= changed * n * k:
            break
    return lists, turn


def search_graph(lists: DataFrame) -> DataFrame:
    """node, vector, around: the nodes on its list and the nearest BACK of those that list it, as 64-bit numbers."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends = np.append(0, np.cumsum(lists.value_lengths().to_numpy())).astype(np.int32) * 8
            values = np.ascontiguousarray(lists.flatten().to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends), pa.py_buffer(values)])], names=["node", "around"])

    entries = _entries(lists)
    back = entries.select(F.col("other").alias("node"), F.col("node").alias("other"), "away")
    nearest = back.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("away", "other"))).filter(F.col("r") <= BACK)
    around = entries.select("node", "other").unionByName(nearest.select("node", "other")).groupBy("node").agg(F.collect_set("other").alias("around")).mapInArrow(packed, "node long, around binary")
    return materialise(lists.select("node", "vector").join(around, "node", "left"), "search_graph")


def _asked(batches: Iterator[pa.RecordBatch], beam: int) -> Iterator[pa.RecordBatch]:
    """query, node, worst, x of what queries ask next: the vector goes to each neighbour, so batches are cut by its bytes."""
    for batch in batches:
        for lo in range(0, batch.num_rows, UNPACKED):
            part = batch.slice(lo, UNPACKED)
            vectors, most = part.column(1), SEND_BYTES // max(1, len(part.column(1)[0].as_py()))
            held: list[tuple] = []
            size = 0
            for r, (q, nodes, away, done, around) in enumerate(zip(*(part.column(i).to_pylist() for i in (0, 2, 3, 4, 5)))):
                turn = b"".join([a for a, d in zip(around, done) if not d][: beam // 2])
                to = np.setdiff1d(np.frombuffer(turn, np.int64), np.array(nodes, np.int64))
                held.append((q, r, to, away[-1] if len(away) >= beam else float("inf")))
                size += len(to)
                if size >= most or r == part.num_rows - 1:
                    count = [len(h[2]) for h in held]
                    query, rows, worst = (np.repeat(np.array([h[i] for h in held], kind_), count) for i, kind_ in ((0, np.int64), (1, np.int64), (3, np.float64)))
                    yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(np.concatenate([h[2] for h in held])), pa.array(worst), vectors.take(pa.array(rows))], names=["query", "node", "worst", "x"])
                    held, size = [], 0


def walk(queries: DataFrame, graph: DataFrame, kind: str, beam: int) -> DataFrame:
    """query, node, away (squared): the beam of each query when all its nodes are expanded.

    A query starts at its own node. A round sends its vector to the neighbours of the nearest nodes that it hasn't
    expanded; those nearer than the last of its beam answer with their distance and their own neighbours.
    """
    expand = beam // 2
    state = "query long, vector binary, nodes array<long>, away array<double>, done array<boolean>, around array<binary>"
    none = F.lit(b"").cast("binary")
    start = queries.join(graph.withColumnRenamed("node", "query"), "query")
    walks = materialise(start.select("query", "vector", F.array("query").alias("nodes"), F.array(F.lit(0.0)).alias("away"), F.array(F.lit(False)).alias("done"), F.array(F.coalesce("around", none)).alias("around")), "walks")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d = _matrix(batch.column(3).to_pylist(), kind).astype(np.float64) - _matrix(batch.column(4).to_pylist(), kind)
            d = (d * d).sum(1)
            near = pa.array(np.flatnonzero(d <= batch.column(2).to_numpy()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(near), batch.column(1).take(near), pa.array(d).take(near), batch.column(5).take(near)], names=["query", "node", "away", "around"])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"query": pa.int64(), "vector": pa.binary(), "nodes": pa.list_(pa.int64()), "away": pa.list_(pa.float64()), "done": pa.list_(pa.bool_()), "around": pa.list_(pa.binary())}

        def told(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], names=list(kinds))

        def kept(query: int, vector: bytes, seen: list[tuple]) -> tuple:
            best = sorted(seen, key=lambda x: x[:2])[:beam]
            return query, vector, *([x[i] for x in best] for i in (1, 0, 2, 3))

        query, vector, seen, out, size = None, None, [], [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, UNPACKED):
                for r in batch.slice(lo, UNPACKED).to_pylist():
                    if r["query"] != query:
                        if query is not None:
                            out.append(kept(query, vector, seen))
                            size += sum(map(len, out[-1][5]))
                        if size >= SEND_BYTES or len(out) >= UNPACKED:
                            yield told(out)
                            out, size = [], 0
                        query, vector, seen = r["query"], None, []
                    if r["vector"] is not None:
                        vector, open_ = r["vector"], 0
                        for x in zip(r["away"], r["nodes"], r["done"], r["around"]):
                            open_ += not x[2]
                            done = x[2] or open_ <= expand
                            seen.append((x[0], x[1], done, b"" if done else x[3]))
                    else:
                        seen.append((r["away"][0], r["nodes"][0], False, r["around"][0]))
        if query is not None:
            yield told([*out, kept(query, vector, seen)])

    while not walks.filter(F.exists("done", lambda d: ~d)).isEmpty():
        wanted = walks.mapInArrow(lambda batches: _asked(batches, beam), "query long, node long, worst double, x binary")
        pairs = wanted.join(graph, "node").select("query", "node", "worst", "x", "vector", F.coalesce("around", none).alias("around"))
        found = pairs.mapInArrow(measured, "query long, node long, away double, around binary")
        answers = found.select("query", F.lit(None).cast("binary").alias("vector"), F.array("node").alias("nodes"), F.array("away").alias("away"), F.array(F.lit(False)).alias("done"), F.array("around").alias("around"))
        following = materialise(walks.unionByName(answers).repartition("query").sortWithinPartitions("query").mapInArrow(step, state), "walks")
        discard(walks)
        walks = following
    out = materialise(walks.select("query", F.explode(F.arrays_zip("nodes", "away")).alias("b")).select("query", F.col("b.nodes").alias("node"), F.col("b.away").alias("away")), "beams")
    discard(walks)
    return out


def _last_exact(queries: DataFrame, nodes: DataFrame, kind: str, k: int) -> DataFrame:
    """query, last: the k-th smallest squared distance from each of at most CHECKED queries to any other node."""
    asked = queries.join(nodes, F.col("query") == F.col("node")).select("query", "vector").orderBy("query").limit(CHECKED).collect()
    own, x = np.array([r["query"] for r in asked]), _matrix([bytes(r["vector"]) for r in asked], kind).astype(np.float64)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(own), k), np.inf)
        for batch in batches:
            node, y = batch.column(0).to_numpy(), _matrix(batch.column(1).to_pylist(), kind, x.shape[1]).astype(np.float64)
            for q in range(len(own)):
                d = y - x[q]
                d = np.append(best[q], (d * d).sum(1)[node != own[q]])
                best[q] = np.partition(d, k - 1)[:k]
        q, _ = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(best[np.isfinite(best)])], names=["query", "away"])

    found = nodes.select("node", "vector").mapInArrow(nearest, "query long, away double")
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("away"))).filter(F.col("r") <= k)
    return ranked.groupBy("query").agg(F.max("away").alias("last"), F.count("*").alias("wanted"))


def fitting_beam(queries: DataFrame, graph: DataFrame, n: int, kind: str, k: int, beam: int, recall: float) -> int:
    """The number of nodes that a query must keep: doubled until a sample of CHECKED queries finds the share `recall` of its
    k nearest nodes, all nodes are kept, or a doubling gains under GAIN."""
    sample = materialise(queries.orderBy(F.xxhash64("query"), "query").limit(CHECKED), "sample")
    last = materialise(_last_exact(sample, graph, kind, k), "exact")
    before = -1.0
    while True:
        beams = walk(sample, graph, kind, beam)
        hits = beams.filter("query <> node").join(last, "query").filter("away <= last").groupBy("query").agg(F.least(F.count("*"), F.max("wanted")).alias("hits"))
        share = (hits.agg(F.sum("hits")).first()[0] or 0) / max(1, last.agg(F.sum("wanted")).first()[0] or 0)
        discard(beams)
        if share >= recall or beam >= n or share < before + GAIN:
            discard(sample, last)
            return beam
        before, beam = share, 2 * beam


def search(embeddings: DataFrame, every: int = 100, k: int = 10, beam: int = BEAM, recall: float = RECALL, **graph) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id is divisible by `every`.

    Vectors that are null, zero, of another length than the first by id, or that hold null or non-finite components take
    no part, nor do null ids. Ties go to the smaller vec_id; equal vectors all count; rows that repeat an id and vector
    count once. Fewer than k candidates give fewer rows; an empty table gives none. Other columns are not read. A query
    keeps `beam` nodes, or as many more as a sample needs for `recall`. `graph` are arguments of build().
    """
    kind = "<f4" if dict(embeddings.dtypes)["embedding"] == "array<float>" else "<f8"
    x = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v")).filter(fine)
    width = rows.orderBy("vec_id").select(F.size(F.col("v")).alias("n")).first()
    if width is None:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("v") == width["n"])

    def binary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.array(batch.column(1).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(batch.num_rows, -1) + 0.0  # -0 is 0
            yield pa.RecordBatch.from_arrays([batch.column(0), _binary(v.astype(kind))], names=["vec_id", "vector"])

    plain = materialise(rows.mapInArrow(binary, "vec_id long, vector binary"), "vectors")
    nodes = materialise(plain.groupBy("vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least")), "distinct")
    n = nodes.count()
    mean = centre(nodes, n, kind)
    nodes = numbered_nodes(nodes, n, kind, mean)
    lists, _ = build(nodes, n, kind, mean, **{"k": max(DEGREE, k)} | graph)
    # a node that holds queries is walked once; single vectors know their id, the rows of copies are looked up by digest
    digest = F.xxhash64("vector")
    several = nodes.filter("copies > 1").select(digest.alias("digest"), "vector", "node")
    found = plain.withColumn("digest", digest).join(several, ["digest", "vector"]).select("node", "vec_id").distinct()
    members = materialise(nodes.filter("copies = 1").select("node", F.col("least").alias("vec_id")).unionByName(found), "members")
    asked = materialise(members.filter(F.col("vec_id") % every == 0), "queries")
    walkers = asked.select(F.col("node").alias("query")).distinct()
    around = search_graph(lists)
    beam = fitting_beam(walkers, around, n, kind, k, max(beam, 2 * k), recall)
    close = walk(walkers, around, kind, beam)
    discard(lists, around)
    # of a node's copies only the k + 1 smallest ids can be among the k nearest: k + 1 of each task, then of all
    part = F.spark_partition_id()
    some = members.withColumn("p", part).withColumn("r", F.row_number().over(Window.partitionBy("node", "p").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    few = some.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).filter(F.col("r") <= k + 1).select("node", "vec_id")
    best = close.join(few, "node").withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("away", "vec_id"))).filter(F.col("r") <= k + 1).select("query", "vec_id", "away")
    pairs = asked.select(F.col("node").alias("query"), F.col("vec_id").alias("query_id")).join(best, "query").filter("vec_id <> query_id")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("away", "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.sqrt("away").alias("score"))
