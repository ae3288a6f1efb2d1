"""Nearest neighbours: numbering, bounded meetings, hubs, repeated rows and vectors of other lengths, and the measured beam."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sitequarry.llm import neighbours
from sitequarry.llm.common import materialise

SCHEMA = "vec_id long, embedding array<float>, node int, query string"


def brute(x: np.ndarray, q: int, k: int = 10) -> list[int]:
    d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(1)
    d[q] = np.inf
    return np.lexsort((np.arange(len(x)), d))[:k].tolist()


def test_inbox_is_bounded():
    inbox = neighbours._Inbox(2, 16)
    for lo in range(0, 500, 100):  # all list node 35, which is a node of the block and comes last
        node = np.arange(lo, lo + 100) + 1000
        lists = pa.array([[35, 36] if i % 2 else [35] for i in node], pa.list_(pa.int64()))
        fresh = pa.array([[True, False] if i % 2 else [True] for i in node], pa.list_(pa.bool_()))
        names = ["node", "worst", "targets", "fresh", "vector"]
        inbox.add(pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.ones(100, np.float32)), lists, fresh, pa.array([b"abcd"] * 100, pa.binary())], names=names))
    own = [pa.array([35]), pa.array(np.ones(1, np.float32)), pa.array([[35]], pa.list_(pa.int64())), pa.array([[False]]), pa.array([b"abcd"], pa.binary())]
    inbox.add(pa.RecordBatch.from_arrays(own, names=names))
    place, visitor, fresh, node, worst, vectors = inbox.meetings()
    assert (place == 3).sum() == neighbours.MEET + 1 and (place == 4).sum() == neighbours.MEET
    assert 35 in node[visitor[place == 3]] and len(vectors) == len(node) <= 2 * neighbours.MEET + 1
    assert fresh[place == 3].sum() == neighbours.MEET and not fresh[place == 4].any()
    assert vectors.nbytes == 4 * len(node) and not inbox.visitors  # held once


def test_batches_are_bounded_whatever_arrives():
    """A node's vector goes to many blocks, a query's to thousands of nodes: what is sent at once is bounded by its bytes."""
    vector, none = b"v" * 256, pa.array([b""] * 5000, pa.binary())
    lists = pa.RecordBatch.from_arrays([pa.array(range(5000)), pa.array([vector] * 5000, pa.binary()), none, none, none], names=["node", "vector", "near", "away", "fresh"])
    parts = list(neighbours._pieces(iter([lists, lists.slice(0, 0), lists.slice(4990)]), 40))
    assert [n for p in parts for n in p["node"].to_pylist()] == [*range(5000), *range(4990, 5000)]
    assert max(p.num_rows for p in parts) * 41 * 256 <= neighbours.SEND_BYTES
    around = [np.arange(80 * i, 80 * i + 80).tobytes() for i in range(96)]
    state = [pa.array(range(300)), pa.array([vector] * 300, pa.binary()), pa.array([[0, 5]] * 300), pa.array([[0.0, 1.0]] * 300), pa.array([[True] + [False] * 95] * 300), pa.array([around] * 300, pa.list_(pa.binary()))]
    asked = list(neighbours._asked(iter([pa.RecordBatch.from_arrays(state, names=["query", "vector", "nodes", "away", "done", "around"])]), 96))
    assert max(b.nbytes for b in asked) <= 2 * neighbours.SEND_BYTES
    got = pa.Table.from_batches(asked).to_pandas()
    assert len(got) == 300 * 48 * 80 and (got.groupby("query").node.agg(["min", "max"]) == [80, 49 * 80 - 1]).all(axis=None)


def test_block_size():
    assert neighbours.block_size(51_282, 256, 6) == 8192 and neighbours.block_size(10, 256, 8) == 1024
    for n, width in ((10**10, 256), (10**10, 3072), (10**9, 10**6)):
        size = neighbours.block_size(n, width, 1000)
        assert size == 16 or size * (neighbours.MEET + 1) * width <= neighbours.BLOCK_BYTES


def test_numbers_are_gapless_and_keep_near_nodes_together(spark):
    rng = np.random.default_rng(1)
    x = (rng.standard_normal((20, 8))[np.arange(800) % 20] * 10 + rng.standard_normal((800, 8)) * 0.01).astype("<f4")
    rows = spark.createDataFrame([(bytearray(v.tobytes()), 1, i) for i, v in enumerate(x)], "vector binary, copies long, least long").repartition(5)
    mean = neighbours.centre(rows, 800, "<f4")
    assert np.allclose(mean, x.mean(0), atol=1e-4)
    out = neighbours.numbered_nodes(rows, 800, "<f4", mean).toPandas().sort_values("node")
    assert out.node.tolist() == list(range(800)) and sorted(out.least) == list(range(800))
    assert (np.diff(out.least % 20) != 0).sum() < 200  # runs of one cluster, where chance would give 760 changes


def test_hub_repeats_and_lengths(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 24))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    x[700] = 0.01  # at distance 1 of all others, nearer than most: on nearly all lists
    rows = [(i, v.tolist(), 0, "x") for i, v in enumerate(x)]
    rows += rows[:200] + [(5000, [1.0] * 5, 0, "x"), (5100, [], 0, "x"), (None, x[3].tolist(), 0, "x")]
    table = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = neighbours.search(table).toPandas().sort_values(["query_id", "rank"])
    assert sorted(got.query_id.unique()) == list(range(0, 1500, 100)) and len(got) == 150
    assert not got.duplicated(["query_id", "vec_id"]).any() and (got.query_id != got.vec_id).all() and got.vec_id.max() < 1500
    hits = sum(len(set(brute(x, q)) & set(g.vec_id)) for q, g in got.groupby("query_id"))
    assert hits >= 0.95 * 150
    d = ((x[:, None].astype(np.float32) - x[None]) ** 2).sum(2)
    listed = (np.argpartition(d, neighbours.DEGREE + 1, 1)[:, : neighbours.DEGREE + 1] == 700).sum()
    assert listed > 10 * neighbours.MEET  # so it is a hub whose messages are thinned
    far = np.sqrt(((x[got.query_id].astype(float) - x[got.vec_id]) ** 2).sum(1))
    assert np.allclose(far, got.score, rtol=0, atol=1e-12)


def test_beam_grows_until_the_sample_finds_enough(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 24)).astype("<f4")
    rows = spark.createDataFrame([(bytearray(v.tobytes()), 1, i) for i, v in enumerate(x)], "vector binary, copies long, least long")
    mean = neighbours.centre(rows, 900, "<f4")
    nodes = neighbours.numbered_nodes(rows, 900, "<f4", mean)
    lists, _ = neighbours.build(nodes, 900, "<f4", mean, k=8, most_rounds=2)
    graph = neighbours.search_graph(lists)
    queries = nodes.filter(F.col("least") % 30 == 0).select(F.col("node").alias("query"))
    assert neighbours.fitting_beam(queries, graph, 900, "<f4", 10, 10, 0.0) == 10
    beam = neighbours.fitting_beam(queries, graph, 900, "<f4", 10, 10, 0.97)
    assert beam > 10
    found = materialise(neighbours.walk(queries, graph, "<f4", beam), "found").join(nodes.select("node", "least"), "node").toPandas()
    names = nodes.select("node", "least").toPandas().set_index("node").least
    hits = 0
    for q, g in found.groupby("query"):
        hits += len(set(brute(x, names[q])) & set(g.least))
    assert hits >= 0.95 * 300
