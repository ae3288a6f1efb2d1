"""Near-duplicates by ProbMinHash, banding and exact verification.

A text is its set of five-word shingles, all of weight 1 however often they occur. ProbMinHash lets each shingle arrive
at random slots as a Poisson process of its weight's rate and keeps the earliest arrival in each slot; a shingle stops
when its next arrival is later than every slot's. Two texts agree in a slot with the Jaccard similarity of their sets.
Bands of slots give candidates; a candidate is a link if that same similarity is 0.8 or more.

Equal texts are one node. Every node is compared with the heaviest head of its buckets, then with the heads of those
buckets that this hasn't joined it to (stars, not all pairs). In buckets that are still not all one, nodes outside the
main part meet the others, and are compared unless one of two exact bounds rules a link out: Jaccard distance is a
metric, so distances to a common head must differ by 0.2 at most; and sets whose parity bitmaps differ in h bits differ
in h shingles at least. No pair is dropped by a cap. Shingles are 32-bit hashes: two different ones of a pair of texts
of 1,000 shingles are taken for one with probability 2e-4, which moves the similarity by a thousandth.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitequarry.llm.common import attach, discard, materialise
from sitequarry.llm.words import WordTable, text_slices

SHINGLE, SLOTS, BAND, THRESHOLD = 5, 96, 4, 0.8
#: Words are runs of digits, a-z (after A-Z are lower-cased) and bytes of non-ASCII characters.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_STEPS = [np.uint64(pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) | 1) for j in range(SHINGLE)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits look independent."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.array([zlib.crc32(w) | zlib.crc32(w, 0x5BD1E995) << 32 for w in words], dtype=np.uint64).reshape(-1, 1)


def word_table() -> WordTable:
    """Hashes of words; a task has its own, which ends with it."""
    return WordTable(_hashes, 1, 200_000, np.uint64)


def shingles(words: list[list[bytes]], table: WordTable) -> tuple[np.ndarray, np.ndarray]:
    """Owner and 32-bit shingle, once each, by owner and shingle. Texts of one to four words are one shingle."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    flat = [x for w in words for x in w]
    numbers = table.numbers(flat)  # may replace table.rows
    h = mix(table.rows[numbers, 0])
    owner = np.repeat(np.arange(len(words), dtype=np.int64), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(flat))  # words from here to the text's end
    s = np.zeros(len(flat), np.uint64)
    for j in range(SHINGLE):
        part = np.zeros(len(flat), np.uint64)
        part[: len(flat) - j] = h[j:] if j else h
        s += np.where(left > j, part, np.uint64(0)) * _STEPS[j]
    first = np.cumsum(lengths) - lengths
    whole = left >= SHINGLE
    whole[first[(lengths > 0) & (lengths < SHINGLE)]] = True
    packed = np.sort((owner[whole].astype(np.uint64) << np.uint64(32)) | (mix(s[whole]) >> np.uint64(32)))
    at = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]])) if len(packed) else np.zeros(0, np.int64)
    packed = packed[at]
    return (packed >> np.uint64(32)).astype(np.int64), packed & np.uint64(0xFFFFFFFF)


def probminhash(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """Sketches [n, slots] of weighted sets, all sets of a batch together: the element that first reached each slot.

    Arrival times and elements are packed in one number (positive floats sort like their bits), so the earliest wins.
    """
    never = np.uint64(0xFFFFFFFFFFFFFFFF)
    best = np.full(n * slots, never, dtype=np.uint64)
    seed = mix(element * _MIX[0] + _MIX[1])
    time = np.zeros(len(element))
    step = 0
    while len(owner):
        step += 1
        r = mix(seed + np.uint64(step * int(_MIX[0]) & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        slot = (mix(r) % np.uint64(slots)).astype(np.int64)
        packed = (time.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | element
        np.minimum.at(best, owner * slots + slot, packed)
        latest = (best.reshape(n, slots).max(1) >> np.uint64(32)).astype(np.uint32).view(np.float32).astype(np.float64)
        latest[np.isnan(latest)] = np.inf  # a slot is still empty
        go = time < latest[owner]
        owner, element, weight, seed, time = owner[go], element[go], weight[go], seed[go], time[go]
    return (best & np.uint64(0xFFFFFFFF)).reshape(n, slots)


def band_keys(sketch: np.ndarray, band: int = BAND) -> np.ndarray:
    """[n, slots / band] hashes of the bands, different for each band's place."""
    n, slots = sketch.shape
    parts = sketch.reshape(n, slots // band, band)
    key = np.arange(slots // band, dtype=np.uint64)[None] * _MIX[0]
    for j in range(band):
        key = mix(key ^ parts[:, :, j]) + _MIX[0]
    return key.view(np.int64)


SKETCH = "doc_id long, raw long, k1 long, k2 long, bands array<long>, shingles binary"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = word_table()
    for batch in batches:
        for a, texts in text_slices(batch.column(1)):
            b = a + len(texts)
            words = [words_of(t) for t in texts]
            owner, element = shingles(words, table)
            keys = band_keys(probminhash(owner, element, np.ones(len(element)), b - a))
            cuts = np.searchsorted(owner, np.arange(b - a + 1))
            flat = element.astype("<u4")
            digest = np.array([np.frombuffer(hashlib.blake2b(b" ".join(w) if w else b"\0" + t.encode(), digest_size=16).digest(), "<i8") for w, t in zip(words, texts)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array([list(k) if w else [] for k, w in zip(keys.tolist(), words)], pa.list_(pa.int64())), pa.array([flat[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary())],
                names=["doc_id", "raw", "k1", "k2", "bands", "shingles"],
            )


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.empty(batch.num_rows)
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
            a, b = np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4")
            both = len(np.intersect1d(a, b, assume_unique=True))
            out[i] = both / max(1, len(a) + len(b) - both)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], names=["a", "b", "similarity"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, similarity of node pairs. Rows of pairs are narrow, and one node's many pairs are split by the adaptive skew join."""
    left = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    return pairs.select("a", "b").join(left.hint("merge"), "b").join(right.hint("merge"), "a").select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node that each node of an undirected graph can reach.

    Labels fall to the least of the neighbours', then to their label's label, until nothing changes; each round is
    written, so lineage stays short. Rounds grow with the logarithm of the longest path.
    """
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        target = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = materialise(step.join(target, "label", "left").select("node", "old", F.coalesce(F.least("label", "next"), "label").alias("label")), "labels")
        if new.filter("label <> old").isEmpty():
            discard(both, labels)
            return new.select("node", "label")
        discard(labels)
        labels = new


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, class_size, kept, raw: one row per input row.

    class_id is the least doc_id of all documents that links and equal texts join. Null is empty text. Texts without
    words are joined to texts equal to them only; texts of one to four words to those with the same words. Repeated
    rows share a class and one of them is kept. An empty table gives no rows; other columns are not read.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("raw", F.xxhash64("text"))
    sketch = materialise(own.mapInArrow(_sketch, SKETCH).withColumn("uid", F.monotonically_increasing_id()), "sketches")
    n = sketch.count()
    copies = materialise(sketch.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min("uid").alias("first")).filter("copies > 1"), "copies")
    members = attach(sketch.select("uid", "doc_id", "raw", "k1", "k2"), copies, ["k1", "k2"], n, "copies")
    members = materialise(members.select("uid", "doc_id", "raw", F.coalesce("first", "uid").alias("node")), "members")
    links, scratch = _links(sketch, members)
    labels = materialise(components(links), "components")
    nodes = materialise(members.groupBy("node").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "uid")).alias("least")).join(labels, "node", "left").filter("copies > 1 or label is not null").withColumn("label", F.coalesce("label", "node")), "nodes")
    classes = materialise(nodes.groupBy("label").agg(F.sum("copies").alias("class_size"), F.count("*").alias("texts"), F.min("least").alias("top")), "classes")
    info = attach(nodes.select("node", "label", "copies"), classes, ["label"], n, "texts").select("node", "copies", "class_size", "top")
    out = attach(members, materialise(info, "node_classes"), ["node"], n, "copies")
    discard(sketch, copies, labels, nodes, classes, *scratch)
    alone = F.col("class_size").isNull()
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), (alone | (F.col("uid") == F.col("top.uid"))).alias("kept"), "raw"
    )


#: Words of 64 bits in a bitmap of a set.
BITMAP = 16


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, n, w0 ..: a set's size and bitmap. A bit is the parity of the set's shingles that fall on it."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            sets = [np.frombuffer(x.as_buffer(), "<u4") for x in part.column(1)]
            n = np.array([len(x) for x in sets])
            at = np.repeat(np.arange(len(sets)), n) * (64 * BITMAP) + (mix(np.concatenate(sets).astype(np.uint64)) % np.uint64(64 * BITMAP)).astype(np.int64)
            bits = (np.bincount(at, minlength=len(sets) * 64 * BITMAP) & 1).astype(np.uint8).reshape(len(sets), -1)
            words = np.packbits(bits, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), *(pa.array(words[:, w]) for w in range(BITMAP))], names=["b", "n", *(f"w{w}" for w in range(BITMAP))])


def _links(sketch: DataFrame, members: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """a, b: links that join all nodes that belong together, and the tables to discard when they have been read."""
    again = members.filter("uid <> node").select("uid")
    buckets = sketch.select("uid", "bands").join(again, "uid", "left_anti").select(F.col("uid").alias("node"), F.explode("bands").alias("bucket"))
    sizes = materialise(buckets.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), "bucket_sizes")
    # bucket rows are two numbers each; a hot bucket is split by the adaptive skew join, whose two sides come from files
    shared = materialise(buckets.join(sizes.hint("merge"), "bucket"), "shared_buckets")
    # a bucket's head is the node that meets most others in all its buckets: near the middle of a group of copies
    weights = shared.groupBy("node").agg(F.sum("size").alias("weight"))
    weighed = shared.join(weights.hint("merge"), "node").select("bucket", "node", "weight")
    heads = materialise(weighed.groupBy("bucket").agg(F.max(F.struct("weight", "node")).alias("top")).select("bucket", F.col("top.node").alias("a"), F.col("top.weight").alias("weight")), "heads")
    stars = materialise(shared.select("bucket", F.col("node").alias("b")).join(heads.hint("merge"), "bucket").select("bucket", "a", "b", "weight"), "stars_of_buckets")
    wanted = shared.select(F.col("node").alias("uid")).distinct()
    sets = materialise(sketch.select("uid", "shingles").join(wanted.hint("merge"), "uid", "left_semi").withColumnRenamed("uid", "node"), "shingle_sets")
    # first every node against the heaviest head of its buckets: most members of a group of copies are joined by that
    best = stars.groupBy("b").agg(F.max(F.struct("weight", "a"))["a"].alias("a")).filter("a <> b")
    near = materialise(verified(best, sets), "similarities")
    links = near.filter(F.col("similarity") >= THRESHOLD).select("a", "b")
    labels = materialise(components(links), "first_components")
    # then against the heads of buckets that are not joined to it yet
    own = labels.withColumnRenamed("node", "b")
    stars2 = stars.select("bucket", "a", "b").join(own, "b", "left").withColumn("label", F.coalesce("label", "b"))
    labelled = materialise(stars2.join(labels.select(F.col("node").alias("a"), F.col("label").alias("head_label")), "a", "left").withColumn("head_label", F.coalesce("head_label", "a")), "labelled_stars")
    open_ = labelled.filter("label <> head_label").select("a", "b").distinct().join(near, ["a", "b"], "left_anti")
    near2 = materialise(verified(open_, sets), "similarities")
    links2 = materialise(links.unionByName(near2.filter(F.col("similarity") >= THRESHOLD).select("a", "b")), "links")
    labels2 = materialise(components(links2), "second_components")
    # last, in buckets whose nodes still aren't all joined, those outside the bucket's main label meet the others
    known = stars.select("bucket", "b").join(labels2.withColumnRenamed("node", "b"), "b", "left").withColumn("label", F.coalesce("label", "b"))
    shares = known.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    parted = shares.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("labels"), F.sum("n").alias("size")).filter("labels > 1 and size > 2").select("bucket", "main")
    away = near.select("b", F.col("a").alias("head"), (1 - F.col("similarity")).alias("away"))
    rest = materialise(known.join(parted.hint("merge"), "bucket").join(away, "b", "left").select("bucket", "b", "label", "main", F.coalesce("head", "b").alias("head"), F.coalesce("away", F.lit(0.0)).alias("away")), "parted_buckets")
    few = sets.join(rest.select(F.col("b").alias("node")).distinct(), "node", "left_semi").select("node", "shingles")
    bitmaps = materialise(few.mapInArrow(_bitmaps, "b long, n long, " + ", ".join(f"w{w} long" for w in range(BITMAP))), "bitmaps")
    rest2 = materialise(rest.join(bitmaps.hint("merge"), "b"), "bitmap_buckets")
    x, y = rest2.filter("label <> main").alias("x"), rest2.alias("y")
    # sets whose bitmaps differ in h bits differ in h shingles at least; distances to a common head differ by no more than their own
    differ = sum((F.bit_count(F.col(f"x.w{w}").bitwiseXOR(F.col(f"y.w{w}"))) for w in range(BITMAP)), F.lit(0))
    both = (F.col("x.n") + F.col("y.n") - differ) / 2
    near_enough = (F.col("x.head") != F.col("y.head")) | (F.abs(F.col("x.away") - F.col("y.away")) <= 1 - THRESHOLD + 1e-9)
    once = (F.col("y.label") == F.col("y.main")) | (F.col("x.label") < F.col("y.label"))
    could = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.label") != F.col("y.label")) & once & near_enough & (both >= THRESHOLD * (F.col("x.n") + F.col("y.n") - both) - 1e-9)
    compared = near.select("a", "b").unionByName(near2.select("a", "b"))
    compared = compared.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = x.join(y, could).select(F.least("x.b", "y.b").alias("a"), F.greatest("x.b", "y.b").alias("b")).distinct().join(compared, ["a", "b"], "left_anti")
    more = materialise(pairs, "more_pairs")
    found = materialise(verified(more, sets).filter(F.col("similarity") >= THRESHOLD), "more_links")
    discard(sizes, shared, heads, stars, labelled, near, near2, rest, rest2, bitmaps, more, sets, labels, labels2)
    return links2.unionByName(found.select("a", "b")), [links2, found]
