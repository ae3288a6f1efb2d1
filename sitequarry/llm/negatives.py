"""Hard negatives: rows of other labels whose score lies in a window under the score of a positive.

Vectors become integers; a score is an integer inner product. Every row keeps its angles to a few reference directions, and
rows are stored in segments of one label that are near in angle, each with the range of its angles and norms. The triangle
inequality for angles bounds the angle between an anchor and all rows of a segment; its cosine times the norms bounds the
scores. Only segments whose bounds overlap an anchor's window are scored. The bounds are widened by more than the rounding
of doubles, the scores are exact.

Anchors, one row in a hundred, are dealt over blocks of bounded bytes, and each block meets all segments, dealt over slices.
A task reads the anchors of its block first, then its segments one after the other, and holds the best rows of each anchor
only. Both passes, for positives and for negatives, are this one join with other windows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitequarry.llm.common import materialise

#: Reference directions, rows that they are fitted on at most, rows of a segment.
REFERENCES, SAMPLE, SEGMENT = 16, 4_096, 512
#: Bytes of the anchors' vectors of a block (as doubles), and segments of a slice, at most.
BLOCK_BYTES, SLICE = 64_000_000, 2_000
#: Anchors scored together, and found pairs held before they are merged.
AT_ONCE, HELD = 2_048, 1_000_000
#: Sums of products under this are exact in doubles; larger ones are made in 64-bit integers, up to the second bound.
EXACT, MOST = float(2**53), float(2**62)
#: Angles are widened by more than an arc cosine of doubles can err, scores by a share of the norms' product and by one.
ANGLE_SLACK, SCORE_SLACK = 1e-6, 1e-9

PLACED = "vec_id long, label int, vector binary, norm double, angles array<double>, home int"
SEGMENTS = "label int, ids binary, vectors binary, low array<double>, high array<double>, least double, most double"
BEST = "anchor_id long, twin long, place int, score long, vec_id long"


def _integers(packed: list[bytes], width: int) -> np.ndarray:
    """Rows of int64 from packed vectors, whatever the size of their numbers."""
    out = np.empty((len(packed), width), np.int64)
    for size in {len(x) for x in packed}:
        at = [i for i, x in enumerate(packed) if len(x) == size]
        out[at] = np.frombuffer(b"".join(packed[i] for i in at), f"<i{size // width}").reshape(-1, width)
    return out


def _packed(row: np.ndarray) -> bytes:
    most = max(-int(row.min()), int(row.max())) if row.size else 0
    return row.astype("<i2" if most < 2**15 else "<i4" if most < 2**31 else "<i8").tobytes()


def angles_to(vectors: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angles of rows to unit directions; a zero row has a right angle to all, and no score but 0."""
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.arccos(np.clip(vectors / np.where(norms > 0, norms, 1) @ references.T, -1, 1))


def fit_references(sample: np.ndarray, k: int) -> np.ndarray:
    """Unit directions in the middle of groups of the sample (ten rounds of means); they only change what can be skipped."""
    norms = np.linalg.norm(sample, axis=1, keepdims=True)
    unit = (sample / np.where(norms > 0, norms, 1))[norms[:, 0] > 0]
    if not len(unit):
        return np.eye(1, sample.shape[1])
    centres = unit[:: max(1, len(unit) // k)][:k].copy()
    for _ in range(10):
        home = (unit @ centres.T).argmax(1)
        for c in range(len(centres)):
            mean = unit[home == c].sum(0)
            if np.linalg.norm(mean) > 0:
                centres[c] = mean / np.linalg.norm(mean)
    return centres


def bounds(alpha: np.ndarray, norm: np.ndarray, low: np.ndarray, high: np.ndarray, least: float, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score that anchors (angles [n, r], norms [n]) can have with rows whose angles and norms lie in ranges."""
    closest = np.maximum(np.maximum(low - alpha, alpha - high).max(1) - ANGLE_SLACK, 0)
    widest = np.minimum(np.minimum(alpha + high, 2 * np.pi - alpha - low).min(1) + ANGLE_SLACK, np.pi)
    up, down = np.cos(closest), np.cos(widest)
    slack = SCORE_SLACK * norm * most + 1
    return norm * down * np.where(down >= 0, least, most) - slack, norm * up * np.where(up >= 0, most, least) + slack


class Best:
    """For each of `groups` the k entries of highest score, ties by smaller id. `last` and `last_id` are the k-th ones."""

    def __init__(self, groups: int, k: int):
        self.k, self.size, self.parts = k, 0, []
        self.score, self.ids = np.full((groups, k), np.iinfo(np.int64).min), np.full((groups, k), np.iinfo(np.int64).max)

    @property
    def last(self) -> np.ndarray:
        return self.score[:, -1]

    @property
    def last_id(self) -> np.ndarray:
        return self.ids[:, -1]

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.parts.append((group, score, ids))
        self.size += len(group)
        if self.size >= HELD:
            self.merge()

    def merge(self) -> None:
        if not self.size:
            return
        group, score, ids = (np.concatenate(c) for c in zip(*self.parts))
        self.parts, self.size = [], 0
        heads = np.unique(group)
        group = np.concatenate([group, np.repeat(heads, self.k)])
        score, ids = np.concatenate([score, self.score[heads].ravel()]), np.concatenate([ids, self.ids[heads].ravel()])
        order = np.lexsort((ids, ~score, group))  # ~score falls as score rises, without overflow
        group, score, ids = group[order], score[order], ids[order]
        start = np.searchsorted(group, heads)
        at = start[:, None] + np.arange(self.k)
        self.score[heads], self.ids[heads] = score[at], ids[at]

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Group, place in it, score and id of all that was found."""
        self.merge()
        group, place = np.nonzero(self.ids < np.iinfo(np.int64).max)
        return group, place, self.score[group, place], self.ids[group, place]


def place_rows(embeddings: DataFrame, references: np.ndarray, width: int, shift_every: int, labels: int) -> DataFrame:
    """PLACED rows: integers, norms, angles, nearest direction; see mine() for the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(2).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, width)
            x = np.floor(256 * x)
            norm = np.sqrt((x * x).sum(1))
            keep = norm * norm < MOST
            whole, angle = x[keep].astype(np.int64), angles_to(x[keep], references)
            some = batch.filter(pa.array(keep))
            ends = pa.array(np.arange(0, angle.size + 1, len(references), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([_packed(r) for r in whole], pa.binary()), pa.array(norm[keep]), pa.ListArray.from_arrays(ends, pa.array(angle.ravel())), pa.array(angle.argmin(1).astype(np.int32) if len(angle) else [], pa.int32())], names=["vec_id", "label", "vector", "norm", "angles", "home"])

    shifted = F.when(F.col("vec_id") % shift_every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")).cast("int")
    return taking_part(embeddings).filter(F.size("x") == width).select("vec_id", shifted.alias("label"), "x").mapInArrow(run, PLACED)


def taking_part(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, x of rows without nulls and non-finite components."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    return rows.filter("vec_id is not null and label is not null and size(x) > 0").filter(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))


def segments_of(placed: DataFrame, width: int, rows: int) -> DataFrame:
    """SEGMENTS of at most `rows` rows of one label, in order of nearest direction and angle to it. Repeated rows are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        before = None

        def segment() -> pa.RecordBatch:
            v = _integers([r["vector"] for r in held], width)
            angle, norm = np.array([r["angles"] for r in held]), [r["norm"] for r in held]
            ids = np.array([r["vec_id"] for r in held], np.int64)
            low, high = angle.min(0), angle.max(0)
            return pa.RecordBatch.from_pylist([{"label": held[0]["label"], "ids": ids.tobytes(), "vectors": _packed(v), "low": low.tolist(), "high": high.tolist(), "least": min(norm), "most": max(norm)}], schema)

        doubles = pa.list_(pa.float64())
        schema = pa.schema([("label", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("low", doubles), ("high", doubles), ("least", pa.float64()), ("most", pa.float64())])
        for batch in batches:
            for r in batch.to_pylist():
                own = (r["vec_id"], r["label"], r["vector"])
                if own == before:
                    continue
                before = own
                if held and (len(held) == rows or held[0]["label"] != r["label"]):
                    yield segment()
                    held.clear()
                held.append(r)
        if held:
            yield segment()

    key = ["label", "home", "angle", "vec_id", "vector"]
    ordered = placed.withColumn("angle", F.col("angles")[F.col("home")]).repartitionByRange(*key).sortWithinPartitions(*key)
    return materialise(ordered.select("vec_id", "label", "vector", "norm", "angles").mapInArrow(run, SEGMENTS).withColumn("segment", F.monotonically_increasing_id()), "segments")


def _search(anchors: DataFrame, segments: DataFrame, blocks: int, slices: int, width: int, k: int, same_label: bool, windows) -> DataFrame:
    """BEST rows: for each window of each anchor the k best rows of each slice, of the anchor's label or of the others.

    `windows` makes the least and greatest score [n, w] that count from the `scores` lists of n anchors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, block, rows = None, None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["unit"] != unit:
                    if block:
                        yield block.found()
                    unit, block, rows = r["unit"], None, []
                if r["anchor_id"] is not None:
                    rows.append(r)
                    continue
                if block is None and rows:
                    block, rows = _Block(rows, width, k, same_label, windows), []
                if block:
                    block.meet(r)
        if block:
            yield block.found()

    dealt = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) * slices
    none = lambda kind: F.lit(None).cast(kind)
    own = anchors.withColumn("unit", F.explode(F.sequence(dealt, dealt + slices - 1))).select("unit", F.col("vec_id").alias("anchor_id"), "twin", "label", none("binary").alias("ids"), F.col("vector").alias("vectors"), F.col("angles").alias("low"), none("array<double>").alias("high"), F.col("norm").alias("least"), F.col("norm").alias("most"), "scores")
    slice_ = F.pmod(F.xxhash64("segment"), F.lit(slices))
    others = segments.withColumn("unit", F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: b * slices + slice_))).select("unit", none("long").alias("anchor_id"), none("long").alias("twin"), "label", "ids", "vectors", "low", "high", "least", "most", none("array<long>").alias("scores"))
    together = own.unionByName(others).repartitionById(blocks * slices, F.col("unit").cast("int")).sortWithinPartitions("unit", F.col("anchor_id").isNull())
    return together.mapInArrow(run, BEST)


class _Block:
    """Anchors of a task, and what was found for them."""

    def __init__(self, rows: list[dict], width: int, k: int, same_label: bool, windows):
        self.id, self.twin, self.label = (np.array([r[c] for r in rows], np.int64) for c in ("anchor_id", "twin", "label"))
        self.whole = _integers([r["vectors"] for r in rows], width)
        self.vectors = self.whole.astype(np.float64)
        self.alpha, self.norm = np.array([r["low"] for r in rows]), np.array([r["least"] for r in rows])
        self.low, self.high = windows([r["scores"] for r in rows])
        self.width, self.same, self.k = width, same_label, k
        self.best = Best(self.low.size, k)

    def meet(self, r: dict) -> None:
        """Score the rows of a segment with the anchors whose windows its bounds overlap."""
        n, w = self.low.shape
        ids = np.frombuffer(r["ids"], np.int64)
        low, high = bounds(self.alpha, self.norm, np.array(r["low"]), np.array(r["high"]), r["least"], r["most"])
        need = np.maximum(self.low, self.best.last.reshape(n, w))  # a score under the k-th best is of no use
        open_ = ((self.low <= self.high) & (need <= high[:, None]) & (self.high >= low[:, None])).any(1)
        at = np.flatnonzero(open_ & ((self.label == r["label"]) == self.same))
        if not len(at):
            return
        whole = _integers([r["vectors"]], len(ids) * self.width).reshape(len(ids), self.width)
        exact = self.norm[at].max() * r["most"] < EXACT
        rows = whole.astype(np.float64).T if exact else whole.T
        for lo in range(0, len(at), AT_ONCE):
            some = at[lo : lo + AT_ONCE]
            score = (self.vectors[some] @ rows).astype(np.int64) if exact else self.whole[some] @ rows
            for j in range(w):
                group = some * w + j
                last, last_id = self.best.last[group, None], self.best.last_id[group, None]
                fits = (score >= self.low[some, j, None]) & (score <= self.high[some, j, None]) & ((score > last) | (score == last) & (ids < last_id))
                if self.same:
                    fits &= ids != self.id[some, None]
                if len(ids) > self.k and np.count_nonzero(fits) > 2 * self.k * len(some):
                    masked = np.where(fits, score, np.iinfo(np.int64).min)
                    fits &= masked >= np.partition(masked, -self.k, 1)[:, -self.k, None]
                a, b = np.nonzero(fits)
                self.best.add(group[a], score[a, b], ids[b])

    def found(self) -> pa.RecordBatch:
        group, _, score, ids = self.best.entries()
        a, w = group // self.low.shape[1], group % self.low.shape[1]
        return pa.RecordBatch.from_arrays([pa.array(self.id[a]), pa.array(self.twin[a]), pa.array(w.astype(np.int32)), pa.array(score), pa.array(ids)], names=["anchor_id", "twin", "place", "score", "vec_id"])


def _reduced(found: DataFrame, k: int) -> DataFrame:
    """The k best of each window over all slices, with rank."""
    w = Window.partitionBy("anchor_id", "twin", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def no_window(scores: list) -> tuple[np.ndarray, np.ndarray]:
    """Every score counts."""
    return np.full((len(scores), 1), -(2**62)), np.full((len(scores), 1), 2**62)


def score_windows(most: int, low: int, high: int):
    """Windows of low to high percent of each of at most `most` scores; a list that is shorter has windows that hold nothing."""

    def windows(scores: list) -> tuple[np.ndarray, np.ndarray]:
        p = np.array([[*s, *[0] * (most - len(s))] for s in scores], np.int64).reshape(len(scores), most)
        real = np.arange(most) < np.array([len(s) for s in scores])[:, None]
        q, r = np.divmod(p, 100)  # percent without overflow: p = 100 q + r
        return np.where(real, low * q - (-low * r // 100), 1), np.where(real, high * q + high * r // 100, 0)

    return windows


def mine(embeddings: DataFrame, every: int = 100, positives: int = 5, k: int = 10, low: int = 30, high: int = 90, shift_every: int = 7, labels: int = 10, references: int = REFERENCES, segment: int = SEGMENT, block_bytes: int = BLOCK_BYTES, slice_segments: int = SLICE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose vec_id is divisible by `every`. Positives are the `positives` best other rows of the anchor's
    label, fewer where the label has fewer; for each, the k best rows of other labels from low to high percent of its score
    (none for a negative score). Where vec_id is divisible by shift_every the label first becomes (label + 1) % labels.
    A component x becomes floor(256 x). Ties go to the smaller vec_id. Rows with a null id or label, or with a null, empty
    or non-finite vector take no part, nor do vectors of another length than the first by id, nor those whose integers
    have a squared norm of 2^62 or more, for their scores may not fit a long. Rows that repeat id, label and vector count
    once; one id with several vectors is as many rows. An empty table gives none; other columns are not read. A group of
    equal vectors fills segments like any other rows: it is split by vec_id.
    """
    spark = embeddings.sparkSession
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = taking_part(embeddings)
    about = rows.agg(F.min_by(F.size("x"), "vec_id").alias("width"), F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("anchors")).first()
    if not about["anchors"]:
        return spark.createDataFrame([], empty)
    width = about["width"]
    sample = rows.filter(F.size("x") == width).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("x").toArrow()
    directions = fit_references(np.floor(256 * np.array(sample["x"].to_pylist())), references)
    placed = place_rows(embeddings, directions, width, shift_every, labels)
    segments = segments_of(placed, width, segment)
    own = placed.filter(F.col("vec_id") % every == 0).withColumn("twin", F.xxhash64("label", "vector")).dropDuplicates(["vec_id", "label", "vector"])
    own = materialise(own.withColumn("scores", F.array().cast("array<long>")), "anchors")
    blocks = math.ceil(about["anchors"] * width * 8 / block_bytes)
    n = segments.count()
    slices = max(math.ceil(n / slice_segments), min(n, math.ceil(2 * spark.sparkContext.defaultParallelism / blocks)), 1)
    near = materialise(_reduced(_search(own, segments, blocks, slices, width, positives, True, no_window), positives).select("anchor_id", "twin", F.col("rank").alias("nth"), F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id")), "positives")
    lists = near.groupBy(F.col("anchor_id").alias("vec_id"), "twin").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "positive_score"))), lambda s: s["positive_score"]).alias("scores"))
    asked = own.drop("scores").join(lists, ["vec_id", "twin"])
    windows = score_windows(positives, low, high)
    found = _reduced(_search(asked, segments, blocks, slices, width, k, False, windows), k).withColumn("nth", F.col("place") + 1)
    out = found.join(near, ["anchor_id", "twin", "nth"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM (SELECT DISTINCT vec_id, label, embedding FROM embeddings)
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_dot_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same AND vec_id <> anchor_id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""
