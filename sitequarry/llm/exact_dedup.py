"""Exact deduplication by composable polynomial fingerprints.

A text's bytes b_0 .. b_(n-1), A-Z lower-cased, have the fingerprint sum(b_i * r^(n-1-i)) mod p under two primes.
Fingerprints compose: f(xy) = f(x) * r^len(y) + f(y), so chunks are hashed independently, many at a time, and then
combined by shifting. Equal (fingerprint, length) is only a candidate; the texts are then compared chunk by chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitequarry.llm.common import HOT_SHARE, attach, discard, materialise

CHUNK = 4096
PRIMES = (2147483629, 2147483587)
BASES = (1000003, 69069069)
#: Chunks hashed at a time: 256 * 4096 bytes, 8 MB as float64.
ROWS_AT_ONCE = 256
SALTS = 64
KEYS = ["fp1", "fp2", "n_bytes"]


def _powers() -> np.ndarray:
    """r^(CHUNK-1-i) mod p as float64: 8 + 31 bits, summed over 2^12 terms, stay exact below 2^53."""
    out = np.empty((CHUNK, 2))
    for k, (r, p) in enumerate(zip(BASES, PRIMES)):
        x = 1
        for i in range(CHUNK - 1, -1, -1):
            out[i, k] = x
            x = x * r % p
    return out


_POWERS = _powers()
SHIFT = tuple(pow(r, CHUNK, p) for r, p in zip(BASES, PRIMES))


def compose(left: tuple[int, int], right: tuple[int, int], right_len: int) -> tuple[int, int]:
    """Fingerprint of a concatenation from the fingerprints of its two parts."""
    return tuple((a * pow(r, right_len, p) + b) % p for a, b, r, p in zip(left, right, BASES, PRIMES))


def fingerprints(texts: list[bytes]) -> list[tuple[int, int]]:
    """Fingerprints of normalised texts. Each text is padded in front with zero bytes to whole chunks."""
    need = [-(-len(t) // CHUNK) for t in texts]
    hashes = np.empty((sum(need), 2), dtype=np.int64)
    block = np.zeros((ROWS_AT_ONCE, CHUNK), dtype=np.uint8)
    filled = done = 0

    def flush() -> None:
        nonlocal filled, done
        sums = block[:filled].astype(np.float64) @ _POWERS
        hashes[done : done + filled] = sums.astype(np.int64) % np.array(PRIMES)
        done += filled
        filled = 0

    for t, rows in zip(texts, need):
        head = len(t) - (rows - 1) * CHUNK
        for c in range(rows):
            part = np.frombuffer(t, np.uint8, head if c == 0 else CHUNK, 0 if c == 0 else head + (c - 1) * CHUNK)
            block[filled, : CHUNK - len(part)] = 0
            block[filled, CHUNK - len(part) :] = part
            filled += 1
            if filled == ROWS_AT_ONCE:
                flush()
    flush()
    out, at = [], 0
    for rows in need:
        a = b = 0
        for h1, h2 in hashes[at : at + rows].tolist():
            a, b = (a * SHIFT[0] + h1) % PRIMES[0], (b * SHIFT[1] + h2) % PRIMES[1]
        out.append((a, b))
        at += rows
    return out


def _texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes with A-Z in lower case (bytes.lower touches nothing else); null is empty."""
    return [(x or b"").lower() for x in column.cast(pa.binary()).to_pylist()]


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = _texts(batch.column(1))
        prints = fingerprints(texts)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([a for a, _ in prints], pa.int64()), pa.array([b for _, b in prints], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), batch.column(2)],
            names=["doc_id", *KEYS, "text_sha256", "raw"],
        )


def _with_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = _texts(batch.column(1))
        prints = fingerprints(texts)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([a for a, _ in prints], pa.int64()), pa.array([b for _, b in prints], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(texts, pa.binary())],
            names=["doc_id", *KEYS, "body"],
        )


def same(a: bytes, b: bytes) -> bool:
    """Chunkwise comparison that stops at the first chunk that differs."""
    x, y = memoryview(a), memoryview(b)
    return len(a) == len(b) and all(x[i : i + CHUNK] == y[i : i + CHUNK] for i in range(0, len(a), CHUNK))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key and salt. The first of a run is held, and every other one streams past it.

    Gives a row for each head of a run (head: its body, to be compared with the heads of other salts) and for each
    row that differs from its head (differs: true).
    """
    key, head = None, b""
    for batch in batches:
        out: list[tuple] = []
        for doc_id, fp1, fp2, n, salt, body in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if (fp1, fp2, n, salt) != key:
                key, head = (fp1, fp2, n, salt), body
                out.append((doc_id, fp1, fp2, n, body if salt >= 0 else None, False))
            elif not same(head, body):
                out.append((doc_id, fp1, fp2, n, None, True))
        cols = list(zip(*out)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()))], names=["doc_id", *KEYS, "body", "differs"])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, raw (hash of the text as it is): one row per input row.

    Null text is empty text; all empty texts are equal. Of equal texts the largest doc_id stays (null ids sort
    first); of repeated rows with that id exactly one is kept. An empty table gives no rows. Other columns are not
    read, so clashing names do no harm.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("raw", F.xxhash64("text"))
    rows = materialise(own.mapInArrow(_digest, "doc_id long, fp1 long, fp2 long, n_bytes long, text_sha256 string, raw long").withColumn("uid", F.monotonically_increasing_id()), "fingerprints")
    n = rows.count()
    shared = materialise(rows.groupBy(*KEYS).agg(F.count("*").alias("copies")).filter("copies > 1"), "shared_fingerprints")
    wrong = materialise(_mismatches(own, shared, n), "fingerprint_collisions")
    keys = [*KEYS, "apart"]
    if wrong.isEmpty():
        rows = rows.withColumn("apart", F.lit(""))
    else:  # a collision: rows that differ from their head are told apart by the digest, and so is everything with that key
        apart = wrong.select(*KEYS).distinct().withColumn("clash", F.lit(True))
        rows = rows.join(apart, KEYS, "left").withColumn("apart", F.when(F.col("clash"), F.col("text_sha256")).otherwise("")).drop("clash")
    totals = materialise(rows.groupBy(*keys).agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "uid")).alias("top")).filter("group_size > 1"), "copy_groups")
    out = attach(rows, totals, keys, n, "group_size")
    alone = F.col("group_size").isNull()
    discard(shared, wrong)
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("uid") == F.col("top.uid"))).alias("kept"),
        "text_sha256",
        "raw",
    )


def _mismatches(own: DataFrame, shared: DataFrame, n_rows: int) -> DataFrame:
    """Rows whose text differs from the text that heads their fingerprint, found by comparing chunks.

    Texts move only by (fingerprint, salt): a hot fingerprint is spread over SALTS runs whose heads meet afterwards.
    """
    hot = shared.filter(F.col("copies") > max(1000, n_rows // HOT_SHARE)).select(*KEYS, F.lit(True).alias("hot"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).otherwise(F.lit(-1))
    bodies = own.mapInArrow(_with_text, "doc_id long, fp1 long, fp2 long, n_bytes long, body binary").join(F.broadcast(hot), KEYS, "left").withColumn("salt", salt).drop("hot")
    wanted = shared.join(F.broadcast(hot), KEYS, "left").select(*KEYS, F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(-1)))).alias("salt"))
    runs = bodies.repartition(*KEYS, "salt").join(wanted, [*KEYS, "salt"], "left_semi").select("doc_id", *KEYS, "salt", "body")
    schema = "doc_id long, fp1 long, fp2 long, n_bytes long, body binary, differs boolean"
    first = materialise(runs.sortWithinPartitions(*KEYS, "salt").mapInArrow(_compare, schema).filter("differs or body is not null"), "run_heads")
    heads = first.filter("not differs").select("doc_id", *KEYS, F.lit(-1).alias("salt"), "body")
    second = heads.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(_compare, schema)
    return first.filter("differs").unionByName(second.filter("differs")).select("doc_id", *KEYS)
