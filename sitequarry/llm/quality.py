"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation estimates, from
the counts of vote patterns over all documents, how accurate each labeller is and how common good documents are; the
posteriors then label a bounded sample, on which a hashed linear scorer is trained. The scorer reads token shapes and the
labellers' votes and binned rates, and scores every document. No hand-made label is used.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitequarry.llm.common import discard, materialise
from sitequarry.llm.words import WordTable, chunks_of, text_slices

#: Documents, first by hash of their id, on which the linear scorer is trained.
TRAIN_DOCS = 4000
BITS = 14
EM_ROUNDS = 100
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = "a an and are as at be by for from in is it of on or that the this to was with au aux dans de des du elle en est et la le les leur ne pas pour que qui se sur un une das dem den der die ein eine für ist im mit nicht sich und von zu al con del el es lo los las mi no para por su una y".split()
#: Columns of a word's row: shape bucket, then the properties that the labellers count.
SHAPE, SYMBOL, LOUD, ORDINARY, STOP, LETTERS, UPPER, ENDS, WIDTH = 0, 1, 2, 3, 4, 5, 6, 7, 8
LABELLERS = ("ordinary_words", "function_words", "characters", "repetition", "variety", "one_word", "sentences", "pairs")
#: Bins of a rate, and numbers of words at which a class of lengths begins.
BINS, LENGTHS = 20, (5, 30, 200)

_stop = frozenset(STOP_WORDS)


class _Kinds(dict):
    """Code point -> X for capitals, x for other letters, 9 for digits, itself for all else."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        self[point] = kind = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        return kind


_kinds, _runs = _Kinds(), re.compile(r"([xX9])\1+")


def _hash(shape: str) -> int:
    return zlib.crc32(shape.encode("utf-8", "surrogatepass")) & 0xFFFFFF


def _row(word: str) -> tuple:
    if word.isalpha() and word.islower():  # most words
        return (_LOWER, 0, 0, 1, word in _stop, len(word), 0, 0)
    kinds = word.translate(_kinds)
    bare = word.strip(".,;:!?\"'()")
    plain = bare.isalpha() and (bare[1:].islower() or len(bare) == 1)
    upper = kinds.count("X")
    letters = kinds.count("x") + upper
    symbols = len(word) - len(word.rstrip("#$%&*@~^=_<>/\\+")) >= 3 or (len(word) > 1 and not letters and "9" not in kinds)
    return (_hash(_runs.sub(r"\1", kinds)[:24]), symbols, word.endswith("!!"), plain, plain and bare.lower() in _stop, letters, upper, word[-1] in ".,;:!?")


_LOWER = _hash("x")


def word_table() -> WordTable:
    """A task has its own, which ends with it."""
    return WordTable(lambda words: np.array([_row(w) for w in words], dtype=np.float32).reshape(-1, WIDTH), WIDTH)


def _sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums over consecutive runs; empty runs give 0."""
    out = np.zeros((len(lengths), *values.shape[1:]))
    some = lengths > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(lengths) - lengths)[some], axis=0)
    return out


def read_words(texts: list[str], table: WordTable) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of whole texts: numbers and rows of all words, whether each repeats the one before, and words in each text."""
    words: list[str] = []
    lengths = np.empty(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        w = t.split()
        lengths[i] = len(w)
        words += w
    numbers = table.numbers(words)
    rows = table.rows[numbers]
    again = np.zeros(len(words), dtype=bool)
    again[1:] = numbers[1:] == numbers[:-1]
    again[(np.cumsum(lengths) - lengths)[lengths > 0]] = False
    return numbers, rows, again, lengths


def measure(numbers: np.ndarray, rows: np.ndarray, again: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The labellers' rates, a row for each text."""
    n, texts = np.maximum(lengths, 1), len(lengths)
    owner = np.repeat(np.arange(texts), lengths)
    s = _sums(rows[:, 1:], lengths)
    each = np.sort(owner << 32 | numbers)
    first = np.flatnonzero(np.diff(each, prepend=-1))
    different = np.bincount(each[first] >> 32, minlength=texts)
    most = np.zeros(texts)
    np.maximum.at(most, each[first] >> 32, np.diff(first, append=len(each)))
    pairs = np.sort((owner[1:] << 44 | numbers[1:] << 22 | numbers[:-1])[owner[1:] == owner[:-1]])
    fresh = np.where(lengths > 1, np.bincount(pairs[np.diff(pairs, prepend=-1) != 0] >> 44, minlength=texts) / np.maximum(lengths - 1, 1), 1.0)
    return np.stack([s[:, ORDINARY - 1] / n, s[:, STOP - 1] / n, (s[:, SYMBOL - 1] + s[:, LOUD - 1]) / n, s[:, UPPER - 1] / np.maximum(s[:, LETTERS - 1], 1), _sums(again.astype(np.float32), lengths) / n, different / n, most / n, s[:, ENDS - 1] / n, fresh, lengths], axis=1)


def votes(rates: np.ndarray) -> np.ndarray:
    """One column per labeller: 1 good, -1 bad, 0 no vote."""
    ordinary, stop, symbols, upper, again, variety, most, ends, fresh, n = rates.T

    def vote(bad, good):
        return np.where(bad, -1, np.where(good, 1, 0))

    return np.stack([
        vote(ordinary < 0.85, ordinary > 0.95),
        vote((n >= 10) & (stop < 0.1), stop > 0.15),
        vote((symbols > 0.03) | ((n >= 3) & (upper > 0.3)), (symbols < 0.01) & ((upper < 0.15) | (n < 5) & (upper < 0.6))),
        vote((n >= 5) & (again > 0.1), again < 0.05),
        vote((n >= 30) & (variety < 0.3), variety > 0.5),
        vote((n >= 10) & (most > 0.2) | (n >= 50) & (most > 0.105), (n >= 5) & (most < 0.09)),
        vote((n >= 10) & ((ends < 0.01) | (ends > 0.4)), (ends >= 0.02) & (ends < 0.35)),
        vote((n >= 30) & (fresh < 0.4), (n >= 5) & (fresh > 0.8)),
    ], axis=1).astype(np.int8)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS) -> tuple[np.ndarray, float, np.ndarray]:
    """Posterior of good per pattern, share of good documents, and P(vote | class) of each labeller.

    The start is the majority vote. Votes are -1, 0 or 1; 0 is silence and says nothing.
    """
    post = 1 / (1 + np.exp(-patterns.sum(1).astype(float)))
    good, table = 0.5, np.ones((2, patterns.shape[1], 3))
    for _ in range(rounds):
        weights = np.stack([counts * (1 - post), counts * post])
        good = float(np.clip(weights[1].sum() / max(counts.sum(), 1), 1e-3, 1 - 1e-3))
        for v in (-1, 1):
            table[:, :, v + 1] = weights @ (patterns == v) + 0.5
        table[:, :, ::2] /= table[:, :, ::2].sum(2, keepdims=True)
        logs = np.log(table)
        ratio = np.log(good / (1 - good)) + sum((logs[1, j, patterns[:, j] + 1] - logs[0, j, patterns[:, j] + 1]) for j in range(patterns.shape[1]))
        new = 1 / (1 + np.exp(-np.clip(ratio, -30, 30)))
        moved, post = np.abs(new - post).max(initial=0), new
        if moved < 1e-6:
            break
    return post, good, table


def accuracies(table: np.ndarray) -> dict[str, dict[str, float]]:
    """Of each labeller: how often its votes are right on good and on bad documents."""
    return {name: {"good": float(table[1, j, 2]), "bad": float(table[0, j, 0])} for j, name in enumerate(LABELLERS)}


def hashed(rows: np.ndarray, again: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Feature numbers of each word: its shape, and its shape with the one before and whether it repeats that word."""
    shape = rows[:, SHAPE].astype(np.int64)
    before = np.concatenate([[0], shape[:-1]]) if len(shape) else shape
    first = np.cumsum(lengths)[:-1]
    before[np.concatenate([[0], first])[lengths > 0]] = 1 if len(shape) else 0
    pair = (shape * 1_000_003 + before * 31 + again.astype(np.int64) * 7919) & ((1 << 40) - 1)
    return np.stack([shape % (1 << (BITS - 1)), (pair * 0x9E3779B1 >> 7) % (1 << (BITS - 1)) + (1 << (BITS - 1))], axis=1)


def rated(rates: np.ndarray) -> np.ndarray:
    """Feature numbers of each text, after those of words: each rate's bin at the text's class of lengths, and each vote."""
    n, v = rates[:, -1], votes(rates)
    bins = np.minimum((rates[:, :-1] * BINS).astype(np.int64), BINS)
    bins += (np.arange(bins.shape[1]) * (len(LENGTHS) + 1) + np.searchsorted(LENGTHS, n, "right")[:, None]) * (BINS + 1)
    first = (rates.shape[1] - 1) * (len(LENGTHS) + 1) * (BINS + 1)
    return np.concatenate([bins, first + np.arange(v.shape[1]) * 3 + v + 1], axis=1) + (1 << BITS)


#: Features of words and of texts.
FEATURES = (1 << BITS) + 9 * (len(LENGTHS) + 1) * (BINS + 1) + 3 * len(LABELLERS)


def train(features: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, table: np.ndarray, epochs: int = 30, seed: int = 0) -> tuple[np.ndarray, float]:
    """Logistic regression on posterior labels by AdaGrad: weights of the hashed features and a bias.

    Votes start at the log ratio that expectation-maximisation found for them, so a vote that is rare in the sample,
    or rare without others, counts as well; training fits the rest.
    """
    w, b, cache, cache_b = np.zeros(FEATURES), 0.0, np.full(FEATURES, 1e-6), 1e-6
    ratios = np.log(table[1] / table[0])
    ratios[:, 1] = 0  # silence
    w[-ratios.size :] = ratios.ravel()
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(features)):
            at, x = features[i]
            g = 1 / (1 + np.exp(-np.clip(w[at] @ x + b, -30, 30))) - target[i]
            grad = g * x + 1e-6 * w[at]
            cache[at] += grad * grad
            w[at] -= 0.3 * grad / np.sqrt(cache[at])
            cache_b += g * g
            b -= 0.1 * g / np.sqrt(cache_b)
    return w, b


def _vote_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = word_table()
    for batch in batches:
        for at, texts in text_slices(batch.column(1)):
            v = votes(measure(*read_words(texts, table)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(["".join("-0+"[x + 1] for x in r) for r in v])], names=["doc_id", "pattern"])


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = word_table()
    for batch in batches:
        for _, texts in text_slices(batch.column(1)):
            read = read_words(texts, table)
            _, rows, again, lengths = read
            rates, numbers, ends = measure(*read), hashed(rows, again, lengths), np.cumsum(lengths)
            found = [np.unique(numbers[e - n : e], return_counts=True) for e, n in zip(ends, lengths)]
            v, more = votes(rates), rated(rates).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0].tolist() + m for x, m in zip(found, more)], pa.list_(pa.int64())), pa.array([(x[1] / max(1, n)).tolist() + [1.0] * len(m) for x, n, m in zip(found, lengths, more)], pa.list_(pa.float64())), pa.array(["".join("-0+"[x + 1] for x in r) for r in v])],
                names=["at", "x", "pattern"],
            )


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> dict | None:
    """The scorer: weights, bias, share of good documents and labeller accuracies. None for an empty table."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    voted = materialise(own.mapInArrow(_vote_batches, "doc_id long, pattern string"), "votes")
    # at most 3^8 patterns, whatever the input
    seen = voted.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()
    if not seen:
        return None
    patterns = np.array([["-0+".index(c) - 1 for c in r["pattern"]] for r in seen], dtype=np.int8)
    post, good, table = expectation_maximisation(patterns, np.array([r["n"] for r in seen], dtype=float))
    by_pattern = {r["pattern"]: p for r, p in zip(seen, post)}
    ids = [r["doc_id"] for r in voted.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs).collect()]
    discard(voted)
    chosen = spark.createDataFrame([(i,) for i in sorted({i for i in ids if i is not None})], "doc_id long")
    sample = own.join(F.broadcast(chosen), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id", "text")).limit(train_docs).mapInArrow(_feature_batches, "at array<long>, x array<double>, pattern string").collect()
    features = [(np.array(r["at"], dtype=np.int64), np.array(r["x"])) for r in sample]
    w, b = train(features, np.array([by_pattern[r["pattern"]] for r in sample]), table)
    return {"weights": w.astype(np.float32), "bias": b, "good": good, "accuracy": accuracies(table)}


def score_texts(texts: list[str], model: dict, table: WordTable | None = None) -> np.ndarray:
    """Probability of good for whole texts."""
    out, table = np.empty(len(texts)), table or word_table()
    for a, b in chunks_of(texts, 1_000_000):
        read = read_words(texts[a:b], table)
        _, rows, again, lengths = read
        numbers = hashed(rows, again, lengths)
        total = _sums(model["weights"][numbers].sum(1), lengths) / np.maximum(lengths, 1)
        total += model["weights"][rated(measure(*read))].sum(1)
        out[a:b] = 1 / (1 + np.exp(-np.clip(total + model["bias"], -30, 30)))
        out[a:b][lengths == 0] = 0.0
    return out


def score(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """doc_id, score (probability of good) and predicted (1 keeps): one row per input row.

    Null, empty and blank texts have score 0. Repeated rows score alike. An empty table gives no rows. Only doc_id
    and text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table()
        for batch in batches:
            for at, texts in text_slices(batch.column(1)):
                s = score_texts(texts, shared.value, table)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """The rows of docs, unchanged, with score 0.5 or more. Null, empty and blank texts score 0 and go.

    Only the text travels to the Python workers, and only scores come back.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))

    @F.arrow_udf("double")
    def good(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = word_table()
        for column in columns:
            yield pa.array(np.concatenate([np.zeros(0), *(score_texts(texts, shared.value, table) for _, texts in text_slices(column))]))

    return docs.filter(good("text") >= 0.5)
