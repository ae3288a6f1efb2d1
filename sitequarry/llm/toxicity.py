"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each word enters as a word vector (words of the training texts) joined with the mean of hashed vectors
of its character runs. Overlapping windows of a text run through a GRU in both directions; attention pools the states of a window
into one logit, and the largest logit of all windows is the text's. Labels say which text is toxic, not where: windows
that carry the words most tied to toxic texts stand in first, then the windows that the network itself ranks first.
"""

from __future__ import annotations

import string
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitequarry.llm.words import WordTable, chunks_of, text_slices

#: Labelled rows used for training at most: toxic ones, others; first by hash of the id.
TRAIN_TOXIC, TRAIN_OTHER = 1000, 1500
WINDOW, STRIDE = 32, 24
WORD_DIM, CHAR_DIM, HIDDEN, ATTEND = 8, 8, 8, 8
#: Rows of the table of byte runs: half for runs of 3, half for runs of 5.
GRAMS = 1 << 14
LEAST_TEXTS = 3
FOLDS = 5
_PUNCT = string.punctuation + "«»“”„’‘¿¡…–—"


def bare(word: str) -> str:
    return word.lower().strip(_PUNCT)


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed runs of 3 and of 5 bytes of ^word$ for many words: numbers, and how many each word has."""
    marked = [f"^{w}$".encode() for w in words]
    lengths = np.array([len(m) for m in marked], dtype=np.int64)
    b = np.frombuffer(b"".join(marked), dtype=np.uint8).astype(np.int64)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(b))  # bytes from here to the word's end
    two = b.copy()
    two[:-1] = b[:-1] * 257 + b[1:]
    three, five = two.copy(), two.copy()
    three[:-2] = two[:-2] * 257 + b[2:]
    five[:-4] = (three[:-4] * 257 + b[3:-1]) * 257 + b[4:]
    at3, at5 = (three * 2654435761 >> 9) & (GRAMS // 2 - 1), ((five * 2654435761 >> 11) & (GRAMS // 2 - 1)) + GRAMS // 2
    use3, use5 = left >= 3, left >= 5
    order = np.argsort(np.concatenate([np.flatnonzero(use3), np.flatnonzero(use5)]), kind="stable")
    return np.concatenate([at3[use3], at5[use5]])[order], np.maximum(lengths - 2, 0) + np.maximum(lengths - 4, 0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Weights, and the passes that training and scoring share."""

    def __init__(self, n_words: int, seed: int = 0):
        r, d, h = np.random.default_rng(seed), WORD_DIM + CHAR_DIM, HIDDEN
        normal = lambda *s, by=0.3: (r.standard_normal(s) * by).astype(np.float32)
        self.p = {"word": normal(n_words, WORD_DIM, by=0.1), "char": normal(GRAMS, CHAR_DIM), "att": normal(2 * h, ATTEND), "att_b": np.zeros(ATTEND, np.float32), "att_v": normal(ATTEND), "out": normal(2 * h), "out_b": np.zeros(1, np.float32)}
        for k in "fb":
            self.p |= {f"w_{k}": normal(d, 3 * h), f"b_{k}": np.zeros(3 * h, np.float32), f"u_{k}": normal(h, 3 * h)}

    def run(self, gx: dict, mask: np.ndarray, keep: bool = False):
        """Logits of windows from the projected inputs of both directions, [windows, WINDOW, 3 * HIDDEN] each."""
        p, h = self.p, HIDDEN
        n, t = mask.shape
        states, tape = np.empty((n, t, 2 * h), np.float32), {"f": [], "b": []}
        for k, order in (("f", range(t)), ("b", range(t - 1, -1, -1))):
            s, at = np.zeros((n, h), np.float32), slice(0, h) if k == "f" else slice(h, 2 * h)
            for i in order:
                g, u, m = gx[k][:, i], s @ p[f"u_{k}"], mask[:, i, None]
                rz = 1 / (1 + np.exp(-(g[:, : 2 * h] + u[:, : 2 * h])))
                c = np.tanh(g[:, 2 * h :] + rz[:, :h] * u[:, 2 * h :])
                new = s + m * (1 - rz[:, h:]) * (c - s)
                if keep:
                    tape[k].append((i, s, rz, c, u[:, 2 * h :]))
                s = new
                states[:, i, at] = s
        a = np.tanh(states @ p["att"] + p["att_b"])
        e = a @ p["att_v"] + np.where(mask > 0, 0, -1e9).astype(np.float32)
        e = np.exp(e - e.max(1, keepdims=True))
        alpha = e / e.sum(1, keepdims=True)
        pooled = (alpha[:, :, None] * states).sum(1)
        logit = pooled @ p["out"] + p["out_b"][0]
        return (logit, states, a, alpha, pooled, tape) if keep else logit

    def gradients(self, words: np.ndarray, chars: np.ndarray, mask: np.ndarray, target: np.ndarray):
        """Loss gradients for a batch: words [n, t] numbers, chars [n, t, CHAR_DIM] mean vectors of character runs."""
        p, h = self.p, HIDDEN
        x = np.concatenate([p["word"][words], chars], 2)
        gx = {k: x @ p[f"w_{k}"] + p[f"b_{k}"] for k in "fb"}
        logit, states, a, alpha, pooled, tape = self.run(gx, mask, True)
        d = (_sigmoid(logit) - target) / len(target)
        g = {"out": pooled.T @ d, "out_b": np.array([d.sum()])}
        dpool = d[:, None] * p["out"]
        dstates = alpha[:, :, None] * dpool[:, None]
        dalpha = (states * dpool[:, None]).sum(2)
        de = alpha * (dalpha - (alpha * dalpha).sum(1, keepdims=True))
        g["att_v"] = np.einsum("nt,nta->a", de, a)
        da = de[:, :, None] * p["att_v"] * (1 - a * a)
        g["att"], g["att_b"] = np.einsum("nth,nta->ha", states, da), da.sum((0, 1))
        dstates = dstates + da @ p["att"].T
        dx = np.zeros_like(x)
        for k, at in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            dgx, du, ds = np.zeros_like(gx[k]), np.zeros_like(p[f"u_{k}"]), np.zeros((len(target), h), np.float32)
            for i, s, rz, c, uc in reversed(tape[k]):
                ds = ds + dstates[:, i, at]
                m, r, z = mask[:, i, None], rz[:, :h], rz[:, h:]
                dz = -ds * m * (c - s)
                dc = ds * m * (1 - z) * (1 - c * c)
                gate = np.concatenate([dc * uc * r * (1 - r), dz * z * (1 - z)], 1)
                dgx[:, i] = np.concatenate([gate, dc], 1)
                back = np.concatenate([gate, dc * r], 1)
                du += s.T @ back
                ds = ds * (1 - m * (1 - z)) + back @ p[f"u_{k}"].T
            g[f"u_{k}"], g[f"b_{k}"] = du, dgx.sum((0, 1))
            g[f"w_{k}"] = np.einsum("ntd,ntg->dg", x, dgx)
            dx += dgx @ p[f"w_{k}"].T
        return g, dx


def _windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping windows over consecutive texts: the first word's place, the number of words, the text."""
    count = np.where(lengths > 0, 1 + np.maximum(0, -(-(lengths - WINDOW) // STRIDE)), 0)
    owner = np.repeat(np.arange(len(lengths)), count)
    turn = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    first = np.cumsum(lengths) - lengths
    return first[owner] + turn * STRIDE, np.minimum(WINDOW, lengths[owner] - turn * STRIDE), owner


def _distinct(texts: list[str]) -> list[int]:
    """Places of texts that share no least hash of five-word shingles with an earlier one: groups of copies count once."""
    seen, out = set(), []
    for i, t in enumerate(texts):
        w = t.lower().split()
        marks = {min((zlib.crc32(" ".join(w[j : j + 5]).encode(), salt) for j in range(max(1, len(w) - 4))), default=0) for salt in (1, 2)}
        if not marks & seen:
            out.append(i)
        seen |= marks
    return out


def train(texts: list[str], labels: np.ndarray, rounds: int = 3, epochs: int = 2, seed: int = 0) -> dict | None:
    """The model, or None if a class has no text."""
    chosen = _distinct(texts)
    texts, labels = [texts[i] for i in chosen], labels[chosen]
    if not 0 < labels.sum() < len(labels):
        return None
    tokens = [[bare(w) for w in t.split()] for t in texts]
    lengths = np.array([len(t) for t in tokens])
    seen, toxic = Counter(), Counter()
    for t, y in zip(tokens, labels):
        seen.update(set(t))
        if y:
            toxic.update(set(t))
    known = sorted(w for w, n in seen.items() if n >= LEAST_TEXTS)
    vocab = {w: i + 1 for i, w in enumerate(known)}
    rate = labels.mean()
    every = list(dict.fromkeys(w for t in tokens for w in t))
    place = {w: i for i, w in enumerate(every)}
    grams, counts = grams_of(every)
    grams = grams.astype(np.int32)
    ends = np.cumsum(counts)
    gram_seen, gram_toxic = np.zeros(GRAMS), np.zeros(GRAMS)
    for t, y in zip(tokens, labels):
        own = np.unique(np.concatenate([grams[ends[i] - counts[i] : ends[i]] for i in {place[w] for w in t}] or [np.zeros(0, int)]))
        gram_seen[own] += 1
        gram_toxic[own] += y

    def tie(hit, all_):
        return np.log((hit + rate) / (all_ - hit + 1 - rate)) - np.log(rate / (1 - rate))

    word_tie = np.array([0.0] + [tie(toxic[w], seen[w]) for w in known])
    gram_tie = np.where(gram_seen >= LEAST_TEXTS, tie(gram_toxic, gram_seen), 0.0)
    net = Network(len(known) + 1, seed)
    net.p["word"][:, 0] = word_tie / 2
    net.p["char"][:, 0] = gram_tie
    # of each distinct word: its own tie or that of its strongest character run
    strongest = np.maximum.reduceat(np.append(gram_tie[grams], -9), np.minimum(ends - counts, len(grams))) if len(every) else np.zeros(0)
    tied = np.maximum(np.where(counts > 0, strongest, -9), [word_tie[vocab.get(w, 0)] for w in every])
    flat_place = np.array([place[w] for t in tokens for w in t], dtype=np.int32)
    flat_word = np.array([vocab.get(w, 0) for w in every], dtype=np.int32)[flat_place]
    del tokens, place, seen, toxic
    start, size, owner = _windows(lengths)
    at = np.minimum(start[:, None] + np.arange(WINDOW), max(0, len(flat_word) - 1)).astype(np.int32)
    mask = (np.arange(WINDOW) < size[:, None]).astype(np.float32)
    evidence = np.where(mask > 0, tied[flat_place[at]], -9).max(1)
    rng = np.random.default_rng(seed)
    moments: dict = {}
    step = 0
    is_toxic = labels[owner] > 0
    rank = evidence
    for turn in range(rounds):
        # the window of each toxic text that ranks first, and those close to it; of the others the worst and some at random
        best = np.full(len(labels), -np.inf, np.float32)
        np.maximum.at(best, owner, rank)
        positive = np.flatnonzero(is_toxic & (rank >= best[owner] - (0.1 if turn == 0 else 1e-6)) & (rank > (1 if turn == 0 else -np.inf)))
        other = np.flatnonzero(~is_toxic)
        worst = other[rank[other] >= best[owner[other]] - 1e-6]
        worst = worst[np.argsort(-rank[worst])][: 2 * len(positive) + 50]
        negative = np.unique(np.concatenate([worst, rng.choice(other, min(len(other), 3 * len(positive) + 100), replace=False)]))
        if not len(positive):
            return None
        batch_of = np.concatenate([positive, negative])
        target = np.concatenate([np.ones(len(positive)), np.zeros(len(negative))]).astype(np.float32)
        for _ in range(epochs):
            order = rng.permutation(len(batch_of))
            for lo in range(0, len(order), 128):
                rows = batch_of[order[lo : lo + 128]]
                words, m = flat_word[at[rows]], mask[rows]
                places, inverse = np.unique(flat_place[at[rows]], return_inverse=True)
                inverse = inverse.reshape(words.shape)
                spans = [grams[ends[i] - counts[i] : ends[i]] for i in places]
                n_grams = np.array([len(s) for s in spans])
                joined, of = np.concatenate(spans) if spans else np.zeros(0, int), np.repeat(np.arange(len(places)), n_grams)
                mean = _scatter(of, net.p["char"][joined], len(places))
                mean /= np.maximum(n_grams, 1)[:, None]
                hidden = np.where(rng.random(words.shape) < 0.15, 0, words)  # so that characters carry weight too
                g, dx = net.gradients(hidden, mean[inverse], m, target[order[lo : lo + 128]])
                flat_dx = dx.reshape(-1, dx.shape[2])
                dword = _scatter(hidden.ravel(), flat_dx[:, :WORD_DIM], len(net.p["word"]))
                dmean = _scatter(inverse.ravel(), flat_dx[:, WORD_DIM:], len(places))
                dchar = _scatter(joined, (dmean / np.maximum(n_grams, 1)[:, None])[of], GRAMS)
                step += 1
                for k, v in (g | {"word": dword, "char": dchar}).items():
                    a, b = moments.setdefault(k, [np.zeros_like(net.p[k]), np.zeros_like(net.p[k])])
                    a += 0.1 * (v - a)
                    b += 0.001 * (v * v - b)
                    net.p[k] -= (0.01 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        model = {"p": net.p, "vocab": vocab, "shift": 0.0}
        rank = np.concatenate(list(window_logits(model, every, flat_place, at, mask)))
    best = np.full(len(labels), -np.inf, np.float32)
    np.maximum.at(best, owner, rank)
    model["shift"] = _threshold(best, labels)
    return model


def _scatter(to: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by their number."""
    return np.stack([np.bincount(to, weights=values[:, j], minlength=n) for j in range(values.shape[1])], 1).astype(np.float32)


def _threshold(best: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the gap that makes fewest errors on the training texts."""
    order = np.argsort(best)
    s, y = best[order], labels[order]
    errors = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([[0], np.cumsum((1 - y)[::-1])])[::-1]
    good = np.flatnonzero(errors == errors.min())
    i = good[len(good) // 2]
    s = np.clip(s, -20, 20)
    return float((s[max(0, i - 1)] + s[min(len(s) - 1, i)]) / 2)


def project(model: dict, words: list[str], at_once: int = 20_000) -> np.ndarray:
    """Projected inputs of both directions for distinct bare words, [n, 6 * HIDDEN]."""
    p, out = model["p"], np.empty((len(words), 6 * HIDDEN), np.float32)
    for lo in range(0, len(words), at_once):
        part = words[lo : lo + at_once]
        grams, counts = grams_of(part)
        total = np.zeros((len(grams) + 1, CHAR_DIM))
        np.cumsum(p["char"][grams], axis=0, out=total[1:], dtype=np.float64)
        ends = np.cumsum(counts)
        mean = (total[ends] - total[ends - counts]) / np.maximum(counts, 1)[:, None]
        x = np.concatenate([p["word"][[model["vocab"].get(w, 0) for w in part]], mean.astype(np.float32)], 1)
        out[lo : lo + len(part)] = np.concatenate([x @ p["w_f"] + p["b_f"], x @ p["w_b"] + p["b_b"]], 1)
    return out


def window_logits(model: dict, every: list[str], numbers: np.ndarray, at: np.ndarray, mask: np.ndarray) -> Iterator[np.ndarray]:
    table = project(model, every) if every else np.zeros((1, 6 * HIDDEN), np.float32)
    yield from _run(model, table, numbers, at, mask)


def _run(model: dict, table: np.ndarray, numbers: np.ndarray, at: np.ndarray, mask: np.ndarray, most: int = 2048) -> Iterator[np.ndarray]:
    net = Network.__new__(Network)
    net.p = model["p"]
    for lo in range(0, len(at), most):
        rows = table[numbers[at[lo : lo + most]]]
        yield net.run({"f": rows[:, :, : 3 * HIDDEN], "b": rows[:, :, 3 * HIDDEN :]}, mask[lo : lo + most])
    yield np.zeros(0, np.float32)


def word_table(model: dict) -> WordTable:
    """Projected inputs of words; a task has its own, which ends with it."""
    return WordTable(lambda words: project(model, [bare(w) for w in words]), 6 * HIDDEN, 100_000)


def score_texts(texts: list[str], model: dict, table: WordTable | None = None) -> np.ndarray:
    """Scores of whole texts: the sigmoid of the largest window logit less the shift; 0 for texts without words."""
    table, out = table or word_table(model), np.zeros(len(texts))
    for a, b in chunks_of(texts, 1_000_000):
        words: list[str] = []
        lengths = np.empty(b - a, dtype=np.int64)
        for i, t in enumerate(texts[a:b]):
            w = t.split()
            lengths[i] = len(w)
            words += w
        numbers = table.numbers(words)
        start, size, owner = _windows(lengths)
        if not len(start):
            continue
        at = np.minimum(start[:, None] + np.arange(WINDOW), len(numbers) - 1)
        logits = np.concatenate(list(_run(model, table.rows, numbers, at, (np.arange(WINDOW) < size[:, None]).astype(np.float32))))
        best = np.full(b - a, -np.inf)
        np.maximum.at(best, owner, logits)
        out[a:b] = np.where(lengths > 0, _sigmoid(best - model["shift"]), 0.0)
    return out


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS)) == 0


def fit(docs: DataFrame, labels: DataFrame, most_toxic: int = TRAIN_TOXIC, most_other: int = TRAIN_OTHER) -> dict | None:
    """A model from labelled rows that aren't held out: at most most_toxic and most_other of them."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).filter(~held_out())
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.filter("toxic = 1").orderBy(*order).limit(most_toxic).unionByName(known.filter("toxic <> 1").orderBy(*order).limit(most_other))
    # the limits bound what is broadcast; repeated rows of one id are bounded by the last limit
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id").orderBy(F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64("text")).limit(most_toxic + most_other).select("text", "toxic").collect()
    if not sample:
        return None
    return train([r["text"] or "" for r in sample], np.array([1 if r["toxic"] == 1 else 0 for r in sample]))


def _scorer(docs: DataFrame, model: dict | None):
    """Scores of text columns, batch by batch. Without a model everything scores 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(columns: Iterator[pa.Array]) -> Iterator[np.ndarray]:
        m = shared.value
        table = None if m is None else word_table(m)
        for column in columns:
            yield np.zeros(len(column)) if m is None else np.concatenate([np.zeros(0), *(score_texts(texts, m, table) for _, texts in text_slices(column))])

    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per input row.

    Null, empty and blank texts score 0, and so does everything where one class has no label to learn from. Repeated
    rows score alike; an id with both labels counts as toxic. An empty table gives no rows. Only text enters a score.
    """
    run = _scorer(docs, fit(docs, labels))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def texts() -> Iterator[pa.Array]:
            for batch in it:
                held.append(batch.select([0, 1]))
                yield batch.column(2)

        for s in run(texts()):
            batch = held.pop()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text").mapInArrow(batches, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, unchanged, that score under 0.5. Null, empty and blank texts score 0 and stay.

    Only the text travels to the Python workers, and only scores come back.
    """
    run = _scorer(docs, fit(docs, labels))

    @F.arrow_udf("double")
    def toxic(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for s in run(columns):
            yield pa.array(s)

    return docs.filter(toxic("text") < 0.5)
