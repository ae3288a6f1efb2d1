"""SentencePiece encoding and decoding with N-best segmentation.

A text is a lattice of the model's pieces. A forward Viterbi pass gives the best score up to every place; these scores
are exact heuristics for a backward A-star search, which then yields segmentations in falling order of score. The
lattice falls apart at every place that no piece spans: words are searched once each, and the N best of a whole text
follow exactly from the N best of its words.

The model file is a merge model: a piece's score in it is its merge's rank, not a probability, and ranks don't add up.
The lattice takes ln 1/(rank + MANDELBROT) instead, by the Zipf-Mandelbrot law the log-probability of a piece of that
rank but for a constant. So `ids` are the likeliest pieces, not the model's own encoding, which joins pieces in the
order of its merges; that one comes from the library, as merge_ids.
"""

from __future__ import annotations

import gc
import heapq
import math
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain, filterfalse
from operator import itemgetter

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitequarry.llm.words import text_slices

N_BEST = 3
SPACE = "▁"
#: The offset of the Zipf-Mandelbrot law; nothing is fitted to a corpus.
MANDELBROT = 1000
#: Characters of words kept in a Python worker from task to task; then the caches start anew.
CACHE_CHARS = 4_000_000
#: Characters that the transition table knows; units with others take the pass for single units.
CLASSES = 127
#: Units up to these lengths run together, at least LEAST_UNITS of them and CELLS places at a time.
WIDTHS = (8, 16, 32, 64)
LEAST_UNITS = 64
CELLS = 1 << 19
_state: dict = {}


class Lattice:
    """Pieces and scores of a SentencePiece model; characters it lacks become byte pieces."""

    def __init__(self, path: str):
        import sentencepiece

        sp = self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, tuple[int, float]] = {}
        self.bytes: dict[int, int] = {}
        self.texts: list[bytes | None] = []
        for i in range(sp.get_piece_size()):
            p, s = sp.id_to_piece(i), sp.get_score(i)
            if sp.is_byte(i):
                self.bytes[int(p[3:-1], 16)] = i
                self.texts.append(bytes([int(p[3:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.texts.append(b"")
            else:
                self.texts.append(p.replace(SPACE, " ").encode())
                if s > -1e8 or len(p) == 1:  # longer runs of blanks serve the merging order only
                    self.pieces[p] = (i, s)
        last = max(-s for _, s in self.pieces.values() if s > -1e8)
        self.pieces = {p: (i, -math.log(min(-s, last) + MANDELBROT)) for p, (i, s) in self.pieces.items()}
        least = -math.log(last + MANDELBROT)
        self.missing = least - 10
        self.starts = {p[:i] for p in self.pieces for i in range(1, len(p))}
        #: All pieces and their beginnings, so that one look-up tells both whether to use and whether to go on.
        self.walk = dict.fromkeys(self.starts, (-1, 0.0)) | self.pieces
        self.spanned = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        self.pairs = np.array(sorted(ord(p[0]) << 21 | ord(p[1]) for p in self.spanned), np.int64)
        self.build_table()
        #: Of each word: best score, gap to the second best, best ids, what they decode to, the library's ids.
        self.words: dict[str, tuple[float, float, bytes, bytes, bytes]] = {}
        self.parts: dict[str, tuple[float, float, bytes, bytes]] = {}
        self.clear()

    def clear(self) -> None:
        self.words.clear()
        self.parts.clear()
        self.options: dict[tuple[str, int], list] = {}
        self.held = 0

    def build_table(self) -> None:
        """The pieces of the most used characters as a table: state and character give the next state, or 0."""
        used = Counter(c for p in self.pieces for c in p)
        self.classes = {c: i + 1 for i, (c, _) in enumerate(used.most_common()) if c in self.pieces and i < CLASSES}
        self.class_of = np.zeros(0x110000, np.uint8)
        for c, i in self.classes.items():
            self.class_of[ord(c)] = i
        self.known = frozenset(self.classes)
        inside = [p for p in self.walk if self.known.issuperset(p)]
        states = {p: i + 2 for i, p in enumerate(inside)} | {"": 1}
        self.next = np.zeros((len(states) + 1, CLASSES + 1), np.int32)
        self.state_piece = np.full(len(states) + 1, -1, np.int32)
        self.state_score = np.zeros(len(states) + 1)
        for p in inside:
            self.next[states[p[:-1]], self.classes[p[-1]]] = states[p]
            self.state_piece[states[p]], self.state_score[states[p]] = self.walk[p]

    def units(self, word: str) -> list[str]:
        """The word cut where no piece spans two neighbours."""
        return self.cut([word])[0]

    def cut(self, words: list[str]) -> list[list[str]]:
        """Each word (none is empty) cut where no piece spans two neighbours."""
        text = "".join(words)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        pairs = points[:-1] << 21 | points[1:]
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        apart = self.pairs[np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)] != pairs
        apart[ends[:-1] - 1] = False
        out = [[w] for w in words]
        places = np.flatnonzero(apart) + 1
        owners = np.searchsorted(ends, places, "right")
        starts = ends - np.fromiter(map(len, words), np.int64, len(words))
        for i, at in zip(owners.tolist(), (places - starts[owners]).tolist()):
            last = out[i].pop()
            at -= len(words[i]) - len(last)
            out[i] += [last[:at], last[at:]]
        return out

    def edges(self, unit: str) -> list[list[tuple[int, int | None, float]]]:
        """For each end: (start, piece or None for bytes, score)."""
        get, starts, out = self.pieces.get, self.starts, [[] for _ in range(len(unit) + 1)]
        for s in range(len(unit)):
            if unit[s] not in self.pieces:
                out[s + 1].append((s, None, self.missing))
            for e in range(s + 1, len(unit) + 1):
                if (p := get(unit[s:e])) is not None:
                    out[e].append((s, *p))
                if unit[s:e] not in starts:
                    break
        return out

    def forward(self, edges: list) -> list[float]:
        """Viterbi: best score up to every place."""
        best = [0.0]
        for ends in edges[1:]:
            best.append(max([best[s] + v for s, _, v in ends]))
        return best

    def encode_ids(self, unit: str, path: list[tuple[int, int | None, int]]) -> bytes:
        ids = []
        for s, p, e in path:
            ids += [p] if p is not None else [self.bytes[b] for b in unit[s:e].encode("utf-8", "surrogatepass")]
        return array("I", ids).tobytes()

    def n_best(self, unit: str, n: int) -> list[tuple[float, bytes]]:
        """Up to n segmentations in falling order of score: A-star from the end, the forward scores as heuristics.

        A hypothesis is a suffix of the unit; what remains can score best[start] and no more, so hypotheses leave the
        queue in the order of their full scores.
        """
        edges = self.edges(unit)
        best = self.forward(edges)
        queue: list = [(-best[-1], 0, len(unit), 0.0, None)]
        made, out = 0, []
        while queue and len(out) < n:
            f, _, at, done, path = heapq.heappop(queue)
            if at == 0:
                steps = []
                while path is not None:
                    steps.append(path[0])
                    path = path[1]
                out.append((-f, self.encode_ids(unit, steps)))
                continue
            for s, p, v in edges[at]:
                made += 1
                heapq.heappush(queue, (-(best[s] + v + done), made, s, v + done, ((s, p, at), path)))
        return out

    def part(self, unit: str) -> tuple[float, float, bytes, bytes]:
        """Best score, gap to the second best (inf if there is none), best ids and what they decode to: one Viterbi pass that keeps two scores."""
        if (known := self.parts.get(unit)) is not None:
            return known
        n, low = len(unit), -1e300
        get = self.walk.get
        first, second, by = [0.0] + [low] * n, [low] * (n + 1), [()] * (n + 1)
        for s in range(n):
            f, g = first[s], second[s]
            if unit[s] not in self.pieces:
                score = f + self.missing
                if score > first[s + 1]:
                    second[s + 1], first[s + 1], by[s + 1] = max(first[s + 1], g + self.missing), score, (s, None)
                else:
                    second[s + 1] = max(second[s + 1], score)
            for e in range(s + 1, n + 1):
                got = get(unit[s:e])
                if got is None:
                    break
                p, v = got
                if p >= 0:
                    score = f + v
                    if score > first[e]:
                        second[e] = max(first[e], g + v)
                        first[e] = score
                        by[e] = (s, p)
                    elif score > second[e]:
                        second[e] = score
        path, at = [], n
        while at:
            s, p = by[at]
            path.append((s, p, at))
            at = s
        path.reverse()
        ids = self.encode_ids(unit, path)
        raw = b"".join([self.texts[i] or b"" for i in array("I", ids)])
        out = (first[n], first[n] - second[n] if second[n] > -1e200 else float("inf"), ids, raw)
        self.parts[unit] = out
        return out

    def fill_parts(self, units: list[str]) -> None:
        """`part` of many units at once: the same Viterbi pass in the same order, place by place for all units."""
        lower = 0
        short = [u for u in units if self.known.issuperset(u)]
        for width in WIDTHS:
            group = [u for u in short if lower < len(u) <= width]
            lower = width
            step = CELLS // width
            for at in range(0, len(group), step):
                if len(group) - at >= LEAST_UNITS:
                    self.fill_group(group[at : at + step], width)

    def fill_group(self, units: list[str], width: int) -> None:
        rows, low = len(units), -1e300
        lengths = np.fromiter(map(len, units), np.int64, rows)
        points = np.frombuffer("".join([u.ljust(width, "\0") for u in units]).encode("utf-32-le"), np.uint32)
        codes = np.ascontiguousarray(self.class_of[points].reshape(rows, width).T)
        first, second = np.full((width + 1, rows), low), np.full((width + 1, rows), low)
        start, piece = np.zeros((width + 1, rows), np.int32), np.full((width + 1, rows), -1, np.int32)
        first[0] = 0.0
        for s in range(width):
            at = np.flatnonzero(lengths > s)
            state = np.ones(len(at), np.int32)
            for e in range(s + 1, width + 1):
                state = self.next[state, codes[e - 1, at]]
                on = state > 0
                at, state = at[on], state[on]
                if not len(at):
                    break
                p = self.state_piece[state]
                ends = p >= 0
                r, p, v = at[ends], p[ends], self.state_score[state[ends]]
                score, old = first[s, r] + v, first[e, r]
                better = score > old
                second[e, r] = np.where(better, np.maximum(old, second[s, r] + v), np.maximum(second[e, r], score))
                b = r[better]
                first[e, b], start[e, b], piece[e, b] = score[better], s, p[better]
        r = np.arange(rows)
        best, other = first[lengths, r], second[lengths, r]
        gaps = np.where(other > -1e200, best - other, np.inf)
        steps, at = [], lengths
        while at.any():
            steps.append(np.where(at > 0, piece[at, r], -1))
            at = np.where(at > 0, start[at, r], 0)
        path = np.stack(steps[::-1], axis=1)
        held = path >= 0
        flat = path[held].astype("<u4")
        ends = np.cumsum(held.sum(axis=1))
        ids, raw = flat.tobytes(), list(map(self.texts.__getitem__, flat.tolist()))
        a = 0
        for u, x, g, z in zip(units, best.tolist(), gaps.tolist(), ends.tolist()):
            self.parts[u] = (x, g, ids[4 * a : 4 * z], b"".join(raw[a:z]))
            a = z

    def look_up(self, words: list[str]) -> list[tuple[float, float, bytes, bytes, bytes]]:
        """What is known of each word (with its leading blank); new words are segmented together."""
        known = self.words
        try:
            return list(map(known.__getitem__, words))
        except KeyError:
            pass
        if self.held > CACHE_CHARS:
            self.clear()
        new = list(dict.fromkeys(filterfalse(known.__contains__, words)))
        cuts = self.cut([SPACE + w for w in new])
        parts = self.parts
        self.fill_parts(list(dict.fromkeys(filterfalse(parts.__contains__, chain.from_iterable(cuts)))))
        for w, units, merged in zip(new, cuts, self.library.encode(new, num_threads=1)):
            score, gap, ids, raw = parts.get(units[0]) or self.part(units[0])
            for u in units[1:]:
                more, gap2, ids2, raw2 = parts.get(u) or self.part(u)
                score, gap, ids, raw = score + more, min(gap, gap2), ids + ids2, raw + raw2
            known[w] = (score, gap, ids, raw, array("I", merged).tobytes())
        self.held += sum(map(len, new))
        return list(map(known.__getitem__, words))

    def encode(self, text: str, n: int = 1, words: list[str] | None = None) -> tuple[list[tuple[float, bytes]], bytes, bytes]:
        """The n best segmentations of the whole text (score, ids), the library's ids, and the decoded bytes of the best.

        words is the text split at blanks, where the caller has it already.

        Only the words whose second best is nearest can take part in the n best: n - 1 of them are searched.
        """
        if not text:
            return [(0.0, b"")], b"", b""
        words = text.split(" ") if words is None else words
        rows = self.look_up(words)
        total = math.fsum(map(itemgetter(0), rows))
        parts = list(map(itemgetter(2), rows))
        ids = b"".join(parts)
        # runs of blanks are pieces of the library's own that cross words
        plain = "" not in words
        merged = b"".join(map(itemgetter(4), rows)) if plain else array("I", self.library.encode(text)).tobytes()
        best = [(0.0, ())]
        if n > 1:
            gaps = np.fromiter(map(itemgetter(1), rows), np.float64, len(rows))
            # smallest gaps first, of equal ones the earlier places
            near = np.flatnonzero(gaps <= np.partition(gaps, n - 2)[n - 2]) if len(gaps) >= n else np.arange(len(gaps))
            near = near[np.argsort(gaps[near], kind="stable")][: n - 1]
            for i in sorted(near.tolist()):
                if np.isfinite(gaps[i]):
                    options = self.word_options(words[i], n)
                    best = sorted((a + b, (*chosen, (i, own)) if b else chosen) for a, chosen in best for b, own in options)[:n]
        out = []
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))) if len(best) > 1 else None
        for loss, chosen in best:
            other = ids
            if chosen:
                at, pieces = 0, []
                for i, own in chosen:
                    pieces += [ids[at : ends[i] - len(parts[i])], own]
                    at = ends[i]
                other = b"".join([*pieces, ids[at:]])
            out.append((total - loss, other))
        return out, merged, b"".join(map(itemgetter(3), rows))

    def word_options(self, word: str, n: int) -> list[tuple[float, bytes]]:
        """The n best segmentations of a word: what each loses against the best, and its ids."""
        if (known := self.options.get((word, n))) is not None:
            return known
        out = [(0.0, b"")]
        for u in self.units(SPACE + word):
            found = self.n_best(u, n)
            # the first pass and the search may differ between segmentations of one score: the first pass holds
            found = [(0.0, self.part(u)[2])] + [(found[0][0] - s, x) for s, x in found if x != self.part(u)[2]]
            out = sorted((a + b, x + y) for a, x in out for b, y in found)[:n]
        self.options[word, n] = out
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: pieces joined, blanks restored, the blank that encoding puts in front removed."""
        raw = b"".join([self.texts[i] or b"" for i in ids.tolist()])
        return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


def lattice(path: str) -> Lattice:
    if _state.get("path") != path:
        _state.update(path=path, lattice=Lattice(path))
        gc.freeze()  # the model's many objects live as long as the worker
    return _state["lattice"]


OUT = "doc_id long, n_pieces long, ids_crc32 long, score double, n_best array<double>, n_best_crc32 array<long>, n_merged long, merged_crc32 long, decoded_crc32 long, round_trip boolean"


def encode_documents(docs: DataFrame, model: str | None = None, n_best: int = N_BEST, with_ids: bool = False) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, score, n_best, n_best_crc32, n_merged, merged_crc32, decoded_crc32, round_trip [, ids,
    n_best_ids, merge_ids]: one row per input row.

    score is the best segmentation's, n_best the scores of the n best of the whole text (fewer if there are no more),
    n_best_crc32 the checksums of their ids (32-bit little-endian); n_merged and merged_crc32 belong to the library's own
    ids. Decoding the best gives decoded_crc32; round_trip says whether it is the text itself (texts with the blank mark
    U+2581 are not). Null is empty text: no pieces, score 0. Repeated rows encode alike; an empty table gives no rows.
    """
    path = model or public_tokenizers.path("piece_bpe_32k.model")
    lists = ["ids", "n_best_ids", "merge_ids"] if with_ids else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = lattice(path)
        numbers = lambda ids: np.frombuffer(ids, "<u4").tolist()
        for batch in batches:
            for at, texts in text_slices(batch.column(1)):
                split = [t.split(" ") for t in texts]
                coder.look_up(list(chain.from_iterable(split)))  # new words of all these texts in one pass
                rows = []
                for t, words in zip(texts, split):
                    best, merged, raw = coder.encode(t, n_best, words)
                    back = (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")
                    row = (len(best[0][1]) // 4, zlib.crc32(best[0][1]), best[0][0], [s for s, _ in best], [zlib.crc32(x) for _, x in best], len(merged) // 4, zlib.crc32(merged), zlib.crc32(back.encode()), back == t)
                    rows.append((*row, numbers(best[0][1]), [numbers(x) for _, x in best], numbers(merged)) if with_ids else row)
                long, longs = pa.int64(), pa.list_(pa.int64())
                kinds = [long, long, pa.float64(), pa.list_(pa.float64()), longs, long, long, long, pa.bool_(), longs, pa.list_(longs), longs]
                names = ["n_pieces", "ids_crc32", "score", "n_best", "n_best_crc32", "n_merged", "merged_crc32", "decoded_crc32", "round_trip", *lists]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=["doc_id", *names])

    more = ", ids array<long>, n_best_ids array<array<long>>, merge_ids array<long>" if with_ids else ""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, OUT + more)


def decode_documents(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text from doc_id and ids; null ids give an empty text."""
    path = model or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = lattice(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([coder.decode(np.array(x or [], dtype=np.int64)) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", F.col("ids").cast("array<long>").alias("ids")).mapInArrow(run, "doc_id long, text string")
