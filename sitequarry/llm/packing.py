"""Packing of token sequences into windows of a fixed length by Karmarkar-Karp differencing.

Documents longer than a window are cut into full windows and a remainder. Remainders are dealt into buckets of about
BUCKET pieces; in each bucket, multiway differencing merges partial partitions, the largest sums of one with the
smallest of the other, until one partition into k windows is left. If a window exceeds its capacity, k rises.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitequarry.llm.common import buckets_for, materialise
from sitequarry.llm.words import text_slices

WINDOW = 4096
END = 2
BUCKET = 1000
#: Characters of words and parts kept with their ids in a task; then the cache starts anew.
CACHE_CHARS = 4_000_000
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"

_state: dict = {}


#: The tokenizer's splitting pattern, and the bytes that byte-level vocabularies show as themselves.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
SHOWN = (range(33, 127), range(161, 173), range(174, 256))
#: Letters whose lower case or composition may depend on what stands around them.
BOUND = re.compile("[\u0130\u0180-\U0010ffff]")


def _plain(text: str) -> bool:
    """Whether lower case and splitting go letter by letter and no special token can stand in the text."""
    return "<|" not in text and (text.isascii() or not BOUND.search(text))


def _byte_map() -> dict[int, int]:
    """Byte -> code point of its visible stand-in: shown bytes are themselves, the others follow 255 in order."""
    shown = {b for r in SHOWN for b in r}
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


class _Encoder(dict):
    """The tokenizer's ids by word: its splitter never crosses white space, so words are encoded once each.

    Words of plain Latin letters are split as the tokenizer does and their parts given to its model; all others, and
    those that might hold a special token, go through the tokenizer as a whole. A part stands for itself as a word, so
    both are held together. A text of plain letters alone is lowered first, so its words are met in one case only.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.split, self.shown = regex.compile(SPLIT).findall, _byte_map()
        self.held = 0

    def clear(self) -> None:
        super().clear()
        self.held = 0

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def part(self, text: str) -> bytes:
        plain = text.isascii() and text.isprintable()  # then the bytes show as themselves
        ids = self.tokenize(text if plain else text.encode().decode("latin-1").translate(self.shown))
        return array("I", [t.id for t in ids]).tobytes()

    def __missing__(self, word):
        self.held += len(word)
        if not _plain(word):
            ids = self.whole(word)
        else:
            low = word.lower()
            parts = [low] if low.isalpha() else self.split(low)  # letters alone are one part
            ids = self.part(low) if parts == [word] else b"".join([self[p] for p in parts])
        self[word] = ids
        return ids

    def batch(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # str.split() breaks at these, the tokenizer doesn't
                yield self.whole(text)
                continue
            if self.held > CACHE_CHARS:
                self.clear()
            words = (text.lower() if _plain(text) else text).split()
            yield b"".join(map(self.__getitem__, words))


def _encoder(path: str) -> _Encoder:
    if _state.get("path") != path:
        _state.update(path=path, encoder=_Encoder(path))
    return _state["encoder"]


def cut(ids: bytes, window: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32 of the ids) of the pieces: full windows, then the remainder."""
    n = len(ids) // 4
    return [(s, min(window, n - s), zlib.crc32(ids[4 * s : 4 * min(n, s + window)])) for s in range(0, n, window)]


def difference(sizes: list[int], k: int) -> list[int]:
    """Karmarkar-Karp: the window 0..k-1 of each size, by multiway differencing.

    A partition is its non-zero sums in falling order, with a tree of items under each; the other k - len sums are
    zero. The two partitions of the widest spread are merged: sums of one meet those of the other in reverse order.
    """
    trees: list = list(range(len(sizes)))
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        both = len(a) + len(b) - k
        if both <= 0:
            c = a + b
        else:  # a's smallest `both` sums meet b's smallest `both`, in opposite order; the others meet zeros
            c = a[: len(a) - both] + b[: len(b) - both]
            for (x, i), (y, j) in zip(a[len(a) - both :], reversed(b[len(b) - both :])):
                trees.append((i, j))
                c.append((x + y, len(trees) - 1))
        c.sort(reverse=True)
        spread = c[0][0] - (c[-1][0] if len(c) == k else 0)
        heapq.heappush(heap, (-spread, made, c))
        made += 1
    out = [0] * len(sizes)
    for window, (_, top) in enumerate(heap[0][2] if heap else []):
        todo = [top]
        while todo:
            t = trees[todo.pop()]
            if isinstance(t, int):
                out[t] = window
            else:
                todo += t
    return out


def windows(sizes: list[int], capacity: int) -> list[int]:
    """Windows of near-equal fill, none over capacity; their number starts at the least possible and rises."""
    k, step = max(1, -(-sum(sizes) // capacity)), 1
    while True:
        out = difference(sizes, k)
        fill = np.bincount(out, weights=sizes, minlength=1) if sizes else np.zeros(1)
        if fill.max() <= capacity:
            return out
        k, step = k + step, step + 1


def _pack(group: pd.DataFrame, capacity: int) -> pd.DataFrame:
    group = group.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
    group["window"] = windows(group["length"].tolist(), capacity)
    group = group.sort_values("window", kind="stable")
    group["offset"] = group.groupby("window")["length"].cumsum() - group["length"]
    return group


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens. Texts are read whole and stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(tokenizer), np.array([END], dtype="<u4").tobytes()
        for batch in batches:
            for at, texts in text_slices(batch.column(1)):
                rows = []
                for doc_id, ids in zip(batch.column(0).slice(at, len(texts)).to_pylist(), encoder.batch(texts)):
                    ids += end
                    rows += [(doc_id, s, n, crc, len(ids) // 4) for s, n, crc in cut(ids, window)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        encoder.clear()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECE)


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece.

    Null text is empty: its document is the end id alone. Repeated rows are packed as often as they occur. Full
    windows are sequences of their own. An empty table gives no rows; other columns are not read.
    """
    rows = materialise(pieces(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json"), window), "pieces")
    n = buckets_for(rows.count(), BUCKET, 1)
    # pieces of one size lie in many buckets; ties of repeated rows are spread by the row's place in its partition
    bucket = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(n)).cast("long")
    dealt = materialise(rows.withColumn("bucket", bucket), "dealt_pieces")
    schema = f"{PIECE}, bucket long, window long, offset long"
    packed = dealt.groupBy("bucket").applyInPandas(lambda g: _pack(g, window), schema)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("bucket") * (1 << 32) + F.col("window")).alias("sequence_id"), "offset")
