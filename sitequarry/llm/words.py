"""Bounded per-worker word tables: text becomes row numbers of a table whose rows are computed once per distinct word."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class _Index(dict):
    """Numbers words from 1 as they come; new ones are listed."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, word):
        self[word] = number = len(self) + 1
        self.new.append(word)
        return number


class WordTable:
    """Rows of `width` numbers per distinct word. Row 0 is a blank. Beyond `most` words the table starts anew."""

    def __init__(self, rows_of: Callable[[list], np.ndarray], width: int, most: int = 200_000, dtype=np.float32):
        self.rows_of, self.most = rows_of, most
        self.index = _Index()
        self.rows = np.zeros((1024, width), dtype=dtype)

    def numbers(self, words: Sequence[Hashable]) -> np.ndarray:
        """Row numbers of the words. A later call may start the table anew and replace `rows`."""
        index = self.index
        if len(index) > self.most:
            index.clear()
        at = len(index) + 1
        out = np.fromiter(map(index.__getitem__, words), dtype=np.int64, count=len(words))
        if index.new:
            new, index.new = index.new, []
            if at + len(new) > len(self.rows):
                grown = np.zeros((max(2 * len(self.rows), at + len(new)), self.rows.shape[1]), dtype=self.rows.dtype)
                grown[: len(self.rows)] = self.rows
                self.rows = grown
            self.rows[at : at + len(new)] = self.rows_of(new)
        return out


def text_slices(column: pa.Array, most_bytes: int = 1_000_000) -> Iterator[tuple[int, list[str]]]:
    """(place of the first, texts) of slices of a text column of about most_bytes at most; null is empty.

    Only a slice at a time becomes Python strings, so a batch of long texts costs no more than itself.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most_bytes, "right")))
        yield start, [x or "" for x in column.slice(start, stop - start).to_pylist()]
        start = stop


def chunks_of(texts: list[str], most_chars: int = 4_000_000):
    """Slices (from, to) of a list whose texts sum to about most_chars at most."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most_chars:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
