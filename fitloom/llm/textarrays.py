"""Texts of an Arrow column as flat numpy arrays of bytes and words.

Words are runs of bytes that are not ASCII white space (``[^\\x20\\x09-\\x0D]+``), so UTF-8 needs no decoding.
A slice holds whole texts, up to ``max_bytes`` or one longer text, so memory follows the longest text only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    space = np.zeros(256, dtype=bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    letters = np.random.Generator(np.random.PCG64(20250101)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
    return space, lower, letters


SPACE, LOWER, LETTERS = _tables()
#: An odd base has an inverse modulo 2^64.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
GRAM = np.uint64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse, grown when a longer slice comes."""

    def __init__(self, base: np.uint64, inverse: np.uint64):
        self.base, self.inverse, self.up, self.down = base, inverse, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            up, down = np.full(n, self.base, np.uint64), np.full(n, self.inverse, np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up, self.down


@dataclass
class Texts:
    """rows: the batch's rows. ends: byte offsets, one more than texts. word_lo, word_hi: byte ranges. first: index of each text's first word, one more than texts."""

    rows: slice
    data: np.ndarray
    ends: np.ndarray
    word_lo: np.ndarray
    word_hi: np.ndarray
    first: np.ndarray

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.n_words)

    def word_hashes(self, powers: Powers, lower: bool = False) -> np.ndarray:
        """64-bit hashes of the words' bytes; with ``lower``, of A-Z lower-cased."""
        letters = LETTERS[LOWER] if lower else LETTERS
        up, down = powers.upto(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(letters[self.data] * up[: len(self.data)], out=sums[1:])
        return mix((sums[self.word_hi] - sums[self.word_lo]) * down[self.word_lo])

    def word(self, i: int) -> bytes:
        return self.data[self.word_lo[i] : self.word_hi[i]].tobytes()

    def count(self, marked: np.ndarray) -> np.ndarray:
        """How many bytes of each text are marked."""
        sums = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(marked, out=sums[1:])
        return np.diff(sums[self.ends])


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words, across the ends of texts too: see ``gram_ok``."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    m, out = len(words) - n + 1, np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = out * GRAM + words[i : i + m]
    return mix(out)


def gram_ok(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the n-grams that lie within a text, and their text's index."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    docs = np.repeat(np.arange(len(counts)), counts)
    skipped = first[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]])
    return np.arange(len(docs)) + skipped[docs], docs


def texts_of(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[Texts]:
    """Slices of a string column; a null counts as an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + max_bytes, "right")) - 1)
        yield split(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], slice(at, to))
        at = to


def split(data: np.ndarray, ends: np.ndarray, rows: slice) -> Texts:
    inside = np.empty(len(data) + 1, bool)
    inside[:-1], inside[-1] = ~SPACE[data], False
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = ends[:-1][ends[:-1] < len(data)]
    begins[edges] = inside[edges]
    lo = np.flatnonzero(begins)
    stops = ~inside
    stops[edges] = True
    where = np.flatnonzero(stops)
    hi = where[np.searchsorted(where, lo, "right")] if len(lo) else lo
    return Texts(rows, data, ends, lo, hi, np.searchsorted(lo, ends, "left"))
