"""Vectorised word and n-gram hashing over a batch of whole texts.

A word is a maximal run of characters outside ``[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` of the
lower-cased text: ASCII digits and letters, and everything beyond ASCII. All operators of this
package share that definition. Nulls are empty texts.

Hashes are 64-bit: a polynomial hash over code points, read off one prefix sum for any span,
followed by a finalising mix. Everything is arithmetic modulo 2**64, so it needs no Python loop
over words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = U64(0xD6E8FEB86659FD93)
_WORD = np.ones(0x110000, bool)
_WORD[:128] = False
_WORD[48:58] = _WORD[97:123] = True
#: Characters handled at once; bounds the memory of a worker whatever the size of an Arrow batch.
CHUNK_CHARS = 500_000

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 19)
        out = np.full(size, U64(base), U64)
        out[0] = 1
        have = _powers[base] = np.multiply.accumulate(out)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Batch:
    """Code points and words of some texts.

    ``begin``/``end``: the words' spans in ``codes``; ``first``: where each text's words start in
    those arrays, with the total appended; ``of``: the text of each word.
    """

    def __init__(self, texts: list[str | None], case: str = "lower"):
        """case: "lower", "ascii" to lower-case A-Z and nothing else, or "keep"."""
        if case == "ascii":
            low = [(t or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass") for t in texts]
        else:
            low = [(t or "").lower() if case == "lower" else t or "" for t in texts]
        lengths = np.fromiter(map(len, low), np.int64, len(low))
        self.offset = np.concatenate(([0], np.cumsum(lengths + 1)))
        self.codes = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), "<u4") if low else np.empty(0, "<u4")
        self.n = len(low)
        self._sums: np.ndarray | None = None
        if case != "keep":
            known = _WORD[self.codes]
            edge = np.flatnonzero(known[1:] != known[:-1]) + 1
            if len(known) and known[0]:
                edge = np.concatenate(([0], edge))
            self.begin, self.end = edge[0::2], edge[1::2]
            self.first = np.searchsorted(self.begin, self.offset)

    @property
    def of(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.first))

    def spans(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of each span of code points; equal strings have equal hashes."""
        if self._sums is None:
            self._sums = np.zeros(len(self.codes) + 1, U64)
            np.add(self.codes, U64(1), out=self._sums[1:], dtype=U64)
            self._sums[1:] *= _power(_BASE, len(self.codes))
            np.cumsum(self._sums[1:], out=self._sums[1:])
        return mix((self._sums[end] - self._sums[begin]) * _power(_INVERSE, len(self.codes) + 1)[begin])

    def words(self) -> np.ndarray:
        return self.spans(self.begin, self.end)

    def shingles(self, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of k words, with repeats, and where each text's start (total appended).

        A text of 1 to k-1 words has one run, of all of them; a text without words has none.
        """
        return shingled(self.words(), self.first, k)


def shingled(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    count = np.diff(first)
    runs = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    at = np.concatenate(([0], np.cumsum(runs)))
    start = np.arange(at[-1]) - np.repeat(at[:-1], runs) + np.repeat(first[:-1], runs)
    left = np.repeat(np.minimum(count, k), runs)
    total = np.zeros(len(start), U64)
    padded = np.concatenate((words, np.zeros(k, U64)))
    for j in range(k):
        total += np.where(left > j, padded[start + j], U64(0)) * U64(pow(int(_STEP), j, 1 << 64))
    return mix(total + left.astype(U64)), at


def trim() -> None:
    """Hand freed memory back: a worker lives on for the next stage, which may be another operator's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library keeps its own house
        pass


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of the batches, each with the whole texts of its rows and about ``most`` bytes."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        at = done = 0
        while at < len(ends):
            stop = max(int(np.searchsorted(ends, done + most)), at) + 1
            stop = min(stop, len(ends))
            yield batch.slice(at, stop - at), texts.slice(at, stop - at).to_pylist()
            at, done = stop, int(ends[stop - 1])
    trim()
