"""A wavelet matrix over token ids, as one self-contained compressed blob.

Layout, little-endian: ``WMX1``, then six unsigned 64-bit numbers (ids, planes, documents, length of
the document block, length of each compressed plane directory entry block, reserved), then the
document block, the directory of planes and the planes. The document block holds each document's id
(int64), whether it is null (byte) and where its ids start (int64, total appended). A plane is the
packed bits of one binary digit of the ids, highest digit first; the ids with a 0 there come before
those with a 1 in the next plane, order kept. Every block is compressed on its own, so that a reader
of a few planes doesn't unpack the others.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

MAGIC = b"WMX1"
#: Bits between two entries of a rank directory.
SPAN = 512
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def encode(ids: np.ndarray, doc_ids: list[int | None], first: np.ndarray) -> bytes:
    planes = max(1, int(ids.max(initial=0)).bit_length())
    now = ids.astype(np.uint32 if planes > 16 else np.uint16)
    blocks, zeros = [], []
    for digit in range(planes - 1, -1, -1):
        bit = (now >> digit & 1).astype(bool)
        blocks.append(_pack(np.packbits(bit, bitorder="little").tobytes()))
        low = now[~bit]
        zeros.append(len(low))
        now = np.concatenate((low, now[bit]))
    null = np.array([d is None for d in doc_ids], np.uint8)
    docs = _pack(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + null.tobytes() + first.astype("<i8").tobytes())
    directory = np.array([zeros, [len(b) for b in blocks]], "<i8").tobytes()
    return MAGIC + struct.pack("<6Q", len(ids), planes, len(doc_ids), len(docs), len(directory), 0) + docs + directory + b"".join(blocks)


class WaveletMatrix:
    """Access, rank, select, counting and occurrence lookup over one blob."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        self.n, self.planes, self.n_docs, docs, directory, _ = struct.unpack_from("<6Q", blob, 4)
        at = 52
        raw = zstandard.ZstdDecompressor().decompress(blob[at : at + docs])
        ids, null = np.frombuffer(raw, "<i8", self.n_docs), np.frombuffer(raw, np.uint8, self.n_docs, 8 * self.n_docs)
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, null, strict=True)]
        self.first = np.frombuffer(raw, "<i8", self.n_docs + 1, 9 * self.n_docs)
        at += docs
        self.zeros, self._length = np.frombuffer(blob, "<i8", 2 * self.planes, at).reshape(2, -1)
        self._at = at + directory + np.cumsum(self._length) - self._length
        self._blob, self._bits, self._rank = blob, {}, {}

    def plane(self, p: int) -> np.ndarray:
        if p not in self._bits:
            self._bits[p] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self._blob[self._at[p] : self._at[p] + self._length[p]]), np.uint8)
        return self._bits[p]

    def _ones(self, p: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        bits = self.plane(p)
        if p not in self._rank:
            padded = np.concatenate((bits, np.zeros(-len(bits) % (SPAN // 8), np.uint8)))
            self._rank[p] = np.concatenate(([0], np.cumsum(_ONES[padded].reshape(-1, SPAN // 8).sum(1, dtype=np.int64))))
        block, byte = i // SPAN, i // 8
        total = int(self._rank[p][block]) + int(_ONES[bits[block * (SPAN // 8) : byte]].sum(dtype=np.int64))
        return total + (int(_ONES[bits[byte] & ((1 << i % 8) - 1)]) if i % 8 else 0)

    def _bit(self, p: int, i: int) -> int:
        return int(self.plane(p)[i // 8]) >> i % 8 & 1

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for p in range(self.planes):
            one = self._bit(p, i)
            value = value << 1 | one
            i = self.zeros[p] + self._ones(p, i) if one else i - self._ones(p, i)
        return value

    def _range(self, token: int, begin: int, end: int) -> tuple[int, int]:
        """Where the occurrences of a token among the ids [begin, end) lie after the last plane."""
        if token < 0 or token >> self.planes:
            return 0, 0
        for p in range(self.planes):
            a, b = self._ones(p, begin), self._ones(p, end)
            begin, end = (int(self.zeros[p]) + a, int(self.zeros[p]) + b) if token >> (self.planes - 1 - p) & 1 else (begin - a, end - b)
        return begin, end

    def rank(self, token: int, i: int) -> int:
        """Occurrences of the token among the first i ids."""
        a, b = self._range(token, 0, i)
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Place of the token's k-th occurrence, from 0."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for p in range(self.planes - 1, -1, -1):
            one = token >> (self.planes - 1 - p) & 1
            target, low, high = (i - int(self.zeros[p]) if one else i), 0, self.n
            while low < high:  # the smallest prefix with target + 1 such bits
                mid = (low + high) // 2
                have = self._ones(p, mid + 1)
                if (have if one else mid + 1 - have) > target:
                    high = mid
                else:
                    low = mid + 1
            i = low
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All ids, in order."""
        now = np.zeros(self.n, np.uint32 if self.planes > 16 else np.uint16)
        for p in range(self.planes - 1, -1, -1):  # undo each plane's stable split, last one first
            bit = np.unpackbits(self.plane(p), count=self.n, bitorder="little").astype(bool)
            zeros, before = int(self.zeros[p]), np.empty_like(now)
            before[~bit] = now[:zeros]
            before[bit] = now[zeros:] | now.dtype.type(1 << (self.planes - 1 - p))
            now = before
        return now
