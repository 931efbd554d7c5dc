"""Token ids of every document, one wavelet matrix per shard.

Documents are dealt by ranges of their id, encoded with a public tokenizer file, ended with an end id
each and cut into shards of about ``SHARD`` ids. A shard is one blob of the format in ``wavelet``,
stored as one row of a Parquet table (any store that Spark writes to holds it; no executor writes a
local file), with its partition, its place in it and its number of ids. Partition totals, one number
per partition, turn places within a partition into places within the corpus.

Order: by id, nulls first, then by a hash of the text; rows that agree in both are equal. Null texts
are empty: a lone end id. An empty table gives no shards. Ids may repeat. Columns other than id and
text are not read. A document longer than a shard makes one long shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import partitions
from .textbatch import U64, Batch, pieces
from .wavelet import WaveletMatrix, encode

SHARD = 1_000_000


_SPACE = np.zeros(0x110000, bool)
_SPACE[[*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True
_HEAD = U64(0xA5A5F00D5EED1234)


class Encoder:
    """Ids exactly as the library gives them for whole texts, with its work on repeated words kept.

    The tokenizer splits before a space that a visible character follows, so what stands between
    such spaces (a unit) is encoded by itself and remembered by a 64-bit hash, in an open-addressed
    table of numpy arrays. Texts with other spacing at those places, or with the opening of a control
    token, go to the library whole. The memory is emptied at ``most`` units.
    """

    def __init__(self, path: str, most: int = 1_500_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.opens = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        for i in range(len(self.opens)):
            self.opens[i] = (self.tokenizer.id_to_token(i) or "")[:1] == "Ġ"  # a space, as this vocabulary writes it
        self.bits = max(12, (2 * most).bit_length())
        self._clear()

    def _clear(self) -> None:
        self.key, self.slot = np.zeros(1 << self.bits, U64), np.full(1 << self.bits, -1, np.int32)
        self.ids, self.end, self.n = np.empty(1 << 16, np.int32), np.zeros(1 << 12, np.int64), 0

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The unit of each hash, or -1."""
        mask = np.int64((1 << self.bits) - 1)
        at = (hashes >> U64(64 - self.bits)).astype(np.int64)
        out = self.slot[at]
        open_ = np.flatnonzero((out >= 0) & (self.key[at] != hashes))
        while len(open_):  # the next cell, until the hash or an empty one
            at[open_] = at[open_] + 1 & mask
            out[open_] = self.slot[at[open_]]
            open_ = open_[(out[open_] >= 0) & (self.key[at[open_]] != hashes[open_])]
        return out

    def _place(self, hashes: np.ndarray, units: np.ndarray) -> None:
        mask = np.int64((1 << self.bits) - 1)
        at, left = (hashes >> U64(64 - self.bits)).astype(np.int64), np.arange(len(hashes))
        while len(left):
            free = left[self.slot[at[left]] < 0]
            self.slot[at[free]], self.key[at[free]] = units[free], hashes[free]  # of several, the last one stays
            left = left[self.key[at[left]] != hashes[left]]
            at[left] = at[left] + 1 & mask

    def _add(self, ids: np.ndarray, ends: np.ndarray) -> None:
        used, n = int(self.end[self.n]), len(ends)
        while used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.empty_like(self.ids)))
        while self.n + n + 1 > len(self.end):
            self.end = np.concatenate((self.end, np.empty_like(self.end)))
        self.ids[used : used + len(ids)] = ids
        self.end[self.n + 1 : self.n + n + 1] = used + ends
        self.n += n

    def _learn(self, hashes: np.ndarray, units: list[str], heads: np.ndarray) -> None:
        start = self.n
        order = np.argsort(heads, kind="stable")  # those after a space first
        after = [units[i] for i in order[: int((~heads).sum())]]
        for i in range(0, len(after), 500):
            group = after[i : i + 500]
            ids = np.array(self.tokenizer.encode(" " + " ".join(group), add_special_tokens=False).ids, np.int32)
            begin = np.flatnonzero(self.opens[ids])
            if len(begin) != len(group):
                raise AssertionError("the tokenizer doesn't split before spaces")
            self._add(ids, np.append(begin[1:], len(ids)))
        alone = [units[i] for i in order[len(after) :]]
        for i in range(0, len(alone), 500):
            got = [e.ids for e in self.tokenizer.encode_batch_fast(alone[i : i + 500], add_special_tokens=False)]
            self._add(np.array([x for g in got for x in g], np.int32), np.cumsum([len(g) for g in got]))
        self._place(hashes[order], np.arange(start, self.n, dtype=np.int32))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many each has."""
        if not texts:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        if self.n > self.most:
            self._clear()
        batch = Batch(texts, case="keep")
        cut = batch.codes == 32
        cut[batch.offset[1:] - 1] = True
        end = np.flatnonzero(cut)
        begin = np.concatenate(([0], end[:-1] + 1))
        first = np.searchsorted(begin, batch.offset[:-1])
        head = np.zeros(len(begin), bool)
        head[first] = True
        size = np.diff(batch.offset) - 1
        odd = (begin == end) | _SPACE[batch.codes[np.minimum(begin, len(batch.codes) - 1)]] | _SPACE[batch.codes[end - 1]]
        whole = np.logical_or.reduceat(odd, first) & (size > 0)
        for i, t in enumerate(texts):
            if t and "<|" in t:
                whole[i] = True
        own = np.repeat(~whole & (size > 0), np.diff(np.append(first, len(begin))))
        hashes = batch.spans(begin[own], end[own]) ^ np.where(head[own], _HEAD, U64(0))
        found = self._find(hashes)
        if (found < 0).any():
            new, at = np.unique(hashes[found < 0], return_index=True)
            at = np.flatnonzero(own)[np.flatnonzero(found < 0)[at]]
            raw = batch.codes.tobytes()
            self._learn(new, [raw[4 * b : 4 * e].decode("utf-32-le", "surrogatepass") for b, e in zip(begin[at].tolist(), end[at].tolist(), strict=True)], head[at])
            found = self._find(hashes)
        start, length = self.end[found], self.end[found + 1] - self.end[found]
        ids = self.ids[np.arange(length.sum()) - np.repeat(np.cumsum(length) - length - start, length)]
        each = np.zeros(len(begin), np.int64)
        each[own] = length
        counts = np.add.reduceat(each, first)
        if whole.any():
            parts, at = [], np.concatenate(([0], np.cumsum(counts)))
            for i in range(len(texts)):
                parts.append(np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.int32) if whole[i] else ids[at[i] : at[i + 1]])
            ids, counts = np.concatenate(parts), np.array([len(p) for p in parts])
        return ids, counts


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One encoder per worker process: what a task has learnt serves the next."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_shards(documents: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> None:
    """Encode all documents into shards under ``path``: (part, seq, start, n_tokens, n_docs, payload)."""
    names = ["part", "seq", "start", "n_tokens", "n_docs", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq, start = encoder_of(tokenizer), TaskContext.get().partitionId(), 0, 0
        docs, ids, counts, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal docs, ids, counts, held, seq, start
            every = np.concatenate(ids)
            blob = encode(every, docs, np.concatenate(([0], np.cumsum(counts))))
            row = pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((part, pa.int32()), (seq, pa.int32()), (start, pa.int64()), (len(every), pa.int64()), (len(docs), pa.int32()), (blob, pa.binary()))], names)
            seq, start, docs, ids, counts, held = seq + 1, start + len(every), [], [], [], 0
            return row

        for piece, texts in pieces(batches, text_col, 400_000):
            found, size = encoder.encode(texts)
            at = np.cumsum(size) - size
            for doc, a, n in zip(piece.column(0).to_pylist(), at, size, strict=True):
                docs.append(doc)
                ids += [found[a : a + n], np.array([end_id], np.int32)]
                counts.append(n + 1)
                held += n + 1
                if held >= shard:
                    yield flush()
        if docs:
            yield flush()

    ordered = documents.select(F.col(id_col).cast("long").alias(id_col), text_col).repartitionByRange(partitions(documents.sparkSession), F.col(id_col).asc_nulls_first(), F.xxhash64(text_col))
    ordered = ordered.sortWithinPartitions(F.col(id_col).asc_nulls_first(), F.xxhash64(text_col))
    ordered.mapInArrow(run, "part int, seq int, start long, n_tokens long, n_docs int, payload binary").write.option("compression", "uncompressed").parquet(path)


def read_shards(spark, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per document, from the shards: id, start (ids of all documents before it), n_tokens, ids_crc32."""
    shards = spark.read.parquet(path)
    before, total = {}, 0
    for row in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():  # one number per partition
        before[row["part"]], total = total, total + row["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, blob in zip(*(batch.column(i) for i in range(3)), strict=True):
                matrix = WaveletMatrix(blob.as_py())
                ids, first = matrix.decode().astype("<u4"), matrix.first
                sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(matrix.doc_ids, pa.int64()), pa.array(first[:-1] + before[part.as_py()] + start.as_py()), pa.array(np.diff(first)), pa.array(sums, pa.int64())], [id_col, "start", "n_tokens", "ids_crc32"])

    return shards.select("part", "start", "payload").mapInArrow(run, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")


def open_shard(spark, path: str, part: int, seq: int) -> WaveletMatrix:
    """One shard, for access, counting and occurrence lookup."""
    row = spark.read.parquet(path).where((F.col("part") == part) & (F.col("seq") == seq)).select("payload").first()
    return WaveletMatrix(bytes(row["payload"]))
