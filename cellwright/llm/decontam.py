"""Benchmark decontamination by latent semantic retrieval.

1. Benchmark items are cut into passages of at most ``PASSAGE`` words; their words are the terms.
   Document frequencies of the terms over all of the corpus's passages (64-word blocks) give the
   TF-IDF weights. A term in more than ``common`` of all blocks is dropped, but each benchmark
   passage keeps its eight rarest terms.
2. A distributed randomised SVD of the TF-IDF passages: each task multiplies its rows by one random
   test matrix and back, the products are summed in two steps, and a Nystroem step on the sum (one
   pass over the corpus) gives the latent directions. The benchmark's passages are rows too, weighted
   to the corpus's total, so that the space has room for what is looked for.
3. Windows of two blocks, half overlapping, are compared with every benchmark passage by the cosine
   in the latent space; a passage of at most 64 words lies whole in some window. Nothing but the
   cosine drops a pair that the next step would take: the words they share, counted term by term,
   spare it those whose subsequence can't be long enough.
4. Candidates stand if the longest common subsequence of words covers ``lcs`` of the benchmark
   passage and, where the benchmark has answers, if the window has the answer's words too.

The benchmark is a stated query set: it runs in blocks of ``BLOCK`` passages against all rows, so
neither a task's memory nor the driver's grows with it, beyond its own text. Nothing but sums of
bounded size is shuffled; a text is never moved.

Nulls are empty texts and match nothing; items without words are skipped; repeated rows are reported
each. Columns other than ids, texts and answers are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, partitions, quoted
from .textbatch import U64, Batch, pieces

SPAN = 64
PASSAGE = 64
BLOCK = 256
#: A window full of other benchmark words still reaches this.
COSINE = 0.12
#: Terms in a larger share of all blocks have no weight in the latent space; the subsequence counts all words.
COMMON = 0.02
LCS = 0.6
#: Passages of fewer words are leaks only where they stand word by word.
SHORT = 8
#: Directions of the latent space, more than a block has passages, and further ones that steady its computation.
RANK, EXTRA = 288, 32
#: Blocks of benchmark passages that one pass over the corpus looks for.
AT_ONCE = 4
#: Low bits of a word's hash; most words are no term, and few pass this.
SIEVE = U64((1 << 17) - 1)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    place: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        place[x] = place.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        if m := place.get(x):
            both = row & m
            row = (row + both | row - both) & full
    return len(a) - row.bit_count()


def stands(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether a is a run of b."""
    at = np.flatnonzero(b[: max(len(b) - len(a) + 1, 0)] == a[0])
    for j in range(1, len(a)):
        at = at[b[at + j] == a[j]]
    return bool(len(at))


def damped(count: np.ndarray) -> np.ndarray:
    """1 + ln(count), 0 for 0: a word that repeats over and over must not drown the others."""
    return np.where(count > 0, 1 + np.log(np.maximum(count, 1)), 0).astype(np.float32)


class Queries:
    """Benchmark passages of one block: word hashes, item, answer, terms and term counts."""

    def __init__(self, passages: list[tuple[object, np.ndarray, np.ndarray]]):
        self.passages = passages
        self.terms = np.unique(np.concatenate([w for _, w, _ in passages]))
        self.counts = np.zeros((len(passages), len(self.terms)), np.float32)
        for i, (_, w, _) in enumerate(passages):
            np.add.at(self.counts[i], np.searchsorted(self.terms, w), 1)
        self.weights = damped(self.counts)
        self.sieve = np.zeros(int(SIEVE) + 1, bool)
        self.sieve[self.terms & SIEVE] = True

    def lookup(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that are terms, and which terms."""
        some = np.flatnonzero(self.sieve[words & SIEVE])
        at = np.minimum(np.searchsorted(self.terms, words[some]), len(self.terms) - 1)
        hit = self.terms[at] == words[some]
        return some[hit], at[hit]


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, answer_col: str | None, size: int = BLOCK) -> Iterator[Queries]:
    """The benchmark, a block of passages at a time."""
    names = [id_col, text_col, *([answer_col] if answer_col else [])]
    held: list = []
    for row in benchmark.select(*[F.col(quoted(n)) for n in names]).orderBy(F.col(quoted(id_col))).toLocalIterator():
        words = Batch([row[1]]).words()
        answer = np.unique(Batch([row[2]]).words()) if answer_col else np.empty(0, U64)
        if len(words):
            held += [(row[0], part, answer) for part in np.array_split(words, -(-len(words) // PASSAGE))]
        if len(held) >= size:
            yield Queries(held[:size])
            held = held[size:]
    while held:
        yield Queries(held[:size])
        held = held[size:]


class Blocks:
    """The corpus's passages in one batch: the block of each word, and the blocks of each text."""

    def __init__(self, batch: Batch):
        count = np.diff(batch.first)
        per = -(-count // SPAN)
        self.first = np.concatenate(([0], np.cumsum(per)))
        self.of = (np.arange(count.sum()) - np.repeat(batch.first[:-1], count)) // SPAN + np.repeat(self.first[:-1], count)


def _term_frequencies(queries: Queries, words: np.ndarray, block: np.ndarray, keep: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, term, count) of the terms in each block, sorted."""
    hit, term = queries.lookup(words)
    if keep is not None:
        kept = keep[term]
        hit, term = hit[kept], term[kept]
    both, count = np.unique(block[hit] * len(queries.terms) + term, return_counts=True)
    return both // len(queries.terms), both % len(queries.terms), count


def weights(texts: DataFrame, queries: Queries, common: float) -> tuple[np.ndarray, int]:
    """Inverse document frequencies over all blocks of the corpus (0: dropped), and how many blocks there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(queries.terms), np.int64), 0
        for _, some in pieces(batches):
            batch = Batch(some)
            blocks = Blocks(batch)
            _, term, _ = _term_frequencies(queries, batch.words(), blocks.of, None)
            total += np.bincount(term, minlength=len(total))
            n += int(blocks.first[-1])
        here = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(here, -1)), pa.array(np.append(total[here], n))], ["term", "n"])

    frequency, n = np.zeros(len(queries.terms)), 0
    for row in texts.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row a term
        if row["term"] < 0:
            n = row["n"]
        else:
            frequency[row["term"]] = row["n"]
    idf = np.log((1 + n) / (1 + frequency))
    keep = frequency <= common * n
    for counts in queries.counts:
        terms = np.flatnonzero(counts)
        keep[terms[np.argsort(frequency[terms], kind="stable")[:8]]] = True
    return np.where(keep, np.maximum(idf, 1e-3), 0).astype(np.float32), n


def latent(texts: DataFrame, queries: Queries, idf: np.ndarray, seed: int = 5, rank: int = RANK, extra: int = EXTRA) -> np.ndarray:
    """Right singular vectors (terms x rank) of the TF-IDF passages of corpus and benchmark.

    The sketch is as large as the terms of a block times rank + extra. As many tasks as the session's
    shuffle partitions make one each, and a level of as many sums as their root brings them together.
    """
    size, tasks = len(queries.terms), partitions(texts.sparkSession)
    width = min(size, rank + extra)
    test = np.random.default_rng(seed).normal(size=(size, width)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, trace = np.zeros((size, width), np.float32), 0.0
        for _, some in pieces(batches):
            batch = Batch(some)
            block, term, count = _term_frequencies(queries, batch.words(), Blocks(batch).of, idf > 0)
            if not len(block):
                continue
            value = (damped(count) * idf[term]).astype(np.float32)
            trace += float(value @ value)
            for at in range(0, len(block), 4_000):  # whole blocks, as many as fit a cache
                low, high = np.searchsorted(block, (block[at], block[min(at + 4_000, len(block) - 1)] + (at + 4_000 >= len(block))))
                if at:
                    low = last
                last = high
                if low >= high:
                    continue
                b, t, v = block[low:high], term[low:high], value[low:high, None]
                start = np.flatnonzero(np.diff(b, prepend=-1))
                row = np.add.reduceat(test[t] * v, start)
                order = np.argsort(t, kind="stable")
                back = (np.repeat(row, np.diff(np.append(start, len(b))), 0) * v)[order]
                heads = np.flatnonzero(np.diff(t[order], prepend=-1))
                total[t[order][heads]] += np.add.reduceat(back, heads)
        yield pa.RecordBatch.from_arrays([pa.array([trace]), pa.array([total.tobytes()], pa.binary())], ["trace", "total"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, trace = np.zeros((size, width), np.float32), 0.0
        for batch in batches:
            for one, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                trace += one
                total += np.frombuffer(blob.as_buffer(), np.float32).reshape(size, width)
        yield pa.RecordBatch.from_arrays([pa.array([trace]), pa.array([total.tobytes()], pa.binary())], ["trace", "total"])

    schema = "trace double, total binary"
    total, trace = np.zeros((size, width)), 0.0
    for row in texts.coalesce(tasks).mapInArrow(run, schema).repartition(math.isqrt(tasks) + 1).mapInArrow(add, schema).toLocalIterator():  # a sum at a time
        trace += row["trace"]
        total += np.frombuffer(row["total"], np.float32).reshape(size, width)
    own = queries.weights * idf
    weight = max(1.0, trace / max(float((own * own).sum()), 1e-9))
    total += weight * (own.T.astype(np.float64) @ (own @ test))
    shift = np.sqrt(size) * np.finfo(np.float32).eps * np.linalg.norm(total)
    total += shift * test
    inner = test.T.astype(np.float64) @ total
    value, vector = np.linalg.eigh((inner + inner.T) / 2)
    good = value > value[-1] * 1e-7
    left, spectrum, _ = np.linalg.svd(total @ (vector[:, good] / np.sqrt(value[good])), full_matrices=False)
    return left[:, : min(rank, int((spectrum > spectrum[0] * 1e-4).sum()))].astype(np.float32)


class Searcher:
    """Finds the benchmark passages of one block in a batch of texts."""

    def __init__(self, queries: Queries, idf: np.ndarray, space: np.ndarray, cosine: float, lcs: float):
        own = queries.weights * idf
        norm = np.maximum(np.linalg.norm(own, axis=1), 1e-9)
        self.back = (space @ ((own / norm[:, None]) @ space).T).astype(np.float32)  # of each term to each passage, through the space
        self.queries, self.idf, self.cosine, self.lcs = queries, idf, cosine, lcs
        kept = [np.flatnonzero((c > 0) & (idf > 0)) for c in queries.counts]
        # of each passage: its terms, how often it has each, and how many of these a window must hold if it has all dropped ones
        self.needs = [(t, c[t].astype(np.uint8), lcs * c.sum() - (c.sum() - c[t].sum()) - 1e-6) for t, c in zip(kept, queries.counts, strict=True)]

    def possible(self, passage: np.ndarray, window: np.ndarray, held: np.ndarray) -> np.ndarray:
        """Which pairs, sorted by passage, can have a long enough subsequence: by the words shared. ``held``: windows x terms."""
        out = np.zeros(len(passage), bool)
        edge = np.searchsorted(passage, np.arange(len(self.needs) + 1))
        for q in np.flatnonzero(np.diff(edge)):
            terms, count, least = self.needs[q]
            some = slice(edge[q], edge[q + 1])
            out[some] = np.minimum(held[window[some, None], terms], count).sum(1) >= least
        return out

    def find(self, batch: Batch) -> list[tuple[int, int, float, float, int]]:
        """(text, passage, cosine, share of the passage found, window's first word)."""
        words, blocks = batch.words(), Blocks(batch)
        block, term, count = _term_frequencies(self.queries, words, blocks.of, self.idf > 0)
        if not len(block):
            return []
        # a window is a block and the next one of its text; the last block of a longer text only closes one
        text = np.repeat(np.arange(batch.n), np.diff(blocks.first))
        last = np.append(text[1:] != text[:-1], True)
        before = block - 1
        second = (before >= 0) & (text[np.maximum(before, 0)] == text[block])
        single = np.diff(blocks.first)[text[block]] == 1
        own = ~last[block] | single
        window = np.concatenate((block[own], before[second]))
        both, inverse = np.unique(window * len(self.idf) + np.concatenate((term[own], term[second])), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate((count[own], count[second])))
        window, term = both // len(self.idf), both % len(self.idf)
        value = (damped(counts) * self.idf[term]).astype(np.float32)
        start = np.flatnonzero(np.diff(window, prepend=-1))
        out = []
        for at in range(0, len(start), 2000):
            head = start[at : at + 2000]
            stop = start[at + 2000] if at + 2000 < len(start) else len(window)
            v, t = value[head[0] : stop], term[head[0] : stop]
            product = np.add.reduceat(self.back[t] * v[:, None], head - head[0])
            cosine = product / np.sqrt(np.add.reduceat(v * v, head - head[0]))[:, None]
            near, w = np.nonzero(cosine.T >= self.cosine)
            held = np.zeros((len(head), len(self.idf)), np.uint8)
            held[np.repeat(np.arange(len(head)), np.diff(np.append(head, stop))), t] = np.minimum(counts[head[0] : stop], 255)
            some = self.possible(near, w, held)
            for w, q in zip(w[some], near[some], strict=True):
                b = window[head[w]]
                doc = text[b]
                begin = batch.first[doc] + (b - blocks.first[doc]) * SPAN
                inside = words[begin : min(begin + 2 * SPAN, batch.first[doc + 1])]
                _, passage, answer = self.queries.passages[q]
                share = common_subsequence(passage, inside) / len(passage) if len(passage) >= SHORT else float(stands(passage, inside))
                if share >= self.lcs and np.isin(answer, inside).all():
                    out.append((int(doc), int(q), float(cosine[w, q]), share, int(begin - batch.first[doc])))
        return out


def searchers(documents: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, answer_col: str | None, common: float, cosine: float, lcs: float) -> Iterator[list[Searcher]]:
    """For each block of the benchmark a searcher, ``AT_ONCE`` together."""
    texts, held = documents.select(F.col(quoted(text_col)).alias("text")), []
    for queries in benchmark_blocks(benchmark, item_col, item_text_col, answer_col):
        idf, _ = weights(texts, queries, common)
        held.append(Searcher(queries, idf, latent(texts, queries, idf), cosine, lcs))
        if len(held) == AT_ONCE:
            yield held
            held = []
    if held:
        yield held


def leaks(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None, common: float = COMMON, cosine: float = COSINE, lcs: float = LCS) -> DataFrame:
    """(id, item_id, cosine, share, first_word) of every document and item that it has a passage of; the best window each.

    An item of several passages may come from passages of different blocks: then it comes once for each
    ``AT_ONCE`` blocks that found it.
    """
    item_type = benchmark.schema[item_col].dataType.simpleString()
    arrow = pa.int64() if item_type in ("bigint", "int", "smallint", "tinyint") else pa.string()
    schema = f"doc {dict(documents.dtypes)[id_col]}, item {'long' if arrow == pa.int64() else 'string'}, cosine double, share double, first_word long"
    texts = documents.select(F.col(quoted(id_col)).alias("doc"), F.col(quoted(text_col)).alias("text"))

    def search(found: list[Searcher]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, some in pieces(batches):
                batch, best = Batch(some), {}
                for s in found:
                    for doc, q, c, share, word in s.find(batch):
                        key = doc, s.queries.passages[q][0]
                        best[key] = max(best.get(key, (-1.0, 0.0, 0)), (share, c, -word))
                rows = sorted(best)
                ids = part.column(0).take(pa.array([d for d, _ in rows], pa.int64()))
                best = [best[k] for k in rows]
                yield pa.RecordBatch.from_arrays([ids, pa.array([i if arrow == pa.int64() else str(i) for _, i in rows], arrow), pa.array([b[1] for b in best], pa.float64()), pa.array([b[0] for b in best], pa.float64()), pa.array([-b[2] for b in best], pa.int64())], ["doc", "item", "cosine", "share", "first_word"])

        return texts.mapInArrow(run, schema)

    out, scratch = None, Scratch(documents.sparkSession, "leaks")
    for found in searchers(documents, benchmark, text_col, item_col, item_text_col, answer_col, common, cosine, lcs):
        if out is not None:  # more than AT_ONCE blocks: written, so that no task holds more of them
            out = scratch.keep(out).unionByName(scratch.keep(search(found)))
        else:
            out = search(found)
    out = documents.sparkSession.createDataFrame([], schema) if out is None else out
    return out.withColumnsRenamed({"doc": id_col, "item": item_col})


def without_leaks(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None, common: float = COMMON, cosine: float = COSINE, lcs: float = LCS) -> DataFrame:
    """The rows of ``documents`` that have no passage of the benchmark, with all their columns."""

    def search(rows: DataFrame, found: list[Searcher]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, texts in pieces(batches, text_col):
                batch, keep = Batch(texts), np.ones(len(texts), bool)
                for s in found:
                    keep[[doc for doc, *_ in s.find(batch)]] = False
                yield part.filter(pa.array(keep))

        return rows.mapInArrow(run, rows.schema)

    out, scratch = documents, Scratch(documents.sparkSession, "leaks")
    for i, found in enumerate(searchers(documents, benchmark, text_col, item_col, item_text_col, answer_col, common, cosine, lcs)):
        out = search(scratch.keep(out) if i else out, found)
    return out
