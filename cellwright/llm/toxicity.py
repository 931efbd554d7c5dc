"""Toxicity scores from subword-bag embeddings and a linear softmax.

A text is the bag of all its words' subwords: each word's character n-grams (three to five code points,
marked where they touch the word's ends) and the word itself, each hashed to one of ``2**bits`` vectors.
The mean of the bag goes through a linear softmax that gives the text's class. The vectors and the
softmax are trained jointly in numpy, by full-batch Adam steps. All words of the whole text count, as
often as they stand there, in training as in use. An unseen misspelling shares most n-gram vectors with
the word it comes from.

The class map is linear, so a vector acts on a score through one number, its product with the
difference of the two class rows. Scoring uses those numbers alone.

The fit uses a bounded sample: of each class at most ``per_class`` labelled rows and ``most_chars``
characters, the first by a hash of their id, without texts of over a tenth of that. What the driver
gathers is bounded by it, and the broadcast by ``2**bits`` numbers.

Nulls count as empty texts and, having no words, get the score of the bias. Rows with a repeated or null id
are scored like any other; of a labelled id that several rows have, the smallest text is learnt from,
and an id that has both labels, or a null one, isn't. With labels of one class only, or none, every
score is that class's share (0.5 without labels). An empty table gives no rows. Input columns other
than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .quality import labelled, logistic, sample_texts
from .shared import quoted
from .textbatch import CHUNK_CHARS, U64, Batch, mix, pieces

BITS = 18
PER_CLASS = 2000
SIZES = (3, 4, 5)
#: Characters of the texts of one class that are learnt from at most; one text is at most a tenth of them.
MOST_CHARS = 20_000_000


def distinct_words(batch: Batch) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct word, and the distinct word of every place."""
    _, place, inverse = np.unique(batch.words(), return_index=True, return_inverse=True)
    return place, inverse


def subwords(batch: Batch, place: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram indices of the words at these places, and where each word's start (total appended)."""
    begin, end = batch.begin[place], batch.end[place]
    of, keys = [np.arange(len(place))], [batch.spans(begin, end) + U64(64)]
    for n in SIZES:
        count = np.maximum(end - begin - n + 1, 0)
        word = np.repeat(np.arange(len(place)), count)
        start = begin[word] + np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
        touch = (start == begin[word]) + 2 * (start + n == end[word])
        of.append(word)
        keys.append(batch.spans(start, start + n) + touch.astype(U64) * U64(8) + U64(n))
    order = np.argsort(np.concatenate(of), kind="stable")
    index = (mix(np.concatenate(keys)) >> U64(64 - bits)).astype(np.int32)[order]
    return index, np.concatenate(([0], np.cumsum(np.bincount(np.concatenate(of), minlength=len(place)))))


def counted(batch: Batch, word: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of each text: the text, the word and how often it stands there."""
    both, count = np.unique(batch.of.astype(np.int64) * max(n_words, 1) + word, return_counts=True)
    return both // max(n_words, 1), both % max(n_words, 1), count


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values from each start to the next; none is empty."""
    return np.add.reduceat(values, first[:-1]) if len(first) > 1 else np.empty(0)


def split(texts: list[str | None], most: int = CHUNK_CHARS) -> list[list[str | None]]:
    out, size = [[]], 0
    for t in texts:
        if size >= most:
            out, size = [*out, []], 0
        out[-1].append(t)
        size += len(t or "") + 1
    return out


@dataclass
class Bag:
    """Some texts' n-grams: the text and the index of each, and its share of the text's bag; 12 bytes each."""

    text: np.ndarray
    index: np.ndarray
    share: np.ndarray

    def where(self, mask: np.ndarray) -> Bag:
        return Bag(self.text[mask], self.index[mask], self.share[mask])


def bags(texts: list[str | None], bits: int) -> list[Bag]:
    """The distinct n-grams of each text, some texts at a time; a text is whole in one of them."""
    out, at = [], 0
    for some in split(texts):
        batch = Batch(some)
        if len(batch.begin):
            place, word = distinct_words(batch)
            grams, first = subwords(batch, place, bits)
            text, which, count = counted(batch, word, len(place))
            size = np.diff(first)[which]
            here = grams[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - first[which], size)]
            both, inverse = np.unique(np.repeat(text, size) << bits | here, return_inverse=True)
            total = np.bincount(text, size * count, batch.n)
            share = np.bincount(inverse, np.repeat(count, size)) / total[both >> bits]
            out.append(Bag((both >> bits).astype(np.int32) + np.int32(at), (both & ((1 << bits) - 1)).astype(np.int32), share.astype(np.float32)))
        at += batch.n
    return out


@dataclass(frozen=True)
class Model:
    effect: np.ndarray  # of each n-gram vector on the difference of the two classes
    bias: float
    slope: float
    shift: float
    bits: int = BITS

    def margins(self, batch: Batch) -> np.ndarray:
        """Log odds of the toxic class."""
        out = np.full(batch.n, self.bias)
        if len(batch.begin):
            place, word = distinct_words(batch)
            index, first = subwords(batch, place, self.bits)
            text, which, count = counted(batch, word, len(place))
            effect = np.bincount(text, sums(self.effect[index].astype(np.float64), first)[which] * count, batch.n)
            size = np.bincount(text, np.diff(first)[which] * count, batch.n)
            out += effect / np.maximum(size, 1)
        return out

    def scores(self, batch: Batch) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(batch) + self.shift, -30, 30)))


def fit(texts: list[str | None], y: np.ndarray, share: float, bits: int = BITS, **how) -> Model:
    """y: 1 or 0 for each text; share: of label 1 among all labelled rows.

    The logistic curve that turns margins into scores comes from margins of texts that the fit hasn't
    seen: each half of the texts is scored by a fit on the other half.
    """
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(1 << bits, np.float32), 0.0, 0.0, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))) if len(y) else 0.0, bits)
    bag, fold, margin = bags(texts, bits), np.arange(len(y)) % 2, np.zeros(len(y))
    for k in (0, 1):
        if len(set(y[fold != k].tolist())) == 2:
            half = embed(bag, y, fold != k, bits, **how)
            z = np.full(len(y), half.bias)
            for b in bag:
                z += np.bincount(b.text, half.effect[b.index] * b.share, len(y))
            margin[fold == k] = z[fold == k]
    whole = embed(bag, y, np.ones(len(y), bool), bits, **how)
    return Model(whole.effect, whole.bias, *logistic(margin, np.where(y == 1, 1.0, -1.0), share), bits)


def embed(bag: list[Bag], y: np.ndarray, learn: np.ndarray, bits: int = BITS, size: int = 8, rounds: int = 100, rate: float = 1.0, calm: float = 1e-3, least: int = 8, seed: int = 11) -> Model:
    """Vectors and softmax, trained jointly on the texts in ``learn``, which have both labels; without the curve."""
    mine = [b.where(learn[b.text]) for b in bag]
    # n-grams of fewer than ``least`` texts say nothing about others: their vectors stay zero
    spread = sum((np.bincount(b.index, minlength=1 << bits) for b in mine), np.zeros(1 << bits, np.int64))
    live = np.flatnonzero(spread >= min(least, learn.sum() // 2))
    slot = np.full(1 << bits, len(live), np.int32)
    slot[live] = np.arange(len(live))
    mine = [Bag(b.text, slot[b.index], b.share).where(slot[b.index] < len(live)) for b in mine]
    rng = np.random.default_rng(seed)
    vectors, classes, bias = rng.normal(0, 0.1, (len(live), size)), rng.normal(0, 0.3, (2, size)), np.zeros(2)
    params = [vectors, classes, bias]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    weight = np.where(learn, np.where(y == 1, 0.5 / (learn & (y == 1)).sum(), 0.5 / (learn & (y == 0)).sum()), 0)
    for step in range(1, rounds + 1):
        delta = classes[1] - classes[0]
        effect, z = (vectors @ delta).astype(np.float32), np.full(len(y), bias[1] - bias[0])
        for b in mine:
            z += np.bincount(b.text, effect[b.index] * b.share, len(y))
        pull = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        near, each = pull.astype(np.float32), np.zeros(len(live))
        for b in mine:
            each += np.bincount(b.index, near[b.text] * b.share, len(live))
        along = each @ vectors
        grads = [np.outer(each, delta), np.stack((-along, along)), np.array([-pull.sum(), pull.sum()])]
        for q, g, (m, v) in zip(params, grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            q -= rate * (1 - (step - 1) / rounds) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + calm)
    effect = np.zeros(1 << bits, np.float32)
    effect[live] = vectors @ (classes[1] - classes[0])
    return Model(effect, float(bias[1] - bias[0]), 1.0, 0.0, bits)


def train(documents: DataFrame, labels: DataFrame, learn, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS, most_chars: int = MOST_CHARS, **how) -> Model:
    """Fit on labelled rows whose id satisfies ``learn``, a function from a column to a condition."""
    sample, share = labelled(documents, labels, label, id_col, per_class, learn)
    found = sample_texts(documents, sample, id_col, text_col).where(F.coalesce(F.length("text"), F.lit(0)) <= most_chars // 10)
    found = found.groupBy("doc_key").agg(F.min(F.struct("text", "y")).alias("m")).select("doc_key", "m.*")  # a row an id
    sofar = F.sum(F.coalesce(F.length("text"), F.lit(0))).over(Window.partitionBy("y").orderBy(F.xxhash64("doc_key"), "doc_key"))
    found = found.withColumn("sofar", sofar).where(F.col("sofar") <= most_chars).toArrow()
    rows = sorted(zip(*(found.column(c).to_pylist() for c in ("doc_key", "text", "y")), strict=True), key=lambda r: r[0])
    return fit([t for _, t, _ in rows], np.array([y for *_, y in rows], dtype=float), share, **how)


def score(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row, over its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, text_col):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(Batch(texts)))], [id_col, "score"])

    return documents.select(F.col(quoted(id_col)), F.col(quoted(text_col))).mapInArrow(run, f"{quoted(id_col)} {dict(documents.dtypes)[id_col]}, score double")


def reject(documents: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that score below the threshold, with all their columns, scored in the same pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, text_col):
            yield part.filter(pa.array(model.scores(Batch(texts)) < threshold))

    return documents.mapInArrow(run, documents.schema)
