"""Quality classifier: naive Bayes support vectors.

A text's features are indicators of its n-grams: characters (one to three), words, and runs of an
equal word (two, three, four or more). Each indicator is scaled by the log ratio of its smoothed
class counts; a linear hinge-loss model over the scaled, length-normalised indicators is fitted by
dual coordinate descent. Margins of a two-fold fit give the logistic curve that turns a margin into
a score from 0 to 1.

The fit uses a bounded sample: of each class at most ``per_class`` labelled rows, the first by a
hash of their id. Feature extraction and scoring run on the executors over whole texts; what the
driver gathers is bounded by ``2 * per_class`` rows of at most ``2**bits`` indices, and what it
broadcasts by ``2**bits`` weights.

Nulls count as empty texts, which have no features and get the score of the bias alone. A row's score
depends on its text only. Rows with a repeated or null id are scored like any other; of a labelled id
that several rows have, the one whose features come first is learnt from, and an id that has both
labels, or a null one, isn't. Texts of any length count whole. With labels of one class only, or none,
every score is that class's share (0.5 without labels). An empty table gives no rows. Input columns
other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import quoted
from .textbatch import U64, Batch, mix, pieces

BITS = 18
PER_CLASS = 3000


def indicators(batch: Batch, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct feature indices of each text, and where each text's start (total appended)."""
    shift, rows, keys = U64(64 - bits), [], []
    text_of = np.repeat(np.arange(batch.n), np.diff(batch.offset))
    for n in (1, 2, 3):
        start = np.arange(max(0, len(batch.codes) - n))
        start = start[text_of[start] == text_of[start + n]]  # all of it before the separator that ends its text
        rows.append(text_of[start])
        keys.append(batch.spans(start, start + n) + U64(n))
    words, of = batch.words(), batch.of
    rows.append(of)
    keys.append(words + U64(7))
    same = np.zeros(len(words), bool)
    run = np.ones(len(words), bool)
    for k in (2, 3, 4):
        same = np.zeros(len(words), bool)
        same[k - 1 :] = (words[k - 1 :] == words[: -(k - 1)]) & (of[k - 1 :] == of[: -(k - 1)])
        run &= same
        rows.append(of[run])
        keys.append(np.full(int(run.sum()), k, U64))
    # sorted and distinct within each text
    both = np.concatenate(rows).astype(np.int64) << bits | np.concatenate([mix(k) >> shift for k in keys]).astype(np.int64)
    both.sort()
    both = both[np.concatenate(([True], both[1:] != both[:-1]))] if len(both) else both
    return (both & ((1 << bits) - 1)).astype(np.int32), np.searchsorted(both, np.arange(batch.n + 1, dtype=np.int64) << bits)


@dataclass(frozen=True)
class Model:
    """score = 1 / (1 + exp(-(slope * margin + shift))), margin = (sum of the weights) / sqrt(features) + bias."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, index: np.ndarray, first: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0.0], np.cumsum(self.weights[index], dtype=np.float64)))
        return (sums[first[1:]] - sums[first[:-1]]) / np.sqrt(np.maximum(np.diff(first), 1)) + self.bias

    def scores(self, index: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(index, first) + self.shift, -30, 30)))


def _hinge(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float, rounds: int, seed: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L1-loss support vector machine; the last coordinate is the bias."""
    size = len(ratio)
    scaled = [np.append(ratio[i] / np.sqrt(max(len(i), 1)), np.float32(1)) for i in rows]
    index = [np.append(i, size) for i in rows]
    square = np.array([float(v @ v) for v in scaled])
    upper = np.where(y > 0, cost * len(y) / (2 * max((y > 0).sum(), 1)), cost * len(y) / (2 * max((y < 0).sum(), 1)))
    w, alpha, rng = np.zeros(size + 1, np.float32), np.zeros(len(y)), np.random.default_rng(seed)
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(y)):
            gradient = y[i] * float(w[index[i]] @ scaled[i]) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), upper[i])
            if new != alpha[i]:
                w[index[i]] += np.float32((new - alpha[i]) * y[i]) * scaled[i]
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < 1e-3:
            break
    return w[:size], float(w[size])


def fit(rows: list[np.ndarray], y: np.ndarray, share: float, bits: int = BITS, cost: float = 1.0, rounds: int = 30, seed: int = 7) -> Model:
    """rows: feature indices of each labelled text; y: +1 or -1; share: of label 1 among all labelled rows."""
    prior = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(1 << bits, np.float32), 0.0, 0.0, 0.0 if len(y) == 0 else prior)

    def one(which: np.ndarray) -> tuple[np.ndarray, float]:
        counts = [np.bincount(np.concatenate([rows[i] for i in which if y[i] == c] or [np.empty(0, np.int32)]), minlength=1 << bits) + 1.0 for c in (1, -1)]
        ratio = np.log((counts[0] / counts[0].sum()) / (counts[1] / counts[1].sum())).astype(np.float32)
        ratio[(counts[0] + counts[1]) < 4] = 0  # an n-gram of a single text says nothing about others
        w, b = _hinge([rows[i] for i in which], y[which], ratio, cost, rounds, seed)
        return w * ratio, b

    fold, margin = np.arange(len(y)) % 2, np.zeros(len(y))
    for k in (0, 1):
        train = np.flatnonzero(fold != k)
        if len(set(y[train].tolist())) == 2:
            w, b = one(train)
            for i in np.flatnonzero(fold == k):
                margin[i] = w[rows[i]].sum() / np.sqrt(max(len(rows[i]), 1)) + b
    slope, shift = logistic(margin, y, share)
    w, b = one(np.arange(len(y)))
    return Model(w, b, slope, shift)


def logistic(margin: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and shift of the logistic curve of label 1, with the rows weighted to the share it has.

    Damped Newton steps on centred margins; a ridge keeps the slope finite where classes don't overlap.
    """
    positive = y > 0
    weight = np.where(positive, share / max(positive.sum(), 1), (1 - share) / max((~positive).sum(), 1))
    target = np.where(positive, 1 - 1e-3, 1e-3)
    centre, spread = float(np.median(margin)), float(np.std(margin)) or 1.0
    x = (margin - centre) / spread
    ridge = 1e-3

    def loss(a: float, b: float) -> float:
        z = a * x + b
        return float(weight @ (np.logaddexp(0, z) - target * z)) + ridge * a * a / 2

    a, b = 1.0, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        d, h = weight * (p - target), weight * p * (1 - p)
        grad = np.array([d @ x + ridge * a, d.sum()])
        hess = np.array([[h @ (x * x) + ridge, h @ x], [h @ x, h.sum() + 1e-6]])
        step, size, now = np.linalg.solve(hess, grad), 1.0, loss(a, b)
        while size > 1e-6 and loss(a - size * step[0], b - size * step[1]) > now:
            size /= 2
        a, b = a - size * step[0], b - size * step[1]
        if size <= 1e-6 or np.abs(size * step).max() < 1e-8:
            break
    a = max(float(a), 0.0)
    return a / spread, float(b) - a * centre / spread


def labelled(documents: DataFrame, labels: DataFrame, label: str, id_col: str, per_class: int, learn) -> tuple[DataFrame, float]:
    """The bounded sample (id, label) to learn from, and label 1's share of all rows that may be learned from."""
    known = labels.select(F.col(quoted(id_col)).alias("doc_key"), F.col(quoted(label)).cast("int").alias("y")).where("doc_key is not null and y in (0, 1)")
    known = known.where(learn(F.col("doc_key"))).groupBy("doc_key").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").drop("z")
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / max(sum(counts.values()), 1)
    some = [known.where(F.col("y") == c).orderBy(F.xxhash64("doc_key"), "doc_key").limit(per_class) for c in (0, 1)]
    return some[0].unionByName(some[1]), share


def sample_texts(documents: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The sample's texts. The sample has at most 2 * per_class rows, so broadcasting it is bounded."""
    return documents.select(F.col(quoted(id_col)).alias("doc_key"), F.col(quoted(text_col)).alias("text")).join(F.broadcast(sample), "doc_key")


def train(documents: DataFrame, labels: DataFrame, learn, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS, bits: int = BITS) -> Model:
    """Fit on labelled rows whose id satisfies ``learn``, a function from a column to a condition."""
    sample, share = labelled(documents, labels, label, id_col, per_class, learn)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches):
            index, first = indicators(Batch(texts), bits)
            blobs = [index[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(blobs, pa.binary())], ["doc_key", "y", "features"])

    found = sample_texts(documents, sample, id_col, text_col).mapInArrow(extract, f"doc_key {dict(documents.dtypes)[id_col]}, y int, features binary")
    found = found.groupBy("doc_key").agg(F.min(F.struct("features", "y")).alias("m")).select("doc_key", "m.*").toArrow()  # a row an id
    # in an order that doesn't depend on partitions
    rows = sorted(zip(*(found.column(c).to_pylist() for c in ("doc_key", "features", "y")), strict=True))
    return fit([np.frombuffer(f, np.int32) for _, f, _ in rows], np.array([1 if y else -1 for _, _, y in rows], dtype=float), share, bits)


def score(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """(id, score) of every row, over its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, text_col):
            index, first = indicators(Batch(texts), bits)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(index, first))], [id_col, "score"])

    return documents.select(F.col(quoted(id_col)), F.col(quoted(text_col))).mapInArrow(run, f"{quoted(id_col)} {dict(documents.dtypes)[id_col]}, score double")
