"""N-gram Jaccard join: MinHash bands find candidates, full sets of word shingles decide.

Texts link if the Jaccard similarity of their sets of five-word shingles is at least 0.8. A text of
one to four words has one shingle, all its words; a text without words (null, empty, punctuation)
has none and links to nothing.

1. Texts with the same word sequence fall into one class (a 128-bit digest), so copies are one row
   from there on, however many they are.
2. The classes' MinHash bands are shuffled on their hashes, counting members and the smallest one
   before the shuffle. Each member of a shared band points at the smallest: candidate components.
3. Each component is dealt over blocks of bounded size by a hash, and each pair of blocks is one unit
   of work on the shared bands and the full shingle sets. A component of a third of all texts is
   many units; the pairs themselves are never rows.
4. A unit yields per member the number of linked texts and a spanning forest of the links; the
   forests' components are the classes of near copies.

Bands and rows are the widest that keep ``recall`` for a pair right at the threshold; the pairs
above it are found with a higher probability. Verification is exact.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import Scratch, free, partitions, quoted
from .textbatch import U64, Batch, mix, pieces

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.9995
MOST_HASHES = 128
#: Shingles and members of one block; a unit of work holds two blocks.
BLOCK_SHINGLES = 600_000
BLOCK_MEMBERS = 2000


def plan_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows for which enough bands for the recall fit in ``most`` hashes."""
    best = None
    for rows in range(1, most + 1):
        chance = threshold**rows
        bands = 1 if chance >= 1 else math.ceil(math.log1p(-recall) / math.log1p(-chance))
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError("no banding reaches the recall with so few hashes")
    return best


def signatures(shingles: np.ndarray, at: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes (texts x bands, int64) of the texts that have shingles."""
    start = at[:-1][np.diff(at) > 0]
    out = np.empty((len(start), bands), np.int64)
    seed = np.arange(1, 2 * bands * rows + 1, dtype=U64)
    factor, shift = mix(seed[: bands * rows]) | U64(1), mix(seed[bands * rows :])
    for b in range(bands):
        total = np.zeros(len(start), U64)
        for r in range(rows):
            k = b * rows + r
            total = mix(total + np.minimum.reduceat(shingles * factor[k] + shift[k], start) + U64(r))
        out[:, b] = mix(total + U64(b + 1)).view(np.int64)
    return out


def digest(words: np.ndarray) -> bytes | None:
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest() if len(words) else None


def describe(documents: DataFrame, id_col: str, text_col: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """(doc, print, key, size, bands): digest of the words, number of shingles, band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches):
            batch = Batch(texts)
            words = batch.words()
            keys = [digest(words[a:b]) for a, b in zip(batch.first[:-1], batch.first[1:], strict=True)]
            shingles, at = batch.shingles(shingle)
            has, found = np.diff(at) > 0, np.zeros((batch.n, bands), np.int64)
            if has.any():
                found[has] = signatures(shingles, at, bands, rows)
            offsets = pa.array(np.arange(batch.n + 1, dtype=np.int32) * bands)
            lists = pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(keys, pa.binary()), pa.array(np.diff(at)), lists], ["doc", "print", "key", "size", "bands"])

    source = documents.select(F.col(quoted(id_col)).alias("doc"), F.xxhash64(F.col(quoted(text_col))).alias("print"), F.col(quoted(text_col)).alias("text"))
    return source.mapInArrow(run, f"doc {dict(documents.dtypes)[id_col]}, print long, key binary, size long, bands array<long>")


def links_of(bands: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs between members ``left`` and ``right`` (all pairs within, if they are the same)."""
    same = left is right
    near = np.zeros((len(left), len(right)), bool)
    for b in range(bands.shape[1]):
        near |= bands[left, b][:, None] == bands[right, b][None, :]
    if same:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    if not len(i):
        return i, j
    sizes = np.array([len(s) for s in sets])
    everything = np.concatenate([sets[k] for k in (left if same else np.concatenate((left, right)))])
    _, column, count = np.unique(everything, return_inverse=True, return_counts=True)
    if len(i) * 15e-6 <= len(left) * len(right) * (count > 1).sum() / 2e10 + 1e-4:
        both = np.array([len(np.intersect1d(sets[left[x]], sets[right[y]], assume_unique=True)) for x, y in zip(i, j, strict=True)])
    else:  # products of 0/1 matrices over the shingles that two members have
        order = np.full(len(count), -1)
        shared = np.flatnonzero(count > 1)
        order[shared] = np.arange(len(shared))
        column = order[column]
        owner = np.repeat(np.arange(len(left) if same else len(left) + len(right)), sizes[left if same else np.concatenate((left, right))])
        total, step = np.zeros((len(left), len(right)), np.float32), 2048
        for at in range(0, len(shared), step):
            here = (column >= at) & (column < at + step)
            dense = np.zeros((owner[-1] + 1, min(step, len(shared) - at)), np.float32)
            dense[owner[here], column[here] - at] = 1
            total += dense[: len(left)] @ (dense if same else dense[len(left) :]).T
        both = total[i, j].astype(np.int64)
    t = Fraction(str(threshold))
    ok = both * (t.denominator + t.numerator) >= t.numerator * (sizes[left[i]] + sizes[right[j]])
    return left[i[ok]], right[j[ok]]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member that each is linked to, over any number of links."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


def verify(units: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """(key, links, root) of the linked members of each unit (component, one, two)."""

    def settle(rows: list[tuple]) -> pa.RecordBatch | None:
        rows = list({r[0]: r for r in rows}.values())
        if len(rows) < 2:
            return None
        keys, many = [r[0] for r in rows], np.array([r[1] for r in rows])
        bands = np.array([r[2] for r in rows])
        sets = [np.frombuffer(r[3], U64) for r in rows]
        block, one, two = np.array([r[4] for r in rows]), rows[0][5], rows[0][6]
        left = np.flatnonzero(block == one)
        a, b = links_of(bands, sets, left, left if one == two else np.flatnonzero(block == two), threshold)
        if not len(a):
            return None
        links = np.bincount(a, many[b], len(rows)) + np.bincount(b, many[a], len(rows))
        root, hit = forest(len(rows), a, b), np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array([keys[k] for k in hit], pa.binary()), pa.array(links[hit].astype(np.int64)), pa.array([keys[root[k]] for k in hit], pa.binary())], ["key", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = [], None
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            unit = list(zip(column["component"].to_pylist(), column["one"].to_pylist(), column["two"].to_pylist(), strict=True))
            rest = list(zip(*(column[n].to_pylist() for n in ("key", "many", "bands", "shingles", "block", "one", "two")), strict=True))
            for u, row in zip(unit, rest, strict=True):
                if u != of:
                    if out := settle(held):
                        yield out
                    held, of = [], u
                held.append(row)
        if out := settle(held):
            yield out

    return units.mapInArrow(run, "key binary, links long, root binary")


def shingle_sets(members: DataFrame, shingle: int) -> DataFrame:
    """Adds the sorted distinct shingles of each member's text; drops rows whose text has other words than the member."""
    kept = [c for c in members.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches):
            batch = Batch(texts)
            words = batch.words()
            mine = [digest(words[a:b]) for a, b in zip(batch.first[:-1], batch.first[1:], strict=True)]
            shingles, at = batch.shingles(shingle)
            sets = [np.unique(shingles[a:b]).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            right = pa.array([m == k for m, k in zip(mine, part.column(part.schema.get_field_index("key")).to_pylist(), strict=True)])
            rows = [part.column(part.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*rows, pa.array(sets, pa.binary())], [*kept, "shingles"]).filter(right)

    return members.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.select(*kept).schema) + ", shingles binary")


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, shingle: int = SHINGLE, block_shingles: int = BLOCK_SHINGLES, block_members: int = BLOCK_MEMBERS, with_group: bool = False) -> DataFrame:
    """One row for each row of ``documents``: its id, ``class_id`` (the smallest id of all that it is
    linked to, over any number of links; its own without links), and ``n_links``, the number of other
    rows whose texts are similar to its own, copies included.

    Null ids take part and sort first. Repeated rows are copies of one another. Other columns aren't
    read. ``with_group`` adds a hash of the text, which with the id tells rows apart, and the group's key
    (null without words).
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "near-dup")
    bands, rows = plan_bands(threshold, recall)
    described = scratch.keep(describe(documents, id_col, text_col, shingle, bands, rows))
    classes = scratch.keep(described.where("key is not null").groupBy("key").agg(F.min(F.struct("doc", "print")).alias("first"), F.count("*").alias("many"), F.first("size").alias("size"), F.first("bands").alias("bands")))
    banded = classes.select("key", F.explode("bands").alias("band"))
    meeting = scratch.keep(banded.groupBy("band").agg(F.min("key").alias("low"), F.count("*").alias("n")).where("n > 1").select("band", "low"))
    candidates = connected_components(banded.join(meeting, "band").select(F.col("key").alias("a"), F.col("low").alias("b")), scratch)
    candidates = scratch.keep(candidates.withColumnRenamed("node", "key").join(classes, "key"))
    blocks = scratch.keep(candidates.groupBy("component").agg(F.ceil(F.greatest(F.sum("size") / block_shingles, F.count("*") / block_members)).cast("int").alias("n_blocks")))
    members = candidates.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("key"), F.col("n_blocks")).cast("int"))
    members = scratch.keep(members.select(F.col("first.doc").alias("doc"), F.col("first.print").alias("print"), "key", "component", "many", "bands", "block", "n_blocks"))
    texts = documents.select(F.col(quoted(id_col)).alias("doc"), F.xxhash64(F.col(quoted(text_col))).alias("print"), F.col(quoted(text_col)).alias("text"))
    found = texts.join(members, texts["print"].eqNullSafe(members["print"]) & texts["doc"].eqNullSafe(members["doc"])).select(members["key"], "component", "many", "bands", "block", "n_blocks", "text")
    sets = shingle_sets(found, shingle)
    units = sets.select("*", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other")).select("component", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "key", "many", "bands", "block", "shingles")
    units = units.repartition(partitions(spark), "component", "one", "two").sortWithinPartitions("component", "one", "two")
    verified = scratch.keep(verify(units, threshold, shingle))
    joined = connected_components(verified.select(F.col("key").alias("a"), F.col("root").alias("b")), scratch)
    linked = joined.withColumnRenamed("node", "key").join(verified.groupBy("key").agg(F.sum("links").alias("links")), "key", "left")
    linked = scratch.keep(linked.join(classes.select("key", F.col("first.doc").alias("doc")), "key").select("key", "component", "links", "doc"))
    lowest = linked.groupBy("component").agg(F.min("doc").alias("low"))
    linked = linked.join(lowest, "component").select("key", "low", "links", "component")
    classes = classes.select("key", F.col("first.doc").alias("own"), "many").join(linked, "key", "left")
    n_links = F.coalesce("links", F.lit(0)) + F.col("many") - 1
    classes = scratch.keep(classes.select("key", F.coalesce("low", "own").alias("class_id"), n_links.alias("n_links"), F.coalesce("component", "key").alias("group")))
    scratch.drop(meeting, candidates, blocks, members, verified)
    out = described.select("doc", "print", "key").join(classes, "key", "left")
    return out.select(F.col("doc").alias(id_col), F.when(F.col("key").isNull(), F.col("doc")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), *([F.col("print"), F.col("group")] if with_group else []))


def one_of_each(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``documents`` with one of each group of near copies: the one with the smallest id.

    Rows without words are no copies of one another and all stay. Repeated rows count once. Null ids sort
    last. All columns are kept, whatever their names. An empty table stays empty.
    """
    found = Scratch(documents.sparkSession, "near-dup-groups").keep(near_duplicates(documents, id_col, text_col, with_group=True, **how).withColumnRenamed(id_col, "doc"))
    grouped = found.where("group is not null").groupBy("group").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "print")).alias("first"))
    stay = grouped.select("first.doc", "first.print").unionByName(found.where("group is null").select("doc", "print").distinct())
    stay = stay.select(F.col("doc").alias("stay_doc"), F.col("print").alias("stay_print"))
    mark, doc, print_ = (free(n, documents.columns) for n in ("mark", "stay_doc", "stay_print"))
    marked = documents.withColumn(mark, F.xxhash64(F.col(quoted(text_col))))
    kept = marked.join(stay.select(F.col("stay_doc").alias(doc), F.col("stay_print").alias(print_)), F.col(mark).eqNullSafe(F.col(print_)) & F.col(quoted(id_col)).eqNullSafe(F.col(doc)), "left_semi")
    if found.groupBy("doc", "print").count().where("count > 1").limit(1).count():  # only then does a second shuffle of the texts pay
        kept = kept.dropDuplicates([mark, id_col])
    return kept.select(*[F.col(quoted(c)) for c in documents.columns])
