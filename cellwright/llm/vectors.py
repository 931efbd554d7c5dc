"""Exact top-k search by inner product over a pivot-distance index.

Largest inner products are nearest neighbours once every vector gets one more component that makes
all norms equal: |q' - x'|^2 = |q|^2 + M^2 - 2 q.x. Each vector is keyed by its nearest pivot and its
distance to it; a pivot's vectors fall into annuli of about equal counts. By the triangle inequality
no vector of an annulus is nearer to a query than the gap between the query's distance to the pivot
and the annulus.

A search has two rounds. Queries first meet a part of their own annulus, which bounds the k-th best
score from below. Then each goes outwards through the annuli whose gap is within the radius of that
bound and stops there: what lies further can't be among its k best. Scores are integers throughout;
the bounds have slack for rounding.

Pivots come from a bounded sample (``SAMPLE`` rows by a hash of the id); every row is indexed. Pivots
and annuli grow with the square root of the number of rows, from ``LEAST`` to ``MOST`` each, so that an
annulus stays near ``CHUNK`` vectors up to a quarter of a billion rows, and their bounds, at most
``MOST ** 2`` of them, small enough to hand to all tasks. An annulus is stored in chunks of about
``CHUNK`` vectors, dealt by a hash of the id and the vector, so that neither a vector that a third of
all rows share nor an id that does fills one. Queries are a stated set; they run in blocks against the
chunks.

Vectors that are null, or hold a null or a non-finite component (also one that 64 times it is), take no
part, neither do null ids. Shorter vectors count as padded with zeros. Scores are exact at any size:
where doubles could round, Python's integers take over; a score beyond 64 bits is given as the nearest
64-bit one. Repeated ids are each a candidate (but not of their own id); a query id on several rows
asks with all of them, and the best k of all their scores come under that id, a candidate once for each
row that it meets. Fewer candidates than k give them all; no query or no candidate gives no rows. Columns
other than the id and the vector are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Scratch, partitions, quoted

#: Pivots, and annuli of each.
LEAST, MOST = 8, 256
SAMPLE = 4096
CHUNK = 4096
BLOCK = 256
LOW, HIGH = -(2**63), 2**63 - 1


def grid(n: int, chunk: int = CHUNK) -> int:
    """Pivots, and annuli of each, for n rows."""
    return min(max(LEAST, math.ceil(math.sqrt(n / chunk))), MOST)


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(vec_id, v, most) of the rows that take part, v the components as whole doubles, most the largest magnitude; and the longest length."""
    rows = vectors.select(F.col(quoted(id_col)).cast("long").alias("vec_id"), F.transform(F.col(quoted(vector_col)), lambda x: 64 * x.cast("double")).alias("e"))
    rows = rows.where("vec_id is not null and e is not null").where(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    size = int(rows.agg(F.max(F.size("e")).alias("n")).first()["n"] or 0)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            length = np.diff(lists.offsets.to_numpy())
            dense = np.zeros((len(length), max(size, 1)))
            dense[np.repeat(np.arange(len(length)), length), np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)] = np.floor(lists.flatten().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in dense + 0.0], pa.binary()), pa.array(np.abs(dense).max(1))], ["vec_id", "v", "most"])

    return rows.mapInArrow(pack, "vec_id long, v binary, most double"), max(size, 1)


def unpack(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, size)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole vectors as 64-bit integers, exact.

    All partial sums of a product are within the product of the norms; below 2**53 a double holds them.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        a, b = (np.nan_to_num(np.sqrt((m * m).sum(1)), nan=np.inf) * (1 + 1e-12) for m in (q, x))
        large = ~(np.outer(a, b) < 2.0**53)
        out = np.where(large, 0, q @ x.T).astype(np.int64)
    for i in np.flatnonzero(large.any(1)):
        own = [int(c) for c in q[i]]
        for j in np.flatnonzero(large[i]):
            out[i, j] = min(max(sum(c * int(d) for c, d in zip(own, x[j].tolist(), strict=True)), LOW), HIGH)
    return out


class Layout:
    """Pivots in the lengthened space, and the distances that part each pivot's annuli.

    Lengths are in units of the largest component, so that no square leaves the doubles.
    """

    def __init__(self, unit: float, most: float):
        self.unit, self.most = unit, most
        self.pivots, self.edges = np.zeros((0, 1)), np.zeros((0, 0))
        #: What rounding can add to a distance.
        self.slack = 1e-6 * (math.sqrt(most) + 1 / unit)

    def distances(self, rows: np.ndarray, query: bool = False) -> np.ndarray:
        rows = rows / self.unit
        square = (rows * rows).sum(1)
        last = np.zeros(len(rows)) if query else np.sqrt(np.maximum(self.most - square, 0))
        whole = square + last * last
        product = rows @ self.pivots[:, :-1].T + np.outer(last, self.pivots[:, -1])
        return np.sqrt(np.maximum(whole[:, None] + (self.pivots**2).sum(1) - 2 * product, 0))

    def annulus(self, pivot: np.ndarray, distance: np.ndarray) -> np.ndarray:
        return (self.edges[pivot] < distance[:, None]).sum(1)

    def radius(self, queries: np.ndarray, floors: np.ndarray) -> np.ndarray:
        """How far a vector that reaches the floor can be from each query; without a floor, any distance."""
        rows = queries / self.unit
        reach = np.sqrt(np.maximum((rows * rows).sum(1) + self.most - 2 * (floors.astype(np.float64) / self.unit / self.unit), 0)) * (1 + 1e-9) + 2 * self.slack
        return np.where((floors == LOW) | (floors == HIGH), np.inf, reach)  # a floor at the end of 64 bits says nothing about distances


def choose_pivots(rows: np.ndarray, most: float, n: int) -> np.ndarray:
    """Farthest-first from the sample, then three rounds of means."""
    whole = np.column_stack((rows, np.sqrt(np.maximum(most - (rows * rows).sum(1), 0))))
    chosen, gap = [0], ((whole - whole[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(rows)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((whole - whole[chosen[-1]]) ** 2).sum(1))
    pivots = whole[chosen]
    for _ in range(3):
        near = (((pivots**2).sum(1))[None, :] - 2 * whole @ pivots.T).argmin(1)
        pivots = np.array([whole[near == p].mean(0) if (near == p).any() else pivots[p] for p in range(len(pivots))])
    return pivots


def top(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each query's k best candidates that reach its floor; ties to the smaller id. All integers."""
    ok = (scores >= floor[:, None]) & (ids[None, :] != own[:, None])
    row, column = np.nonzero(ok)
    order = np.lexsort((ids[column], ~scores[row, column], row))  # ~x falls as x rises, and fits 64 bits
    row, column = row[order], column[order]
    first = np.searchsorted(row, np.arange(len(own)))
    keep = np.arange(len(row)) - first[row] < k
    return row[keep], column[keep]


def packed(rows: DataFrame, names: list[str], most: int) -> DataFrame:
    """Runs of sorted rows (vec_id, v and equal ``names``) as one row of at most ``most``: names, n, ids, vectors, number.

    The number is the partition and the place in it: unlike ids, which may repeat, no two rows share it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, number = [], None, TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            ids = np.array([h[0] for h in held], "<i8").tobytes()
            values = [*key, len(held), ids, b"".join(h[1] for h in held), number]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [pa.int32()] * len(names) + [pa.int32(), pa.binary(), pa.binary(), pa.int64()], strict=True)], [*names, "n", "ids", "vectors", "number"])

        for batch in batches:
            keys = list(zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True))
            for k, i, v in zip(keys, batch.column(batch.schema.get_field_index("vec_id")).to_pylist(), batch.column(batch.schema.get_field_index("v")).to_pylist(), strict=True):
                if held and (k != key or len(held) >= most):
                    yield flush()
                    held, number = [], number + 1
                key = k
                held.append((i, v))
        if held:
            yield flush()

    return rows.mapInArrow(run, ", ".join(f"{n} int" for n in names) + ", n int, ids binary, vectors binary, number long")


def top_k(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int | None = None, annuli: int | None = None, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of every query's k best candidates. ``is_query``: from the id column to a condition."""
    found = visits(vectors, is_query, k, id_col, vector_col, pivots, annuli, chunk, block)
    result = "query_id long, rank int, vec_id long, score long"
    if found is None:
        return vectors.sparkSession.createDataFrame([], result)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found[0].withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def visits(vectors: DataFrame, is_query, k: int, id_col: str, vector_col: str, pivots: int | None = None, annuli: int | None = None, chunk: int = CHUNK, block: int = BLOCK) -> tuple[DataFrame, DataFrame, int] | None:
    """The best of each chunk that a query has to visit (query_id, vec_id, score); the visits (cell, queries, vectors there); the number of rows."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    rows, width = quantised(vectors, id_col, vector_col)
    rows = scratch.keep(rows)
    found = rows.agg(F.max("most").alias("m"), F.count("*").alias("n")).first()
    if not found["n"]:
        return None
    pivots, annuli, unit = pivots or grid(found["n"], chunk), annuli or grid(found["n"], chunk), max(found["m"], 1.0)

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([((unpack(batch.column(0), width) / unit) ** 2).sum(1).max()])], ["square"])

    layout = Layout(unit, rows.select("v").mapInArrow(squares, "square double").agg(F.max("square")).first()[0])
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).select("v").toArrow().column(0)
    layout.pivots = choose_pivots(unpack(sample, width) / unit, layout.most, pivots)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                distance = layout.distances(unpack(batch.column(1), width))
                near = distance.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32)), pa.array(distance[np.arange(len(near)), near])], ["vec_id", "v", "pivot", "distance"])

    keyed = scratch.keep(rows.select("vec_id", "v").mapInArrow(key, "vec_id long, v binary, pivot int, distance double"))
    parts = [i / annuli for i in range(1, annuli)]
    layout.edges = np.full((len(layout.pivots), annuli - 1), np.inf)
    if annuli > 1:
        for r in keyed.groupBy("pivot").agg(F.percentile_approx("distance", parts, 1000).alias("at")).collect():  # a row a pivot
            layout.edges[r["pivot"]] = r["at"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                pivot = batch.column(2).to_numpy()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((pivot * annuli + layout.annulus(pivot, batch.column(3).to_numpy())).astype(np.int32))], [*batch.schema.names, "cell"])

    celled = keyed.mapInArrow(place, "vec_id long, v binary, pivot int, distance double, cell int")
    cells = celled.groupBy("cell").agg(F.min("distance").alias("low"), F.max("distance").alias("high"), F.count("*").alias("n")).orderBy("cell").collect()  # pivots x annuli rows at most
    number, low, high = np.array([c["cell"] for c in cells], np.int32), np.array([c["low"] for c in cells]), np.array([c["high"] for c in cells])
    pivot_of = number // annuli
    n_chunks = spark.createDataFrame([(c["cell"], -(-c["n"] // chunk)) for c in cells], "cell int, n_chunks long")
    dealt = celled.select("vec_id", "v", "cell").join(F.broadcast(n_chunks), "cell").withColumn("chunk", F.pmod(F.xxhash64("vec_id", "v", F.monotonically_increasing_id()), "n_chunks").cast("int"))
    chunks = scratch.keep(packed(dealt.repartition(partitions(spark), "cell", "chunk").sortWithinPartitions("cell", "chunk"), ["cell", "chunk"], 2 * chunk))
    asked = celled.where(is_query(F.col("vec_id"))).select("vec_id", "v", "pivot", "cell")
    asked = asked.repartition(partitions(spark), "pivot", F.pmod(F.xxhash64("vec_id", "v"), F.lit(64))).sortWithinPartitions("pivot", "cell")
    blocks = scratch.keep(packed(asked.select("vec_id", "v", "pivot"), ["pivot"], block))

    def gaps(queries: np.ndarray) -> np.ndarray:
        """How near any vector of each cell can be to each query."""
        distance = layout.distances(queries, query=True)[:, pivot_of]
        return np.maximum(np.maximum(low - distance, distance - high), 0)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, blob in zip(batch.column("ids").to_pylist(), batch.column("vectors").to_pylist(), strict=True):
                for c in np.unique(gaps(np.frombuffer(blob, "<f8").reshape(-1, width)).argmin(1)):
                    yield pa.RecordBatch.from_arrays([pa.array([ids], pa.binary()), pa.array([blob], pa.binary()), pa.array([number[c]])], ["qids", "queries", "cell"])

    def score(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    get = lambda n, kind: np.frombuffer(batch.column(n)[i].as_py(), kind)  # noqa: B023, E731
                    own, q = get("qids", "<i8"), get("queries", "<f8").reshape(-1, width)
                    ids, x = get("ids", "<i8"), get("vectors", "<f8").reshape(-1, width)
                    floor = np.full(len(own), LOW) if first else get("floors", "<i8")
                    scores = products(q, x)
                    a, b = top(scores, ids, own, k, floor)
                    if first:  # the k-th best, where there are k
                        full = np.bincount(a, minlength=len(own)) == k
                        worst = np.full(len(own), HIGH)
                        np.minimum.at(worst, a, scores[a, b])
                        yield pa.RecordBatch.from_arrays([pa.array(own[full]), pa.array(worst[full])], ["query_id", "floor"])
                    else:
                        yield pa.RecordBatch.from_arrays([pa.array(own[a]), pa.array(ids[b]), pa.array(scores[a, b])], ["query_id", "vec_id", "score"])

        return run

    met = blocks.mapInArrow(home, "qids binary, queries binary, cell int")
    floors = met.join(chunks.where("chunk = 0").select("cell", "ids", "vectors"), "cell").mapInArrow(score(True), "query_id long, floor long").groupBy("query_id").agg(F.max("floor").alias("floor"))
    # floors go back to their blocks: one row per query, gathered by block
    numbered = blocks.select(F.col("number").alias("b"), "ids", "vectors")

    def split_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, ids in zip(batch.column("b").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                own = np.frombuffer(ids, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), b)), pa.array(np.arange(len(own))), pa.array(own)], ["b", "i", "query_id"])

    placed = numbered.select("b", "ids").mapInArrow(split_ids, "b long, i long, query_id long").join(floors, "query_id", "left")
    gathered = placed.groupBy("b").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "floor"))), lambda s: F.coalesce(s["floor"], F.lit(LOW))).alias("floors"))
    ready = numbered.join(gathered, "b")

    def outwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, blob, floor in zip(batch.column("ids").to_pylist(), batch.column("vectors").to_pylist(), batch.column("floors").to_pylist(), strict=True):
                q, floor = np.frombuffer(blob, "<f8").reshape(-1, width), np.array(floor, "<i8")
                near = gaps(q) <= layout.radius(q, floor)[:, None]
                for c in np.flatnonzero(near.any(0)):
                    some = near[:, c]
                    yield pa.RecordBatch.from_arrays([pa.array([np.frombuffer(ids, "<i8")[some].tobytes()], pa.binary()), pa.array([q[some].tobytes()], pa.binary()), pa.array([floor[some].tobytes()], pa.binary()), pa.array([number[c]])], ["qids", "queries", "floors", "cell"])

    work = ready.select("ids", "vectors", "floors").mapInArrow(outwards, "qids binary, queries binary, floors binary, cell int")
    pairs = work.join(chunks.select("cell", "n", "ids", "vectors"), "cell")
    scored = pairs.select("qids", "queries", "floors", "ids", "vectors").mapInArrow(score(False), "query_id long, vec_id long, score long")
    return scored, pairs.select("cell", (F.length("qids") / 8).cast("long").alias("queries"), "n"), found["n"]


def share_visited(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", **how) -> float:
    """The share of all pairs of a query and a row that the index doesn't rule out."""
    found = visits(vectors, is_query, k, id_col, vector_col, **how)
    if found is None:
        return 0.0
    asked = vectors.where(F.col(quoted(id_col)).isNotNull()).where(is_query(F.col(quoted(id_col)))).count()
    return float(found[1].agg(F.sum(F.col("queries") * F.col("n"))).first()[0] or 0) / max(asked * found[2], 1)
