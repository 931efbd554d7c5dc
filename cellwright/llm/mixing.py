"""Mixing sources to target weights by Poisson replication.

Each row is repeated k times, k from a Poisson distribution whose mean is its source's target rate:
target share x rows wanted / rows the source has. The distribution is inverted at a number hashed
from the row's id, its text and a seed, so a row's count never depends on partitions or reruns. The
copies are exploded and dealt out by a hash, then sorted by another: one global shuffle.

Sources are counted with partial sums. Each source's distribution is a table of sums that is made
once; a row only counts the sums up to its number. The tables are joined by broadcast while they have
at most ``BROADCAST_TERMS`` numbers together, and by a shuffle, whose hot sources Spark splits,
beyond. A null source is a source of its own. Sources without a weight get weight ``other``; weights of
sources that have no rows count for nothing. Rows with a null id or text are drawn like others; equal
rows (same id and text) get the same count each. An empty table stays empty. Columns of any name are
kept as they are; where one is called ``copy`` or ``shuffle_key``, the added one is called ``copy_2``
or ``shuffle_key_2``, and so on.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Scratch, bound, free, partitions, quoted

BROADCAST_TERMS = 500_000
#: Rates above it are inverted from a term near the mean.
LARGE = 500.0


def uniform(seed: int, *columns: Column) -> Column:
    """A number in [0, 1) from an MD5 of the seed and the columns: its first 52 bits."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def distributions(rates: DataFrame) -> DataFrame:
    """(source, low, sums) of (source, rate): ``sums`` are P(X <= k) of a Poisson X for k from ``low`` on.

    Terms run until none can matter for the rate. From ``LARGE`` on, where exp(-rate) nears the end of
    the doubles, they start 12 deviations below the mean: at the logarithm of that term, by Stirling's
    series, which has all digits there; what lies below is under 1e-30. Each further term adds the
    logarithm of rate / k.
    """
    rate, low, k = F.col("rate"), F.col("low"), F.col("k")
    spread = F.lit(12.0) * F.sqrt(rate) + 30
    at = rates.select("source", "rate", F.when(rate > LARGE, F.floor(rate - spread)).otherwise(0).cast("int").alias("low"), F.ceil(rate + spread).cast("int").alias("high"))
    gap = rate - low
    series = 1 / (12.0 * low) - 1 / (360.0 * F.pow(low, F.lit(3))) + 1 / (1260.0 * F.pow(low, F.lit(5)))
    begin = F.when(low > 0, low * F.log1p(gap / F.nullif(low, F.lit(0))) - gap - 0.5 * F.log(2 * math.pi * low) - F.when(low > 0, series)).otherwise(-rate)
    terms = at.select("source", "rate", "low", begin.alias("begin"), F.explode(F.sequence("low", "high")).alias("k"))
    upward = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    steps = terms.withColumn("log", F.col("begin") + F.sum(F.when(k > low, F.log(rate / k)).otherwise(0.0)).over(upward))
    sums = steps.select("source", "low", "k", F.sum(F.exp("log")).over(upward).alias("sum"))
    lists = sums.groupBy("source", "low").agg(F.array_sort(F.collect_list(F.struct("k", "sum"))).alias("s"))
    return lists.select("source", "low", F.transform("s", lambda x: x["sum"]).alias("sums"))


def draw(u: Column, low: Column, sums: Column) -> Column:
    """The smallest k with P(X <= k) > u."""
    return low + F.size(F.filter(sums, lambda c: c <= u))


def rates(documents: DataFrame, weights: dict[str | None, float] | None, total: float | None, other: float, source_col: str) -> DataFrame:
    """(source, rate). Without weights every source has the same; without a total, as many rows as there are."""
    counts = documents.groupBy(F.col(quoted(source_col)).alias("source")).agg(F.count("*").alias("rows_there"))
    weight = F.lit(other)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    counts = counts.withColumn("weight", weight)
    sums = counts.agg(F.sum("weight").alias("w"), F.sum("rows_there").alias("n")).first()
    wanted = float(sums["n"] or 0) if total is None else total
    return counts.select("source", (F.col("weight") / F.lit(float(sums["w"] or 1)) * F.lit(wanted) / F.col("rows_there")).alias("rate"))


def mix(documents: DataFrame, weights: dict[str | None, float] | None = None, total: float | None = None, other: float = 1.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``documents``, each as often as drawn, plus ``copy`` (from 1) and ``shuffle_key``, in shuffled order."""
    scratch, own = Scratch(documents.sparkSession, "mix"), documents.columns
    table = scratch.keep(distributions(rates(documents, weights, total, other, source_col)))
    terms = table.agg(F.sum(F.size("sums"))).first()[0] or 0
    copy, key = free("copy", own), free("shuffle_key", own)
    source, low, sums, print_ = (free(n, [*own, copy, key]) for n in ("mix_source", "mix_low", "mix_sums", "mix_print"))
    table = table.select(F.col("source").alias(source), F.col("low").alias(low), F.col("sums").alias(sums))
    joined = documents.join(F.broadcast(table) if terms <= BROADCAST_TERMS else table, F.col(quoted(source_col)).eqNullSafe(F.col(source)))
    joined = joined.withColumn(print_, F.md5(F.coalesce(F.col(quoted(text_col)), F.lit(""))))
    id_, given = F.col(quoted(id_col)), [F.col(quoted(c)) for c in own]
    times = bound(uniform(seed, id_, F.col(print_)), lambda u: draw(u, F.col(low), F.col(sums)))
    each = joined.select(*given, print_, F.explode(bound(times, lambda n: F.when(n > 0, F.sequence(F.lit(1), n)))).alias(copy))
    keyed = each.select(*given, copy, uniform(seed + 1, id_, F.col(print_), F.col(copy)).alias(key))
    return keyed.repartition(partitions(documents.sparkSession), F.xxhash64(key)).sortWithinPartitions(key, id_, copy)
