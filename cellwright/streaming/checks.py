"""Statistics and rule checks of cells as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import basic_features
from ..operators.labelling import rule_violation


def basic_stream(stream: DataFrame, column: str) -> DataFrame:
    return stream.select("*", *[c.alias(n) for n, c in basic_features(F.col(column)).items()])


def violations_stream(stream: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """The rows plus ``violations``: names of the columns that break their rule."""
    hits = F.array(*[F.when(rule_violation(F.col(c), **r), F.lit(c)) for c, r in rules.items()])
    return stream.withColumn("violations", F.array_compact(hits))


def violation_rates(stream: DataFrame, rules: dict[str, dict], time_col: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, column, n, n_errors) per time window, with a watermark. Times without a zone are read in the session's."""
    timed = stream.withColumn(time_col, F.col(time_col).cast("timestamp"))
    each = violations_stream(timed, rules).withWatermark(time_col, late)
    names = F.array(*[F.lit(c) for c in rules])
    rows = each.select(time_col, "violations", F.explode(names).alias("column"))
    return rows.groupBy(F.window(time_col, window), "column").agg(F.count("*").alias("n"), F.sum(F.array_contains("violations", F.col("column")).cast("long")).alias("n_errors"))
