"""Few-shot examples, chosen by a seeded hash so that a rerun chooses the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def select_few_shot(dirty: DataFrame, clean: DataFrame, column: str, key: str, k: int = 2, strategy: str = "balanced", seed: int = 42) -> DataFrame:
    """Rows of ``dirty`` with ``clean_value``, at most k.

    None if k is not between 1 and the number of rows. ``balanced``: errors first, then clean rows, as
    far as there are any. ``diverse``: one row of each distinct value (null is one), then others.
    Anything else: any rows. Order within each: MD5 of key and seed.
    """
    if k <= 0 or k > dirty.count():
        return dirty.withColumn("clean_value", F.lit(None).cast("string")).where("false")
    rows = dirty.join(clean.select(key, F.col(column).alias("clean_value")), key)
    rows = rows.withColumn("_h", F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}"))))
    if strategy == "balanced":
        group = F.when(F.coalesce(F.col(column) != F.col("clean_value"), F.lit(True)), 0).otherwise(1)
    elif strategy == "diverse":
        first = F.row_number().over(Window.partitionBy(column).orderBy("_h", key))
        group = F.when(first == 1, 0).otherwise(1)
    else:
        group = F.lit(0)
    return rows.withColumn("_g", group).orderBy("_g", "_h", key).limit(k).drop("_g", "_h")
