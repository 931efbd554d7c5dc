"""What the operators share: scratch tables, names, the number of partitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import Scratch, clear

__all__ = ["Scratch", "bound", "clear", "free", "partitions", "quoted"]


def quoted(name: str) -> str:
    """The name as a reference, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def free(name: str, taken: list[str]) -> str:
    """The name, or the first of ``name_2``, ``name_3``, ... that isn't taken; letter case doesn't tell names apart."""
    have, i, out = {t.lower() for t in taken}, 1, name
    while out.lower() in have:
        i += 1
        out = f"{name}_{i}"
    return out


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it stands there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
