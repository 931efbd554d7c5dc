"""Expressions over arrays of numbers."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def linspace(low: float, high: float, n: int) -> list[float]:
    return [low] if n == 1 else [low + (high - low) * i / (n - 1) for i in range(n)]


def known(value: object, kind: str) -> Column:
    """Numbers, texts or lists of them as one literal once the plan is optimised, not as an expression each."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def digitize(x: Column, edges: Column) -> Column:
    """Number of the bin whose lower edge is the last one not above x; at least 0."""
    return F.greatest(F.size(F.filter(edges, lambda e: e <= x)) - 1, F.lit(0))


def distance(a: Column, b: Column) -> Column:
    """Euclidean, rounded to nine digits so that ties break by identity and not by noise."""
    return F.round(F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)), 9)


def safe_ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
