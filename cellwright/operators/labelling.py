"""Labels from responses of a language model, or from deterministic rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The first block of labels in a response.
BLOCK = r'(\{\s*"labels"\s*:\s*\[[\s\S]*?\]\s*\})'
TRUE, FALSE = ["true", "t", "yes", "y", "on", "1", "1.0"], ["false", "f", "no", "n", "off", "0", "0.0"]


def extract_block(response: Column) -> Column:
    """The label block, or the stripped response if there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(response, BLOCK, 1), F.lit("")), F.trim(response))


def parse_labels(responses: DataFrame, response: str = "response") -> DataFrame:
    """Adds ``pos``, ``label_row``, ``is_error`` for each label. A response with one bad label has none.

    Numbers and truth values may come as text, as a lenient reader would take them.
    """
    read = F.from_json(extract_block(F.col(response)), "labels array<struct<row_id:string,is_error:string>>")["labels"]
    flag = lambda x: F.when(F.lower(x).isin(TRUE), True).when(F.lower(x).isin(FALSE), False)
    whole = lambda x: F.when(x.rlike(r"^\s*[+-]?\d+(\.0*)?\s*$"), F.regexp_replace(F.trim(x), r"\.0*$", "").try_cast("bigint"))
    typed = F.transform(read, lambda l: F.struct(whole(l["row_id"]).alias("label_row"), flag(l["is_error"]).alias("is_error")))
    good = responses.withColumn("_l", typed).where(F.col("_l").isNotNull() & F.forall("_l", lambda l: l["label_row"].isNotNull() & l["is_error"].isNotNull()))
    return good.select("*", F.posexplode("_l").alias("pos", "_x")).select(*responses.columns, "pos", "_x.label_row", "_x.is_error")


def settle_labels(labels: DataFrame, known: DataFrame, key: str, by: list[str] | None = None, order: tuple[str, ...] = ("batch", "pos")) -> DataFrame:
    """(by..., key, is_error): labels of known rows only, the last one of each row."""
    by = by or []
    ids = known.select(*by, F.col(key).alias("label_row")).distinct()
    mine = labels.join(ids, [*by, "label_row"], "left_semi")
    return mine.groupBy(*by, "label_row").agg(F.max_by("is_error", F.struct(*order)).alias("is_error")).withColumnRenamed("label_row", key)


def rule_violation(value: Column, data_type: str | None = None, pattern: str | None = None, allowed: list[str] | None = None, nullable: bool = False) -> Column:
    """True where a cell breaks its rule. Types: integer, float, boolean, datetime; others are free."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    checks = {"integer": r"^[+-]?\d+$", "float": r"^[+-]?(\d+(\.\d*)?|\.\d+)$", "boolean": r"^(?i:true|false)$", "datetime": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"}
    bad = F.lit(False)
    if data_type in checks:
        bad = bad | ~text.rlike(checks[data_type])
    if pattern:
        bad = bad | ~text.rlike(pattern)
    if allowed:
        bad = bad | ~text.isin(allowed)
    return F.when(text == "", F.lit(not nullable)).otherwise(bad)


def label_by_rules(df: DataFrame, rules: dict[str, dict], key: str) -> DataFrame:
    """(key, column, is_error) for every column that has a rule (the keywords of ``rule_violation``)."""
    each = F.array(*[F.struct(F.lit(c).alias("column"), rule_violation(F.col(c), **r).alias("is_error")) for c, r in rules.items()])
    return df.select(key, F.explode(each).alias("e")).select(key, "e.column", "e.is_error")
