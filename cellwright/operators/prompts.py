"""Prompts for labelling cells: templates, rows and batches as columns, assembled by expressions."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# The prompt's parts, word for word, in the order they are joined.
TEMPLATES = {
    "error_detection": {
        "system_prompt": "You are an error detection assistant. Respond ONLY in valid JSON.\n",
        "base_instruction": (
            "Instructions:\n"
            "- You are given a list of data rows extracted from a dataset, where the target column named `{column_name}`. Label each value from the target column as either an error or not an error. An error could be a typo or a formatting issue.\n"
            "- Only evaluate the `{column_name}` value.\n"
            "- Only label values you are confident about. If you are not sure, do not label it as an error.\n"
        ),
        "rule_instruction": "- If value does not follow the rules, label it as an error.\n\n\nRules for column '{column}':\n{rules}\n",
        "fewshot_template": "\n\nHere are some examples:\n\n{examples}\n",
        "example_template": "Example {example_num}:\nRow: {row_data}\nColumn: {column}\nOriginal value: {original_value}\nCorrected value: {clean_value}\n",
        "input_template": "Input:\n{data_json}\n",
        "output_template": '\nPlease fill in the "is_error" field (either `true` or `false`) in the following JSON template:\n{output_json}\n',
    }
}


class PromptManager:
    """Templates by category and name; from a JSON or YAML file, if one is given."""

    def __init__(self, path: str | None = None):
        self.path = path
        self.reload()

    def reload(self) -> None:
        self.templates = TEMPLATES if self.path is None else read_config(self.path)["prompts"]

    def get(self, category: str, name: str) -> str:
        if category not in self.templates or name not in self.templates[category]:
            raise KeyError(f"{category}.{name}")
        return self.templates[category][name]

    def prompt(self, column: str, data_json: Column, label_json: Column, rules: Column | None = None, examples: Column | None = None) -> Column:
        """The whole prompt: system, instructions, rules if there are any, examples if there are any, input, output."""
        t = lambda name, **values: filled_in(self.get("error_detection", name), values)
        parts = [t("system_prompt"), t("base_instruction", column_name=column)]
        if rules is not None:
            parts.append(F.coalesce(t("rule_instruction", column=column, rules=rules), F.lit("")))
        if examples is not None:
            parts.append(F.coalesce(t("fewshot_template", examples=examples), F.lit("")))
        return F.concat(*parts, t("input_template", data_json=data_json, column_name=column), t("output_template", output_json=label_json))

    def examples(self, rows: DataFrame, column: str, key: str) -> str | None:
        """The few-shot block of at most a few chosen rows (gathered by the driver); None without rows.

        A row's cells stand as Python prints a dict, as models were shown them before.
        """
        template, out = self.get("error_detection", "example_template"), []
        for i, r in enumerate(rows.collect(), 1):
            row = {k: v for k, v in r.asDict().items() if k not in ("clean_value", key)}
            values = {"example_num": i, "row_data": row, "column": column, "original_value": r[column], "clean_value": r["clean_value"]}
            out.append(PLACE.sub(lambda m, v=values: str(v[m[1]]), template) + "\n\n")
        return "".join(out) or None


PLACE = re.compile(r"\{(\w+)\}")


def filled_in(template: str, values: dict[str, Column | str]) -> Column:
    """The template with its places filled, in one pass: braces within a value stay as they are."""
    pieces = PLACE.split(template)  # text and names in turn
    put = [values[x] if i % 2 else x for i, x in enumerate(pieces)]
    return F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in put if isinstance(x, Column) or x])


def rule_text(rule: dict, fields: list[str]) -> str:
    """A column's rule as Python prints its dict, without the name; what it lacks and another rule has is ``nan``."""
    return str({f: float("nan") if rule.get(f) is None else rule[f] for f in fields if f != "name"})


def read_config(path: str) -> dict:
    """A missing file is a FileNotFoundError, one that can't be read a ValueError."""
    text = Path(path).read_text()
    try:
        if path.endswith((".yaml", ".yml")):
            import yaml

            return yaml.safe_load(text)
        return json.loads(text)
    except ImportError:
        raise
    except Exception as e:
        raise ValueError(f"{path}: {e}") from e


@dataclass(frozen=True)
class Strategy:
    """ZS-I: no rules, ZS-R: rules; V: the value alone, A: related columns too. Of each pair the last named wins."""

    rules: bool = True
    related: bool = False
    fewshot: int = 0

    @classmethod
    def of(cls, names: list[str], fewshot: int = 0) -> Strategy:
        rules, related = True, False
        for n in names:
            if n not in ("ZS-I", "ZS-R", "V", "A"):
                raise ValueError(f"unknown strategy {n}")
            rules = n == "ZS-R" if n.startswith("ZS") else rules
            related = n == "A" if n in "VA" else related
        return cls(rules, related, fewshot)


def sample_rows(df: DataFrame, columns: list[str], ids: DataFrame, key: str) -> DataFrame:
    """(key, chosen columns, row_id last) of the rows named in ``ids``; a column called row_id gives way to the id."""
    kept = df.join(ids.select(key).distinct(), key, "left_semi")
    return kept.select(*[c for c in columns if c != "row_id"], F.col(key).alias("row_id"))


def batches(rows: DataFrame, order: str, size: int) -> DataFrame:
    """Adds ``batch`` from 0, in order. For rows of representatives, k a column; their number is bounded."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.orderBy(order)) - 1) / size).cast("long"))


def json_text(value: Column) -> Column:
    """A string as JSON, with what lies beyond ASCII as it is."""
    out = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for i in range(32):
        out = F.replace(out, F.lit(chr(i)), F.lit(json.dumps(chr(i))[1:-1]))
    return F.concat(F.lit('"'), out, F.lit('"'))


def json_value(df: DataFrame, column: str) -> Column:
    """A cell as JSON: null, a bare number or truth value, else a string."""
    kind, c = df.schema[column].dataType, F.col(column)
    bare = isinstance(kind, T.BooleanType) or isinstance(kind, T.NumericType)
    return F.coalesce(c.cast("string") if bare else json_text(c.cast("string")), F.lit("null"))


def json_object(fields: list[tuple[str, Column]], indent: int) -> Column:
    """One object, a field a line, indented by two blanks more than its braces."""
    inner, outer = "\n" + " " * (indent + 2), "\n" + " " * indent
    each = [x for i, (name, value) in enumerate(fields) for x in (F.lit(("," if i else "") + inner + json.dumps(name, ensure_ascii=False) + ": "), value)]
    return F.concat(F.lit("{"), *each, F.lit(outer + "}"))


def batch_documents(rows: DataFrame, columns: list[str], key: str, size: int) -> DataFrame:
    """(batch, ids, data_json, label_json): the rows of each batch as JSON, and the answer to fill in; two blanks a level."""
    number = json_value(rows, key)
    doc = json_object([(c, json_value(rows, c)) for c in columns if c != "row_id"] + [("row_id", number)], 2)
    blank = json_object([("row_id", number), ("is_error", F.lit("null"))], 4)
    each = batches(rows, key, size).select("batch", F.struct(F.col(key).alias("id"), doc.alias("doc"), blank.alias("blank")).alias("r"))
    gathered = each.groupBy("batch").agg(F.array_sort(F.collect_list("r")).alias("r"))
    inside = lambda field, indent: F.array_join(F.transform("r", lambda r: F.concat(F.lit(" " * indent), r[field])), ",\n")
    return gathered.select(
        "batch",
        F.transform("r", lambda r: r["id"]).alias("ids"),
        F.concat(F.lit("[\n"), inside("doc", 2), F.lit("\n]")).alias("data_json"),
        F.concat(F.lit('{\n  "labels": [\n'), inside("blank", 4), F.lit("\n  ]\n}")).alias("label_json"),
    )
