"""A training corpus from ``documents``: five stages, each over all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cellwright.llm import decontam, mixing, near_dup, tokens, toxicity
from cellwright.llm.queries import table, tokenizer_path, toxic_model
from cellwright.llm.shared import Scratch

REJECT_FROM = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity model rejects go. It learns from labels of rows still there."""
    return toxicity.reject(docs, toxic_model(docs, table(spark, sf_dir, "labels")), REJECT_FROM)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dup.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def balance_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Equal shares of all sources, by repetition; a row stands as often as drawn."""
    return mixing.mix(docs).select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Wavelet-matrix shards of all token ids; returned is what they hold of each document."""
    path = Scratch(spark, "tokens").path()
    tokens.write_shards(docs, path, tokenizer_path())
    return tokens.read_shards(spark, path)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", balance_sources),
    ("tokens", write_tokens),
]

#: Trained scores and token ids are beyond SQL; tests/llm holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if i + 1 == len(STAGES) else scratch.keep(out)
    return docs
