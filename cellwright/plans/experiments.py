"""Runs over datasets, and the command line."""

from __future__ import annotations

import argparse
import logging
import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clients, fewshot, labelling, metrics, prompts
from ..operators.clustering import Clusterer, LabelPropagator
from ..operators.dependencies import nmi_matrix, top_relations
from ..operators.features import dataset_features
from ..operators.profile import preprocess_dataset
from ..sources.datasets import RULE_FIELDS, Dataset, load_dataset
from ..sources.results import save_result
from ..sources.scratch import Scratch

log = logging.getLogger(__name__)
SWEEP = {"datasets": ["beers", "flights", "hospital", "spotify"], "k": [10, 20, 30], "seeds": [114, 42, 123]}


def propagation_run(data: Dataset, k: int = 20, seed: int = 114, clusterer: Clusterer | None = None, save: bool = False) -> dict:
    """Cluster every column, read the true label of k rows each, spread them, score."""
    start = time.time()
    ready, stats = preprocess_dataset(data)
    propagator = LabelPropagator(dataset_features(ready.dirty, ready.key), ready.key, clusterer, k, seed)
    predicted = propagator.propagate_dataset(ready.labels)
    result = metrics.Evaluator().evaluate(ready.labels, predicted, ready.key, data.name, "label_propagation")
    propagator.forget()
    result |= {"execution_time": time.time() - start, "k": k, "seed": seed, "preprocessing": stats}
    if save:
        save_result(result, data.name, k, seed)
    return result


def detection_run(data: Dataset, respond: Callable[[DataFrame], DataFrame], strategies: list[str] = ("ZS-R", "A"), fewshot_k: int = 0, k: int = 20, batch_size: int = 10, seed: int = 42, clusterer: Clusterer | None = None) -> dict:
    """As above, but the representatives' labels come from ``respond``: a function that adds ``response`` to prompts."""
    start = time.time()
    ready, stats = preprocess_dataset(data)
    key, plan, manager = ready.key, prompts.Strategy.of(list(strategies), fewshot_k), prompts.PromptManager()
    columns, scratch = [c for c in ready.dirty.columns if c != key], Scratch(data.dirty.sparkSession, "answers")
    propagator = LabelPropagator(dataset_features(ready.dirty, key), key, clusterer, k, seed)
    _, reps = propagator.sample()
    related = {}
    if plan.related:
        for r in top_relations(nmi_matrix(ready.dirty, columns), 0.9, 5, 1).orderBy("rank").collect():  # at most five a column
            related.setdefault(r["col1"], []).append(r["col2"])
    found = [r.asDict() for r in ready.rules.collect()] if plan.rules and ready.rules is not None else []  # a row a column
    fields = [f for f in RULE_FIELDS if any(r[f] is not None for r in found)]
    rules = {r["name"]: prompts.rule_text(r, fields) for r in found}
    asked = []
    for column in columns:
        rows = ready.dirty.join(reps.where(F.col("column") == column).select(F.col("rep").alias(key)), key, "left_semi")
        docs = prompts.batch_documents(rows, [column, *related.get(column, [])], key, batch_size)
        rule = F.lit(rules[column]) if column in rules else None
        examples = manager.examples(fewshot.select_few_shot(ready.dirty, ready.clean, column, key, fewshot_k, seed=seed), column, key) if fewshot_k else None
        asked.append(docs.select(F.lit(column).alias("column"), "batch", manager.prompt(column, F.col("data_json"), F.col("label_json"), rule, F.lit(examples) if examples else None).alias("prompt")))
    # all prompts go out in one pass, and what comes back is written before anything reads it: no prompt is sent twice
    answers = scratch.keep(respond(reduce(DataFrame.unionByName, asked)))
    known = reps.select("column", F.col("rep").alias(key))
    labels = labelling.settle_labels(labelling.parse_labels(answers), known, key, ["column"])
    predicted = propagator.propagate(labels)
    result = metrics.Evaluator().evaluate(ready.labels, predicted, key, data.name)
    spent = {"usage": clients.usage(answers).first().asDict()} if {"tokens", "seconds"} <= set(answers.columns) else {}
    scratch.drop(answers)
    propagator.forget()
    return result | {"execution_time": time.time() - start, "preprocessing": stats} | spent


def sweep(spark: SparkSession, root: str, datasets: list[str] = SWEEP["datasets"], ks: list[int] = SWEEP["k"], seeds: list[int] = SWEEP["seeds"]) -> list[dict]:
    """All combinations; a failed one is logged and skipped."""
    out = []
    for name in datasets:
        for k in ks:
            for seed in seeds:
                try:
                    r = propagation_run(load_dataset(spark, root, name), k, seed)
                    out.append({"dataset": name, "k": k, "seed": seed, "f1_score": r["overall"]["f1_score"], "execution_time": r["execution_time"]})
                except Exception:
                    log.exception("%s, k %s, seed %s", name, k, seed)
    return out


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Find erroneous cells in a dirty table.")
    p.add_argument("root")
    p.add_argument("--dataset", default="hospital")
    p.add_argument("--model", help="label representatives with this model; without it, with the true labels")
    p.add_argument("--strategies", nargs="+", default=["ZS-R", "A"])
    p.add_argument("--fewshot", type=int, default=0)
    p.add_argument("--batch-size", type=int, default=10)
    p.add_argument("-k", "--clusters", type=int, default=20)
    p.add_argument("--seed", type=int, default=114)
    p.add_argument("--save", action="store_true")
    p.add_argument("--multi", action="store_true")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("-q", "--quiet", action="store_true")
    a = p.parse_args(args)
    logging.basicConfig(level=logging.INFO if a.verbose else logging.ERROR if a.quiet else logging.WARNING)
    spark = SparkSession.builder.getOrCreate()
    if a.multi:
        for r in sweep(spark, a.root):
            print(r)
        return
    data = load_dataset(spark, a.root, a.dataset)
    if a.model:
        factory = clients.Factory()
        how, wait = clients.call_policy(factory.models[a.model]["api"])
        result = detection_run(data, lambda df: clients.respond(df, lambda: factory.create(a.model), how, wait), a.strategies, a.fewshot, a.clusters, a.batch_size, a.seed)
    else:
        result = propagation_run(data, a.clusters, a.seed, save=a.save)
    metrics.print_results(result)


if __name__ == "__main__":
    main()
