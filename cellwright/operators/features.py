"""Per-cell features: characters, character TF-IDF, token-frequency bins, dependencies; scaled vectors."""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import digitize, known, linspace, safe_ratio
from ..functions.text import BASIC, basic_features, collapsed, tokens
from ..sources.scratch import Scratch
from .dependencies import fd_features

log = logging.getLogger(__name__)
MAX_CHARS = 200
N_BINS = 50


def basic(df: DataFrame, column: str, key: str) -> DataFrame:
    """(key, eleven statistics of the column's text)."""
    return df.select(key, *[c.alias(n) for n, c in basic_features(F.col(column)).items()])


def char_frequencies(df: DataFrame, column: str, max_features: int = MAX_CHARS) -> tuple[list[tuple[str, int]], int]:
    """The corpus's most frequent characters with their document frequencies (ties by code point), and the number of rows."""
    text = df.select(collapsed(F.col(column)).alias("t"))
    n = text.count()
    # a row gives each of its characters once, with its count: nothing is shuffled but partial sums
    per_row = text.select("t", F.explode(F.array_distinct(F.split("t", ""))).alias("c")).where("c <> ''").select("c", (F.length("t") - F.length(F.replace("t", "c", F.lit("")))).alias("tf"))
    best = per_row.groupBy("c").agg(F.sum("tf").alias("ctf"), F.count("*").alias("df")).orderBy(F.desc("ctf"), "c").limit(max_features)
    return [(r["c"], r["df"]) for r in best.collect()], n


def char_tfidf_array(column: str, chars: list[tuple[str, int]], n: int) -> Column:
    """The row's TF-IDF weights in the characters' order, L2-normalised over them; all 0 for an empty text."""
    text = collapsed(F.col(column))
    raw = F.transform(F.array(*[F.struct(F.lit(c).alias("c"), (F.log(F.lit((1 + n) / (1 + d))) + 1).alias("idf")) for c, d in chars]), lambda x: (F.length(text) - F.length(F.replace(text, x["c"], F.lit("")))) * x["idf"])
    norm = F.get(F.transform(F.array(raw), lambda r: F.sqrt(F.aggregate(r, F.lit(0.0), lambda s, x: s + x * x))), F.lit(0))
    return F.get(F.transform(F.array(F.struct(raw.alias("r"), norm.alias("n"))), lambda b: F.transform(b["r"], lambda x: safe_ratio(x, b["n"]))), F.lit(0))


def char_tfidf(df: DataFrame, column: str, key: str, max_features: int = MAX_CHARS) -> DataFrame:
    """(key, feature, value) of the non-zero weights; features are ``char_<c>``."""
    chars, n = char_frequencies(df, column, max_features)
    if not chars:
        raise ValueError("no characters: all texts are empty")
    names = F.array(*[F.lit(f"char_{c}") for c, _ in chars])
    pairs = df.select(key, F.explode(F.arrays_zip(names.alias("feature"), char_tfidf_array(column, chars, n).alias("value"))).alias("z"))
    return pairs.select(key, F.col("z.feature").alias("feature"), F.col("z.value").alias("value")).where("value <> 0")


def token_frequencies(df: DataFrame, column: str, tokenizer=tokens) -> DataFrame:
    """(token, freq) over all rows; ``tokenizer`` is a function from a column to an array column."""
    return df.select(F.explode(tokenizer(F.col(column))).alias("token")).groupBy("token").agg(F.count("*").alias("freq"))


def bin_edges(frequencies: DataFrame, n_bins: int = N_BINS, method: str = "quantile") -> list[float]:
    """Sorted distinct lower edges over the frequencies of unique tokens; none without tokens."""
    if method not in ("quantile", "uniform", "log"):
        raise ValueError(f"unknown binning method {method}")
    shape = frequencies.agg(F.count_distinct("freq").alias("d"), F.min("freq").alias("a"), F.max("freq").alias("b")).first()
    if not shape["d"]:
        return []
    n = min(n_bins, shape["d"])
    if method == "quantile":
        edges = frequencies.agg(F.percentile("freq", [q / 100 for q in linspace(0, 100, n)]).alias("e")).first()["e"]
    elif method == "uniform":
        edges = linspace(shape["a"], shape["b"], n)
    else:
        from math import exp, log as ln

        edges = [exp(x) for x in linspace(ln(max(shape["a"], 1)), ln(max(shape["b"], 1)), n)]
    return sorted({round(float(e), 9) for e in edges})


def token_bins(df: DataFrame, column: str, key: str, n_bins: int = N_BINS, method: str = "quantile", normalize: bool = True, tokenizer=tokens) -> DataFrame:
    """(key, bin, value): how many of the row's tokens have a corpus frequency in each bin; shares if normalised.

    Rows without tokens have no bins. The lookup of frequencies is a join on the token, which Spark
    broadcasts or splits by its size; partial counts per (row, bin) come before the last shuffle.
    """
    frequencies = token_frequencies(df, column, tokenizer)
    edges = bin_edges(frequencies, n_bins, method)
    if not edges:
        log.warning("no tokens in %s", column)
        return df.select(key, F.lit(0).alias("bin"), F.lit(0.0).alias("value"))
    table = frequencies.select("token", digitize(F.col("freq").cast("double"), F.array(*[F.lit(e) for e in edges])).cast("int").alias("bin"))
    counts = df.select(key, F.explode(tokenizer(F.col(column))).alias("token")).join(table, "token").groupBy(key, "bin").agg(F.count("*").cast("double").alias("value"))
    if not normalize:
        return counts
    total = counts.groupBy(key).agg(F.sum("value").alias("t"))
    return counts.join(total, key).select(key, "bin", (F.col("value") / F.col("t")).alias("value"))


def bin_labels(edges: list[float]) -> list[str]:
    if not edges:
        return ["bin_tf_empty"]
    return [f"bin_tf_{i}_[{a:.2f},{b:.2f})" for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))] + [f"bin_tf_{len(edges) - 1}_[{edges[-1]:.2f},+inf)"]


def token_count_scaled(df: DataFrame, column: str, key: str, tokenizer=tokens) -> DataFrame:
    """(key, token_count_scaled): tokens of the row between the least and the most of any row; 0 if all are equal."""
    counts = df.select(key, F.size(tokenizer(F.col(column))).cast("double").alias("n"))
    span = counts.agg(F.min("n").alias("a"), F.max("n").alias("b")).first()
    low, high = float(span["a"] or 0), float(span["b"] or 0)
    return counts.select(key, safe_ratio(F.col("n") - low, F.lit(high - low)).alias("token_count_scaled"))


def merge_vectors(frames: list[tuple[DataFrame, list[str] | None]], key: str) -> tuple[DataFrame, list[str]]:
    """Join (key, vec) frames on the key and chain their vectors; missing names are ``feat_i``."""
    if not frames:
        raise ValueError("no features")
    names, out = [], None
    for i, (df, own) in enumerate(frames):
        part = df.select(key, F.col("vec").alias(f"v{i}"))
        size = None if own else (part.agg(F.max(F.size(f"v{i}")).alias("n")).first()["n"] or 0)
        names += own or [f"feat_{len(names) + j}" for j in range(size)]
        out = part if out is None else out.join(part, key)
    return out.select(key, F.concat(*[f"v{i}" for i in range(len(frames))]).alias("vec")), names


def zscore(df: DataFrame, key: str) -> DataFrame:
    """(key, vec) with each place centred and divided by its population deviation; constants become 0."""
    stats = df.select(F.posexplode("vec").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("i").collect()  # a row a feature
    if not stats:
        return df
    zip_ = F.arrays_zip(F.col("vec").alias("x"), *[known([r[c] for r in stats], "array<double>").alias(c) for c in ("m", "s")])
    return df.select(key, F.transform(zip_, lambda z: F.when(z["s"] > 1e-12, (z["x"] - z["m"]) / z["s"]).otherwise(0.0)).alias("vec"))


def column_features(df: DataFrame, column: str, key: str, max_chars: int = MAX_CHARS, n_bins: int = N_BINS, method: str = "quantile", tokenizer=tokens) -> tuple[DataFrame, list[str]]:
    """(key, vec) of a column: basic, character TF-IDF, token bins, token count, dependencies; z-scored. And the names.

    Vectors are written before they are scaled: the moments and the result read them, and plan none of it again.
    """
    if column not in df.columns:
        raise ValueError(f"no column {column}")
    first = df.select(F.sum(F.when(F.col(column).isNull(), 1).otherwise(0)).alias("nulls"), F.count("*").alias("n")).first()
    if not first["n"]:
        raise ValueError("the table is empty")
    if first["nulls"]:
        log.warning("%s nulls in %s become empty texts", first["nulls"], column)
    df = df.withColumn(column, F.coalesce(F.col(column).cast("string"), F.lit("")))
    chars, n = char_frequencies(df, column, max_chars)
    local = [c.cast("double") for c in basic_features(F.col(column)).values()]
    names = [*BASIC, *[f"char_{c}" for c, _ in chars]]
    vec = F.array(*local)
    if chars:
        vec = F.concat(vec, char_tfidf_array(column, chars, n))
    frames: list[tuple[DataFrame, list[str] | None]] = [(df.select(key, vec.alias("vec")), names)]
    edges = bin_edges(token_frequencies(df, column, tokenizer), n_bins, method)
    bins = token_bins(df, column, key, n_bins, method, True, tokenizer)
    size = max(len(edges), 1)
    per_row = bins.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bin", "value"))).alias("m"))
    wide = df.select(key).join(per_row, key, "left").select(key, F.array(*[F.coalesce(F.col("m")[F.lit(i)], F.lit(0.0)) for i in range(size)]).alias("vec"))
    frames.append((wide, bin_labels(edges)))
    frames.append((token_count_scaled(df, column, key, tokenizer).select(key, F.array("token_count_scaled").alias("vec")), ["token_count"]))
    others = [c for c in df.columns if c != key]
    fd = fd_features(df, column, key).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("lhs", F.struct("support", "confidence").alias("v")))).alias("m"))
    frames.append((fd.select(key, F.array(*[F.col("m")[c][k] for c in others for k in ("support", "confidence")]).alias("vec")), [f"{c}_{k}" for c in others for k in ("support", "confidence")]))
    merged, names = merge_vectors(frames, key)
    return zscore(Scratch(df.sparkSession, "features").keep(merged), key), names


def dataset_features(df: DataFrame, key: str, **how) -> dict[str, DataFrame]:
    return {c: column_features(df, c, key, **how)[0] for c in df.columns if c != key}


def long_features(features: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, column, vec) of all columns."""
    if not features:
        raise ValueError("no features")
    return reduce(DataFrame.unionByName, [f.select(key, F.lit(c).alias("column"), "vec") for c, f in features.items()])
