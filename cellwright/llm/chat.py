"""Chat formatting of reply trees, with DataFrame operations only.

Messages form trees by their parents. Root-to-leaf paths come from iterative self-joins. Each round
joins the nodes with themselves and doubles how far up each one reaches, with the sum of the scores on
the way: after log2(n) rounds every leaf has the mean score of its path, and the branches of a tree are
ranked by it. Only the chosen branches are then walked: one join per round's table adds, to every
(leaf, node) found so far, the node that many steps up. So a tree of many branches of which few are
wanted gives rows for these alone. All joins are on keys that spread a long conversation over all tasks.
A chosen path is formatted as one conversation, in one row.

Template: a turn is ``<|role|>``, a newline, the text, ``<|end|>`` and a newline. Inside roles and
texts a backslash is doubled, and every control string gets one after its first character; so each
backslash escapes the next character, no control string survives in a text, and dropping those
backslashes gives the text back.

A null tree is a tree of its own; rows without a node are left out. A missing parent makes its child a root. Rows that agree in tree and node count once, the smallest
one. Messages on a cycle have no path and are left out. Null texts and roles are empty; missing scores
are 0. Ties between branches go to the smaller leaf. An empty table gives no conversation.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Scratch

# Control strings of this template and of common others.
CONTROLS = ["<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
END = "<|end|>\n"


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def linked(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Messages (tree, node, parent, role, text, score) of conversations whose rows reply to the row before.

    Order: turn, then role, then text; nulls first. Rows gather by conversation with partial lists.
    """
    turns = rows.groupBy(F.col(conv_col).alias("tree")).agg(F.array_sort(F.collect_list(F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")))).alias("turns"))
    each = turns.select("tree", F.posexplode("turns").alias("node", "m"))
    return each.select("tree", F.col("node").cast("long").alias("node"), F.when(F.col("node") > 0, F.col("node").cast("long") - 1).alias("parent"), "m.role", "m.text", F.lit(0.0).alias("score"))


def ranked(messages: DataFrame, scratch: Scratch, per_tree: int | None) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, leaf, rank, score) of the chosen branches, and the tables (tree, node, up) of ancestors 1, 2, 4, ... steps up."""
    same = lambda a, b: a.eqNullSafe(b)
    nodes, most = messages.select("tree", "node", "parent", "score"), messages.count()
    known = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    first = nodes.join(known, same(nodes["tree"], known["t"]) & (nodes["parent"] == known["n"]), "left")
    reach = scratch.keep(first.select("tree", "node", F.col("n").alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("length")))
    rounds = [reach]
    while reach.where("up is not null").limit(1).count() and 1 << len(rounds) <= 4 * most:
        b = reach.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("further"), F.col("total").alias("more"), F.col("length").alias("longer"))
        both = reach.join(b, same(reach["tree"], b["t"]) & (reach["up"] == b["n"]), "left")
        reach = scratch.keep(both.select("tree", "node", F.col("further").alias("up"), (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total"), (F.col("length") + F.coalesce("longer", F.lit(0))).alias("length")))
        rounds.append(reach)
    parents = rounds[0].where("up is not null").select(F.col("tree").alias("t"), F.col("up").alias("n")).distinct()
    ended = reach.where("up is null")  # the others are on a cycle, or below one
    leaves = ended.join(parents, same(ended["tree"], parents["t"]) & (ended["node"] == parents["n"]), "left_anti")
    leaves = leaves.select("tree", F.col("node").alias("leaf"), (F.col("total") / F.col("length")).alias("score"))
    order = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    chosen = order if per_tree is None else order.where(F.col("rank") <= per_tree)
    return scratch.keep(chosen.select("tree", "leaf", "rank", "score")), rounds[:-1]


def paths(chosen: DataFrame, rounds: list[DataFrame], scratch: Scratch) -> DataFrame:
    """(tree, leaf, node, up): every node on the way from each chosen leaf to its root, ``up`` steps above the leaf."""
    parts = [scratch.keep(chosen.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up")))]
    for k in range(len(rounds) - 1, -1, -1):
        sofar = functools.reduce(DataFrame.unionByName, parts)
        jump = rounds[k].where("up is not null").select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("to"))
        parts.append(scratch.keep(sofar.join(jump, sofar["tree"].eqNullSafe(jump["t"]) & (sofar["node"] == jump["n"])).select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + (1 << k)).alias("up"))))
    return functools.reduce(DataFrame.unionByName, parts)


def format_trees(messages: DataFrame, per_tree: int | None = 1, loss_role: str = "assistant") -> DataFrame:
    """(tree, leaf, rank, score, n_turns, segments, formatted) of the chosen paths.

    messages: tree, node, parent, role, text, score. ``segments`` are the formatted text's pieces in
    order, each with ``loss``: whether a model is trained on it. ``per_tree`` None keeps all branches.
    """
    scratch = Scratch(messages.sparkSession, "chat")
    rows = messages.select("tree", "node", "parent", "role", "text", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    messages = scratch.keep(rows.where("node is not null").groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m")).select("tree", "node", "m.*"))
    best, rounds = ranked(messages, scratch, per_tree)
    way = paths(best, rounds, scratch)
    own = messages.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text")
    full = way.join(own, way["tree"].eqNullSafe(own["t"]) & (way["node"] == own["n"]))
    lists = full.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text"))).alias("turns"))
    means = best.select(F.col("tree").alias("rt"), F.col("leaf").alias("rl"), "rank", F.col("score").alias("mean"))
    chosen = lists.join(means, lists["tree"].eqNullSafe(means["rt"]) & (lists["leaf"] == means["rl"]))
    scratch.drop(*rounds)
    turn = lambda m: F.array(
        F.struct(F.concat(F.lit("<|"), escape(m["role"]), F.lit("|>\n")).alias("piece"), F.lit(False).alias("loss")),
        F.struct(escape(m["text"]).alias("piece"), F.coalesce(m["role"] == loss_role, F.lit(False)).alias("loss")),
        F.struct(F.lit(END).alias("piece"), F.lit(False).alias("loss")),
    )
    out = chosen.withColumn("segments", F.flatten(F.transform("turns", turn)))
    return out.select("tree", "leaf", "rank", F.col("mean").alias("score"), F.size("turns").cast("long").alias("n_turns"), "segments", F.array_join(F.transform("segments", lambda s: s["piece"]), "").alias("formatted"))


def parse(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation was made from."""
    parts = F.filter(F.split(formatted, r"<\|end\|>\n", -1), lambda p: p != "")
    pattern = r"(?s)^<\|(.*?)\|>\n(.*)$"
    return F.transform(parts, lambda p: F.struct(unescape(F.regexp_extract(p, pattern, 1)).alias("role"), unescape(F.regexp_extract(p, pattern, 2)).alias("text")))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, as it was before formatting."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["piece"])), "")
