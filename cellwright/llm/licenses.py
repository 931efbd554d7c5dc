"""License scans: fixed phrases, and an exact set-similarity join with license templates.

Words are those of ``textbatch``, with only A-Z lower-cased. A phrase is found where its words stand
consecutively. A template, as a set of words, is found in a text block that contains at least
``threshold`` of it. The blocks of a template of n words are the runs of 2n words that start at every
n-th word, so any n + 1 consecutive words lie whole in one; a shorter end of a text is a block too.

The join is exact. All template words are counted over the whole corpus and ordered from rare to
frequent; words of no template can add nothing to a containment and are left out. For a template T
with least overlap a = ceil(threshold x |T|), a matching block has one of the |T| - a + 1 rarest words
of T (prefix); at least a distinct template words (length); and at least a of them from the rarest
shared one on (position). What passes is verified on the full sets.

Templates and phrases are parameters; the templates' words bound what is broadcast. Nulls and empty
texts have no words and no labels. Each row is judged alone, so repeated rows and ids need no care.
Columns other than id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import Batch, pieces

THRESHOLD = 0.8

# Phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Labels and notices as the licenses' stewards publish them.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "This project is released under the MIT License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]


class Library:
    """Templates and phrases as word hashes."""

    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str], threshold: float):
        batch = Batch([t for _, t in templates], case="ascii")
        words = batch.words()
        self.sets = [np.unique(words[a:b]) for a, b in zip(batch.first[:-1], batch.first[1:], strict=True)]
        self.lengths = np.diff(batch.first).tolist()
        self.labels = [label for label, _ in templates]
        share = Fraction(str(threshold))
        self.least = [math.ceil(share * len(s)) for s in self.sets]
        self.words = np.unique(words)
        phrase = Batch(list(phrases), case="ascii")
        hashes = phrase.words()
        self.phrases = [(hashes[a:b], label) for a, b, label in zip(phrase.first[:-1], phrase.first[1:], phrases.values(), strict=True)]
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[self.words & np.uint64(0xFFFF)] = True

    def lookup(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        some = np.flatnonzero(self.sieve[words & np.uint64(0xFFFF)])
        at = np.minimum(np.searchsorted(self.words, words[some]), len(self.words) - 1)
        hit = self.words[at] == words[some]
        return some[hit], at[hit]


def frequencies(texts: DataFrame, library: Library) -> np.ndarray:
    """How often each template word stands in the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(library.words), np.int64)
        for _, some in pieces(batches):
            total += np.bincount(library.lookup(Batch(some, case="ascii").words())[1], minlength=len(total))
        here = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(here), pa.array(total[here])], ["word", "n"])

    out = np.zeros(len(library.words), np.int64)
    for row in texts.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():  # a row a template word
        out[row["word"]] = row["n"]
    return out


class Scanner:
    def __init__(self, library: Library, frequency: np.ndarray):
        self.library = library
        self.rank = np.empty(len(frequency), np.int64)
        self.rank[np.lexsort((library.words, frequency))] = np.arange(len(frequency))
        self.members = [np.sort(self.rank[np.searchsorted(library.words, s)]) for s in library.sets]

    def phrases(self, batch: Batch, words: np.ndarray) -> list[tuple[int, int, str]]:
        """(text, first word, label) of every place."""
        out = []
        for phrase, label in self.library.phrases:
            at = np.flatnonzero(words[: max(len(words) - len(phrase) + 1, 0)] == phrase[0])
            for j in range(1, len(phrase)):
                at = at[words[at + j] == phrase[j]]
            text = np.searchsorted(batch.first, at, "right") - 1
            inside = at + len(phrase) <= batch.first[text + 1]
            out += [(int(t), int(a - batch.first[t]), label) for t, a in zip(text[inside], at[inside], strict=True)]
        return out

    def templates(self, batch: Batch, words: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(text, template, block's first word, containment) of every matching block."""
        place, word = self.library.lookup(words)
        rank = self.rank[word]
        text = np.searchsorted(batch.first, place, "right") - 1
        inner = place - batch.first[text]
        out = []
        for i, (own, n, least) in enumerate(zip(self.members, self.library.lengths, self.library.least, strict=True)):
            if not least:
                continue
            # each word stands in the block that starts at its stride and in the one before; blocks are numbered by text and stride
            stride = inner // n
            base = batch.first[text] + text  # room for every text's strides
            prefix = np.isin(rank, own[: len(own) - least + 1])
            if not prefix.any():
                continue
            candidates = np.unique(np.concatenate(((base + stride)[prefix], (base + stride - 1)[prefix & (stride > 0)])))
            block = np.concatenate((base + stride, (base + stride - 1)[stride > 0]))
            ranks, texts = np.concatenate((rank, rank[stride > 0])), np.concatenate((text, text[stride > 0]))
            kept = np.isin(block, candidates)
            pair, first_at = np.unique(block[kept] * len(self.rank) + ranks[kept], return_index=True)
            block, ranks, texts = pair // len(self.rank), pair % len(self.rank), texts[kept][first_at]
            start = np.flatnonzero(np.diff(block, prepend=-1))
            size = np.diff(np.append(start, len(block)))
            shared = np.isin(ranks, own)
            # rarest shared word, and how many template words of the block come from it on
            begin = np.minimum.reduceat(np.where(shared, np.arange(len(block)), len(block)), start)
            passes = (size >= least) & (start + size - begin >= least)
            overlap = np.add.reduceat(shared.astype(np.int64), start)
            for s, got in zip(start[passes & (overlap >= least)], overlap[passes & (overlap >= least)], strict=True):
                t = int(texts[s])
                out.append((t, i, int((block[s] - batch.first[t] - t) * n), float(got / len(own))))
        return out


def scan(documents: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, places, blocks) of every row.

    ``places``: (word, label) of every phrase; ``blocks``: (template, label, first_word, containment)
    of every matching block; both in order.
    """
    library = Library(templates, phrases, threshold)
    scanner = Scanner(library, frequencies(documents.select(F.col(text_col).alias("text")), library))
    place_type = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    block_type = pa.list_(pa.struct([("template", pa.int32()), ("label", pa.string()), ("first_word", pa.int64()), ("containment", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches):
            batch = Batch(texts, case="ascii")
            words = batch.words()
            places: list[list] = [[] for _ in texts]
            blocks: list[list] = [[] for _ in texts]
            for t, w, label in scanner.phrases(batch, words):
                places[t].append({"word": w, "label": label})
            for t, i, w, got in scanner.templates(batch, words):
                blocks[t].append({"template": i, "label": library.labels[i], "first_word": w, "containment": got})
            for p in places:
                p.sort(key=lambda x: (x["word"], x["label"]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(batch.first)), pa.array(places, place_type), pa.array(blocks, block_type)], ["doc", "n_words", "places", "blocks"])

    schema = f"doc {dict(documents.dtypes)[id_col]}, n_words long, places array<struct<word:long,label:string>>, blocks array<struct<template:int,label:string,first_word:long,containment:double>>"
    return documents.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("doc", id_col)
