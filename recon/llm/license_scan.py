"""Licence scan: a trained classifier of paragraphs, confirmed by templates. DataFrame functions only.

A multinomial logistic regression over words and word pairs tells the licence families apart from each other and from other text. It
is trained on variants of the templates below and on a bounded sample of the documents' own paragraphs, with a penalty that leaves
few weights; the matrix of the fit is sparse and bounded with the sample. Wrapped lines are joined, without the marks of comments. A
paragraph that has no n-gram of positive weight cannot be anything but other text, so only paragraphs with a word of one are scored.
A family is reported if its probability reaches a limit and a template of the family confirms it; else a paragraph that is more surely
some licence than all but a thousandth of other text is ``unknown``. Both limits are calibrated on templates that were left out whole,
three times over: the first is the least that has, with the confirmation by the templates that weren't left out, a precision of 0.95 there.
Where no limit has that, no family is reported and licences are ``unknown``.
"""

from __future__ import annotations

import json
import random
import struct
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, read

#: Paragraphs of the documents that are sampled as other text, at most; the driver holds their n-grams for the fit.
MAX_OTHER = 1500
NONE, UNKNOWN, SLOTS, CONFIRM, PRECISION, FOLDS = "none", "unknown", 1 << 16, 0.6, 0.95, 3
#: A fit ends when no weight moves by more than this share of the largest one.
STILL = 2e-3
#: Marks of comments at the beginning of a line; the end of a line that goes on in the next one: no end of a sentence, and so much before it.
MARKS, WRAPPED = r"(?m)^[ \t]*(?://+|#+|\*+/?|/\*+|--+|;+|%+|<!--|\.\.(?= ))[ \t]*", r"(?=[ \t]*\r?\n)(?<=[^\n]{40})(?<![.!?:;])[ \t]*\r?\n[ \t]*(?=[^\s])"

# Notices by which licences are stated.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT", "The MIT License (MIT)",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "Apache License Version 2.0, January 2004",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later", "GNU General Public License v2.0",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only",
             "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"],
    "AGPL": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "BSD": ["Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-2-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "ISC": ["Released under the ISC License.", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0", "Dedicated to the public domain under CC0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."],
}
# Other text with words that licences use.
OTHER = ["He lost his driving license last year.", "The licensed taxi waited at the gate.", "License plates must be clean.", "The general public was admitted free of charge.", "The foundation gave a public lecture on software.",
         "She asked for permission to leave.", "The right to vote is reserved for members.", "MIT and other universities took part.", "The Apache helicopter landed.", "Version 2.0 of the report will be published in January.",
         "The terms of the contract and its conditions are met.", "Use the source of energy with care.", "Creative people share work in common rooms.", "Tickets are free for any person under ten.", "We obtained a copy of the file.", "The work is in the public library."]


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of a text in lower case."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def grams(text: Column) -> Column:
    """The distinct words and word pairs of a text."""
    return let(tokens(text), lambda ws: F.array_distinct(F.concat(ws, F.zip_with(F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0))), F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))))


def paragraphs(text: Column) -> Column:
    """Lines of a text that hold a letter or digit, without the marks of comments; lines that are wrapped are one."""
    joined = F.regexp_replace(F.regexp_replace(text, MARKS, ""), WRAPPED, " ")
    return F.filter(F.split(joined, "[\n\r]+"), lambda x: x.rlike("[A-Za-z0-9]"))


@dataclass
class Model:
    families: list[str]
    vocabulary: list[str]
    weights: np.ndarray  # n-gram x class, the last class is other text
    bias: np.ndarray
    limit: float = 0.5
    other_limit: float = 0.5
    triggers: list[str] = field(default_factory=list)


def variants(seed: int = 1, each: int = 24) -> list[tuple[str, int, str]]:
    """Family, number of the template and text of templates as they occur: whole, cut at an end, with words before or behind, with a
    word lost; and other text with words that licences use."""
    rng, out = random.Random(seed), []
    noise = [w for t in OTHER for w in t.split()]
    for family, texts in TEMPLATES.items():
        for k, text in enumerate(texts):
            words = text.split()
            out.append((family, k, text))
            for _ in range(each):
                w = list(words)
                if len(w) > 12:
                    at = rng.randrange(len(w) - 11)
                    w = w[at:at + rng.randrange(12, len(w) - at + 1)] if rng.random() < 0.4 else w
                if len(w) > 6 and rng.random() < 0.3:
                    w.pop(rng.randrange(1, len(w) - 1))
                w = rng.choices(noise, k=rng.randrange(6)) * (rng.random() < 0.5) + w + rng.choices(noise, k=rng.randrange(6)) * (rng.random() < 0.5)
                out.append((family, k, " ".join(w)))
    out += [(NONE, k, t) for k, t in enumerate(OTHER) for _ in range(3)]
    return out + [(NONE, k, " ".join(rng.choices(noise, k=rng.randrange(3, 20)))) for k in range(300)]


def fitted(rows: list[tuple[str, list[str]]], corpus: list[list[str]], families: list[str], penalty: float = 2e-4, steps: int = 400) -> Model:
    """The regression by proximal gradient steps, without limits. ``corpus``: n-grams of the documents' own paragraphs."""
    rows, classes = rows + [(NONE, g) for g in corpus], [*families, NONE]
    y = np.array([classes.index(k) for k, _ in rows])
    seen: dict[str, int] = {}
    for _, g in rows:
        for x in g:
            seen[x] = seen.get(x, 0) + 1
    # Words that other text has often say nothing, alone or two of them together.
    often: dict[str, int] = {}
    for g in corpus:
        for x in g:
            often[x] = often.get(x, 0) + 1
    vocabulary = sorted(x for x, n in seen.items() if n > 2 and any(not w.isdigit() and often.get(w, 0) <= max(2, 0.003 * len(corpus)) for w in x.split(" ")))
    x, ys = Sparse([g for _, g in rows], vocabulary), np.eye(len(classes), dtype=np.float32)[y]
    share = ys.sum(axis=0)
    weight = (len(ys) / (len(classes) * np.maximum(share, 1)))[y][:, None].astype(np.float32)
    w, b, rate = np.zeros((len(vocabulary), len(classes)), np.float32), np.zeros(len(classes), np.float32), 4.0
    vw, aw = w.copy(), 1.0
    for _ in range(steps):
        g = (_softmax(x.times(vw) + b) - ys) * weight / len(ys)
        new = vw - rate * x.transposed(g)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        b -= rate * g.sum(axis=0)
        ahead = (1 + np.sqrt(1 + 4 * aw * aw)) / 2
        moved, most = (float(np.abs(m).max(initial=0)) for m in (new - w, new))
        vw, w, aw = new + (aw - 1) / ahead * (new - w), new, ahead
        if moved < STILL * most:
            break
    b[-1] = max(b[-1], b[:-1].max() + 0.1)
    used = np.flatnonzero(np.abs(w).max(axis=1) > 0)
    model = Model(families, [vocabulary[k] for k in used], w[used].astype(np.float64), b.astype(np.float64))
    gain = (model.weights[:, :-1] - model.weights[:, -1:]).max(axis=1)
    model.triggers = sorted({v.split(" ")[0] for v, s in zip(model.vocabulary, gain) if s > 0})
    return model


class Sparse:
    """Texts by n-grams of a vocabulary, one over the root of their number for each that a text has, as positions by row and by column."""

    def __init__(self, grams_: list[list[str]], vocabulary: list[str]):
        place = {x: k for k, x in enumerate(vocabulary)}
        at = [[place[w] for w in g if w in place] for g in grams_]
        size = np.fromiter(map(len, at), np.int64, len(at))
        self.n, self.width = len(at), len(vocabulary)
        self.columns, self.rows = np.fromiter((k for x in at for k in x), np.int64, int(size.sum())), np.repeat(np.arange(len(at)), size)
        self.values = (1 / np.sqrt(np.maximum(1, size))).astype(np.float32)[self.rows][:, None]
        self.by_column = np.argsort(self.columns, kind="stable")

    def times(self, w: np.ndarray) -> np.ndarray:
        return _summed_runs(w[self.columns] * self.values, self.rows, self.n)

    def transposed(self, g: np.ndarray) -> np.ndarray:
        order = self.by_column
        return _summed_runs(g[self.rows[order]] * self.values[order], self.columns[order], self.width)


def _summed_runs(x: np.ndarray, run: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by their ascending run numbers."""
    out = np.zeros((n, x.shape[1]), x.dtype)
    first = np.flatnonzero(np.diff(run, prepend=-1))
    if len(first):
        out[run[first]] = np.add.reduceat(x, first, axis=0)
    return out


def probabilities(model: Model, grams_: list[list[str]]) -> np.ndarray:
    return _softmax(Sparse(grams_, model.vocabulary).times(model.weights) + model.bias)


def alike(t: set[str], g: set[str]) -> float:
    """The share of the smaller one of two sets of n-grams, of three at least, that they have in common."""
    return len(t & g) / max(3, min(len(t), len(g)))


def train(rows: list[tuple[str, int, list[str]]], corpus: list[list[str]], families: list[str]) -> Model:
    """The model of all rows, with limits from models that didn't see a third of the templates and of the other text each. Of the rows of
    one template the first is the template itself."""
    folds = np.array([k % FOLDS for _, k, _ in rows])
    other = np.array([xxhash.xxh64_intdigest("|".join(g)) % FOLDS for g in corpus], int)
    templates: dict[tuple[str, int], set[str]] = {}
    for f, k, g in rows:
        templates.setdefault((f, k), set(g))
    best, right, licence = [], [], []
    for fold in range(FOLDS):
        model = fitted([(f, g) for (f, _, g), k in zip(rows, folds) if k != fold], [g for g, k in zip(corpus, other) if k != fold], families, steps=200)
        held = [(f, g) for (f, _, g), k in zip(rows, folds) if k == fold] + [(NONE, g) for g, k in zip(corpus, other) if k == fold]
        p = probabilities(model, [g for _, g in held])
        named = p[:, :-1].argmax(axis=1)
        seen = {f: [t for (name, k), t in templates.items() if name == f and k % FOLDS != fold] for f in families}
        confirmed = np.array([any(alike(t, set(g)) >= CONFIRM for t in seen[families[c]]) for c, (_, g) in zip(named, held)], bool)
        best.append(p[confirmed, :-1].max(axis=1)), right.append(np.array([f == families[c] for c, (f, _) in zip(named, held)], bool)[confirmed])
        licence.append(1 - p[[f == NONE for f, _ in held], -1])
    model = fitted([(f, g) for f, _, g in rows], corpus, families)
    # From the surest down: the least probability down to which the share of right ones is still high enough.
    best_, right_, licence_ = (np.concatenate(x) for x in (best, right, licence))
    order = np.argsort(-best_)
    precise = np.flatnonzero(np.cumsum(right_[order]) / np.arange(1, len(order) + 1) >= PRECISION)
    model.limit = float(best_[order][precise[-1]]) if len(precise) else 2.0
    # Of other text left out, one paragraph in a thousand may look like an unknown licence.
    model.other_limit = float(np.quantile(licence_, 0.999)) if len(licence_) else 0.5
    return model


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(docs: DataFrame, max_other: int = MAX_OTHER) -> Model:
    """The model for ``docs(doc_id, text)``: their part in it is a sample of at most ``max_other`` paragraphs, one a document, the
    first by a hash; those that are like a template are left out, since nobody has labelled them."""
    spark = docs.sparkSession
    share = F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(1_000_000))
    n = docs.count()
    some = docs.where(share < int(min(1.0, 2 * max_other / max(1, n)) * 1_000_000) + 1).select(paragraphs(F.col("text")).alias("p"), F.xxhash64("doc_id", "text", F.lit(6)).alias("h"))
    some = some.where(F.size("p") > 0).select(F.element_at("p", F.pmod(F.col("h"), F.size("p")).cast("int") + 1).alias("t"), "h")
    some = some.orderBy("h", "t").limit(max_other).withColumn("g", grams(F.col("t")))
    other = [r.g for r in some.collect() if len(r.g)]
    known = spark.createDataFrame(variants(), "family string, k int, t string").select("family", "k", grams(F.col("t")).alias("g")).collect()
    notices = [set(r.g) for r in known if r.family != NONE]
    other = [g for g in other if not any(len(t & set(g)) >= max(3, 0.6 * min(len(t), len(g))) for t in notices)]
    return train([(r.family, r.k, r.g) for r in known], other, list(TEMPLATES))


def _literal(value: object, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def _slots(model: Model) -> list[tuple[list[str], list[list[float]]]]:
    """Tables of n-grams and their weights by a hash; what finds its slot taken goes to the next table, with another hash."""
    left, tables = list(range(len(model.vocabulary))), []
    while left or not tables:
        names: list[str] = [""] * SLOTS
        rows: list[list[float]] = [[] for _ in range(SLOTS)]
        over = []
        for k in left:
            seed = xxhash.xxh64_intdigest(model.vocabulary[k].encode(), seed=42)
            at = xxhash.xxh64_intdigest(struct.pack("<i", len(tables)), seed=seed) % SLOTS
            if names[at]:
                over.append(k)
            else:
                names[at], rows[at] = model.vocabulary[k], [round(float(v), 6) for v in model.weights[k]]
        tables.append((names, rows))
        left = over
    return tables


def classify(text: Column, model: Model, template_grams: dict[str, list[list[str]]]) -> Column:
    """``struct(family, score, similarity)`` of a paragraph; null if it is other text."""
    tables = [(_literal(names, "array<string>"), _literal(rows, "array<array<double>>")) for names, rows in _slots(model)]
    classes = [*model.families, NONE]
    cards = _literal([template_grams[f] for f in model.families], "array<array<array<string>>>")

    def scored(gs: Column) -> Column:
        def vector(g: Column, k: int) -> Column:
            """The weights of an n-gram in the k-th table or a later one; null if none has it."""
            names, weights = tables[k]
            rest = vector(g, k + 1) if k + 1 < len(tables) else F.lit(None)
            return let(F.pmod(F.xxhash64(g, F.lit(k)), F.lit(SLOTS)).cast("int"), lambda s: F.when(F.get(names, s) == g, F.get(weights, s)).otherwise(rest))

        vectors = F.filter(F.transform(gs, lambda g: vector(g, 0)), lambda v: v.isNotNull())
        total = lambda vs: F.aggregate(vs, F.array(*[F.lit(0.0)] * len(classes)), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
        bias = F.array(*[F.lit(round(float(v), 6)) for v in model.bias])
        return let(vectors, lambda vs: F.zip_with(bias, total(vs), lambda c, t: c + t / F.sqrt(F.greatest(F.size(vs), F.lit(1)))))

    def decided(gs: Column) -> Column:
        def of(z: Column) -> Column:
            e = let(F.array_max(z), lambda m: F.transform(z, lambda v: F.exp(v - m)))
            p = let(e, lambda es: let(F.aggregate(es, F.lit(0.0), lambda a, v: a + v), lambda t: F.transform(es, lambda v: v / t)))

            def named(ps: Column) -> Column:
                own = F.slice(ps, 1, len(model.families))
                best = F.array_position(own, F.array_max(own)).cast("int")
                near = lambda t: F.size(F.array_intersect(t, gs)) / F.greatest(F.least(F.size(t), F.size(gs)), F.lit(3))
                similar = F.array_max(F.transform(F.element_at(cards, best), near))
                any_ = 1 - F.element_at(ps, len(classes))
                state = F.struct(best.alias("b"), F.array_max(own).alias("p"), similar.alias("s"), any_.alias("any"))

                def told(r: Column) -> Column:
                    sure = (r["p"] >= model.limit) & (r["s"] >= CONFIRM)
                    name = F.when(sure, F.element_at(F.array(*map(F.lit, model.families)), r["b"])).otherwise(UNKNOWN)
                    return F.when(sure | (r["any"] > model.other_limit), F.struct(name.alias("family"), r["p"].alias("score"), r["s"].alias("similarity")))

                return let(state, told)

            return let(p, named)

        return let(scored(gs), of)

    return let(grams(text), decided)


def trigger_pattern(model: Model) -> str:
    return "(?i)(?<![a-z0-9])(?:" + "|".join(model.triggers or ["(?!)"]) + ")(?![a-z0-9])"


def template_ngrams(spark: SparkSession) -> dict[str, list[list[str]]]:
    rows = spark.createDataFrame([(f, t) for f, ts in TEMPLATES.items() for t in ts], "family string, t string").select("family", grams(F.col("t")).alias("g")).collect()
    out: dict[str, list[list[str]]] = {f: [] for f in TEMPLATES}
    for r in rows:
        out[r.family].append(sorted(r.g))
    return out


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, n_paragraphs, found`` of every row of ``docs(doc_id, text)``.

    ``found`` lists the paragraphs that state a licence, in order: ``paragraph`` (counted from 1), ``family`` or ``unknown``,
    ``score``, ``similarity`` to the nearest template, and the paragraph itself.
    Defined results: null, empty and blank texts have no paragraph; repeated rows are scanned each; an empty table gives none.
    """
    model = model or fit(docs)
    known = template_ngrams(docs.sparkSession)
    pattern = trigger_pattern(model)

    def found(ps: Column) -> Column:
        rows = F.filter(F.transform(ps, lambda p, i: F.struct((i + 1).alias("paragraph"), p.alias("text"))), lambda r: r["text"].rlike(pattern))
        judged = F.transform(rows, lambda r: F.struct(r["paragraph"], classify(r["text"], model, known).alias("c"), r["text"].alias("text")))
        return F.transform(F.filter(judged, lambda r: r["c"].isNotNull()), lambda r: F.struct(r["paragraph"].alias("paragraph"), r["c"]["family"].alias("family"), r["c"]["score"].alias("score"), r["c"]["similarity"].alias("similarity"), r["text"].alias("text")))

    text = F.coalesce(F.col("text"), F.lit(""))
    kind = "array<struct<paragraph:int,family:string,score:double,similarity:double,text:string>>"
    both = let(paragraphs(text), lambda ps: F.struct(F.size(ps).alias("n"), F.when(text.rlike(pattern), found(ps)).otherwise(F.array().cast(kind)).alias("found")))
    return docs.select("doc_id", both.alias("_b")).select("doc_id", F.col("_b.n").alias("n_paragraphs"), F.col("_b.found").alias("found"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_paragraphs, n_found, families`` and the best ``family, score`` over the whole table ``documents``; ``none``
    where no paragraph states a licence."""
    rows = scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    named = F.filter("found", lambda f: f["family"] != UNKNOWN)
    best = F.array_max(F.transform(F.when(F.size(named) > 0, named).otherwise(F.col("found")), lambda f: F.struct(f["score"].alias("s"), f["family"].alias("f"))))
    rows = rows.withColumn("best", best)
    return rows.select("doc_id", "n_paragraphs", F.size("found").alias("n_found"), F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda f: f["family"]))), ",").alias("families"),
                       F.coalesce(F.col("best.f"), F.lit(NONE)).alias("family"), F.round("best.s", 6).alias("score"))
