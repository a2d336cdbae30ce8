import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recon.llm.license_scan import CONFIRM, NONE, PRECISION, Model, TEMPLATES, UNKNOWN, _slots, alike, classify, fit, fitted, grams, paragraphs, probabilities, scan, template_ngrams, train, trigger_pattern, variants

SCHEMA = "doc_id bigint, text string, family string, found string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    syllables = ["tion", "er", "an", "the", "of", "re", "ou", "ing", "this", "with", "is"]
    line = lambda: " ".join("".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(rng.randrange(3, 25))) + "."
    rows = []
    for i in range(500):
        lines = [line() for _ in range(rng.randrange(1, 8))]
        if i % 10 == 0:
            lines.insert(rng.randrange(len(lines) + 1), TEMPLATES[sorted(TEMPLATES)[i // 10 % len(TEMPLATES)]][0])
        rows.append((i, "\n".join(lines), "x", "y"))
    rows += [(900, None, "x", "y"), (901, "", "x", "y"), (902, "\n \n", "x", "y"), (903, "so\n\nSPDX-License-Identifier: MIT\r\nReleased under the Apache 2.0 License", "x", "y"), (904, line() * 3000 + "\nLicensed under CC BY-SA 4.0.", "x", "y"), (None, "All rights reserved.", "x", "y"), (7, "again", "x", "y")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def model(docs):
    return fit(docs)


def test_families_are_found_and_clean_text_is_not(docs, model):
    got = {r.doc_id: r for r in scan(docs, model).collect()}
    order = sorted(TEMPLATES)
    for i in range(500):
        named = [f.family for f in got[i].found] if i != 7 else []
        assert named == ([order[i // 10 % len(order)]] if i % 10 == 0 else []), (i, got[i].found)
    assert [got[i].n_paragraphs for i in (900, 901, 902)] == [0, 0, 0] and all(got[i].found == [] for i in (900, 901, 902))
    assert [(f.paragraph, f.family) for f in got[903].found] == [(2, "MIT"), (3, "Apache-2.0")]
    assert [f.family for f in got[904].found] == ["CC-BY-SA"] and [f.family for f in got[None].found] == ["proprietary"]
    assert scan(docs.limit(0), model).count() == 0


def test_held_out_variants(spark, model):
    rows = spark.createDataFrame(variants(seed=77, each=6), "want string, k int, t string")
    got = rows.select("want", classify(F.col("t"), model, template_ngrams(spark)).alias("c")).select("want", "c.family").collect()
    named = [r for r in got if r.want != "none"]
    right = sum(r.family == r.want for r in named)
    wrong = sum(r.family not in (r.want, UNKNOWN, None) for r in named)
    assert right / len(named) > 0.85 and wrong / len(named) < 0.08
    none = [r for r in got if r.want == "none"]
    assert sum(r.family not in (None, UNKNOWN) for r in none) / len(none) < 0.02


def test_only_paragraphs_with_a_trigger_can_be_licences(spark, docs, model):
    lines = docs.select(F.explode(F.split("text", "\n")).alias("t")).where(~F.col("t").rlike(trigger_pattern(model))).limit(400)
    assert lines.select(classify(F.col("t"), model, template_ngrams(spark)).alias("c")).where("c is not null").count() == 0


def test_ngrams(spark):
    row = spark.createDataFrame([("The  MIT-license, the MIT",), ("x",), ("",)], "t string").select(grams(F.col("t")).alias("g")).collect()
    assert [sorted(r.g) for r in row] == [sorted(["the", "mit", "license", "the mit", "mit license", "license the"]), ["x"], []]


NOTICE = """/*
 * Copyright (c) 2019 Somebody
 *
 * Permission is hereby granted, free of charge, to any person obtaining a
 * copy of this software and associated documentation files (the "Software"),
 * to deal in the Software without restriction, including without limitation
 * the rights to use, copy, modify, merge, publish and sell copies.
 */
int main() { return 0; }
# This program is free software: you can redistribute it and/or modify it
# under the terms of the GNU General Public License as published by the
# Free Software Foundation, either version 3 of the License.
x = 1
"""


def test_wrapped_notices_in_comments_are_one_paragraph(spark, model):
    docs = spark.createDataFrame([(1, NOTICE, "x", "y"), (2, NOTICE.replace("\n", "\r\n"), "x", "y")], SCHEMA)
    for r in scan(docs, model).collect():
        assert [f.family for f in r.found if f.family != UNKNOWN] == ["MIT", "GPL"]
        whole = next(f for f in r.found if f.family == "MIT")
        assert whole.text.startswith("Permission is hereby") and whole.text.endswith("sell copies.") and whole.similarity > 0.8
    row = docs.where("doc_id = 1").select(paragraphs(F.col("text")).alias("p")).first()
    assert len(row.p) == 5 and paragraphs is not None


def test_precision_on_templates_that_were_not_seen_and_recall(spark):
    """Models without a template of each of some families: of what they report, with the confirmation by the templates they have, the
    share that is right is the one stated; most of the rest is some licence at least."""
    rows = spark.createDataFrame(variants(each=8), "family string, k int, t string").select("family", "k", grams(F.col("t")).alias("g")).collect()
    known, reported, right, some, all_ = [(r.family, r.k, r.g) for r in rows], 0, 0, 0, 0
    for turn in (1, 2):
        left = {(f, len(ts) - turn) for f, ts in TEMPLATES.items() if len(ts) > 2}
        model = train([r for r in known if (r[0], r[1]) not in left], [], list(TEMPLATES))
        seen = {f: [set(g) for name, k, g in known if name == f and (f, k) not in left] for f in TEMPLATES}
        held = [r for r in known if (r[0], r[1]) in left]
        p = probabilities(model, [g for *_, g in held])
        for (f, _, g), own in zip(held, p):
            best = model.families[int(own[:-1].argmax())]
            sure = own[:-1].max() >= model.limit and max(alike(t, set(g)) for t in seen[best]) >= CONFIRM
            reported, right, some, all_ = reported + sure, right + (sure and best == f), some + (sure or 1 - own[-1] > model.other_limit), all_ + 1
    assert all_ > 100 and reported > 20 and right / reported >= PRECISION
    assert some / all_ > 0.5


def test_classify_is_the_regression_and_the_templates(spark, model):
    """The native expression against the plain one, row by row."""
    rows = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(variants(seed=5, each=4))], "i int, t string").withColumn("g", grams(F.col("t")))
    known = template_ngrams(spark)
    got = rows.select("i", "g", classify(F.col("t"), model, known).alias("c")).collect()
    p = probabilities(model, [r.g for r in got])
    for r, own in zip(got, p):
        best = int(own[:-1].argmax())
        similar = max(alike(set(t), set(r.g)) for t in known[model.families[best]])
        sure = own[best] >= model.limit and similar >= CONFIRM
        if min(abs(own[best] - model.limit), abs(1 - own[-1] - model.other_limit)) < 1e-4:
            continue
        if not sure and 1 - own[-1] <= model.other_limit:
            assert r.c is None
        else:
            assert r.c.family == (model.families[best] if sure else UNKNOWN)
            assert r.c.score == pytest.approx(own[best], abs=1e-4) and r.c.similarity == pytest.approx(similar)


def test_without_a_limit_that_is_precise_no_family_is_reported(spark):
    """Templates that are the same in two families: whatever is confirmed is right half of the time."""
    texts = ["alpha beta gamma delta", "alpha beta gamma epsilon", "alpha beta gamma zeta"]
    rows = [(f, k, t.split(" ")) for f in ("a", "b") for k, t in enumerate(texts) for _ in range(6)] + [(NONE, k, ["other", f"w{k}"]) for k in range(30)]
    assert train(rows, [], ["a", "b"]).limit > 1


def test_no_ngram_is_lost_to_another(spark):
    """3,000 n-grams share some of the slots of a table; all are stored, and each is found by the hash of its table."""
    words = [f"word{k}" for k in range(3000)]
    tables = _slots(Model(["a"], words, np.arange(6000.0).reshape(3000, 2), np.zeros(2)))
    stored = {n: w for names, rows in tables for n, w in zip(names, rows) if n}
    assert stored == {w: [2.0 * k, 2.0 * k + 1] for k, w in enumerate(words)} and len(tables) > 1
    hashes = spark.createDataFrame([(w,) for w in words], "t string").select("t", *[F.pmod(F.xxhash64("t", F.lit(k)), F.lit(1 << 16)).alias(f"h{k}") for k in range(len(tables))]).collect()
    assert all(any(names[r[f"h{k}"]] == r.t for k, (names, _) in enumerate(tables)) for r in hashes)
    assert fitted([("a", ["x y"])] * 5 + [(NONE, ["z"])] * 5, [], ["a"], steps=20).families == ["a"]
