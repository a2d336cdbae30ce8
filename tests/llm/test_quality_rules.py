import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from recon.llm import quality_rules as Q

SCHEMA = "doc_id bigint, text string, n_words string, quality string, kept string"


def slow(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    seen, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            inside |= set(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside), failed


def texts():
    rng = random.Random(6)
    pool = ["a", "bé", "c#", "🙂d", "$$", "e|f", "G", "<h>"]
    out = [None, "", " \n\t ", "x" * 50000, "same line\nsame line\n\n \nsame line\n", "\x0b".join("abcdefgh") * 9, "w " * 30000, " ".join(map(str, range(20000)))]
    for n in (1, 7, 8, 9, 16, 19, 20, 21, 60, 200, 900):
        out += [rng.choice([" ", "\n", "  ", "\r\n"]).join(rng.choices(pool[:k], k=n)) for k in (1, 2, 3, 8) for _ in range(2)]
        body = rng.sample(range(10**6), n)
        out.append(" ".join(map(str, body + body[: n // 2])))
    return out


def test_counts_against_brute_force(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)
    got = {r.doc_id: r for r in Q.judged(docs, [], "doc_id").collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == slow(t), (t or "")[:80]
        assert r.kept == (not r.base_failed)


def test_rules_are_learned_pruned_and_emitted():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(Q.FEATURES)))
    symbol, upper, mean = (Q.FEATURES.index(f) for f in ("symbol_share", "upper_share", "mean_word"))
    bad = (x[:, symbol] > 0.8) | ((x[:, upper] > 0.6) & (x[:, mean] < 0.3))
    noisy = bad ^ (rng.random(3000) < 0.02)
    rules = Q.learn(x, noisy, rng.random(3000) < 0.67)
    hit = np.logical_or.reduce([Q.covers(r, x) for r in rules])
    assert {c.feature for r in rules for c in r} >= {"symbol_share", "upper_share"}
    assert (hit & bad).sum() / bad.sum() > 0.9 and (hit & ~bad).sum() < 30
    assert Q.learn(x, rng.random(3000) < 0.1, rng.random(3000) < 0.67) == []


def test_expression_is_the_list(spark):
    rules = [(Q.Condition("symbol_share", True, 0.1),), (Q.Condition("n_words", False, 30.0), Q.Condition("upper_share", True, 0.2))]
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in enumerate(texts())], SCHEMA)
    for r in Q.judged(docs, rules, "doc_id").collect():
        x = np.array([[float(r[f]) for f in Q.FEATURES]])
        assert r.kept == (not r.base_failed and not any(Q.covers(rule, x)[0] for rule in rules))


def test_labelled_documents_are_told_apart(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(700):
        words = [f"{rng.choice('abcdef')}{rng.randrange(500)}" for _ in range(rng.randrange(25, 60))]
        bad = i % 4 == 0
        rows.append((i, " ".join(w + "&&&" if bad else w for w in words), "x", "y", "z"))
        labels.append((i, 0 if bad else 1, 0, "t"))
    docs = spark.createDataFrame(rows, SCHEMA)
    labels += [(2, 0, 0, "t"), (None, 1, 0, "t"), (9000, 1, 0, "t"), (3, None, 0, "t")]
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int, text string")
    rules = Q.fit(docs, table)
    assert rules == Q.fit(docs.repartition(3), table)
    kept = {r.doc_id: r.kept for r in Q.judged(docs, rules, "doc_id").collect()}
    assert sum(kept[i] == (i % 4 != 0) for i in kept) >= 695
    assert Q.fit(docs, table.limit(0)) == [] and Q.judged(docs.where(F.lit(False)), rules, "doc_id").count() == 0


def test_statistics_are_made_of_labelled_texts_alone(spark):
    """The documents are read once for the labelled texts, without windows and hashes of words."""
    docs = spark.createDataFrame([(1, "a b", "x", "y", "z"), (1, "a a", "x", "y", "z")], SCHEMA)
    labels = spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    plans = []
    keep = Q.Kept.keep
    try:
        Q.Kept.keep = lambda self, df, **o: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(self, df, **o)
        assert Q.fit(docs, labels) == []
    finally:
        Q.Kept.keep = keep
    assert len(plans) == 1 and "transform" not in plans[0] and "xxhash64(x" not in plans[0]


def test_accuracy_on_labels_of_other_documents(spark):
    """Learned from three quarters of the labelled documents of the given tables, judged on the others: what is dropped is bad."""
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    docs, labels = read("documents").select("doc_id", "text"), read("labels")
    rules = Q.fit(docs, labels.where(~held))
    rows = Q.judged(docs, rules, "doc_id").join(labels.where(held), "doc_id").select("kept", "quality", "base_failed").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert len(good) > 30 and len(bad) > 10
    dropped_good, dropped_bad = sum(not r.kept for r in good) / len(good), sum(not r.kept for r in bad) / len(bad)
    assert dropped_good < 0.1 and dropped_bad > 0.6, (dropped_good, dropped_bad)
