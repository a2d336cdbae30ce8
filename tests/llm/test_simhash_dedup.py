import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from recon.llm.common import Kept, components
from recon.llm.simhash_dedup import keep_one, links_between, near_duplicates, near_links

SCHEMA = "doc_id bigint, text string, lang string, fp string, component_id string"


def slow_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps, radius):
    root = {i: i for i in fps}
    find = lambda i: i if root[i] == i else find(root[i])
    for i in fps:
        for j in fps:
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in fps}


def test_whole_operator_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}É" for i in range(60)] + ["The", "and", "of"]
    base = [" ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 40, 300]))) for _ in range(40)]
    rows = []
    for i, text in enumerate(base):
        rows.append((3 * i + 7, text))
        if i % 3 == 0:
            words = text.split(" ")
            words[rng.randrange(len(words))] = "changed"
            rows.append((3 * i + 8, "\n ".join(words)))
        if i % 5 == 0:
            rows.append((3 * i + 9, text.upper().replace("É", "É")))
    rows += [(1000, ""), (1001, None), (1002, " \t\r\n\x0b\x0c"), (1003, "a b" * 3000)]
    docs = spark.createDataFrame([(i, t, "en", "x", "y") for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.fp, r.component_id) for r in near_duplicates(docs, tile=8).collect()}
    fps = {i: slow_fp(t) for i, t in rows}
    assert {i: f & (2**64 - 1) for i, (f, _) in got.items()} == fps
    assert {i: c for i, (_, c) in got.items()} == slow_components(fps, 3)


def test_links_join_what_all_pairs_join(spark):
    rng = np.random.default_rng(1)
    heads = rng.integers(0, 2**63, 30, dtype=np.uint64)
    values = np.unique(np.concatenate([heads, *[heads ^ (np.uint64(1) << rng.integers(0, 64, 30, dtype=np.uint64)) for _ in range(6)]]))
    slow = slow_components({int(v): int(v) for v in values}, 3)
    fps = spark.createDataFrame([(int(v.view(np.int64)),) for v in values], "fp bigint")
    kept = Kept(spark, "t")
    parts = {r.node: r.component for r in components(near_links(fps, kept, 3, tile=16), kept).collect()}
    signed = lambda v: int(np.uint64(v).view(np.int64))
    for v in slow:
        for w in slow:
            same = parts.get(signed(v), signed(v)) == parts.get(signed(w), signed(w))
            assert same == (slow[v] == slow[w])
    assert len(links_between(values[:50], values[:50], 64)) == 99


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, 500 + i) for i in range(1, 80)] + [(900, 900), (901, 902)]
    got = dict(components(spark.createDataFrame(edges, "a bigint, b bigint"), Kept(spark, "t")).collect())
    assert got == {i: 0 for i in range(101)} | {500 + i: 500 for i in range(80)} | {901: 901, 902: 901}


def test_empty_table_nulls_and_repeated_rows(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(None, "a b c d", None, None, None), (4, "a b c d", None, None, None), (4, "a b c d", None, None, None), (9, None, None, None, None)], SCHEMA)
    assert sorted((r.doc_id or -1, r.component_id) for r in near_duplicates(docs).collect()) == [(-1, 4), (4, 4), (4, 4), (9, 9)]
    left = keep_one(docs)
    assert left.columns == docs.columns and sorted(r.doc_id or -1 for r in left.collect()) == [-1, 4, 9]
    assert keep_one(docs.where(F.lit(False))).count() == 0
