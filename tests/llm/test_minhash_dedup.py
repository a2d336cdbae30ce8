import random
import re

import numpy as np
from pyspark.sql import functions as F

from recon.llm.buckets import tile_pairs
from recon.llm.common import Kept
from recon.llm.minhash_dedup import REGISTERS, by_chance, digest, estimates, near_duplicates, similar, sketches

SCHEMA = "doc_id bigint, text string, id string, n string, component string, component_id string"


def shingles(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(ws[i:i + 3]) for i in range(len(ws) - 2)} or ({" ".join(ws)} if ws else set())


def slow(rows):
    """Component of each row by all pairs: the least id that is reachable."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least.get(find(i)), d == least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def family(rng, n, copies, most):
    """A text and copies of it in which up to ``most`` words are changed."""
    base = [f"w{rng.randrange(500)}É" for _ in range(n)]
    yield base
    for _ in range(copies):
        own = list(base)
        for _ in range(rng.randrange(most + 1)):
            own[rng.randrange(n)] = f"X{rng.randrange(10**6)}"
        yield own


def test_whole_operator_against_all_pairs(spark):
    rng = random.Random(8)
    texts = [x for n, copies, most in ((150, 60, 9), (40, 20, 2), (21, 20, 1), (9, 10, 1), (400, 10, 12), (3, 3, 1), (2, 3, 1), (1, 3, 0)) for x in family(rng, n, copies, most)]
    rows = [(i, rng.choice([" ", "\n ", "\t"]).join(x)) for i, x in enumerate(texts)]
    rng.shuffle(rows)
    rows += [(1000, None), (1001, ""), (1002, " \n"), (None, rows[3][1]), (None, "alone by itself and without an id"), (None, None), (2000, rows[5][1].upper().replace("É", "É")), (5, rows[9][1]), (5, rows[9][1]), (3000, "a b " * 5000)]
    docs = spark.createDataFrame([(d, t, "x", "y", "z", "q") for d, t in rows], SCHEMA).repartition(3)
    got = sorted(map(tuple, near_duplicates(docs, tile=8, room=3000).collect()), key=repr)
    assert got == sorted(slow(rows), key=repr)
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_registers_agree_as_sets_do_however_small():
    rng = np.random.default_rng(4)
    chance = by_chance()
    for n, shared in ((2, 1), (7, 6), (30, 27), (100, 85), (400, 300), (5000, 4700)):
        agree = []
        for _ in range(60):
            pool = rng.integers(0, 2**64, 2 * n - shared, dtype=np.uint64)
            a, b = np.sort(pool[:n]), np.sort(pool[n - shared:])
            one, two = sketches(np.concatenate((a, b)), np.array([0, n, 2 * n]))
            agree.append(float(estimates(one, two, np.array([n]), np.array([n]), chance)[0]))
        true = shared / (2 * n - shared)
        assert abs(np.mean(agree) - true) < 4 * (true * (1 - true) / REGISTERS / 60) ** 0.5 + 0.01
    a, b = rng.integers(0, 2**64, (2, 200_000), dtype=np.uint64)
    one, two = sketches(np.concatenate((a, b)), np.arange(0, 400_001, 50))[::2], sketches(np.concatenate((a, b)), np.arange(0, 400_001, 50))[1::2]
    by_count = (one == two).mean()
    assert abs(by_count - chance[11, 11]) < 0.0003


def test_similarity_is_exact_at_the_border():
    assert similar(np.arange(85), np.arange(100)) and not similar(np.arange(84), np.arange(100))
    assert digest(np.array([1, 2], np.uint64)) != digest(np.array([1, 3], np.uint64)) and len(digest(np.array([1], np.uint64))) == 16


def test_tiles_of_a_hot_bucket_meet_wherever_components_differ(spark):
    rows = [(1, i, 7 if i < 300 else i, 1) for i in range(320)] + [(2, i, 5, 1) for i in range(50)] + [(3, i, i, 40) for i in range(9)]
    members = spark.createDataFrame(rows, "key bigint, id bigint, component bigint, weight bigint")
    numbered, pairs = tile_pairs(members, Kept(spark, "t"), 16, 100)
    of = {(r.key, r.id): (r.tile, r.component) for r in numbered.collect()}
    met = {(r.key, r.tile, r.other) for r in pairs.collect()}
    assert {k for k, _ in of} == {1, 3}
    for (k, i), (t, c) in of.items():
        for (m, j), (u, d) in of.items():
            assert k != m or c == d or (k, min(t, u), max(t, u)) in met
    assert max(r.n for r in numbered.groupBy("key", "tile").agg(F.count(F.lit(1)).alias("n")).collect()) < 48
    own = {t for (k, i), (t, c) in of.items() if (k, c) == (1, 7)}
    assert not any(k == 1 and t in own and u in own for k, t, u in met)
