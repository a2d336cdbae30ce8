import random
import re
from collections import Counter, defaultdict

import pytest

from recon.llm.mixing import mixed_documents, schedule, taken, targets

SCHEMA = "doc_id bigint, text string, source string, lang string, n_chars bigint, target string, slot string, size string"


def n_words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def slow_targets(sizes, weights=(5, 2, 1), share=1.5, passes=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(passes * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        t = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if t[s] > passes * sizes[s]}
        if not over:
            return {s: float(passes * sizes[s]) if s in full else t[s] for s in names}
        full |= over


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, "en", len(t or ""), "x", "y", "z") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = []
    for i in range(600):
        source = rng.choice(["hot"] * 6 + ["a", "b", "Ä", "z", "tiny", None])
        if source == "tiny" and i > 30:
            source = "hot"
        out.append((i, " ".join(rng.choices(["one", "two\n", "three"], k=rng.choice([0, 1, 5, 50, 400 if i % 50 == 0 else 20]))), source))
    return out + [(700, None, "a"), (None, "no id at all", "b"), (701, "same row", "b"), (701, "same row", "b"), (702, "", "nothing")]


def test_targets_and_words_taken(spark, rows):
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += n_words(t)
    want = slow_targets(sizes)
    docs = table(spark, rows)
    got = taken(docs, block=64).collect()
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((i, s, n_words(t)) for i, t, s in rows)
    by = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r["size"]
        by[r.source] += r.taken
    assert {s: by[s] for s in want} == {s: round(want[s]) for s in want}
    again = taken(docs.repartition(3), block=64).collect()
    assert Counter(map(tuple, [(r.doc_id, r.taken) for r in again])) == Counter((r.doc_id, r.taken) for r in got)


def test_slots_are_filled_once_and_near_their_weights(spark, rows):
    docs = table(spark, rows)
    pieces = [r for r in schedule(docs, block=32).collect() if r.slot is not None]
    filled = defaultdict(list)
    for r in pieces:
        filled[r.slot].append(r)
    assert all(len({r.source for r in rs}) == 1 and sum(r.n_words for r in rs) <= 32 for rs in filled.values())
    assert sum(len({r.source for r in rs}) for rs in filled.values()) == len(filled)
    order = [filled[s][0].source for s in sorted(filled)]
    total = sum(r.target for r in {r.source: r for r in pieces}.values())
    for name, share in {r.source: r.target / total for r in pieces}.items():
        for upto in (50, len(order) // 2):
            assert abs(order[:upto].count(name) - share * upto) < 5
    for r in pieces:
        assert 0 <= r.first_word and r.first_word + r.n_words <= r["size"]


def test_documents_of_the_mix(spark, rows):
    docs = table(spark, rows)
    mixed = mixed_documents(docs, block=64)
    assert mixed.columns == docs.columns
    want = Counter()
    for r in taken(docs, block=64).collect():
        want[r.doc_id] += r.taken
    got = Counter()
    for r in mixed.collect():
        got[r.doc_id] += n_words(r.text)
    differ = {k for k in want if want[k] != got[k]}
    assert differ <= {701}  # two rows alike share what they got


def test_empty_table(spark):
    assert taken(table(spark, []).limit(0)).count() == 0
    assert mixed_documents(table(spark, []).limit(0)).count() == 0
    assert targets(spark.createDataFrame([(None, 0)], "source string, size bigint")).first().target == 0


def test_driver_gets_no_table_but_the_sources(spark, rows):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(schedule(table(spark, rows), block=32)).count("BroadcastHashJoin") == 1
    assert "BroadcastHashJoin" not in plan(mixed_documents(table(spark, rows), block=32))
