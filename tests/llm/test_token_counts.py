import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from recon.llm.token_counts import PieceCounts, Tree, byte_bpe, derived_edits, pieces, with_edits, with_trees

SCHEMA = "doc_id bigint, text string, lang string, before string"
POOL = ["word", "Größe", "it's", "don't", "12.5", "a--b", "!!!", "x", " ", "é", "日本", "🙂", "<|endoftext|>", "\x1c", "\x85", "'s", "we'll", "--"]
GAPS = [" ", "  ", "\n", " \n ", "\t", "   ", "", "\r\n"]


@pytest.fixture(scope="module")
def slow():
    tokenizer = Tokenizer.from_file(byte_bpe())
    return lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids)


def text(rng, n):
    return "".join(rng.choice(POOL) + rng.choice(GAPS) for _ in range(n))


def test_pieces_are_encoded_as_the_whole_is(slow):
    rng, counter = random.Random(2), PieceCounts(byte_bpe(), room=40)
    for t in ["", " ", "  a", "a  ", "\n\n", *(text(rng, rng.randrange(60)) for _ in range(400))]:
        ps = pieces(t)
        assert "".join(ps) == t and sum(counter.counts(ps)) == slow(t), repr(t)


def test_any_edits_give_the_count_of_the_new_text(slow):
    rng, counter = random.Random(3), PieceCounts(byte_bpe())
    for case in range(120):
        t = text(rng, rng.choice([0, 1, 5, 200]))
        tree = Tree.of(t, counter, leaf_chars=rng.choice([1, 8, 40]))
        assert tree.total == slow(t) and tree.chars[1] == len(t)
        for _ in range(12):
            start, removed, new = rng.randrange(len(t) + 3), rng.choice([0, 1, 2, 30, 10**6 if case % 40 == 0 else 3]), rng.choice(["", " ", "x", "\n", text(rng, 3), "'s"])
            want = t[:start] + new + t[min(len(t), start) + removed:]
            t, leaves, chars = tree.edit(t, start, removed, new, counter)
            assert t == want and tree.total == slow(t) and tree.chars[1] == len(t) == sum(c for c, _ in tree.leaves)
            assert tree.tokens[1] == sum(tree.tokens[tree.first:]) and leaves <= tree.first and chars <= len(t)


def test_an_edit_renews_few_leaves(slow):
    rng, counter = random.Random(4), PieceCounts(byte_bpe())
    t = " ".join(rng.choices(["alpha", "beta", "gamma"], k=20000))
    tree = Tree.of(t, counter)
    t, leaves, chars = tree.edit(t, 50_000, 10, "delta", counter)
    assert leaves <= 3 and chars < 4 * 512 and tree.total == slow(t)


def test_many_edits_at_one_place_keep_leaves_small(slow):
    rng, counter = random.Random(6), PieceCounts(byte_bpe())
    t = " ".join(rng.choices(["alpha", "beta", "gamma"], k=4000))
    tree = Tree.of(t, counter)
    for _ in range(200):
        t, _, _ = tree.edit(t, 9_000, 0, " some more words here", counter)
    assert tree.total == slow(t) and max(c for c, _ in tree.leaves) < 2 * 512
    t, leaves, chars = tree.edit(t, 9_000, 5, "x", counter)
    assert leaves <= 4 and chars <= 3 * 512 and tree.total == slow(t)
    for _ in range(300):  # and the way back
        t, leaves, _ = tree.edit(t, 2_000, 80, "", counter)
        assert leaves <= 4
    assert tree.total == slow(t) and tree.first <= 128


def test_operator_over_a_table(spark, slow):
    rng = random.Random(5)
    rows = [(i, text(rng, rng.randrange(300)), "x", "y") for i in range(60)] + [(100, None, "x", "y"), (101, "", "x", "y"), (None, "no id", "x", "y"), (5, "again", "x", "y")]
    docs = derived_edits(spark.createDataFrame(rows, SCHEMA))
    got = with_edits(with_trees(docs, byte_bpe()), byte_bpe()).collect()
    want = []
    for r in docs.collect():
        t = r.text or ""
        for e in r.edits:
            a = min(e.start, len(t))
            t = t[:a] + e.inserted + t[a + e.removed:]
        want.append((r.doc_id, slow(r.text), slow(t), t))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.before, r.after, r.text)) for r in got)
    assert with_edits(with_trees(docs.limit(0), byte_bpe()), byte_bpe()).count() == 0
    none = with_edits(with_trees(docs, byte_bpe()).withColumn("edits", F.lit(None).cast(docs.schema["edits"].dataType)), byte_bpe())
    assert none.where("before <> after or encoded_leaves > 0").count() == 0
