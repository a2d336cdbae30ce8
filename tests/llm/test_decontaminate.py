import random
from collections import Counter

import numpy as np

from recon.llm.decontaminate import RADIUS, Index, Prints, leaks, spare_words, split_words, window_prints, without_leaks, word_hashes

DOCS, ITEMS = "doc_id bigint, text string, item_id string, similarity string", "item_id bigint, text string, doc_id string"


def grams(words, width):
    return Counter(tuple(words[i:i + width]) for i in range(len(words) - width + 1))


def slow(docs, items):
    """Every window of every item's size against the item, by similarity alone."""
    out = {}
    for d, t in docs:
        words = split_words(t)
        for i, it in items:
            own = split_words(it)
            n, width = min(len(own), len(words)), min(5, len(own))
            if not own or len(words) < width:
                continue
            b = grams(own, width)
            best = max((a & b).total() / (a | b).total() for s in range(len(words) - n + 1) for a in [grams(words[s:s + n], width)])
            if best >= 0.8:
                out[d, i] = best
    return out


def cases():
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(30)] + ["é", "the", "of"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 5, 12, 60, 90, 300])))) for k in range(40)] + [(50, ""), (51, None), (52, "v1 v2 v3 v4 v5"), (53, "v1 v2 v3 v4 v5"), (54, "ab ab ab ab ab ab ab ab")]
    docs = [(0, None), (1, ""), (2, " \n "), (3, "ab " * 4000)]
    for k, t in items[:40]:
        words = (t or "").split(" ")
        near = list(words)
        if len(near) > 50:
            near[len(near) // 2] = "other"
            near.insert(7, "more")
        for j, w in enumerate((words, near, words[:len(words) * 9 // 10], rng.sample(words, len(words)))):
            docs.append((10 * k + j + 10, "\n".join(["Before", *rng.choices(vocabulary, k=rng.choice([0, 30]))]) + " " + "  ".join(w).upper() + "\tafter"))
    return docs, items


def test_every_similar_window_is_found(spark):
    docs, items = cases()
    want = slow(docs, items)
    rows = leaks(spark.createDataFrame([(d, t, "x", "y") for d, t in docs], DOCS), spark.createDataFrame([(i, t, "z") for i, t in items], ITEMS), chars_at_once=9000).collect()
    assert len({(r.doc_id, r.item_id) for r in rows}) == len(rows)
    assert {(r.doc_id, r.item_id): r.similarity for r in rows} == want
    assert 45 < len(want)


def test_index_meets_every_fingerprint_within_the_radius():
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(40)]
    index = Index([(0, " ".join(words)), (1, " ".join(words[::-1]))])
    print_ = int(index.prints[0])
    assert print_ == int(window_prints(word_hashes(words), np.array([0]), 40)[0])
    others = np.array([print_ ^ sum(1 << int(f) for f in rng.choice(64, RADIUS, replace=False)) for _ in range(300)], np.uint64)
    at, items = index.met(others, 40)
    assert set(at[items == 0].tolist()) == set(range(300))
    assert RADIUS == 19 and not len(index.met(np.array([print_ ^ (2**64 - 1)], np.uint64), 40)[0])


def test_fingerprints_of_any_windows_are_those_of_whole_texts():
    rng = random.Random(6)
    words = [f"w{rng.randrange(40)}" for _ in range(3000)]
    index = Index([(0, " ".join(f"w{k}" for k in range(20)))])
    prints = Prints(np.array([index.vocabulary.get(w, 0) for w in words], np.uint64), words, index.hashes)
    starts = np.array(sorted(rng.sample(range(2970), 400)))
    assert (prints.of(starts, 30, 7) == [window_prints(word_hashes(words[a:a + 30]), np.array([0]), 30)[0] for a in starts]).all()


def test_windows_that_are_passed_over_are_not_similar():
    rng = random.Random(12)
    for _ in range(3000):
        size = rng.choice([1, 3, 5, 6, 9, 15, 40])
        item = [f"w{rng.randrange(30)}" for _ in range(size)]
        window = list(item) if rng.random() < 0.8 else item[:max(1, size - rng.randrange(4))]
        for _ in range(rng.randrange(4)):
            at = rng.choice([0, len(window) - 1, rng.randrange(len(window))])
            window[at:at + rng.randrange(1, 4)] = ["x"] * len(window[at:at + rng.randrange(1, 4)])
        window = window[:size] or ["x"]
        width = min(5, size)
        if len(window) < width:
            continue
        a, b = grams(window, width), grams(item, width)
        if (a & b).total() / (a | b).total() >= 0.8:
            assert window.count("x") <= spare_words(len(window), size)


def test_filter_keeps_clean_documents_whole(spark):
    text = " ".join(f"q{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"so {text} on", "a", "b"), (2, "clean text here " * 50, "a", "b"), (None, text, "a", "b"), (None, "clean", "a", "b"), (2, text, "a", "b")], DOCS)
    items = spark.createDataFrame([(1, text, "c")], ITEMS)
    left = without_leaks(docs, items)
    assert left.columns == docs.columns and sorted(r.text for r in left.collect()) == sorted(["clean", "clean text here " * 50])
    assert without_leaks(docs, items.limit(0)).count() == 5
    assert leaks(docs.limit(0), items).count() == 0


def test_windows_just_above_the_limit_are_found():
    rng = random.Random(21)
    met = found = 0
    for size, cut in ((15, 1), (50, 5), (100, 10), (300, 32)):
        items = [(k, " ".join(f"w{rng.randrange(5000)}" for _ in range(size))) for k in range(150)]
        index = Index(items)
        for k, text in items:
            words = text.split(" ")[:size - cut] + [f"x{rng.randrange(5000)}" for _ in range(cut)]
            want = slow([(0, " ".join(words))], [(k, text)])[0, k]
            got = {i: s for i, _, _, s, _ in index.search("so it began " + " ".join(words) + " and ended")}
            assert want < 0.84 and got.get(k, want) == want
            met, found = met + 1, found + (k in got)
    assert met == 600 and found >= 598


def test_refrains_are_found_however_they_are_rotated():
    """Windows of 0.8 or more that are refrains of two to four words, against items that are: none is lost to the fingerprints."""
    rng = random.Random(5)
    lost = cases = 0
    for _ in range(120):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(2, 5))]
        item = (words * 20)[:rng.randrange(15, 40)]
        turn = rng.randrange(len(words))
        window = (words[turn:] + words * 20)[:len(item)]
        want = slow([(0, " ".join(window))], [(0, " ".join(item))])
        if want:
            cases += 1
            lost += not Index([(0, " ".join(item))]).search("before it " + " ".join(window) + " after it")
    assert cases > 60 and lost == 0
