import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from recon.llm.language_id import Models, Sorted, fit, gram_counts, gram_hashes, identify, keep_identified, normalised, predict, stored_levels

SCHEMA = "doc_id bigint, text string, lang string, score string, held_out string"
SYLLABLES = {"aa": ["ta", "mi", "ro", "ka", "lu"], "bb": ["sch", "ung", "ein", "ö", "ver"], "cc": ["ión", "que", "lla", "ñe", "ado"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, lang, rng.choice([1, 5, 40])) + rng.choice([" 12!", "\n##", ""]), lang, "x", "y") for i in range(400) for lang in [rng.choice("abc") * 2]]
    rows += [(1000, None, "aa", "x", "y"), (1001, "", "bb", "x", "y"), (1002, "12 34 !!", "cc", "x", "y"), (1003, prose(rng, "aa", 30), None, "x", "y"), (None, prose(rng, "bb", 30), "bb", "x", "y"), (5, "tami", "aa", "x", "y"), (1004, "zzxq wwvv jjkk pqpq " * 40, "aa", "x", "y"), (1005, prose(rng, "cc", 20000), "cc", "x", "y")]
    return spark.createDataFrame(rows, SCHEMA)


def slow_model(texts, order):
    """Interpolated Kneser-Ney from dictionaries: a function of (context, character)."""
    counts = Counter()
    for t in texts:
        if t:
            padded = " " * (order - 1) + t + " "
            counts.update(padded[i:i + order] for i in range(len(padded) - order + 1))
    levels = {order: counts}
    for m in range(order - 1, 0, -1):
        levels[m] = Counter(g[1:] for g in levels[m + 1])
    discount, context = {}, {}
    for m, c in levels.items():
        once, twice = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        discount[m] = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
        context[m] = defaultdict(lambda: [0, 0])
        for g, v in c.items():
            context[m][g[:-1]][0] += v
            context[m][g[:-1]][1] += 1

    def p(ctx, ch, m=order):
        if m == 0:
            return 1 / (len(levels[1]) + 1)
        ctx = ctx[len(ctx) - (m - 1):] if m > 1 else ""
        lower = p(ctx[1:] if ctx else "", ch, m - 1)
        if ctx not in context[m]:
            return lower
        total, kinds = context[m][ctx]
        return max(0, levels[m][ctx + ch] - discount[m]) / total + discount[m] * kinds / total * lower

    return p, levels[1]


def counted(texts, order):
    c = Counter()
    for t in texts:
        padded = " " * (order - 1) + t + " "
        c.update(padded[i:i + order] for i in range(len(padded) - order + 1))
    return c


def models_of(spark, texts, order=5, **options):
    """Models of ``texts`` by language, through Spark."""
    rows = [(k, g, n) for k, ts in texts.items() for g, n in counted(ts, order).items()]
    return Models(*stored_levels(spark.createDataFrame(rows, "lang string, gram string, n bigint"), order, **options), order)


def test_probabilities_against_dictionaries(spark):
    rng = random.Random(1)
    texts = {k: [prose(rng, k, 30) for _ in range(20)] for k in ("aa", "bb")}
    order = 3
    slow = [slow_model(ts, order) for ts in texts.values()]
    models = models_of(spark, texts, order)
    for text in [*(t for ts in texts.values() for t in ts[:3]), "unseen zq", "ta", "a"]:
        e, n = models.entropies([text])
        padded = " " * (order - 1) + text + " "
        for k, (p, _) in enumerate(slow):
            want = -np.mean([np.log(p(padded[i:i + order - 1], padded[i + order - 1])) for i in range(len(text) + 1)])
            assert e[0, k] == pytest.approx(want, rel=1e-5) and n[0] == len(text) + 1
    p, alphabet = slow[0]
    for ctx in ("ta", "zz", "  ", " m"):
        assert sum(p(ctx, ch) for ch in alphabet) + p(ctx, "☃") == pytest.approx(1)


def test_a_language_beyond_the_bound_keeps_its_estimates(spark):
    """With a bound that most n-grams are over: those stored have the discounted share and lower-order counts of the whole corpus, and
    what isn't stored goes to the lower order, so probabilities add up to one."""
    rng = random.Random(12)
    texts = {"aa": ["".join(rng.choices("abcdefg ", weights=[9, 7, 5, 3, 2, 1, 1, 4], k=400)).strip() for _ in range(8)]}
    order, bound = 3, 60
    p, alphabet = slow_model(texts["aa"], order)
    whole, small = models_of(spark, texts, order), models_of(spark, texts, order, max_grams=bound)
    assert len(whole.found[3].keys) > 3 * bound >= 3 * len(small.found[3].keys) > 0 and len(small.found[1].keys) == len(whole.found[1].keys) == len(alphabet)
    common = set(small.found[3].keys.tolist())
    chars, at, _ = normalised(texts["aa"][:1], order)
    stored = np.array([h in common for h in gram_hashes(chars, at, order).tolist()])
    assert 0.2 < stored.mean() < 1
    for m in (2, 3):  # the stored shares are those of the whole corpus
        place = whole.found[m].find(small.found[m].keys)
        assert (place >= 0).all() and np.allclose(whole.found[m].values[place], small.found[m].values)
    for ctx in ("ab", "ga", "  ", "zz"):
        text = np.array([[ord(x) for x in ctx + ch] for ch in [*alphabet, "☃"]], np.uint32)
        logs = small.logs(text.ravel(), np.arange(2, text.size, 3))
        assert np.exp(logs[:, 0]).sum() == pytest.approx(1)
    assert p("ab", "a") > 0


def test_slices_and_long_texts_change_no_entropy(spark, monkeypatch):
    import recon.llm.language_id as module

    rng = random.Random(2)
    models = models_of(spark, {k: [prose(rng, k, 30) for _ in range(20)] for k in ("aa", "bb")})
    texts = [None, "", "12", *(prose(rng, "aa", n) for n in (1, 3, 400, 5)), "ta " * 3000, "x"]
    whole = models.entropies(texts)
    monkeypatch.setattr(module, "SLICE", 50)
    cut = models.entropies(texts)
    assert np.allclose(whole[0], cut[0]) and (whole[1] == cut[1]).all()


def test_marks_belong_to_words_but_are_no_letters():
    for text, want in [("हिन्दी में", "हिन्दी में "), ("ไทยนี้", "ไทยนี้ "), ("\u0301\u0300", ""), ("e\u0301 \u0301", "e\u0301 \u0301 ")]:
        chars, at, count = normalised([text])
        assert "".join(map(chr, chars[at[:count[1]]])) == want


def test_normalisation_and_arrays():
    for text, want in [("  Ab, c!! ", "ab c "), ("", ""), ("12 !", ""), (None, ""), ("É\n\n9x", "é x "), ("a", "a ")]:
        chars, at, count = normalised([text, "zz"])
        assert "".join(map(chr, chars[at[:count[1]]])) == want and count[2] - count[1] == 3
    keys = np.unique(np.random.default_rng(0).integers(0, 2**64, 5000, dtype=np.uint64))
    rows = Sorted(keys, np.arange(len(keys)))
    assert (rows.find(keys) == np.arange(len(keys))).all() and (rows.find(keys + np.uint64(1)) == -1).all()
    assert len(set(gram_hashes(np.arange(1, 5000, dtype=np.uint32), np.arange(4, 4000), 5).tolist())) == 3996


def test_counts_are_those_of_all_texts(spark, docs):
    got = {(r.lang, r.gram): r.n for r in gram_counts(docs.where("text is not null and lang is not null").repartition(5), 4).collect()}
    want = Counter()
    for r in docs.where("text is not null and lang is not null").collect():
        body = " ".join("".join(ch if ch.isalpha() else " " for ch in r.text.lower()).split())
        padded = f"   {body} " if body else ""
        want.update((r.lang, padded[i:i + 4]) for i in range(max(0, len(padded) - 3)))
    assert got == want


def test_held_out_texts_and_defined_results(spark, docs):
    rows = identify(docs).collect()
    assert len(rows) == docs.count()
    text = {(r.doc_id, r.lang): r.text for r in docs.collect()}
    lang = {r.doc_id: r.lang for r in docs.collect() if r.doc_id not in (5,)}
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    by = {r.doc_id: r for r in rows}
    assert all((by[i].lang_pred, by[i].score, by[i].rejected) == ("und", 0, True) for i in (1000, 1001, 1002))
    known = [r for r in rows if r.doc_id in lang and lang[r.doc_id] and r.lang_pred != "und" and r.doc_id != 1004]
    right = [r.lang_pred == lang[r.doc_id] for r in known if r.held_out]
    assert len(right) > 60 and np.mean(right) > 0.97
    assert by[1004].rejected and not by[1005].rejected and sum(r.rejected for r in known) == 0
    assert text


def test_labels_of_held_out_rows_do_not_matter(spark, docs):
    part = F.crc32(F.col("doc_id").cast("string")) % 4
    other = docs.withColumn("lang", F.when(part == 2, F.lit("zz")).otherwise(F.col("lang")))
    as_rows = lambda d: sorted(map(str, identify(d).collect()))
    assert as_rows(docs) == as_rows(other)


def test_filter_and_empty_tables(spark, docs):
    left = keep_identified(docs)
    assert left.columns == docs.columns
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in left.collect()}
    assert gone == {1000, 1001, 1002, 1004}
    assert identify(docs.limit(0)).count() == 0
    alone = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in identify(alone).collect()} == {"und"}
    assert predict(docs.select("doc_id", "text"), fit(docs)).columns == ["doc_id", "lang_pred", "score", "entropy", "rejected"]


def test_mislabelled_and_junk_texts_do_not_lift_the_limits(spark):
    rng = random.Random(3)
    junk = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz   ", k=n))
    models = models_of(spark, {lang: [prose(rng, lang, 40) for _ in range(60)] for lang in SYLLABLES})
    few = {"aa": 200, "bb": 200, "cc": 8}
    rows = [(prose(rng, lang, rng.choice([1, 5, 40, 300])), lang) for lang, n in few.items() for _ in range(n)]
    clean = [prose(rng, lang, n) for lang in few for n in (1, 2, 5, 40, 300) for _ in range(40)]
    short = [junk(n) for n in (40, 100, 1000) for _ in range(40)]
    for odd in ([], [(junk(5000), "aa"), (junk(5000), "cc"), *((prose(rng, "bb", 300), "aa") for _ in range(10)), *((junk(200), "bb") for _ in range(4))]):
        models.calibrate(*map(list, zip(*rows, *odd)))
        assert models.judge(short)[3].all() and models.judge(clean)[3].mean() < 0.01
