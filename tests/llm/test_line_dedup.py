import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from recon.llm.line_dedup import AGREE, BANDS, ROWS, SHINGLE, agreeing, bands, dedup_lines, marks, minima, shingle_codes, similar, tile_links, without_lines

SCHEMA = "doc_id bigint, text string, removed string, copy string"


def shingle_set(line):
    return {line[i:i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def slow(rows):
    """Every line against every other; the first of each component stays."""
    lines = [((i is None, i or 0, t, k), i, x.strip(" \t\n\x0b\x0c\r")) for i, t in set(rows) for k, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\x0b\x0c\r")]
    texts = sorted({x for *_, x in lines})
    sets, root = {x: shingle_set(x) for x in texts}, {x: x for x in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and jaccard(sets[a], sets[b]) >= 0.8:
                root[find(a)] = find(b)
    groups = {}
    for place, i, x in lines:
        groups.setdefault(find(x), []).append((place, i))
    out = Counter()
    for members in groups.values():
        members.sort(key=lambda m: m[0][:2] + (m[0][3],))
        out[len(members)] += 1
    return {frozenset((i, place[3]) for place, i in g) for g in groups.values() if len(g) > 1}


def corpus():
    rng = random.Random(7)
    vocabulary = [f"{a}{b}{i}" for i, (a, b) in enumerate(zip("abcdefghijklmnop" * 9, "uvwxyzklmn" * 15))]
    line = lambda n: " ".join(rng.choices(vocabulary, k=n))
    common = [line(12) for _ in range(6)]
    rows = []
    for i in range(90):
        lines = [line(rng.choice([1, 3, 20])) for _ in range(4)]
        for c in common[: rng.randrange(4)]:
            w = c.split()
            if rng.random() < 0.6:
                w[rng.randrange(len(w))] = "zz"
            lines.insert(rng.randrange(len(lines)), "  " + " ".join(w) + "\r")
        rows.append((i, "\n".join(lines + ["", " \t"])))
    return rows + [(200, None), (201, ""), (202, "\n\n"), (203, "short"), (204, "short\nshort"), (205, "x" * 30000 + "\n" + "x" * 30001), (206, "日本語のテキスト行です\n日本語のテキスト行です")]


def test_components_are_those_of_brute_force(spark):
    rows = corpus()
    got = dedup_lines(spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA).repartition(5)).collect()
    want = slow(rows)
    gone = {(r.doc_id, x.line_no): x.kept_doc for r in got for x in r.removed}
    for group in want:
        stay = [m for m in group if m not in gone]
        assert stay == [min(group)], group
        assert all(gone[m] == stay[0][0] for m in group if m != stay[0])
    assert len(gone) == sum(len(g) - 1 for g in want)
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and [by[i].n_lines for i in (200, 201, 202, 203)] == [0, 0, 0, 1]
    assert all(r.n_kept == r.n_lines - len(r.removed) for r in got)


def test_similar_lines_share_a_band_and_agree():
    rng = random.Random(2)
    hits = total = 0
    for _ in range(600):
        a = "".join(rng.choices("abcdefghij", k=rng.choice([60, 120, 400])))
        b = list(a)
        for _ in range(max(1, len(a) // 60)):
            b[rng.randrange(len(b))] = "Z"
        b = "".join(b)
        if jaccard(shingle_set(a), shingle_set(b)) >= 0.8:
            least = minima([a, "other line", b])
            x, m = bands(least), marks(least)
            same = (m[0].view(np.uint8) == m[2].view(np.uint8)).sum()
            total, hits = total + 1, hits + bool((x[0] == x[2]).any() and same >= AGREE)
    assert total > 200 and hits / total > 0.985
    # The marks tell lines apart: they agree about as often as the lines are similar.
    texts = ["".join(rng.choices("abcdefghijklmnopqrst", k=300)) for _ in range(30)]
    seen = marks(minima(texts)).view(np.uint8)
    assert max((seen[i] == seen[j]).sum() for i in range(30) for j in range(i)) < AGREE / 4
    alone = np.stack([bands(minima([t]))[0] for t in ("abc", "x" * 50, "é日🙂" * 9)])
    assert (bands(minima(["abc", "x" * 50, "é日🙂" * 9])) == alone).all() and alone.shape == (3, BANDS)


def test_long_lines_are_cut_without_a_change(monkeypatch):
    import recon.llm.line_dedup as module

    rng = random.Random(4)
    lines = ["".join(rng.choices("abcdef ", k=k)) for k in (1, 4, 5, 6, 99, 100, 101, 5000)]
    whole = minima(lines)
    monkeypatch.setattr(module, "SLICE", 96)
    assert (minima(lines) == whole).all()


def test_codes_are_the_sets_of_shingles():
    rng = random.Random(8)
    wide = [chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(9000)]
    for letters in ("ab", "abcdefghij é", wide, [chr(c) for c in range(0x20, 0x3000)] + ["🙂", "\0", "\ud800"]):
        lines = ["".join(rng.choices(letters, k=rng.choice([1, 2, 4, 5, 6, 30, 300, 4000]))) for _ in range(60)]
        lines += [x[: len(x) // 2] + "#" + x[len(x) // 2 + 1:] for x in lines] + ["ab", "ab\0\0\0", "abc"]
        codes, sets = shingle_codes(lines), [shingle_set(x) for x in lines]
        assert [len(c) for c in codes] == [len(s) for s in sets]
        for i in range(0, len(lines), 3):
            for j in range(len(lines)):
                assert similar(codes[i], codes[j]) == (jaccard(sets[i], sets[j]) >= 0.8), (lines[i], lines[j])
    assert shingle_codes([]) == []


def test_small_changes_in_short_lines_are_found(spark):
    """A changed character in 50 letters or more, a changed word of six letters in 90 or more, are near-equal by their shingles."""
    rng = random.Random(5)
    word = lambda k: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=k))
    rows, expect = [], {}
    for i in range(150):
        ws = [word(6) for _ in range(rng.randrange(5, 14))]
        line = " ".join(ws)
        if i % 2:
            at = rng.randrange(len(line))
            other = line[:at] + "#" + line[at + 1:]
        else:
            ws[rng.randrange(len(ws))] = word(6)
            other = " ".join(ws)
        rows += [(2 * i, line), (2 * i + 1, other)]
        expect[2 * i + 1] = jaccard(shingle_set(line), shingle_set(other)) >= 0.8
        if len(line) >= (50 if i % 2 else 91):
            assert expect[2 * i + 1]
    got = {r.doc_id: r.n_kept == 0 for r in dedup_lines(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)).collect()}
    missed = [i for i, near in expect.items() if near and not got[i]]
    assert sum(expect.values()) > 60 and len(missed) <= 2
    assert not [i for i, near in expect.items() if got[i] and not near]


def test_agreement_in_columns_is_that_of_the_bytes(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**32, (40, BANDS * ROWS), dtype=np.uint32)
    b = np.where(rng.random(a.shape) < 0.5, a, rng.integers(0, 2**32, a.shape, dtype=np.uint32)).astype(np.uint32)
    want = (marks(a).view(np.uint8) == marks(b).view(np.uint8)).sum(axis=1)
    rows = spark.createDataFrame([(x.tolist(), y.tolist()) for x, y in zip(marks(a), marks(b))], "a array<bigint>, b array<bigint>")
    assert [r[0] for r in rows.select(agreeing(F.col("a"), F.col("b"))).collect()] == want.tolist()


def family(rng, n, base, changes):
    """Variants of a line of words, each with some words changed: many pairs are just below or above the border."""
    out = []
    for _ in range(n):
        ws = list(base)
        for k in rng.sample(range(len(ws)), changes):
            ws[k] = "".join(rng.choices("qrstuvw", k=5))
        out.append(" ".join(ws))
    return out


def test_hot_buckets_of_several_tiles_lose_no_link(spark, monkeypatch):
    """A family with so many variants that its buckets have many tiles. Every link that brute force finds among lines that share a
    band and agree enough must be in one component, and no more."""
    import recon.llm.line_dedup as module

    monkeypatch.setattr(module, "TILE", 16)
    rng = random.Random(9)
    base = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(30)]
    lines = sorted({*family(rng, 220, base, 3), *family(rng, 120, base, 5), *family(rng, 60, base, 1)})
    rng.shuffle(lines)
    least = minima(lines)
    keys, seen, sets = bands(least), marks(least).view(np.uint8), [shingle_set(x) for x in lines]
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(lines)):
        for j in range(i):
            if (keys[i] == keys[j]).any() and (seen[i] == seen[j]).sum() >= AGREE and jaccard(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = Counter(find(i) for i in range(len(lines)))
    got = dedup_lines(spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(lines)], SCHEMA).repartition(4)).collect()
    kept_doc = {r.doc_id: r.removed[0].kept_doc if r.removed else r.doc_id for r in got}
    assert {i: find(i) for i in range(len(lines))} == kept_doc
    assert 3 < len(want) < len(lines) and max(want.values()) > 64


def test_a_pair_is_verified_in_its_first_band_alone():
    line = "the same words again and again in one long line of text"
    least = minima([line, line + "."])
    keys, seen = bands(least).view(np.int64), marks(least)
    texts = [line, line + "."]
    tile = lambda i: {"component": np.array([i]), "keys": keys[i:i + 1], "marks": seen[i:i + 1], "line": lambda at: [texts[i] for _ in at]}
    shared = [k for k in keys[0].tolist() if k in keys[1].tolist()]
    assert len(shared) > 1
    assert [bool(tile_links(tile(0), tile(1), k)) for k in shared] == [True] + [False] * (len(shared) - 1)


def test_copies_nulls_and_cleaned_texts(spark):
    text = "a line that is long enough to compare\nand another line of its own here"
    rows = [(5, text), (5, text), (None, text), (3, "first\n\nand another line of its own here.")]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    judged = dedup_lines(docs)
    got = sorted((r.doc_id or 99, r.copy, r.n_kept) for r in judged.collect())
    assert got == [(3, 1, 2), (5, 1, 1), (5, 2, 0), (99, 1, 0)]
    clean = without_lines(docs.where("doc_id = 3 or doc_id is null"), judged)
    assert clean.columns == docs.columns and {r.doc_id: r.text for r in clean.collect()} == {3: rows[3][1], None: ""}
    assert dedup_lines(docs.where(F.lit(False))).count() == 0
