import random
from collections import Counter

from pyspark.sql import functions as F

from recon.operators import codes, dims, match, rounds


def test_names_are_never_guessed(spark):
    left = spark.createDataFrame([(1, "가 나"), (2, "다·라"), (3, "마(신규)"), (4, "두 번"), (5, "없음")], "id int, name string")
    right = spark.createDataFrame([(10, "가 나"), (20, "다라"), (30, "마"), (40, "두번"), (41, "두 번 "), (42, "두  번")], "rid int, rname string")
    got = {r.id: (r.match, r.tier) for r in match.name_join(left, right, "name", "rid", "rname").collect()}
    assert got == {1: (10, 1), 2: (20, 2), 3: (30, 3), 4: (41, 1), 5: (None, None)}


def test_amounts_match_if_there_is_one(spark):
    a = spark.createDataFrame([(1, 10.0), (2, 50.0), (3, None)], "l int, x double")
    b = spark.createDataFrame([(7, 11.0), (8, 49.5), (9, 50.9), (10, None)], "r int, y double")
    assert [tuple(r) for r in match.amount_join(a, b, "l", "x", "r", "y").collect()] == [(1, 7)]


def test_rows_without_a_code_take_what_coded_ones_leave(spark):
    cols = "name string, amount int, code string"
    made = spark.createDataFrame([("a", 1, ""), ("a", 1, "X"), ("b", 2, "Y"), ("c", 3, "Z")], cols)
    got = spark.createDataFrame([("a", 1, "X"), ("a", 1, "W"), ("b", 2, "Q"), ("c", 3, "Z")], cols)
    rows = match.diff_one_to_one(made, got, ["name", "amount"], "code").collect()
    assert {(r.name, r.code, r.side) for r in rows} == {("b", "Y", "made"), ("b", "Q", "got")}


def greatest(left, right, near):
    """How many pairs the greatest matching has, by augmenting paths."""
    partner = {}

    def find(i, seen):
        for j, y in enumerate(right):
            if j not in seen and near(left[i], y):
                seen.add(j)
                if j not in partner or find(partner[j], seen):
                    partner[j] = i
                    return True
        return False

    return sum(find(i, set()) for i in range(len(left)))


def test_as_many_amounts_are_paired_as_can_be(spark):
    rng, left, right = random.Random(2), [], []
    for key in [None, *range(60)]:
        spread = rng.choice([1, 3, 10, 2000])
        left += [(key, rng.choice([round(rng.random() * spread, 2), None, -3.0]) if rng.random() < 0.9 else 0.25) for _ in range(rng.randrange(9))]
        right += [(key, rng.choice([round(rng.random() * spread, 2), None, -3.4]) if rng.random() < 0.9 else 0.25) for _ in range(rng.randrange(9))]
    a, b = (spark.createDataFrame(x, "k int, amount double") for x in (left, right))
    got = [tuple(r) for r in match.multiset_gap(a, b, "amount").collect()]
    for key in [None, *range(60)]:
        sides = [[x for k, x in rows if k == key] for rows in (left, right)]
        near = lambda x, y: x is None and y is None or None not in (x, y) and abs(x - y) < 0.5
        pairs = greatest(*sides, near)
        lost, more = ([x for k, x, s in got if k == key and s == side] for side in ("left", "right"))
        assert len(lost) == len(sides[0]) - pairs and len(more) == len(sides[1]) - pairs
        assert not Counter(lost) - Counter(sides[0]) and not Counter(more) - Counter(sides[1]) and greatest(lost, more, near) == 0
    pieces = match.multiset_gap(spark.createDataFrame([(1, 1.05), (1, 1.40)], "k int, amount double"), spark.createDataFrame([(1, 1.58)], "k int, amount double"), "amount").collect()
    assert [(r.amount, r.side) for r in pieces] == [(1.05, "left")] or [(r.amount, r.side) for r in pieces] == [(1.40, "left")]
    assert match.multiset_gap(a.limit(0), b.limit(0), "amount").count() == 0


def test_a_key_with_very_many_amounts_is_cut_into_runs(spark):
    a = spark.range(20_000).select(F.lit("hot").alias("k"), (F.col("id") * 2).cast("double").alias("amount"))
    b = a.where("amount % 10 <> 0").select("k", (F.col("amount") + 0.25).alias("amount")).union(a.limit(1).select("k", F.lit(-7.0)))
    got = match.multiset_gap(a, b, "amount")
    assert got.groupBy("side").count().orderBy("side").collect() == [("left", 4000), ("right", 1)]
    runs = match._runs(a.withColumns({"n_l": F.lit(1), "n_r": F.lit(0)}), ["k"], "amount", 0.5)
    assert runs.select("_run").distinct().count() == 20_000


def test_rows_of_near_amounts_answer_each_other_by_code(spark):
    cols = "name string, code string, amount double"
    made = spark.createDataFrame([("a", "", 1.0), ("a", "X", 1.3), ("a", None, 5.0), ("b", "Y", 2.0), ("c", "Z", 3.0)], cols)
    got = spark.createDataFrame([("a", "X", 1.0), ("a", "W", 1.2), ("a", "V", 5.6), ("b", "Y", 2.5), ("c", "Z", 3.4)], cols)
    rows = match.diff_one_to_one(made, got, ["name"], "code", "amount").collect()
    assert {(r.name, r.code, r.amount, r.side) for r in rows} == {("a", "", 5.0, "made"), ("a", "V", 5.6, "got"), ("b", "Y", 2.0, "made"), ("b", "Y", 2.5, "got")}


def test_prefix_cards(spark):
    projects = spark.createDataFrame([(1, "유-보-초 이음교육 운영"), (2, "영유아교육내실화 지원"), (3, "다른 것")], "project_no int, name string")
    cards = spark.createDataFrame([(5, "유보초이음교육운영(특교포함)"), (6, "영유아교육내실화"), (7, "놀고 있음")], "card_no int, name string")
    out = dims.assign_cards(projects, cards)
    assert {r.project_no: (r.card, r.matched) for r in out.collect()} == {1: ("유보초이음교육운영(특교포함)", True), 2: ("영유아교육내실화", True), 3: ("다른 것", False)}
    assert {tuple(r) for r in dims.card_coverage(out, cards).collect()} == {("다른 것", "project"), ("놀고 있음", "card")}


FORM = "name string, parent string, account string, code7 string"


def test_parent_decides_and_ambiguity_stops(spark):
    learned = codes.learn(spark.createDataFrame([("(1) 기본", "강사수당", "", "2100605"), ("기본", "심사수당", "", "2100607"), ("물", "", "수용비", "2100143"), ("불", "", "", "2100122")], FORM))
    items = spark.createDataFrame([(1, "210-06", "기본", "강사수당", ""), (2, "210-06", "기본", "", ""), (3, "21001", "흙", "", "수용비"), (4, "21001", "흙", "", ""), (5, "99999", "x", "", ""), (6, "", "기본", "심사수당", ""), (7, "", "기본", "", ""), (8, "", "물", "", "")],
                                  "i int, code5 string, name string, parent string, account string")
    got = {r.i: (r.code7, r.source) for r in codes.resolve(items, learned).collect()}
    assert got == {1: ("2100605", "parent"), 2: (None, "several by name"), 3: ("2100143", "account"), 4: (None, "several by code"), 5: (None, "unknown code"), 6: ("2100607", "parent only"), 7: (None, "several by name only"), 8: ("2100143", "name only")}
    over = spark.createDataFrame([("21006", "기본", "1111111"), ("21001", None, "2222222"), (None, "강사수당 > 기본", "3333333")], "code5 string, name string, code7 string")
    again = codes.decide(codes.resolve(items.withColumn("code5", F.regexp_replace("code5", "-", "")), learned), over)
    by = {r.i: (r.code7, r.source) for r in again.collect()}
    twice = codes.decide(codes.resolve(items.withColumn("code5", F.regexp_replace("code5", "-", "")), learned), over.union(over).union(spark.createDataFrame([("21006", "기본", "9999999")], over.schema)))
    other = {r.i: (r.code7, r.source) for r in twice.collect()}
    assert twice.count() == items.count() and other[4] == ("2222222", "decided") and other[2] == (None, "several by name")
    assert by[2] == ("1111111", "decided") and by[4] == ("2222222", "decided") and by[7] == (None, "several by name only")


def test_more_years_never_resolve_less(spark):
    rows = [(f"n{i % 40}", f"p{i % 7}", "", f"21{i % 9:03d}{i % 2:02d}") for i in range(300)]
    items = spark.createDataFrame([(i, f"21{i % 9:03d}", f"n{i % 40}", f"p{i % 7}", "") for i in range(300)], "i int, code5 string, name string, parent string, account string")
    known = [codes.resolve(items, codes.learn(spark.createDataFrame(rows[:k], FORM))).where("source <> 'unknown code'").count() for k in (5, 40, 300)]
    assert known == sorted(known) and known[-1] == 300


def test_continuity_is_one_directional(spark):
    now = spark.createDataFrame([("a", 10.0), ("b", 5.0), ("c", 0.0), ("d", 7.0)], "k string, before double")
    then = spark.createDataFrame([("a", 10.0), ("b", 6.0), ("gone", 9.0)], "k string, closing double")
    assert {(r.k, r.problem) for r in rounds.continuity(now, then, ["k"]).collect()} == {("b", "differs"), ("d", "not in the round before")}
    files = spark.createDataFrame([(2025, 1, "old", 1), (2025, 1, "new", 2), (2025, 2, "x", 3)], "year int, round int, path string, modified int")
    assert {r.path: r.previous for r in rounds.previous_round(files).collect()} == {"old": None, "new": None, "x": "new"}
