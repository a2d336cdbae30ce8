import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from recon.operators import rollup, tree

ITEMS = "doc_id int, pos int, depth int, name string, amount decimal(20,6), formula string, leaf boolean"


def frame(spark, rows):
    return spark.createDataFrame([(d, p, k, n, None if a is None else Decimal(a), f, bool(f)) for d, p, k, n, a, f in rows], ITEMS)


def random_forest(rng, doc):
    depth, rows = 0, []
    for pos in range(rng.randrange(1, 25)):
        depth = rng.randint(1, min(6, depth + 2))
        rows.append((doc, pos, depth, f"n{pos}", rng.choice([None, 1, 2, 5]), "x" if rng.random() < 0.4 else ""))
    return rows


def slow_parent(rows, i):
    return next((j for j in range(i - 1, -1, -1) if rows[j][2] < rows[i][2]), None)


def slow_children(rows, i):
    out = []
    for j in range(i + 1, len(rows)):
        if rows[j][2] <= rows[i][2]:
            break
        if rows[j][2] == rows[i][2] + 1 and slow_parent(rows, j) == i:
            out.append(j)
    return out


def slow_subtree(rows, i):
    out = []
    for j in range(i + 1, len(rows)):
        if rows[j][2] <= rows[i][2]:
            break
        out.append(j)
    return out


@pytest.fixture(scope="module")
def forests():
    rng = random.Random(1)
    return [random_forest(rng, d) for d in range(120)]


@pytest.mark.parametrize("how", [{}, {"depths": 6}, {"block": 4}])
def test_parents_and_ancestors_of_random_forests(spark, forests, how):
    got = {(r.doc_id, r.pos): r for r in tree.parents(frame(spark, sum(forests, [])), ["doc_id"], **how).collect()}
    for rows in forests:
        for i, r in enumerate(rows):
            assert got[r[0], i].parent == slow_parent(rows, i)
            assert list(got[r[0], i].ancestors) == [j for j in range(i) if i in slow_subtree(rows, j)]


def test_deepest_broken_nodes_of_random_forests(spark, forests):
    got = {(r.doc_id, r.pos): r.verdict for r in rollup.check_children(frame(spark, sum(forests, [])), ["doc_id"]).collect()}
    want = {}
    for rows in forests:
        broken = set()
        for i in range(len(rows) - 1, -1, -1):
            kids, below = slow_children(rows, i), slow_subtree(rows, i)
            if rows[i][4] is None or not kids or any(j in broken for j in below):
                continue
            direct = sum(rows[j][4] or 0 for j in kids)
            leaves = sum(rows[j][4] or 0 for j in below if rows[j][5])
            if abs(direct - rows[i][4]) <= 1:
                continue
            if any(rows[j][5] for j in below) and abs(leaves - rows[i][4]) <= 1:
                want[rows[i][0], i] = "review"
            else:
                broken.add(i)
                want[rows[i][0], i] = "error"
    assert got == want


SOUND = [(0, 0, 1, "section", 10000, ""), (0, 1, 2, "A", 4000, ""), (0, 2, 3, "A1", 4000, "4,000,000원×1건"), (0, 3, 2, "B", 6000, "6,000,000원×1건")]


def test_every_changed_amount_is_caught(spark):
    """One copy of the forest for each row, with five more in that row, in a single job."""
    copies = [(d, p, k, n, a + (5 if d == p else 0), f) for d in range(5) for _, p, k, n, a, f in SOUND]
    items = frame(spark, copies)
    rows = {r.doc_id for r in rollup.check_children(items, ["doc_id"]).collect()}
    leaves = {r.doc_id for r in rollup.check_leaves(items).where("route = 'issue'").collect()}
    assert rows | leaves == {0, 1, 2, 3} and 4 not in rows | leaves


def test_reported_rows_are_silent(spark):
    bad = [r if r[1] != 0 else (0, 0, 1, "section", 10007, "") for r in SOUND]
    items = frame(spark, bad)
    assert [r.pos for r in rollup.check_children(items, ["doc_id"]).collect()] == [0]
    assert rollup.check_children(items, ["doc_id"], reported=items.where("pos = 2").select("doc_id", "pos")).count() == 0


def test_shape_ordinals_paths_and_marks(spark):
    items = frame(spark, [(0, 0, 1, "a", 1, ""), (0, 1, 3, "b", 1, "x"), (0, 2, 2, "c", 1, ""), (0, 3, 2, "d", 1, "x"), (0, 4, 1, "e", 1, "x")])
    assert {(r.pos, r.problem) for r in rollup.check_shape(items, ["doc_id"]).collect()} == {(1, "depth jump"), (2, "nothing below")}
    t = tree.parents(items, ["doc_id"])
    assert {r.pos: r.ordinal for r in tree.sibling_ordinals(t, ["doc_id"]).collect()} == {0: 1, 1: 1, 2: 1, 3: 2, 4: 2}
    assert {r.pos: list(r.path) for r in tree.paths(t, ["doc_id"]).collect()} == {0: ["a"], 1: ["a", "b"], 2: ["a", "c"], 3: ["a", "d"], 4: ["e"]}
    marks = spark.range(1, 7).select(tree.prefix(F.col("id"), F.lit(2)).alias("m")).collect()
    assert [r.m for r in marks] == ["2.", "나.", "2)", "나)", "(2)", "(나)"]
    later = spark.range(1, 30).select("id", tree.prefix(F.lit(2), F.col("id")).alias("m"), tree.prefix(F.lit(9), F.col("id")).alias("deep")).collect()
    assert [r.m for r in later if r.id in (1, 14, 15, 28, 29)] == ["가.", "하.", "거.", "허.", "가."] and later[14].deep == "(거)"


def test_a_wrong_headline_repeated_in_a_row_is_a_review(spark):
    items = frame(spark, SOUND).withColumn("amount", F.when(F.col("pos") == 0, 12000).otherwise(F.col("amount")).cast("decimal(20,6)"))
    heads = items.withColumn("request", F.lit(12000)).withColumn("base", F.lit(10000))
    found = lambda x: [(r.pos, r.verdict) for r in rollup.check_children(x, ["doc_id"], heads=("request", "base")).collect()]
    assert found(heads) == [(0, "review")]
    assert found(heads.withColumn("base", F.lit(11000))) == [(0, "error")]
    assert found(heads.withColumn("request", F.lit(None).cast("int"))) == [(0, "error")]


def test_nulls_repeats_clashing_columns_and_empty_trees(spark):
    items = frame(spark, [(0, 0, 1, "a", 7, ""), (0, 1, 2, "b", None, "x"), (0, 2, 2, "c", 5, "x"), (0, 2, 2, "c", 5, "x"), (None, 0, 1, "d", 1, "")])
    odd = items.withColumns({c: F.lit("x") for c in ("parent", "ancestors", "parent_depth", "verdict", "direct", "children", "at", "self")})
    got = rollup.check_children(odd, ["doc_id"]).collect()
    assert [(r.pos, r.direct, r.verdict) for r in got] == [(0, 10, "error")]
    assert rollup.check_children(odd.where(F.lit(False)), ["doc_id"]).count() == 0 == tree.parents(odd.where(F.lit(False)), ["doc_id"]).count()


def test_the_whole_roll_up_has_one_exchange(spark):
    """Sums, deepest rows and all: nothing is scanned or sorted twice, and nothing is joined."""
    plan = rollup.check_children(frame(spark, SOUND), ["doc_id"], depths=6)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan and plan.count("Window [") == 1


def test_the_query_of_roll_ups_has_few_exchanges(spark):
    from recon.plans.trees import rollup_deepest_only

    plan = rollup_deepest_only(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 8 and plan.count("FileScan parquet") <= 6


def test_forests_of_any_depth_in_blocks_of_any_size(spark):
    rng, rows = random.Random(9), []
    for d, n in ((0, 400), (1, 90), (None, 60), (3, 1)):
        depth = 7
        for i in range(n):
            depth = max(-2, min(40, depth + rng.choice([-9, -3, -2, -1, 0, 1, 1, 2, 3])))
            rows.append((d, 3 * i, depth))
    want = {}
    for d, p, k in rows:
        chain, least = [], k
        for e, q, j in reversed([r for r in rows if r[0] == d and r[1] < p]):
            if j < least:
                chain.append(q)
                least = j
        want[d, p] = chain[::-1]
    items = spark.createDataFrame([*rows, (0, None, 4), (1, 5, None)], "doc_id int, pos bigint, depth int").repartition(5)
    for block in (None, 1, 10, 64, 10_000):
        got = {(r.doc_id, r.pos): r for r in tree.parents(items, ["doc_id"], block=block).where("pos is not null and depth is not null").collect()}
        assert {k: list(r.ancestors) for k, r in got.items()} == want
        assert all(r.parent == (want[k][-1] if want[k] else None) for k, r in got.items())
    odd = tree.parents(items, ["doc_id"], block=10).where("pos is null or depth is null").collect()
    assert len(odd) == 2 and all(r.parent is None and list(r.ancestors) == [] for r in odd)
    assert tree.parents(items.where("false"), ["doc_id"], block=10).count() == 0


def test_a_wrong_sum_below_the_sixth_level_is_found_and_a_bound_is_kept(spark):
    rows = [(0, i, i + 1, f"n{i}", 9 if i >= 6 else 5, "") for i in range(9)]
    assert [(r.pos, r.depth, r.direct) for r in rollup.check_children(frame(spark, rows), ["doc_id"]).collect()] == [(5, 6, 9)]
    with pytest.raises(Exception, match="deeper than 6"):
        tree.parents(frame(spark, rows), ["doc_id"], depths=6).collect()


def test_numbers_by_cells_are_those_of_one_window(spark):
    rng = random.Random(3)
    rows = spark.createDataFrame([(rng.choice(["a", "b", None]), rng.choice([None, *range(40)]), i) for i in range(400)], "card string, x int, i int")
    one = {r.i: r.seq for r in tree.sequence(rows, "card", ["x", "i"]).collect()}
    assert {r.i: r.seq for r in tree.sequence(rows, "card", ["x", "i"], [F.floor(F.col("x") / 15), F.floor(F.col("x") / 5)]).collect()} == one


def test_repeated_pages_name_their_first(spark):
    pages = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", "x"), (4, "a", None), (5, "b", None)], "no int, x string, y string")
    assert {(r.no, r.first) for r in rollup.duplicate_pages(pages, ["x", "y"], "no").collect()} == {(2, 1), (4, 1)}


def test_one_exchange_and_one_window(spark):
    plan = tree.parents(frame(spark, SOUND), ["doc_id"], depths=6)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 1 and plan.count("Exchange ") <= 1


def test_identity_witnesses_and_poison(spark):
    rows = spark.createDataFrame([(1.0, 3.0, 2.0), (1.0, 3.0, 1.0), (None, 3.0, 1.0)], "before double, after double, change double")
    assert [r.route for r in rollup.check_identity(rows).collect()] == ["ok", "issue", "skipped"]
    w = spark.createDataFrame([(5.0, 5.0, 1.0), (5.0, 9.0, 5.0), (5.0, 9.0, 9.5), (5.0, 9.0, 1.0), (None, 1.0, 1.0)], "r double, l double, w double")
    got = [r.v for r in w.select(rollup.verdict_by_witnesses(F.col("r"), F.col("l"), {"outline": F.col("w")}).alias("v")).collect()]
    assert got == ["ok", "leaves wrong: outline", "request wrong: outline", "no witness", "cannot tell"]
    sums = spark.createDataFrame([(1, 2.0), (1, None), (2, 3.0)], "k int, x double").groupBy("k").agg(rollup.poisoned_sum("x").alias("s")).collect()
    assert {r.k: r.s for r in sums} == {1: None, 2: 3.0}


def test_forests_are_dealt_by_their_size(spark, tmp_path, monkeypatch):
    """a task's share of a forest doesn't grow with the tables."""
    from recon.plans import common, trees

    monkeypatch.setattr(common, "TASK_ROWS", 100, raising=False)
    spark.range(200).selectExpr("id as o_orderkey", "id % 40 as o_custkey", "1.0D as o_totalprice", "timestamp'2020-01-01' as o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(1000).selectExpr("id % 200 as l_orderkey", "id as l_partkey", "id as l_suppkey", "cast(id as int) as l_linenumber", "1.0D as l_quantity", "id * 1.0D as l_extendedprice", "0.0D as l_discount", "0.0D as l_tax", "'a' as l_returnflag", "'b' as l_linestatus", "timestamp'2020-01-01' as l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert common.forest(spark, str(tmp_path)).rdd.getNumPartitions() == 10
    assert trees.deep_forest(spark, str(tmp_path)).rdd.getNumPartitions() == 10
    assert trees.rollup_every_level(spark, str(tmp_path)).rdd.getNumPartitions() == 10


def test_rollup_of_a_large_document_in_blocks(spark):
    """the blocks of a document are told apart, with the findings of one stack."""
    rows = spark.range(3000).selectExpr("'d' as doc_id", "id as pos", "case when id = 0 then 1 when id % 10 = 1 then 2 else 3 end as depth", "cast(case when id = 0 then 24300 when id % 10 = 1 then if(id = 1501, 85, 90) else 10 end as decimal(18,2)) as amount", "id > 0 and id % 10 <> 1 as leaf")
    found = [sorted(map(tuple, rollup.check_children(rows, ["doc_id"], **x).collect())) for x in ({}, {"block": 100})]
    assert found[0] == found[1] and [r[1] for r in found[0] if r[-1] == "error"]
