import math
import random

from pyspark.sql import functions as F

from recon.operators import profile, tables


def test_group_filter_sort(spark):
    people = spark.createDataFrame([("a", "x ", "1,000"), ("b", "x", "3000원"), ("c", "y", "n/a"), ("d", "", "5"), ("e", None, "5")], "name string, dept string, amount string")
    got = {r.dept: (r["count"], r.value) for r in tables.group_table(people, ["dept"], "amount").collect()}
    assert got == {"x": (2, 4000.0)}
    assert {r.dept: r.value for r in tables.group_table(people, ["dept"], "amount", "count").collect()} == {"x": 2.0, "y": 1.0}
    assert tables.group_table(people, ["dept"], "amount", "average").first().value == 2000
    assert [r.name for r in tables.filter_rows(people, "dept", "eq", " X").collect()] == ["a", "b"]
    assert [r.name for r in tables.filter_rows(people, "amount", "gte", 1000).collect()] == ["a", "b"]
    mixed = spark.createDataFrame([("10",), ("b",), ("",), ("9",), (None,), ("A",)], "v string")
    assert [r.v for r in tables.mixed_sort(mixed, "v").collect()][:4] == ["9", "10", "A", "b"]
    assert [r.v for r in tables.mixed_sort(mixed, "v", descending=True).collect()][:4] == ["b", "A", "10", "9"]


def test_duplicates_sums_and_stats(spark):
    rows = spark.createDataFrame([(1, "k "), (2, "k"), (3, "K"), (4, ""), (5, "")], "i int, key string")
    assert sorted(r.i for r in tables.duplicate_rows(rows, "key").collect()) == [1, 2]
    sums = spark.createDataFrame([("1", "2", "3"), ("1", "2", "4"), ("x", "2", "3"), ("1", "2", None)], "a string, b string, t string")
    assert [r.result for r in tables.row_sum_check(sums, ["a", "b"], "t").collect()] == ["match", "mismatch", "cannot tell", "cannot tell"]
    stats = tables.group_stats(spark.createDataFrame([("p", 1.0), ("q", 5.0)], "k string, value double"), ["k"]).first()
    assert (stats.maximum_group, stats.minimum_group, stats.average) == ("q", "p", 3.0)


CELLS = "doc_id string, sheet string, row_no int, col_no int, value_str string, value_num double, value_ts timestamp, is_formula boolean, cached_null boolean"


def sheet(spark, rows):
    cells = [("d", "s", r, c, v if isinstance(v, str) else None, float(v) if isinstance(v, (int, float)) else None, None, False, False) for r, values in rows.items() for c, v in enumerate(values, 1) if v is not None]
    return spark.createDataFrame(cells, CELLS)


def test_header_below_a_title_and_number_kind(spark):
    cells = sheet(spark, {1: ["A title"], 3: ["부서", "금액", "코드번호"], 4: ["x", "1,000원", "001"], 5: ["y", "2,000원", "002"], 7: ["a note at the end of the table that is rather long, longer than forty"]})
    assert profile.header_row(cells).first().header_row == 3
    heads = cells.where("row_no = 3").select("doc_id", "sheet", F.lit(3).alias("header_row"), "col_no", F.col("value_str").alias("header"))
    got = {r.header: r.kind for r in profile.column_profile(cells.where("row_no < 7"), heads).collect()}
    assert got == {"부서": "text", "금액": "number", "코드번호": "text"}


def test_two_tables_in_a_sheet(spark):
    cells = sheet(spark, {1: ["a", "b"], 2: ["1", "2"], 3: ["3", "4"], 5: ["c", "d"], 6: ["5", "6"]})
    assert sorted((r.header_row, r.end_row) for r in profile.table_regions(cells).collect()) == [(1, 4), (5, 6)]


def test_header_names_and_columns(spark):
    heads = spark.createDataFrame([("d", "s", 1, "n"), ("d", "s", 2, " n "), ("d", "s", 3, "m"), ("d", "s", 4, "n")], "doc_id string, sheet string, col_no int, header string")
    assert [r.header for r in profile.unique_headers(heads).orderBy("col_no").collect()] == ["n", "n_2", "m", "n_3"]
    wanted, columns = spark.createDataFrame([("total amount",), ("dept",)], "name string"), spark.createDataFrame([("total_amount",), ("amount",), ("department",), ("depot",)], "column string")
    got = {r.name: r for r in profile.match_columns(wanted, columns).collect()}
    assert got["total amount"].column == "total_amount" and math.isclose(got["total amount"].score, 1.0)
    assert got["dept"].column in ("department", "depot")


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_short_names_meet_all_that_the_score_accepts(spark):
    rng = random.Random(5)
    names = lambda n: sorted({"".join(rng.choices("abcdxyz", k=rng.randrange(1, 10))) for _ in range(n)})
    wanted, columns = ["abcde", "abcdefg", "q", "longq", *names(60)], ["axcxe", "axcxexg", "xqx", *names(60)]
    score = lambda a, b: 1.0 if a == b else max(0.92 if a in b or b in a else 0, 1 - edits(a, b) / max(len(a), len(b)))
    for threshold in (0.55, 0.4):
        want = {}
        for a in wanted:
            ranked = sorted((-score(a, b), b) for b in columns if score(a, b) >= threshold)
            if ranked:
                want[a] = (ranked[0][1], round(-ranked[0][0], 6))
        found = profile.match_columns(spark.createDataFrame([(x,) for x in wanted], "name string"), spark.createDataFrame([(x,) for x in columns], "column string"), threshold).collect()
        assert {r.name: (r.column, round(r.score, 6)) for r in found} == want
