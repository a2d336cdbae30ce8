from decimal import Decimal

from pyspark.sql import functions as F

from recon.operators import narrative, reconcile

PROJECTS = "doc_id string, project_no int, name string, candidates array<struct<label:string,value:double>>, split boolean, restarted boolean, bundled boolean, handover boolean"


def test_three_way_totals(spark):
    c = lambda *vs: [(f"c{i}", v) for i, v in enumerate(vs)]
    rows = [("d", 1, "가 나", c(10.0, 12.0), False, False, False, False), ("d", 2, "다름", c(77.0), False, False, False, False), ("d", 3, "라", c(5.0), True, False, False, False), ("d", 4, "없음", c(1.0), False, False, False, False),
            ("d", 5, "빈", c(None), False, False, False, False), ("d", 6, "세부", c(2.0), False, True, False, False), ("d", 7, "이관", c(3.0), False, False, False, True)]
    projects = spark.createDataFrame(rows, PROJECTS)
    ledger = spark.createDataFrame([("가나", 12.5), ("다른 이름", 77.5), ("라", 9.0), ("이관", 3.0)], "name string, amount double")
    form = spark.createDataFrame([("가 나", 10.0), ("다름", 70.0), ("라", 5.0), ("빈", 1.0), ("세부", 2.0), ("남음", 4.0)], "name string, amount double")
    got = {(r.project, r.message, r.severity) for r in reconcile.compare_totals(projects, ledger, form, "g").collect()}
    assert got == {("빈", "no amount in the narrative", "skipped"), ("없음", "not in the ledger", "error"), ("라", "differs from the ledger", "review"), ("없음", "not in the load sheet", "error"), ("다름", "differs from the load sheet", "error"), ("남음", "only in the load sheet", "error")}


def test_delta_against_ledger_and_summary(spark):
    pages = spark.createDataFrame([("d", "1", "a", 10.0, 15.0, 5.0, False), ("d", "2", "b(신규)", 4.0, 4.0, 0.0, False), ("d", "3", "part", 3.0, 9.0, 6.0, True), ("d", "4", "none", 1.0, 1.0, 0.0, False)], "doc_id string, number string, name string, change double, after double, before double, bundled boolean")
    ledger = spark.createDataFrame([(1, "a", 11.0, 5.0, False), (2, "b", 4.0, 1.0, False), (3, "part", 3.0, 60.0, False), (4, "listed", 8.0, 0.0, False), (5, "lone", 7.0, 0.0, False), (6, "idle", 0.0, 0.0, False)], "row_no int, name string, change double, before double, unplanned boolean")
    summary = spark.createDataFrame([("1", "a", 10.0, 15.0, 5.0), ("2", "b(신규)", 4.0, 4.0, 9.0), ("3", "part", 3.0, 63.0, 60.0), ("9", "is listed too", 8.0, 8.0, 0.0)], "number string, name string, change double, after double, before double")
    got = {(r.project, r.message) for r in reconcile.compare_delta(pages.select("doc_id", "name", "change", "before"), ledger, summary).collect()}
    assert got == {("a", "change differs from the ledger"), ("b(신규)", "amount before differs from the ledger"), ("none", "not in the ledger"), ("lone", "only in the ledger")}
    got = {(r.project, r.message, r.severity) for r in reconcile.compare_summary(pages, summary).collect()}
    assert got == {("b(신규)", "before differ from the summary", "error"), ("part", "after, before differ from the summary", "review"), ("none", "not in the summary", "error")}


def test_delta_against_ledger_in_parts(spark):
    pages = spark.createDataFrame([(d, f"p{i}", float(i), 1.0) for d in ("d", "e", None) for i in range(40)], "doc_id string, name string, change double, before double")
    ledger = spark.createDataFrame([(d, i, f"p{i}", float(i + i % 3), 1.0 + i % 2, False) for d in ("d", None) for i in range(4, 44)], "doc_id string, row_no int, name string, change double, before double, unplanned boolean")
    summary = spark.createDataFrame([("d", "p7", 0.0, 2.0), ("d", "has p41 in it", 43.0, 0.0)], "doc_id string, name string, change double, before double")
    found = reconcile.compare_delta(pages, ledger, summary, parts=7).select("doc_id", "project", "message", "left", "right")
    want = {("e", f"p{i}", "not in the ledger", float(i), None) for i in range(1, 40)}
    for d in ("d", None):
        want |= {(d, f"p{i}", "not in the ledger", float(i), None) for i in range(1, 4)} | {(d, f"p{i}", "only in the ledger", None, float(i + i % 3)) for i in range(40, 44) if (d, i) != ("d", 41)}
        want |= {(d, f"p{i}", "change differs from the ledger", float(i), float(i + i % 3)) for i in range(4, 40) if i % 3}
        want |= {(d, f"p{i}", "amount before differs from the ledger", 1.0, 2.0) for i in range(4, 40) if i % 2 and (d, i) != ("d", 7)}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want
    # Pages without a row aren't joined with the ledger by their null, and names and matches are dealt in the parts given.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LeftOuter" in plan and not [x for x in plan.splitlines() if "Join" in x and "LeftOuter" in x and "match#" in x]
    assert all(", 7)" in x for x in plan.splitlines() if "Exchange hashpartitioning(_own" in x or "Exchange hashpartitioning(match" in x)


def test_headlines_candidates_and_handover(spark):
    d = Decimal
    projects = spark.createDataFrame([("d", 1, d(100), d(90), [("p", d(40), d(50)), ("q", d(7), None)]), ("d", 2, d(5), d(5), [])], "doc_id string, project_no int, request decimal(20,6), base decimal(20,6), parts array<struct<name:string,request:decimal(20,6),year_request:decimal(20,6)>>")
    items = spark.createDataFrame([("d", 1, 0, 1, d("40.5")), ("d", 1, 1, 2, d(100)), ("d", 1, 2, 1, d(40))], "doc_id string, project_no int, pos int, depth int, amount decimal(20,6)")
    assert {(r.part, r.witness, r.verdict) for r in reconcile.check_headlines(projects, items).collect()} == {("", None, "headline wrong"), ("p", 0, "table wrong")}
    row = spark.createDataFrame([(10.0, None, 12.0), (10.0, 10.0, 10.0)], "r double, y double, l double").select(reconcile.amount_candidates(F.col("r"), F.col("y"), F.col("l")).alias("c")).collect()
    assert [[x.label for x in r.c] for r in row] == [["headline", "leaves"], ["this year", "headline"]]
    leaves = spark.createDataFrame([("d", 1, True, "620-02"), ("d", 2, True, "620-02"), ("d", 2, True, None), ("d", 4, False, "620-02")], "doc_id string, project_no int, leaf boolean, code5 string")
    named = spark.createDataFrame([("d", 1, "x"), ("d", 2, "x"), ("d", 3, "x(재배정)"), ("d", 4, "x")], "doc_id string, project_no int, name string")
    assert {r.project_no: r.handover for r in reconcile.handed_over(leaves, named).collect()} == {1: True, 2: False, 3: True, 4: False}


TABLES = {
    2: [["정책사업", "단위사업"], ["x", "y"]],
    4: [["산출근거", "", "", ""], ["① 강사", "", "", "10,000"], ["", "- 기본", "일반수용비(210-01)", "10,000원×1회", "9", "10"], ["합계", "10,000"], ["", "33,400"]],
    7: [["정책사업", "단위사업"]],
    8: [["산출내역", "요구액"], ["1. 운영", "500천원", "7"], ["가. 물품(5,000원×100개)", "500천원", "1"], ["○ 기타 (설명)", "", "20"], ["합계", "1"]],
}


def test_chunks_become_projects_and_items(spark):
    texts = {1: "3. 유아 교육 지원", 3: "총사업비: 10천원\n보통교부금 7천원 자체 3천원", 5: "4. 급식", 6: "방과후 과정 운영"}
    chunks = spark.createDataFrame([("d", 0, n, "table" if n in TABLES else "text", texts.get(n, "")) for n in range(1, 9)], "doc_id string, section_no int, chunk_no int, kind string, text string")
    cells = spark.createDataFrame([("d", 0, n, r, c, v) for n, t in TABLES.items() for r, row in enumerate(t) for c, v in enumerate(row)], "doc_id string, section_no int, chunk_no int, row_no int, col_no int, value string")
    found = {r.project_no: (r.number, r.name, r.unnumbered, r.request) for r in narrative.projects(chunks, cells).collect()}
    assert found == {1: (3, "유아 교육 지원", False, 10.0), 2: (4, "방과후 과정 운영", True, None)}
    assert {(r.chunk_no, r.table_kind, r.project_no) for r in narrative.chunk_projects(chunks, cells).collect()} == {(2, "organisation", 1), (4, "basis", 1), (7, "organisation", 2), (8, "outline", 2)}
    bullets = spark.createDataFrame([("d", "-", 2), ("d", "○", 3)], "doc_id string, glyph string, depth int")
    basis = narrative.basis_items(cells.where("chunk_no = 4"), bullets).where("row_no > 0").orderBy("row_no").collect()
    assert [(r.depth, r.name, r.account_name, r.code5, r.formula, r.amount) for r in basis] == [(1, "강사", None, None, "", 10000.0), (2, "기본", "일반수용비", "210-01", "10,000원×1회", 10.0)]
    outline = narrative.outline_items(cells.where("chunk_no = 8"), bullets).orderBy("row_no").collect()
    assert [(r.depth, r.name, r.formula, r.amount, r.leaf) for r in outline] == [(2, "운영", "", 500.0, False), (3, "물품", "5,000원×100개", 500.0, True), (3, "기타 (설명)", "", 20.0, True)]
    assert [r.value for r in narrative.under_header(cells.where("chunk_no = 8"), "요구액").collect()] == [1.0]


def test_fields_and_titles(spark):
    row = spark.createDataFrame([("사업기간: 2025. 3. ~ 2026. 2.\n사업비 : △1,500,000원\n총사업비 : 9천원 국고 4천원, 자체 5천원",), ("x",)], "t string").select(narrative.fields(F.col("t")).alias("f")).collect()
    f = row[0].f
    assert (tuple(f.period), f.section_cost, f.total_cost) == ((2025, 2026), -1500.0, 9.0) and [tuple(x) for x in f.funding] == [("국고", 4.0), ("자체", 5.0)]
    assert (row[1].f.section_cost, row[1].f.total_cost, row[1].f.funding) == (None, None, None)
    lines = ["유치원 운영 지원", "(총액배분사업비)", "○ 목록", "기간: 1월", "12", "a", "- 3쪽 -"]
    got = spark.createDataFrame([(x,) for x in lines], "t string").select(narrative.title_like(F.col("t")).alias("v")).collect()
    assert [r.v for r in got] == [True] + [False] * 6


def test_deal_of_sheets_grows_with_their_cells(spark, tmp_path, monkeypatch):
    """a task's share of the cells of load sheets doesn't grow with the table."""
    from recon.plans import common, documents

    monkeypatch.setattr(common, "TASK_ROWS", 100)
    spark.range(200).selectExpr("id as o_orderkey", "id % 40 as o_custkey", "1.0D as o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    found = documents.load_sheet_scan(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 10 and found.count() == 200
