import pytest
from pyspark.sql import functions as F

from recon.operators import codes, delta, delta_document as D, dims, match, reconcile, summaries
from recon.operators.profile import match_columns
from recon.sources import sheets

ROWS = "doc_id string, project_no int, table_no int, row_no int, cells array<string>, kind string"
TABLE = [
    ["제목"], ["사업명", "추경안(A)", "기정(B)", "산출내역", "요구액"], ["", "산출내역", "요구액"], ["", "", ""],
    ["운영", "1,000", "1,200(100)", "강사수당 (2천원×3명)", "6천원", "△200", "비고"],
    ["․ 기본 (△100천원×2회)", "△200천원"], [" 하나", "△150"], [" 둘", "△50"], [" 셋", ""],
    ["재료", "500", "400(0)", "재료비", "100"], ["기타(100천원)", "100"],
    ["합 계", "1,500", "1,600(100)", "△100"], ["뒤", "1"],
]


def rows(spark, tables, kinds=("change",)):
    return spark.createDataFrame([("d", 1, t, i, c, k) for t, (table, k) in enumerate(zip(tables, kinds), 1) for i, c in enumerate(table)], ROWS)


def test_rows_become_groups_totals_and_lines(spark):
    told = D.change_rows(rows(spark, [TABLE, [["사업명"], ["옛 사업", "7", "7(0)", "0", "그대로"], ["줄", "1"]]], ("change", "unreflected")))
    g = {(r.table_no, r.title): r for r in D.groups_of(told).collect()}
    a = g[1, "강사수당"]
    assert (a.after, a.before, a.previous, a.change, a.own, a.formula, a.business, a.is_total) == (1000, 1200, 100, -200, 6, "2천원×3명", "운영", False)
    b = g[1, "재료비"]
    assert (b.after, b.before, b.change, b.own, b.group_no) == (500, 400, 100, None, 2)
    t = g[1, "합계"]
    assert (t.after, t.before, t.previous, t.change, t.is_total) == (1500, 1600, 100, -100, True)
    u = g[2, "옛 사업"]
    assert (u.after, u.before, u.change, u.own) == (7, 7, 0, None) and len(g) == 4
    lines = delta.line_depths(D.lines_of(told), D.DOTS).orderBy("line_no").collect()
    assert [(r.group_no, r.depth, r.name, r.formula, r.amount) for r in lines] == [
        (1, 1, "기본", "△100천원×2회", -200), (1, 2, "하나", "", -150), (1, 3, "둘", "", -50), (1, 2, "셋", "", None), (2, 1, "기타(100천원)", "", 100)]
    assert D.groups_of(D.change_rows(rows(spark, [TABLE]).limit(0))).count() == 0


def test_lines_without_glyphs_are_siblings(spark):
    r = spark.createDataFrame([("d", 1, 1, 1, i, g) for i, g in enumerate(["․", None, "", "a", "", "․"])], "doc_id string, project_no int, table_no int, group_no int, line_no int, glyph string")
    assert [x.depth for x in delta.line_depths(r, "․").orderBy("line_no").collect()] == [1, 2, 2, 3, 4, 1]


def test_head_summary_and_status_tables(spark):
    head = rows(spark, [[["x"], ["2026년 제2회추경예산안(A)", "기정예산(B)", "최종", "증감(A-B)"], ["", ""], ["1,500", "1,600", "1,400", "△100"]]])
    assert [tuple(r)[3:] for r in D.head_values(head).collect()] == [("2026년 제2회추경예산안(A)", 1500, 1600, 1400, -100)]
    summary = D.summary_rows(rows(spark, [[["번호", "사업항목명", "추가경정", "기정", "증감", "쪽수"], ["합계", "10", "8", "2"], ["1", "a", "10", "8", "2", "3"], ["2", "b", "", "8", "2", "3"], [None]]])).collect()
    assert [(r.number, r.name, r.after, r.before, r.change, r.page, r.is_total) for r in summary] == [(None, None, 10, 8, 2, None, True), ("1", "a", 10, 8, 2, "3", False)]
    status = D.status_rows(rows(spark, [[["이름", "a", "b", "c"], ["정책", "5", "3", "2"], ["", "단위", "5", "3", "2"], ["", "", "세부", "5", "3", ""], []]])).collect()
    assert [(r.level, r.name, r.after, r.before, r.change) for r in status] == [(0, "정책", 5, 3, 2), (1, "단위", 5, 3, 2)]


PROJECTS = "doc_id string, project_no int, number string, name string, after double, before double, change double, total_cost double, funding map<string,double>, year_from int, year_to int"
GROUPS = "doc_id string, project_no int, table_no int, group_no int, kind string, title string, business string, formula string, after double, before double, previous double, change double, own double, is_total boolean, row_no int"


def document(spark, project=(), groups=(), extra=()):
    p = ["d", 1, "1", "page", 1500.0, 1600.0, -100.0, 1500.0, {"a": 1000.0, "b": 500.0}, 2026, 2026]
    for k, v in dict(project).items():
        p[k] = v
    g = [["d", 1, 1, 1, "change", "one", "", "", 1000.0, 1200.0, 0.0, -200.0, None, False, 4], ["d", 1, 1, 2, "change", "two", "", "", 500.0, 400.0, 0.0, 100.0, None, False, 9], ["d", 1, 1, 2, "change", "합계", "", "", 1500.0, 1600.0, None, -100.0, None, True, 11]]
    for i, k, v in groups:
        g[i][k] = v
    return spark.createDataFrame([tuple(p)], PROJECTS), spark.createDataFrame([tuple(x) for x in [*g, *extra]], GROUPS)


@pytest.mark.parametrize("project, groups, extra, want", [
    ({}, [], [], []),
    ({4: None}, [], [], [("skipped", "no head")]),
    ({5: 1601.0}, [], [], [("error", "after - before is not the change"), ("review", "unchanged parts are not in the tables")]),
    ({7: 1600.0, 8: None}, [], [], [("error", "total cost is still the amount before")]),
    ({7: 1700.0, 8: {}}, [], [], [("error", "total cost is not the amount after")]),
    ({7: 9999.0, 8: {}, 10: 2028}, [], [], []),
    ({8: {"a": 1.0, "b": 2.0}}, [], [], [("error", "funding is not the total cost")]),
    ({8: {"a": 1.0}}, [], [], []),
    ({}, [(2, 11, -90.0)], [], [("error", "tables do not add up to the head: change")]),
    ({4: 1510.0, 5: 1610.0, 7: None}, [], [], [("review", "unchanged parts are not in the tables")]),
    ({4: 1510.0, 5: 1610.0, 7: None}, [], [("d", 1, 2, 1, "unreflected", "old", "", "", 1.0, 1.0, 0.0, 0.0, None, False, 1)], [("error", "tables do not add up to the head: after"), ("error", "tables do not add up to the head: before")]),
    ({}, [(0, 11, None), (2, 11, None)], [], []),
    ({1: 7}, [], [], [("skipped", "no tables")]),
])
def test_heads_against_their_tables(spark, project, groups, extra, want):
    found = D.check_heads(*document(spark, project, groups, extra)).collect()
    assert sorted((r.severity, r.message) for r in found) == want


def test_section_costs_status_names_and_the_whole_document(spark):
    p, g = document(spark)
    sections = spark.createDataFrame([("d", 1, 1, "plan", -90.0)], "doc_id string, project_no int, table_no int, section string, section_cost double")
    assert [(r.item, r.left, r.right) for r in D.check_heads(p, g, sections).collect()] == [("plan", -90.0, -100.0)]
    status = spark.createDataFrame([("d", 1, 0, "a", 10.0, 8.0, 2.0), ("d", 2, 1, "b", 6.0, 5.0, 1.0), ("d", 3, 2, "c", 6.0, 5.0, 1.0), ("d", 4, 1, "e", 4.0, 3.0, 2.0)], "doc_id string, row_no int, level int, name string, after double, before double, change double")
    got = sorted((r.project, r.item or "", r.message) for r in D.check_status(status).collect())
    assert got == [("a", "change", "not the sum of the rows below"), ("e", "", "after - before is not the change")]
    twice = p.unionByName(p.withColumn("project_no", F.lit(2)).withColumn("name", F.lit("pa ge")))
    assert [(r.project, r.left) for r in D.check_names(twice).collect()] == [("page", 2.0)]
    lines = spark.createDataFrame([("d", 1, 1, 1, 1, 1, "x", "", -200.0), ("d", 1, 1, 2, 1, 1, "y", "2천원×3", 5.0)], "doc_id string, project_no int, table_no int, group_no int, line_no int, depth int, name string, formula string, amount double")
    summary = spark.createDataFrame([("d", 1, "1", "page", 1500.0, 1600.0, -100.0, "3", False), ("d", 0, None, None, 1500.0, 1600.0, -99.0, None, True)], "doc_id string, row_no int, number string, name string, after double, before double, change double, page string, is_total boolean")
    found = sorted((r.goal, r.message) for r in D.check_document(p, g, lines, summary, status.limit(0)).collect())
    assert found == [("delta lines", "first-level lines add up to neither amount"), ("delta lines", "formula is not the amount"), ("delta summary", "total is not the sum")]
    empty = D.check_document(p.limit(0), g.limit(0), lines.limit(0), summary.limit(0), status.limit(0))
    assert empty.count() == 0


FORM = "doc_id string, row_no int, level int, indent int, name string, code7 string, detail string, basis_before string, before double, basis string, amount double, change double, leaf boolean"


def form(spark, *changes):
    r = [[0, 1, 0, "top", None, None, None, 10.0, None, 30.0, 20.0, False], [1, 2, 2, "a", None, None, None, 10.0, None, 30.0, 20.0, False], [2, 3, 4, "a1", "2100143", "what", "10천원×1회=", 10.0, "10천원×3회=", 30.0, 20.0, True]]
    for i, at, value in changes:
        r[i][at] = value
    return spark.createDataFrame([("d", *x) for x in r], FORM)


def test_forms_levels_fields_and_totals(spark):
    told = lambda f, **o: sorted((r.item, r.severity, r.message) for r in delta.check_form(f, **o).collect())
    assert told(form(spark)) == []
    assert told(form(spark, (1, 1, 3))) == [("a", "error", "level")]
    assert told(form(spark, (2, 4, None), (2, 5, ""))) == [("a1", "error", "no code, no detail")]
    assert told(form(spark, (2, 8, "말씀"))) == [("a1", "skipped", "can't be computed: basis")]
    assert told(form(spark, (2, 7, None), (2, 9, None), (2, 8, None), (2, 6, None), (2, 10, None), (2, 4, None), (1, 7, None), (1, 9, None), (1, 10, None), (0, 7, None), (0, 9, None), (0, 10, None))) == []
    totals = spark.createDataFrame([("d", 10.0, 31.0, None)], "doc_id string, before double, amount double, change double")
    assert told(form(spark), totals=totals) == [("amount", "error", "total is not the sum of the projects")]
    assert delta.check_form(form(spark).limit(0)).count() == 0
    entered = spark.createDataFrame([("d", 1, 1, 0, "a", "2천원×3=", 6.0, "1"), ("d", 2, 1, 2, "b", "2천원×3=", 9.0, None), ("d", 3, None, 2, "c", None, 9.0, None)], "doc_id string, row_no int, level int, indent int, name string, basis string, amount double, code7 string")
    assert sorted((r.item, r.message) for r in delta.check_entered(entered).collect()) == [("b", "basis is not the amount"), ("b", "level is not the indent's"), ("b", "no code")]


def test_ledger_rows_in_three_tiers(spark):
    ledger = spark.createDataFrame([(1, "one", False), (2, "one", False), (3, "t wo", True), (4, "two ", False), (5, "tw o", True), (6, "three(신규)", True), (7, "three", True), (8, None, False)], "row_no int, name string, unplanned boolean")
    names = spark.createDataFrame([("one",), ("two",), ("tw  o",), ("thr ee",), ("four",), (None,)], "name string")
    got = {r.name: (r.match, r.tier) for r in match.find_row(names, ledger, "name", "row_no", "name", "unplanned").collect()}
    assert got == {"one": (1, 1), "two": (4, 1), "tw  o": (4, 2), "thr ee": (7, 2), "four": (None, None), None: (None, None)}


def test_delta_form_against_narrative_and_ledger(spark):
    f = spark.createDataFrame([("f", 1, 1, "one", 10.0, 30.0, 20.0), ("f", 2, 2, "x", 5.0, 20.0, 15.0), ("f", 3, 2, "y", 5.0, 10.0, 5.0), ("f", 4, 1, "two", 1.0, 1.0, 0.0), ("f", 5, 1, "lone", 1.0, 1.0, 0.0)], "doc_id string, row_no int, depth int, name string, before double, after double, change double")
    p = spark.createDataFrame([(1, "one", 10.0, 30.0, 20.0), (2, "two", 3.0, 3.0, 0.0)], "project_no int, name string, before double, after double, change double")
    ledger = spark.createDataFrame([(1, "one", 10.0, 20.0, False), (2, "two", 1.0, 0.0, False)], "row_no int, name string, before double, change double, unplanned boolean")
    groups = spark.createDataFrame([(1, 1, "gx", 5.0, 20.0, 15.0), (1, 2, "gy", None, None, 5.0), (1, 3, "gz", None, None, 5.0), (1, 4, "g0", None, None, 0.0)], "project_no int, group_no int, title string, before double, after double, change double")
    told = lambda *a: sorted((r.project, r.item or "", r.message) for r in reconcile.compare_form(*a).collect())
    assert told(f, p, ledger, groups) == [("lone", "", "not in the ledger"), ("lone", "", "not in the narrative"), ("one", "gz", "no row of the form has this change")]
    assert told(f, p, None) == [("lone", "", "not in the narrative"), ("two", "", "after differs from the narrative"), ("two", "", "before differs from the narrative")]
    assert told(f, p.withColumn("change", F.lit(7.0)), None, groups)[1][2] == "change differs from the narrative"
    assert told(f.limit(0), p, ledger, groups) == []


def test_totals_pieces_and_bundles(spark):
    one = spark.createDataFrame([("d", 5.0, 9.0)], "doc_id string, change double, before double")
    assert [(r.item, r.left, r.right) for r in reconcile.agency_totals(one, one.withColumn("before", F.lit(8.0))).collect()] == [("before", 9.0, 8.0)]
    h = "array<struct<label:string,amount:double,details:array<struct<label:string,amount:double>>>>"
    x = spark.createDataFrame([([("a", 5.0, [("d", 2.0), ("e", 3.0), ("f", None)]), ("b", 7.0, []), ("c", None, None)], 0.0), ([], 0.0), ([], 1.0), (None, 0.0)], f"h {h}, change double")
    assert [(r.p, r.u) for r in x.select(reconcile.pieces(F.col("h")).alias("p"), reconcile.unplanned(F.col("h"), F.col("change")).alias("u")).collect()] == [([2.0, 3.0, 7.0], False), ([], True), ([], False), (None, True)]
    a, b = (spark.createDataFrame([(1, v) for v in vs], "key int, amount double") for vs in ([5.0, 5.2, 0.1, 9.0, None], [5.3, 5.1, 8.0]))
    assert sorted((r.amount, r.side) for r in reconcile.differing_pieces(a, b).collect()) == [(8.0, "right"), (9.0, "left")]
    names = spark.createDataFrame([("총액배분 a", False, None), ("b", True, None), ("c", None, ["x"]), ("d", False, [])], "name string, split boolean, parts array<string>")
    assert [r.bundled for r in reconcile.bundled(names).collect()] == [True, True, True, False]


def test_codes_lists_orders_and_coverage(spark):
    r = spark.createDataFrame([("d", "p", "n1", "210-01", None, "several by code", False), ("d", "p", "n2", "", None, "unknown name", None), ("d", "p", "n3", "210-01", "2100143", "name", False), ("d", "q", "n4", "", None, "x", True)], "doc_id string, project string, name string, code5 string, code7 string, source string, handover boolean")
    assert sorted((x.item, x.message) for x in codes.unresolved(r).collect()) == [("n1", "no code: several by code (210-01)"), ("n2", "no code: unknown name")]
    known = spark.createDataFrame([("2100143", ""), ("2100143", "own"), ("2200101", None), ("2300101", "")], "code7 string, name string")
    items = spark.createDataFrame([("210-01", "w"), ("220-01", "supplies"), ("220-01", "supplies"), ("230-01", "a"), ("230-01", "b")], "code5 string, account string")
    assert {x.code7: x.name for x in codes.code_list(known, items).collect()} == {"2100143": "own", "2200101": "supplies", "2300101": ""}
    d = codes.open_decisions(r)
    assert [x.code5 for x in codes.work_order(d).collect()] == ["", "210-01"] and tuple(codes.decision_totals(d).first()) == (2, 2, 4, 1, 0, 1)
    assert codes.named_kinds(r).first().named_kinds == 2
    learned = codes.learn(spark.createDataFrame([("2100143", "n", "p", "a"), ("2100144", "n", "p", "a"), ("2200101", "m", "p", "")], "code7 string, name string, parent string, account string"))
    c = {x.kind: (x["keys"], x.unanimous, x.rows) for x in codes.coverage(learned).collect()}
    assert c["code"] == (2, 1, 3) and c["account"] == (1, 0, 2) and c["name_only"] == (2, 1, 3)


def test_scope_classes_and_labels(spark):
    projects = spark.createDataFrame([(1, "a b", "P", "U"), (2, "other", "P", "X")], "project_no int, name string, policy string, unit string")
    cards = spark.createDataFrame([(1, "a-b"), (2, None), (3, "")], "card_no int, name string")
    assert [r.project_no for r in dims.in_scope(projects, cards).collect()] == [1]
    classes = spark.createDataFrame([("policy", "01", "P", None), ("unit", "02", "u", "example"), ("unit", "03", "U", None)], "level string, code string, name string, note string")
    got = {r.project_no: (r.described, r.note) for r in dims.describe_classes(projects, classes, ["policy", "unit"]).collect()}
    assert got[2] == ("[01]P > [?]X", None) and got[1][0].startswith("[01]P > [0")
    assert {r.level: r.classes for r in dims.class_counts(classes).collect()}["policy"] == 1
    x = spark.range(1).select(dims.full_code(F.array(F.struct(F.lit("01").alias("code"), F.lit("P").alias("name"))), F.lit("02")).alias("c"), summaries.label(F.lit(15), F.lit("n")).alias("l"), summaries.label(F.lit(None).cast("int"), F.lit("n")).alias("m"),
                             summaries.charge(F.lit("office, team")).alias("o"), summaries.charge(F.lit(" office ")).alias("q"), summaries.code_digits(F.lit("210-01")).alias("k")).first()
    assert tuple(x) == ("01-02", "15. n", "n", "team", "office", "21001")


def test_numbers_of_a_run(spark):
    p = spark.createDataFrame([("d", 1, "a", 3, 10.0, False), ("d", 2, "b", None, 5.0, True), ("d", 3, "a", 2, None, None)], "doc_id string, project_no int, name string, number int, amount double, handover boolean")
    items = spark.createDataFrame([("d", 1, True, False, "x"), ("d", 1, True, None, None), ("d", 1, False, False, None), ("d", 2, True, False, None), ("d", 3, True, True, "y")], "doc_id string, project_no int, leaf boolean, handover boolean, code7 string")
    f = spark.createDataFrame([("a", "error"), ("c", "error"), ("b", "review")], "project string, severity string")
    assert {r.measure: r.value for r in summaries.run_numbers(p, items, f).collect()} == {"projects": 3, "leaves": 4, "not_entered": 2, "settled": 1, "unsettled": 1, "error": 2, "review": 1, "skipped": 0, "dropped": 0}
    assert tuple(summaries.goals(p).first()) == (2, 10.0, 1, 5.0)
    assert {r.project: r.label for r in summaries.labelled(f, p).collect()} == {"a": "2. a", "b": "b", "c": "c"}
    ledger = spark.createDataFrame([("a", 1.0), ("a", None), ("", 9.0), (None, 9.0)], "name string, amount double")
    assert [tuple(r) for r in summaries.ledger_totals(ledger).collect()] == [("a", 1.0)]
    g = spark.createDataFrame([("x", 1.0), ("y", 5.0), ("a", 5.0)], "k string, value double")
    assert [r.k for r in summaries.ordered_groups(g, ["k"], by_value=True).collect()] == ["a", "y", "x"] and [r.k for r in summaries.ordered_groups(g, ["k"]).collect()] == ["a", "x", "y"]


def cells(spark, table):
    return spark.createDataFrame([("f", "s", r, c, v) for r, row in enumerate(table, 1) for c, v in enumerate(row, 1)], "doc_id string, sheet string, row_no int, col_no int, value string")


def test_load_sheets_balances_and_adjustments(spark):
    top = ["레벨", "순번", "* 사업항목", "", "* 원가통계비목", "", "상세내역", "기정예산", "", "최종요구", "", "추경요구"]
    sub = ["", "", "", "", "", "", "", "산출기초①", "금액①", "산출기초②", "금액②", ""]
    sheet = cells(spark, [top, sub, ["", "", "총계", "", "", "", "", "", "10", "", "1,030", "20"], ["1", "1", "1. 사업", None, None, None, None, "", "10", "", "30", "20"], ["2", "1", "  가. 줄", "", " 2100143 ", "", "what", "10천원=", "10", "0=", "30", "x"], [None, None, " "]])
    rows = sheets.load_sheet(sheet, sheets.DELTA_ROLES).orderBy("row_no").collect()
    assert [(r.level, r.name, r.depth, r.is_total, r.before, r.amount, r.change, r.code7) for r in rows] == [(None, "총계", 1, True, 10, 1030, 20, ""), (1, "사업", 1, False, 10, 30, 20, ""), (2, "줄", 2, False, 10, 30, None, "2100143")]
    assert [(r.amount) for r in sheets.grand_total(sheets.load_sheet(sheet, sheets.DELTA_ROLES)).collect()] == [1030]
    main = sheets.load_sheet(cells(spark, [["레벨", "순번", "사업항목", "원가통계비목", "상세내역", "2026년도 요구", ""], ["", "", "", "", "", "* 산출기초", "* 금액②"], ["1", "1", "a", "", "", "2×3=", "6"]])).collect()
    assert [(r.level, r.name, r.basis, r.amount) for r in main] == [(1, "a", "2×3=", 6)]
    balance = sheets.balance_sheet(cells(spark, [["사업항목", "원가통계비목", "산출기초"], ["top", "", ""], ["  below", "[2100143] 일반수용비", "b"], ["", "x"], ["    odd", "[21] y", ""]])).orderBy("row_no").collect()
    assert [(r.name, r.depth, r.code7, r.account) for r in balance] == [("top", 1, "", ""), ("below", 2, "2100143", "일반수용비"), ("odd", 3, "", "")]
    ledger = spark.createDataFrame([("a", "i", "p", 5.0), ("", "a", "p", -2.0), ("b", "i", "p", 0.0), ("c", "i", "", 9.0), ("e", "i", "p", None)], "name string, item string, program string, adjust double")
    assert [tuple(r) for r in sheets.adjustments(ledger).collect()] == [("a", 3.0)]


def test_columns_by_family_and_kind(spark):
    wanted = spark.createDataFrame([("금액", "number"), ("이름", "text"), ("부서", None), ("zz", "text"), (None, "text")], "name string, kind string")
    columns = spark.createDataFrame([("지급액", "number"), ("합계", "text"), ("성명", "text"), ("소속 부서", "text"), ("비고", "text")], "column string, kind string")
    got = {r.name: (r.column, round(r.score, 2), r.ambiguous) for r in match_columns(wanted, columns).collect()}
    assert got == {"금액": ("지급액", 0.93, False), "이름": ("성명", 0.93, False), "부서": ("소속 부서", 0.92, False)}
    assert match_columns(wanted.drop("kind"), columns.drop("kind")).where("name = '금액'").first().ambiguous


def test_rows_of_one_name_keep_their_findings_and_documents_their_own_rows(spark):
    cols = "doc_id string, row_no int, level int, name string, after double, before double, change double"
    rows = spark.createDataFrame([("a", 0, 0, "top", 10.0, 0.0, 10.0), ("a", 1, 1, "pay", 3.0, 0.0, 0.0), ("a", 2, 1, "pay", 7.0, 0.0, 0.0), ("a", 3, 1, "pay", 0.0, 0.0, 10.0), ("a", 4, 1, "pay", 0.0, 0.0, 0.0)], cols)
    found = [r for r in D.check_status(rows).collect() if r.message == "after - before is not the change"]
    assert sorted((r.place, r.left, r.right) for r in found) == [("1", 0.0, 3.0), ("2", 0.0, 7.0), ("3", 10.0, 0.0)]
    pages = spark.createDataFrame([("a", 1, "road", 5.0, 5.0, 0.0, False), ("b", 1, "road", 9.0, 9.0, 0.0, False)], "doc_id string, number int, name string, change double, after double, before double, bundled boolean")
    assert reconcile.compare_summary(pages, pages.drop("bundled")).count() == 0
    assert {r.doc_id for r in reconcile.compare_summary(pages, pages.drop("bundled", "doc_id")).collect()} == {"b"}
    ledger = pages.selectExpr("doc_id", "1 as row_no", "name", "change", "before", "false as unplanned")
    summary = pages.select("doc_id", "name", "change", "before")
    assert reconcile.compare_delta(pages, ledger, summary).count() == 0
    assert reconcile.compare_delta(pages, ledger.withColumn("doc_id", F.when(F.col("doc_id") == "a", "b").otherwise("a")), summary).count() == 2
    form = pages.selectExpr("doc_id", "0 as row_no", "1 as depth", "name", "before", "after", "change")
    assert reconcile.compare_form(form, pages.withColumn("project_no", F.lit(1)), ledger).count() == 0


def test_names_within_names_meet_over_rare_pieces(spark):
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcd", k=rng.randrange(1, 9)))
    long = [(word(), rng.randrange(3)) for _ in range(300)]
    short = [(word()[:rng.randrange(1, 5)], rng.randrange(3)) for _ in range(200)]
    got = {tuple(r) for r in reconcile.holders(spark.createDataFrame(short, "_k string, c int").distinct(), spark.createDataFrame(long, "_sk string, c int").distinct(), ["c"]).select("_k", "c").collect()}
    assert got == {(k, c) for k, c in short if any(d == c and k in x for x, d in long)}
