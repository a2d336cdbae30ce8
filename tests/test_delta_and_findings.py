from decimal import Decimal

from recon.operators import delta, findings
from recon.operators.findings import finding, gate, search, summary, union_findings
from pyspark.sql import functions as F

GROUPS = "doc_id string, project_no int, table_no int, group_no int, kind string, title string, after decimal(20,6), before decimal(20,6), previous decimal(20,6), change decimal(20,6), own decimal(20,6), formula string, is_total boolean"
LINES = "doc_id string, project_no int, table_no int, group_no int, line_no int, depth int, name string, formula string, amount decimal(20,6)"


def groups(spark, *changes):
    rows = {1: ["change", "g1", 100, 60, 0, 40, 40, "40천원×1회"], 2: ["change", "g2", 10, 30, 0, -20, None, "△20천원×1회="], 3: ["unreflected", "g3", 5, 5, 0, 0, None, None], 9: ["change", "계", 115, 95, 0, 20, None, None]}
    for no, at, value in changes:
        rows[no][at] = value
    d = lambda x: None if x is None else Decimal(x)
    return spark.createDataFrame([("d", 1, 1, no, k, t, d(a), d(b), d(p), d(c), d(o), f, no == 9) for no, (k, t, a, b, p, c, o, f) in rows.items()], GROUPS)


def test_sound_groups_are_silent_and_each_error_is_found(spark):
    assert delta.check_groups(groups(spark)).count() == 0 and delta.check_tables(groups(spark)).count() == 0
    for change, message in [((1, 2, 101), "after - before is not the change"), ((1, 6, 41), "own amount is not the change"), ((1, 7, "41천원×1회"), "formula is not the amount"), ((3, 5, 1), "not reflected, but not zero")]:
        assert message in [r.message for r in delta.check_groups(groups(spark, change)).collect()]
    assert [r.item for r in delta.check_tables(groups(spark, (9, 3, 96))).collect()] == ["before"]
    assert delta.check_tables(groups(spark, (9, 3, 96), (2, 3, None))).count() == 0


def lines(spark, *changes):
    rows = [[1, "a", None, 40], [2, "a1", "30천원×1회", 30], [2, "a2", "10,000원×1회", 10]]
    for i, at, value in changes:
        rows[i][at] = value
    return spark.createDataFrame([("d", 1, 1, 1, i, d, n, f, None if a is None else Decimal(a)) for i, (d, n, f, a) in enumerate(rows)], LINES)


def test_lines(spark):
    g = groups(spark).where("group_no = 1")
    assert delta.check_lines(lines(spark), g).count() == 0
    assert {r.message for r in delta.check_lines(lines(spark, (1, 3, 31)), g).collect()} == {"formula is not the amount", "not the sum of its lines"}
    assert {r.message for r in delta.check_lines(lines(spark, (0, 3, 41)), g).collect()} == {"not the sum of its lines", "first-level lines add up to neither amount"}


def test_state_machines(spark):
    rows = spark.createDataFrame([("d", 1, 1, 1, i, g) for i, g in enumerate("○-·-○·")], "doc_id string, project_no int, table_no int, group_no int, line_no int, glyph string")
    assert [r.depth for r in delta.line_depths(rows).orderBy("line_no").collect()] == [1, 2, 3, 2, 1, 2]
    items = spark.createDataFrame([("d", 1, i, g) for i, g in enumerate("□○-○-")] + [("d", 2, i, g) for i, g in enumerate("○-")] + [("d", 3, i, g) for i, g in enumerate("□○")], "doc_id string, table_no int, row_no int, glyph string")
    assert {r.glyph: r.depth for r in delta.bullet_depths(items).collect()} == {"□": 1, "○": 2, "-": 3}
    raw = spark.createDataFrame([("d", 1, i, h, a) for i, (h, a) in enumerate([("x", None), ("g", 1), ("l", None), ("h", 2), ("합 계", 3), ("after", None)])], "doc_id string, table_no int, row_no int, head string, after int")
    assert [(r.role, r.group_no) for r in delta.classify_rows(raw).orderBy("row_no").collect()] == [("line", None), ("group", 1), ("line", 1), ("group", 2), ("total", None), ("line", None)]
    pages = spark.createDataFrame([("d", 1, True, False), ("d", 2, False, True), ("d", 3, True, True), ("d", 4, False, True), ("d", 5, False, False)], "doc_id string, ord int, numbered boolean, has_items boolean")
    assert [(r.ord, r.host, r.folded, r.split) for r in delta.fold_pages(pages).orderBy("ord").collect()] == [(1, 1, False, False), (2, 1, True, False), (3, 3, False, False), (4, 4, False, True), (5, 5, False, False)]


FORM = "doc_id string, row_no int, level int, name string, code7 string, basis_before string, before double, basis string, amount double, change double, leaf boolean"


def form(spark, *changes):
    rows = [[1, "top", None, None, 10.0, None, 30.0, 20.0, False], [2, "a", None, None, 10.0, None, 30.0, 20.0, False], [3, "a1", "2100143", "10천원×1회=", 10.0, "10천원×3회=", 30.0, 20.0, True]]
    for i, at, value in changes:
        rows[i][at] = value
    return spark.createDataFrame([("d", i, *r) for i, r in enumerate(rows)], FORM)


def test_form_names_one_cause(spark):
    assert delta.check_form(form(spark)).count() == 0
    assert [(r.item, r.message) for r in delta.check_form(form(spark, (2, 2, None))).collect()] == [("a1", "no code")]
    assert [(r.item, r.message) for r in delta.check_form(form(spark, (1, 6, 31.0), (1, 7, 21.0))).collect()] == [("a", "not the sum of its rows: amount")]
    assert [(r.item, r.message) for r in delta.check_form(form(spark, (2, 5, "10천원×4회="))).collect()] == [("a1", "basis")]


def test_findings_are_routed_joined_and_gated(spark):
    rows = spark.createDataFrame([("p", "i", 2.0, "error"), ("p", "i", 2.0, "error"), ("q", "kit", 1.0, "review"), ("r", "j", 0.0, "skipped")], "p string, i string, x double, s string")
    f = union_findings(rows.select(*finding("g", F.col("s"), project=F.col("p"), item=F.col("i"), left=F.col("x"), right=F.lit(1.0))))
    assert {(r.project, r.route, r.gap) for r in f.collect()} == {("p", "issue", 1.0), ("q", "issue", 0.0), ("r", "skipped", -1.0)}
    assert [r.project for r in findings.by_severity(f).collect()] == ["p", "q", "r"]
    assert tuple(summary(f).first())[1:] == (1, 1, 1, 0)
    assert [r.project for r in search(f, text="ki").collect()] == ["q"] and search(f, "error").count() == 1
    assert gate(f, ["g"]).first().blocked and not gate(f, ["other"]).first().blocked


def test_lines_of_known_depths_need_no_stack(spark):
    """the findings of windows over two levels are those of stacks."""
    group = ["'d' as doc_id", "id % 7 as project_no", "1 as table_no", "id % 5 as group_no"]
    lines = spark.range(400).selectExpr(*group, "id as line_no", "if(id < 35, 1, 2) as depth", "concat('l', id) as name", "'' as formula", "cast(if(id < 35, id + 100, id % 11) as double) as amount")
    groups = spark.range(35).selectExpr(*group, "concat('g', id) as title", "cast(id + 100 as double) as change", "cast(null as double) as own")
    found = [sorted(map(str, delta.check_lines(lines, groups, **x).collect())) for x in ({}, {"depths": 2})]
    assert found[0] == found[1] and len(found[0]) > 10
