import zipfile

import pytest
from pyspark.sql import functions as F

from recon.operators.findings import finding, union_findings
from recon import sinks
from recon.sources import documents, sheets
from recon.streaming.learn import learn_stream, scan_stream


def test_zipped_documents_in_order_of_sections(spark, tmp_path):
    p = lambda t: f"<p><run><t>{t}</t></run></p>"
    inner = f"<tbl><tr><tc>{p('in')}</tc></tr></tbl>"
    table = f"<p><run><tbl><tr><tc>{p('a &amp; b')}<p><run>{inner}</run></p></tc><tc>{p('c')}</tc></tr></tbl></run></p>"
    with zipfile.ZipFile(tmp_path / "one.hwpx", "w") as z:
        z.writestr("Contents/section10.xml", f"<sec>{p('last')}</sec>")
        z.writestr("Contents/section2.xml", f"<sec>{p('first')}{table}</sec>")
    (tmp_path / "bad.hwpx").write_bytes(b"no zip")
    rows = documents.chunks(spark, str(tmp_path)).collect()
    good = [(r.section_no, r.kind, r.text) for r in rows if r.doc_id.endswith("one.hwpx")]
    assert [g[:2] for g in good] == [(2, "text"), (2, "table"), (2, "table"), (10, "text")] and good[3][2] == "last"
    assert [r.error.split(":")[0] for r in rows if r.doc_id.endswith("bad.hwpx")] == ["BadZipFile"]
    tables = spark.createDataFrame([(0, good[1][2])], "n int, html string")
    assert [(r.row_no, r.col_no, r.value) for r in documents.table_cells(tables, "html").collect()] == [(0, 0, "a & b"), (0, 1, "c")]


def test_csv_of_two_encodings_and_discovery(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("부서,금액\n가,1\n,\n".encode("cp949"))
    (tmp_path / "b.csv").write_bytes("부서,금액\n나,2\n".encode("utf-8-sig"))
    (tmp_path / "~$lock.csv").write_bytes(b"x")
    (tmp_path / "c.txt").write_bytes(b"x")
    rows = documents.csv_lines(spark, str(tmp_path)).where("not path like '%lock%'").collect()
    assert {(r.path[-5:], r.line, r.encoding) for r in rows} == {("a.csv", "부서,금액", "cp949"), ("a.csv", "가,1", "cp949"), ("b.csv", "부서,금액", "utf-8-sig"), ("b.csv", "나,2", "utf-8-sig")}
    found = {r.path[-5:]: r.supported for r in documents.discover(spark, str(tmp_path), (".csv",)).collect()}
    assert found == {"a.csv": True, "b.csv": True, "c.txt": False}


def test_layout_and_roles(spark):
    heads = spark.createDataFrame([("x", "레벨 순번"), ("x", "금 액"), ("y", "검토")], "doc_id string, text string")
    assert {r.doc_id: r.layout for r in documents.layout(heads, {"form": ["레벨", "금액"], "review": ["검토"]}).collect()} == {"x": "form", "y": "review"}
    grid = [["레벨", "* 사업항목", "", "2026년도 요구", ""], ["", "", "코드", "* 산출기초", "* 금액②"], ["1", "n", "7", "b", "10"]]
    cells = spark.createDataFrame([("d", "s", r + 1, c + 1, v) for r, row in enumerate(grid) for c, v in enumerate(row)], "doc_id string, sheet string, row_no int, col_no int, value string")
    rules = {"level": ["레벨"], "name": ["사업항목"], "code": ["사업항목", "코드"], "basis": ["요구", "산출기초"], "amount": ["요구", "금액"], "none": ["없음"]}
    row = sheets.by_role(cells, rules).first()
    assert (row.level, row.name, row.code, row.basis, row.amount, row.none) == ("1", "n", "7", "b", "10", None)


def test_ledger_classes_and_cards(spark):
    rows = spark.createDataFrame([("d", 1, "a", "i", "p"), ("d", 2, "", "item", "p"), ("d", 3, "total", "x", "")], "doc_id string, row_no int, name string, item string, program string")
    assert [r.name for r in sheets.ledger(rows).collect()] == ["a", "item"]
    lines = spark.createDataFrame([("d", 1, ""), ("d", 2, "◎ one"), ("d", 3, "- x"), ("d", 4, "-y"), ("d", 5, ""), ("d", 6, "◎ two")], "doc_id string, row_no int, t string")
    assert [(r.row_no, r.headlines, r.details) for r in sheets.with_headlines(lines, ["doc_id"], "row_no", "t").orderBy("row_no").collect()] == [(1, ["one"], ["x", "y"]), (5, ["two"], [])]
    cells = spark.createDataFrame([("d", 1, 1, "[01]A"), ("d", 2, 2, "[02] B"), ("d", 3, 3, "[03]C"), ("d", 4, 2, "[04]D"), ("d", 5, 3, "[05]E"), ("d", 6, 1, "[06]F"), ("d", 7, 3, "[07]G"), ("d", 8, 2, "note")], "doc_id string, row_no int, col_no int, value string")
    assert {r.name: r.path for r in sheets.classification(cells).collect()} == {"A": ["A"], "B": ["A", "B"], "C": ["A", "B", "C"], "D": ["A", "D"], "E": ["A", "D", "E"], "F": ["F"], "G": ["F", "G"]}
    cards = spark.createDataFrame([(1, "유아교육 [AB12]"), (2, "합 계"), (3, "x")], "card_no int, value string")
    assert [(r.name, r.code) for r in sheets.cards(cards).collect()] == [("유아교육", "AB12"), ("x", None)]
    region = spark.createDataFrame([("d", "s", 4, 1, "v"), ("d", "s", 4, 2, "w"), ("d", "s", 5, 1, "※ note"), ("d", "s", 6, 1, "z"), ("d", "s", 9, 1, "out")], "doc_id string, sheet string, row_no int, col_no int, value string")
    assert sorted(r.value for r in sheets.table_data(region, 3, 8).collect()) == ["v", "w", "z"]


def test_outputs_are_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("c1", 1, 1, "2100143", False), ("c1", 2, 1, None, False), ("c2", 1, 1, "1", False), ("c2", 1, 2, "1", True)], "card string, project_ord int, pos int, code7 string, handover boolean")
    sinks.write_load_sheets(rows, str(tmp_path / "out"))
    entry = spark.read.parquet(str(tmp_path / "out/entry"))
    assert sorted((r.card, r.seq) for r in entry.collect()) == [("c1", 1), ("c1", 2), ("c2", 1)]
    assert spark.read.parquet(str(tmp_path / "out/guide")).where("code_missing").count() == 1 and spark.read.parquet(str(tmp_path / "out/not_entered")).count() == 1
    sinks.write_result(rows.limit(3), rows, str(tmp_path / "res"), "limit")
    assert tuple(spark.read.parquet(str(tmp_path / "res/log")).first())[:3] == (4, 3, 1)
    over = spark.createDataFrame([("21001", "", "2100143"), ("21001", "물", "2100122")], "code5 string, name string, code7 string")
    assert sorted(map(tuple, sinks.read_overrides(sinks.write_overrides(over)).collect())) == sorted(map(tuple, over.collect()))
    files = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"y"))], "doc_id string, content binary")
    hits = spark.createDataFrame([("a", True), ("a", False)], "doc_id string, selected boolean")
    assert sorted((r.found, r.selected, len(r.sha256), len(r.file)) for r in sinks.processing_report(files, hits).collect()) == [(0, 0, 64, 12), (2, 1, 64, 12)]


def test_a_report_has_issues_skipped_unresolved_and_numbers(spark, tmp_path):
    found = "goal string, severity string, project string, item string"
    rows = spark.createDataFrame([("totals", "error", "road", "a"), ("totals", "skipped", "road", "b"), ("form", "review", "none", "c"), ("form", "dropped", "road", "d")], found)
    findings = union_findings(rows.select(*finding("x", F.col("severity"), project=F.col("project"), item=F.col("item"), left=F.lit(3), right=F.lit(1))).withColumn("goal", F.lit("totals")))
    resolved = spark.createDataFrame([("road", "pay", "21006", "x", None, "several by code", False), ("road", "pay", "21006", "x", None, "several by code", False), ("road", "trip", None, None, None, "unknown code", False), ("road", "ok", "1", "", "2100143", "name", False), ("road", "away", "1", "", None, "unknown code", True)],
                                     "project string, name string, code5 string, account string, code7 string, source string, handover boolean")
    projects = spark.createDataFrame([("15", "road")], "number string, name string")
    sinks.write_report(findings, resolved, projects, spark.createDataFrame([("projects", 1)], "measure string, value int"), str(tmp_path / "r"))
    part = lambda name: spark.read.parquet(str(tmp_path / "r" / name))
    assert sorted((r.severity, r.label, r.item, r.gap) for r in part("issues").collect()) == [("error", "15. road", "a", 2.0), ("review", "none", "c", 2.0)]
    assert [(r.label, r.item) for r in part("skipped").collect()] == [("15. road", "b")]
    assert sorted(map(tuple, part("unresolved").collect())) == [("", "", "15. road", "trip", "unknown code", 1), ("21006", "x", "15. road", "pay", "several by code", 2)]
    assert dict(map(tuple, part("summary").collect())) == {"projects": 1, "totals error": 1, "totals skipped": 1, "totals review": 1, "totals dropped": 1}


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1")] * 3 + [("b", "2")], "k string, c string")
    for n in range(2):
        rows.coalesce(1).write.parquet(str(tmp_path / f"in{n}"))
    (tmp_path / "all").mkdir()
    for n in range(2):
        for f in (tmp_path / f"in{n}").glob("*.parquet"):
            f.rename(tmp_path / "all" / f"{n}.parquet")
    got = learn_stream(spark, str(tmp_path / "all"), "*.parquet", rows.schema, "k", "c")
    assert sorted(map(tuple, got.collect())) == [("a", "1", 6), ("b", "2", 2)]
    scan_stream(spark, str(tmp_path / "all"), rows.schema, lambda b: b.where("k = 'a'"), str(tmp_path / "scan"))
    assert spark.read.parquet(str(tmp_path / "scan/found")).count() == 6
    scan_stream(spark, str(tmp_path / "all"), rows.schema, lambda b: b.select(F.col("missing")), str(tmp_path / "broken"))
    assert spark.read.parquet(str(tmp_path / "broken/failed")).count() == 2
    # A file that can't be read costs no other file of its batch, and new files are scanned afterwards, each once.
    (tmp_path / "all" / "3.parquet").write_bytes(b"PAR1 no table PAR1")
    for _ in range(2):
        scan_stream(spark, str(tmp_path / "all"), rows.schema, lambda b: b.where("k = 'a'"), str(tmp_path / "mixed"))
        assert spark.read.parquet(str(tmp_path / "mixed/found")).count() == 6
        failed = [r.file for r in spark.read.parquet(str(tmp_path / "mixed/failed")).collect()]
        assert len(failed) == 1 and failed[0].endswith("3.parquet")
    rows.coalesce(1).write.parquet(str(tmp_path / "in4"))
    next((tmp_path / "in4").glob("*.parquet")).rename(tmp_path / "all" / "4.parquet")
    scan_stream(spark, str(tmp_path / "all"), rows.schema, lambda b: b.where("k = 'a'"), str(tmp_path / "mixed"))
    assert spark.read.parquet(str(tmp_path / "mixed/found")).count() == 9


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from recon.storage import shared_root

    conf = {}
    session = SimpleNamespace(conf=SimpleNamespace(get=conf.get, set=conf.__setitem__), sparkContext=SimpleNamespace(master="spark://a:7077"))
    with pytest.raises(RuntimeError):
        shared_root(session)
    session.sparkContext.master = "local[2]"
    assert shared_root(session) == conf["spark.checkpoint.dir"]
