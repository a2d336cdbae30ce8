from pyspark.sql import Window
from pyspark.sql import functions as F

from recon.operators import personal_data as pii


def found(spark, texts, **options):
    rows = spark.createDataFrame([(i, "t", t) for i, t in enumerate(texts)], "doc_id int, location string, text string")
    out = [set() for _ in texts]
    for r in pii.find(rows, **options).collect():
        out[r.doc_id].add((r.kind, r.value, round(r.confidence, 2)))
    return out


def test_rules_and_check_digits(spark):
    got = found(spark, ["이름: 홍길동 / 010-1234-5678", "4111-1111-1111-1111", "주문번호 2026082512345678", "등록번호 900101-5123456", "정산코드 991399-1234567", "생년월일: 19760913", "070-1234-5678", "1588-1234", "passport no. M12345678", "12-34-567890-12", None, ""])
    assert got[0] == {("name", "홍길동", 0.78), ("phone", "010-1234-5678", 0.95)}
    assert got[1] == {("card", "4111-1111-1111-1111", 0.95)} and got[2] == set()
    assert {k for k, *_ in got[3]} == {"resident_id"} and got[4] == set()
    assert {k for k, *_ in got[5]} == {"birth_date"}
    assert {k for k, *_ in got[6]} == {"phone"} and {k for k, *_ in got[7]} == {"phone"} and {k for k, *_ in got[8]} == {"passport"} and {k for k, *_ in got[9]} == {"licence"}
    assert got[10] == got[11] == set()


def test_validators(spark):
    rows = spark.createDataFrame([("220-81-62517", "4111111111111111", "900101-1234568"), ("220-81-62518", "4111111111111112", "900101-1234567")], "b string, c string, r string")
    got = rows.select(pii.business_id_ok(F.col("b")).alias("b"), pii.luhn_ok(F.col("c")).alias("c"), pii.resident_id_ok(F.col("r")).alias("r")).collect()
    assert [tuple(r) for r in got] == [(True, True, True), (False, False, False)]


def test_kinds_and_literals(spark):
    assert found(spark, ["a@b.io 1.2.3.4 se cret"], kinds=["email"], literals=["Secret"]) == [{("email", "a@b.io", 0.98), ("custom", "se cret", 1.0)}]


def test_masked_texts_hold_nothing(spark):
    texts = spark.createDataFrame([(1, "t", "a.b@c.io and A.B@C.IO, 1.2.3.4"), (2, "t", "again a.b@c.io (x) +1"), (3, "t", "clean $1 \\ text")], "doc_id int, location string, text string")
    hits = pii.select_confident(pii.find(texts))
    by = {m: {r.doc_id: r.text for r in pii.mask(texts, hits, m).collect()} for m in ("alias", "label", "delete")}
    assert by["alias"] == {1: "[email_0001] and [email_0001], [ip_0001]", 2: "again [email_0001] (x) +1", 3: "clean $1 \\ text"}
    assert by["label"][1] == "[email] and [email], [ip]" and by["delete"][2] == "again ■■■■■■■■ (x) +1"
    assert pii.residual(pii.mask(texts, hits), hits).count() == 0
    assert pii.residual(texts, hits).count() == hits.count()


def test_values_take_the_nearest_header_above(spark):
    rows = [("d", "s", 1, 1, "report"), ("d", "s", 2, 1, "성 명"), ("d", "s", 3, 1, "홍길동"), ("d", "s", 4, 1, "연락처"), ("d", "s", 5, 1, "010"), ("d", "s", 1, 2, "x")]
    cells = spark.createDataFrame(rows, "doc_id string, sheet string, row_no int, col_no int, value string")
    assert {(r.value, tuple(r.kinds)) for r in pii.under_headers(cells).collect()} == {("홍길동", ("name",)), ("010", ("phone",))}


def test_name_columns_evidence_and_report(spark):
    names = ["김철수", "이영희", "박민수", "최지우", "정우성", "제목"]
    cells = spark.createDataFrame([("d", "s", i, 1, n) for i, n in enumerate(names)] + [("d", "s", i, 2, "x") for i in range(9)], "doc_id string, sheet string, row_no int, col_no int, value string")
    assert [r.col_no for r in pii.name_columns(cells).collect()] == [1]
    hits = spark.createDataFrame([(1, "p", "name", "k", 0.8, "ocr", True, False), (1, "p", "name", "k", 0.8, "text", True, False), (1, "p", "ip", "q", 0.6, "ocr", False, True)], "doc_id int, location string, kind string, value_key string, confidence double, source string, selected boolean, low boolean")
    best = pii.best_evidence(hits)
    assert {(r.kind, r.source) for r in best.collect()} == {("name", "text"), ("ip", "ocr")}
    assert tuple(pii.report(best).first()) == (1, 2, 1, 1)


def test_numbers_of_string_ids_of_one_prefix_are_those_of_one_window(spark):
    n = 30_000
    hits = spark.range(n).select(F.when(F.col("id") % 500 != 7, F.concat(F.lit("s3://bucket/docs/"), F.lpad((F.col("id") * 7919 % n).cast("string"), 9, "0"))).alias("doc_id"), F.lit(1).alias("location"),
                                 F.when(F.col("id") % 3 == 0, "email").otherwise("phone").alias("kind"), F.concat(F.lit("v"), (F.col("id") % 9000).cast("string")).alias("value_key"))
    first = hits.groupBy("kind", "value_key").agg(F.min(F.struct("doc_id", "location")).alias("_at"))
    one = first.withColumn("n", F.row_number().over(Window.partitionBy("kind").orderBy("_at", "value_key")))
    want = {(r.kind, r.value_key): f"[{r.kind}_{r.n:04d}]" for r in one.collect()}
    assert {(r.kind, r.value_key): r.alias for r in pii.aliases(hits).collect()} == want
    cells = first.groupBy("kind", *pii.ranges(first.select(F.col("_at.doc_id").alias("x")), F.col("_at.doc_id"))).count()
    assert cells.agg(F.max("count")).first()[0] < first.count() / 40


def test_pii_luhn_reads_numbers_as_its_sql_does(spark, tmp_path):
    import duckdb

    from recon.plans import tables

    texts = ["+1 (314) 555-6532 4663622617512349 x", "4663622617512349", "a 4111-1111-1111-1111 4663622617512349", "466362261751234-95 card", "46636226175123491 card", "card 1234567890123456, 123456789012345", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(99, 1, texts[0]), (99, 2, texts[2])], "conv_id bigint, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = {(d, l, n, float(c)) for d, l, n, c in con.execute(tables.BOOK.sql["pii_luhn"]).fetchall()}
    assert {tuple(r) for r in tables.pii_luhn(spark, str(tmp_path)).collect()} == want and len(want) == 6
    assert found(spark, texts[:1], kinds=["card"])[0] == {("card", "4663622617512349 ", 0.95)}
