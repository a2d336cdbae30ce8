"""Queries of matching, codes, dimensions and rounds over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import codes, dims, match, rounds
from .common import Book, cents, read

BOOK = Book()


@BOOK.add("""
WITH l AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ' ' || c_name WHEN 1 THEN replace(c_name, '#', ' # ') WHEN 2 THEN c_name || '(신규, 계속)' ELSE c_name || '(본)' END AS name FROM customer),
r AS (SELECT c_custkey AS id, c_name AS rname FROM customer WHERE c_custkey % 10 <> 9 UNION ALL SELECT c_custkey + 1000000, c_name || ' ' FROM customer WHERE c_custkey % 50 = 6)
SELECT c_custkey, CASE WHEN c_custkey % 10 = 9 OR c_custkey % 4 = 3 OR c_custkey % 50 = 6 THEN NULL ELSE c_custkey END AS match,
 CASE WHEN c_custkey % 10 = 9 OR c_custkey % 4 = 3 OR c_custkey % 50 = 6 THEN NULL ELSE c_custkey % 4 + 1 END AS tier FROM customer""")
def name_join_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-spelled names against a list in which some are missing and some occur twice."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    k = F.col("c_custkey")
    left = c.select("c_custkey", F.when(k % 4 == 0, F.concat(F.lit(" "), "c_name")).when(k % 4 == 1, F.replace("c_name", F.lit("#"), F.lit(" # "))).when(k % 4 == 2, F.concat("c_name", F.lit("(신규, 계속)"))).otherwise(F.concat("c_name", F.lit("(본)"))).alias("name"))
    right = c.where(k % 10 != 9).select(k.alias("id"), F.col("c_name").alias("rname")).union(c.where(k % 50 == 6).select((k + 1_000_000).alias("id"), F.concat("c_name", F.lit(" ")).alias("rname")))
    return match.name_join(left, right, "name", "id", "rname").select("c_custkey", "match", "tier")


@BOOK.add("""
SELECT s_suppkey, min(c_custkey) AS c_custkey FROM supplier JOIN customer ON abs(s_acctbal - c_acctbal) <= 1 GROUP BY s_suppkey HAVING count(*) = 1""")
def amount_fallback_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.amount_join(read(spark, sf_dir, "supplier"), read(spark, sf_dir, "customer"), "s_suppkey", "s_acctbal", "c_custkey", "c_acctbal")


@BOOK.add("""
WITH a AS (SELECT o_orderkey AS k, o_totalprice AS declared FROM orders WHERE o_orderkey % 31 <> 5), b AS (SELECT o_orderkey AS k, o_totalprice + CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 0 END AS booked FROM orders WHERE o_orderkey % 29 <> 3)
SELECT k, declared, booked, CASE WHEN b.k IS NULL THEN 'missing right' WHEN a.k IS NULL THEN 'missing left' WHEN abs(declared - booked) < 0.5 THEN 'same' ELSE 'differs' END AS status FROM a FULL JOIN b USING (k)""")
def coverage_both_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_totalprice")
    a = o.where(F.col("k") % 31 != 5).withColumnRenamed("o_totalprice", "declared")
    b = o.where(F.col("k") % 29 != 3).select("k", (F.col("o_totalprice") + F.when(F.col("k") % 7 == 0, 2).otherwise(0)).alias("booked"))
    return match.coverage(a, b, "k", "declared", "booked")


@BOOK.add("""
WITH l AS (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS s, max(l_extendedprice) AS m FROM lineitem GROUP BY 1),
c AS (SELECT o_orderkey, o_totalprice AS t, s, m FROM orders LEFT JOIN l ON o_orderkey = l_orderkey)
SELECT o_orderkey, CASE WHEN s IS NULL THEN NULL WHEN abs(s - t) <= abs(m - t) THEN 'sum' ELSE 'max' END AS label, CASE WHEN s IS NULL THEN NULL ELSE least(abs(s - t), abs(m - t)) <= 5000 END AS ok FROM c""")
def closest_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(cents("l_extendedprice")).cast("double").alias("s"), F.max("l_extendedprice").alias("m"))
    rows = read(spark, sf_dir, "orders").join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    cands = F.array(F.struct(F.lit("sum").alias("label"), F.col("s").alias("value")), F.struct(F.lit("max").alias("label"), F.col("m").alias("value")))
    best = match.nearest_candidate(cands, F.col("o_totalprice"), 5000.0)
    return rows.select("o_orderkey", best["label"].alias("label"), best["ok"].alias("ok"))


_MADE = "SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_partkey % 9 = 0 THEN '' ELSE l_returnflag END AS code FROM lineitem"
_GOT = "SELECT l_orderkey, l_linenumber, l_quantity + CASE WHEN l_partkey % 50 = 7 THEN 1 ELSE 0 END AS l_quantity, l_returnflag AS code FROM lineitem WHERE l_suppkey % 40 <> 11"


@BOOK.add(f"""
WITH m AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_quantity, code ORDER BY code) AS n FROM ({_MADE}) WHERE code <> ''), b AS (SELECT * FROM ({_MADE}) WHERE code = ''),
g AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_quantity, code ORDER BY code) AS n FROM ({_GOT})),
lost AS (SELECT m.* FROM m ANTI JOIN g USING (l_orderkey, l_linenumber, l_quantity, code, n)), rest AS (SELECT g.* EXCLUDE (n) FROM g ANTI JOIN m USING (l_orderkey, l_linenumber, l_quantity, code, n)),
b2 AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_quantity ORDER BY code) AS n FROM b), r2 AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_quantity ORDER BY code) AS n FROM rest)
SELECT l_orderkey, l_linenumber, l_quantity, code, 'made' AS side FROM lost UNION ALL SELECT l_orderkey, l_linenumber, l_quantity, code, 'made' FROM b2 ANTI JOIN r2 USING (l_orderkey, l_linenumber, l_quantity, n)
UNION ALL SELECT l_orderkey, l_linenumber, l_quantity, code, 'got' FROM r2 ANTI JOIN b2 USING (l_orderkey, l_linenumber, l_quantity, n)""")
def form_diff_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "lineitem")
    made = l.select("l_orderkey", "l_linenumber", "l_quantity", F.when(F.col("l_partkey") % 9 == 0, "").otherwise(F.col("l_returnflag")).alias("code"))
    got = l.where(F.col("l_suppkey") % 40 != 11).select("l_orderkey", "l_linenumber", (F.col("l_quantity") + F.when(F.col("l_partkey") % 50 == 7, 1).otherwise(0)).alias("l_quantity"), F.col("l_returnflag").alias("code"))
    return match.diff_one_to_one(made, got, ["l_orderkey", "l_linenumber", "l_quantity"], "code")


@BOOK.add(f"""
WITH m AS (SELECT l_orderkey, l_linenumber, l_quantity FROM ({_MADE})), g AS (SELECT l_orderkey, l_linenumber, l_quantity FROM ({_GOT}))
SELECT *, 'left' AS side FROM (SELECT * FROM m EXCEPT ALL SELECT * FROM g) UNION ALL SELECT *, 'right' FROM (SELECT * FROM g EXCEPT ALL SELECT * FROM m)""")
def multiset_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "lineitem")
    cols = ["l_orderkey", "l_linenumber"]
    return match.multiset_gap(l.select(*cols, "l_quantity"), l.where(F.col("l_suppkey") % 40 != 11).select(*cols, (F.col("l_quantity") + F.when(F.col("l_partkey") % 50 == 7, 1).otherwise(0)).alias("l_quantity")))


_CARDS = "SELECT min(p_partkey) AS card_no, p_name || CASE WHEN length(p_name) % 2 = 0 THEN ' extra(특교)' ELSE '' END AS name FROM part WHERE p_name NOT LIKE 'red%' GROUP BY p_name"
_CARD_SQL = f"""
WITH cards AS ({_CARDS}), projects AS (SELECT p_partkey AS project_no, p_name || CASE WHEN p_partkey % 3 = 0 THEN ' more' ELSE '' END AS name FROM part),
ck AS (SELECT card_no, name AS card_name, regexp_replace(regexp_replace(name, '\\([^()]*\\)\\s*$', ''), '[\\s_\\-~]', '', 'g') AS ck FROM cards), pk AS (SELECT *, regexp_replace(name, '[\\s_\\-~]', '', 'g') AS k FROM projects),
hit AS (SELECT project_no, arg_min(card_name, (CASE WHEN k = ck THEN 0 ELSE 1 END) * 1000000000 + card_no) AS card FROM pk JOIN ck ON starts_with(k, ck) OR starts_with(ck, k) GROUP BY project_no),
a AS (SELECT p.project_no, p.name, coalesce(h.card, p.name) AS card, h.card IS NOT NULL AS matched FROM projects p LEFT JOIN hit h USING (project_no))
"""


def _assigned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = read(spark, sf_dir, "part")
    cards = p.where("p_name not like 'red%'").groupBy("p_name").agg(F.min("p_partkey").alias("card_no")).select("card_no", F.concat("p_name", F.when(F.length("p_name") % 2 == 0, F.lit(" extra(특교)")).otherwise("")).alias("name"))
    projects = p.select(F.col("p_partkey").alias("project_no"), F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, F.lit(" more")).otherwise("")).alias("name"))
    return dims.assign_cards(projects, cards), cards


@BOOK.add("""
WITH p AS (SELECT o_custkey AS key, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, (o_orderkey // 3) % 2 AS s FROM orders),
t AS (SELECT *, CASE WHEN s = lag(s) OVER (PARTITION BY key ORDER BY i) OR lag(s) OVER (PARTITION BY key ORDER BY i) IS NULL THEN 1 ELSE 0 END AS begins FROM p),
g AS (SELECT *, sum(begins) OVER (PARTITION BY key ORDER BY i) AS part FROM t),
n AS (SELECT *, row_number() OVER (PARTITION BY key, part ORDER BY i) AS k, count(*) OVER (PARTITION BY key, part) AS m FROM g)
SELECT key, round(i * 0.4, 1)::DOUBLE AS amount, CASE WHEN s = 0 THEN 'left' ELSE 'right' END AS side FROM n WHERE m % 2 = 1 AND k = m""")
def nearest_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts of a customer on a line, 0.4 apart, each of one side or the other: only neighbours are near, so where sides take turns every
    second one is paired, and of an odd number the last is left."""
    i = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.round(i * 0.4, 1).alias("amount"), (F.floor(F.col("o_orderkey") / 3) % 2).alias("s"))
    return match.multiset_gap(rows.where("s = 0").select("key", "amount"), rows.where("s = 1").select("key", "amount"), "amount")


@BOOK.add(_CARD_SQL + "SELECT project_no, name, card, matched FROM a")
def prefix_card_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir)[0].select("project_no", "name", "card", "matched")


@BOOK.add(_CARD_SQL + "SELECT name, 'project' AS side FROM a WHERE NOT matched UNION ALL SELECT name, 'card' FROM cards WHERE name NOT IN (SELECT card FROM a WHERE matched)")
def card_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dims.card_coverage(*_assigned(spark, sf_dir))


@BOOK.add("""
WITH f AS (SELECT o_orderkey, o_custkey, (o_orderkey % 11)::DOUBLE - 5 AS gap FROM orders WHERE o_orderkey % 11 <> 5), a AS (SELECT c_custkey, (c_custkey % 4)::DOUBLE AS adjust FROM customer)
SELECT o_orderkey, gap, CASE WHEN adjust <> 0 AND abs(abs(adjust) - abs(gap)) < 0.5 THEN 'skipped' ELSE 'issue' END AS route FROM f LEFT JOIN a ON o_custkey = c_custkey""")
def adjustment_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = read(spark, sf_dir, "orders").where("o_orderkey % 11 <> 5").select("o_orderkey", F.col("o_custkey").alias("project"), ((F.col("o_orderkey") % 11).cast("double") - 5).alias("gap"), F.lit("issue").alias("route"))
    a = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project"), (F.col("c_custkey") % 4).cast("double").alias("adjust"))
    return match.explain_by_adjustment(f, a, "project").select("o_orderkey", "gap", "route")


@BOOK.add("""
SELECT a.s_name || ' late' AS name, b.s_name AS other FROM supplier a JOIN supplier b ON round_even(a.s_acctbal, 0) = round_even(b.s_acctbal, 0) AND contains(a.s_name || ' late', b.s_name)""")
def contained_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    return match.contained_join(s.select(F.concat("s_name", F.lit(" late")).alias("name"), F.col("s_acctbal").alias("amount")), s.select(F.col("s_name").alias("other"), F.col("s_acctbal").alias("amount")), "name", "other", "amount")


@BOOK.add("""
WITH a AS (SELECT o_custkey AS k, o_orderkey AS pos, o_orderkey % 5 AS amt, o_orderstatus AS x FROM orders), b AS (SELECT o_custkey AS k, o_orderkey AS pos, (o_orderkey + 1) % 5 AS amt, o_orderstatus AS x FROM orders),
a1 AS (SELECT *, row_number() OVER (PARTITION BY k, amt, x ORDER BY pos) AS i FROM a), b1 AS (SELECT *, row_number() OVER (PARTITION BY k, amt, x ORDER BY pos) AS i FROM b),
m1 AS (SELECT a1.k, a1.pos, b1.pos AS other FROM a1 JOIN b1 USING (k, amt, x, i)),
a2 AS (SELECT *, row_number() OVER (PARTITION BY k, amt ORDER BY pos) AS i FROM a ANTI JOIN m1 USING (k, pos)), b2 AS (SELECT *, row_number() OVER (PARTITION BY k, amt ORDER BY pos) AS i FROM b WHERE (k, pos) NOT IN (SELECT (k, other) FROM m1))
SELECT k, pos, other FROM m1 UNION ALL SELECT a2.k, a2.pos, b2.pos FROM a2 JOIN b2 USING (k, amt, i)""")
def greedy_amount_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("pos"), F.col("o_orderstatus").alias("x"))
    return match.greedy_amounts(o.withColumn("amt", (F.col("pos") % 5).cast("double")), o.withColumn("amt", ((F.col("pos") + 1) % 5).cast("double")), ["k"], "amt", ["x"])


_FORMS = """forms AS (SELECT substr(p_brand, 7, 5) AS b, lpad((p_size % 40)::VARCHAR, 5, '0') || lpad((CASE WHEN p_partkey % 23 = 0 THEN p_partkey % 3 ELSE p_size % 2 END)::VARCHAR, 2, '0') AS code7, p_name AS raw, p_type AS parent, p_brand AS account, p_partkey FROM part)"""
_LEARN = f"""WITH {_FORMS}, rows_ AS (SELECT substr(code7, 1, 5) AS code5, account, parent, raw AS name, code7, p_partkey FROM forms WHERE p_partkey % 4 <> 0),
learned AS (SELECT 'account' AS kind, code5, account, NULL AS parent, NULL AS name, code7, count(*) AS n FROM rows_ GROUP BY ALL UNION ALL SELECT 'parent', code5, NULL, parent, name, code7, count(*) FROM rows_ GROUP BY ALL UNION ALL SELECT 'name', code5, NULL, NULL, name, code7, count(*) FROM rows_ GROUP BY ALL
 UNION ALL SELECT 'code', code5, NULL, NULL, NULL, code7, count(*) FROM rows_ GROUP BY ALL UNION ALL SELECT 'parent_only', NULL, NULL, parent, name, code7, count(*) FROM rows_ GROUP BY ALL UNION ALL SELECT 'name_only', NULL, NULL, NULL, name, code7, count(*) FROM rows_ GROUP BY ALL)"""
_RESOLVE = _LEARN + """, items AS (SELECT p_partkey, CASE WHEN p_partkey % 8 = 0 THEN '' ELSE substr(code7, 1, 5) END AS code5, raw AS name, parent, CASE WHEN p_partkey % 16 = 4 THEN account ELSE '' END AS account FROM forms WHERE p_partkey % 4 = 0),
d AS (SELECT kind, code5, account, parent, name, count(*) AS k, min(code7) AS c FROM learned GROUP BY kind, code5, account, parent, name),
j AS (SELECT i.*, a.k AS ak, a.c AS ac, p.k AS pk, p.c AS pc, q.k AS qk, q.c AS qc, n.k AS nk, n.c AS nc, o.k AS ok, o.c AS oc, x.k AS xk, x.c AS xc, y.k AS yk, y.c AS yc FROM items i
 LEFT JOIN d a ON a.kind = 'account' AND a.code5 = i.code5 AND a.account = i.account LEFT JOIN d p ON p.kind = 'parent' AND p.code5 = i.code5 AND p.parent = i.parent AND p.name = i.name LEFT JOIN d q ON q.kind = 'parent' AND q.code5 = i.code5 AND q.parent = i.account AND q.name = i.name
 LEFT JOIN d n ON n.kind = 'name' AND n.code5 = i.code5 AND n.name = i.name LEFT JOIN d o ON o.kind = 'code' AND o.code5 = i.code5 LEFT JOIN d x ON x.kind = 'parent_only' AND x.parent = i.parent AND x.name = i.name LEFT JOIN d y ON y.kind = 'name_only' AND y.name = i.name),
r AS (SELECT *, CASE WHEN code5 <> '' THEN CASE WHEN account <> '' AND ak = 1 THEN 'account' WHEN parent <> '' AND pk = 1 THEN 'parent' WHEN account <> '' AND qk = 1 THEN 'account as parent' WHEN nk = 1 THEN 'name' WHEN nk > 1 THEN 'several by name' WHEN ok = 1 THEN 'code' WHEN ok > 1 THEN 'several by code' ELSE 'unknown code' END
 ELSE CASE WHEN parent <> '' AND xk = 1 THEN 'parent only' WHEN yk = 1 THEN 'name only' WHEN yk > 1 THEN 'several by name only' ELSE 'unknown name' END END AS source FROM j),
resolved AS (SELECT p_partkey, code5, name, parent, account, source, CASE source WHEN 'account' THEN ac WHEN 'parent' THEN pc WHEN 'account as parent' THEN qc WHEN 'name' THEN nc WHEN 'code' THEN oc WHEN 'parent only' THEN xc WHEN 'name only' THEN yc END AS code7 FROM r)"""


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    tail = F.when(F.col("p_partkey") % 23 == 0, F.col("p_partkey") % 3).otherwise(F.col("p_size") % 2)
    code = F.concat(F.lpad((F.col("p_size") % 40).cast("string"), 5, "0"), F.lpad(tail.cast("string"), 2, "0"))
    mark = F.when(F.col("p_partkey") % 2 == 0, "(1) 가) ").otherwise("")
    return p.select("p_partkey", code.alias("code7"), F.concat(mark, "p_name").alias("name"), F.col("p_type").alias("parent"), F.col("p_brand").alias("account"), F.col("p_name").alias("raw"))


def _learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.learn(_forms(spark, sf_dir).where("p_partkey % 4 <> 0"))


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _forms(spark, sf_dir).where("p_partkey % 4 = 0")
    items = f.select("p_partkey", F.when(F.col("p_partkey") % 8 == 0, "").otherwise(F.substring("code7", 1, 5)).alias("code5"), F.col("raw").alias("name"), "parent", F.when(F.col("p_partkey") % 16 == 4, F.col("account")).otherwise("").alias("account"))
    return codes.resolve(items, _learned(spark, sf_dir))


@BOOK.add(_LEARN + " SELECT kind, code5, account, parent, name, code7, n FROM learned")
def learn_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _learned(spark, sf_dir)


@BOOK.add(_RESOLVE + " SELECT p_partkey, code7, source FROM resolved")
def resolve_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).select("p_partkey", "code7", "source")


_OVER = """, over_ AS (SELECT '' AS code5, 'ECONOMY > ' || min(name) AS name, '9999901' AS code7 FROM resolved UNION ALL SELECT '', max(name), '9999902' FROM resolved UNION ALL SELECT '00005', '', '9999903' UNION ALL SELECT '00007', min(name), '9999904' FROM resolved),
dec AS (SELECT r.p_partkey, r.code5, r.name, coalesce(a.code7, b.code7, c.code7) AS o, r.code7, r.source FROM resolved r LEFT JOIN over_ a ON a.code5 = r.code5 AND a.name = CASE WHEN r.code5 = '' THEN r.parent || ' > ' || r.name ELSE r.name END
 LEFT JOIN over_ b ON r.code5 = '' AND b.code5 = '' AND b.name = r.name LEFT JOIN over_ c ON r.code5 <> '' AND c.code5 = r.code5 AND c.name = '')"""


@BOOK.add(_RESOLVE + _OVER + " SELECT p_partkey, coalesce(o, code7) AS code7, CASE WHEN o IS NOT NULL THEN 'decided' ELSE source END AS source FROM dec")
def override_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _resolved(spark, sf_dir)
    ends = r.agg(F.min("name").alias("lo"), F.max("name").alias("hi"))
    over = ends.select(F.inline(F.array(*[F.struct(F.lit(c).alias("code5"), n.alias("name"), F.lit(v).alias("code7")) for c, n, v in (
        ("", F.concat(F.lit("ECONOMY > "), "lo"), "9999901"), ("", F.col("hi"), "9999902"), ("00005", F.lit(""), "9999903"), ("00007", F.col("lo"), "9999904"))])))
    return codes.decide(r, over).select("p_partkey", "code7", "source")


@BOOK.add(_RESOLVE + """, n AS (SELECT code5, name, count(*) AS rows_, count(*) FILTER (code7 IS NULL) AS open_rows, min(code7) AS lo, max(code7) AS hi FROM resolved GROUP BY 1, 2),
g AS (SELECT code5, CASE WHEN open_rows > 0 OR lo <> hi THEN NULL ELSE lo END AS e, sum(rows_) AS rows_, sum(open_rows) AS open_rows FROM n GROUP BY ALL)
SELECT code5, sum(rows_)::BIGINT AS rows, sum(open_rows)::BIGINT AS open_rows, count(*) AS groups, count(DISTINCT e) > 1 AS split FROM g GROUP BY code5""")
def open_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.open_decisions(_resolved(spark, sf_dir))


@BOOK.add(f"WITH {_FORMS} SELECT code7, raw AS name, n, rank FROM (SELECT code7, raw, count(*) AS n, row_number() OVER (PARTITION BY code7 ORDER BY count(*) DESC, raw) AS rank FROM forms GROUP BY 1, 2) WHERE rank <= 3")
def common_code_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.common_names(_forms(spark, sf_dir).select("code7", F.col("raw").alias("name")))


@BOOK.add(f"WITH {_FORMS} SELECT code7, min(parent) AS detail FROM forms GROUP BY code7 HAVING count(DISTINCT parent) = 1")
def unanimous_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.unanimous_detail(_forms(spark, sf_dir).select("code7", F.col("parent").alias("detail")))


@BOOK.add("""
WITH p AS (SELECT s_suppkey AS project_no, CASE WHEN s_suppkey % 6 = 0 THEN 'REGION X' ELSE r_name END AS outer_, CASE WHEN s_suppkey % 7 = 0 THEN n_name || '9' ELSE replace(n_name, '_', ' - ') END AS inner_, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT project_no, 'outer' AS level, outer_ AS name, 'not in the classification' AS problem FROM p WHERE outer_ = 'REGION X'
UNION ALL SELECT project_no, 'inner', inner_, 'not in the classification' FROM p WHERE project_no % 7 = 0 AND replace(inner_, '_', '') NOT IN (SELECT replace(n_name, '_', '') FROM nation)
UNION ALL SELECT p.project_no, 'inner', inner_, 'another parent' FROM p JOIN nation n ON regexp_replace(inner_, '[\\s\\-_]', '', 'g') = replace(n.n_name, '_', '') JOIN region r ON n.n_regionkey = r.r_regionkey WHERE regexp_replace(outer_, '\\s', '', 'g') <> regexp_replace(r.r_name, '\\s', '', 'g')""")
def class_path_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    p = read(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    projects = p.select(k.alias("project_no"), F.when(k % 6 == 0, "REGION X").otherwise(F.col("r_name")).alias("outer"), F.when(k % 7 == 0, F.concat("n_name", F.lit("9"))).otherwise(F.replace("n_name", F.lit("_"), F.lit(" - "))).alias("inner"))
    classes = n.select(F.lit("inner").alias("level"), F.col("n_name").alias("name"), F.col("r_name").alias("parent_name")).union(read(spark, sf_dir, "region").select(F.lit("outer"), "r_name", F.lit("").cast("string")))
    return dims.check_classes(projects, classes, ["outer", "inner"], "inner", "outer")


_LEDGER = """SELECT *, coalesce(sum(change) OVER (PARTITION BY n_nationkey, c_mktsegment ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
 FROM (SELECT c_nationkey AS n_nationkey, c_mktsegment, year(o_orderdate) AS y, sum(o_totalprice::DECIMAL(18,2)) AS change FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


@BOOK.add(f"""
WITH l AS ({_LEDGER}), p AS (SELECT n_nationkey, c_mktsegment, y + 1 AS y, before + change AS closing FROM l WHERE n_nationkey % 9 <> 4), c AS (SELECT n_nationkey, c_mktsegment, y, before + CASE WHEN n_nationkey % 6 = 1 THEN 3 ELSE 0 END AS before FROM l)
SELECT n_nationkey, c_mktsegment, y, before::DECIMAL(28,2) AS before, closing::DECIMAL(28,2) AS closing, CASE WHEN closing IS NULL THEN 'not in the round before' ELSE 'differs' END AS problem FROM c LEFT JOIN p USING (n_nationkey, c_mktsegment, y) WHERE (closing IS NULL AND abs(before) >= 0.5) OR abs(before - closing) >= 0.5""")
def round_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every year's amounts before against what the year before it closed with; some nations are missing there, some differ."""
    keys = ["n_nationkey", "c_mktsegment"]
    l = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment", F.year("o_orderdate").alias("y")).agg(F.sum(cents("o_totalprice")).alias("change"))
    l = l.withColumn("before", F.coalesce(F.sum("change").over(Window.partitionBy(*keys).orderBy("y").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    previous = rounds.closing(l.where("n_nationkey % 9 <> 4").select(*keys, (F.col("y") + 1).alias("y"), F.lit(None).cast("decimal(18,2)").alias("request"), "before", "change"), [*keys, "y"])
    current = l.select(*keys, "y", (F.col("before") + F.when(F.col("n_nationkey") % 6 == 1, 3).otherwise(0)).alias("before"))
    out = rounds.continuity(current, previous, [*keys, "y"])
    return out.select(*keys, "y", F.col("before").cast("decimal(28,2)").alias("before"), F.col("closing").cast("decimal(28,2)").alias("closing"), "problem")


@BOOK.add("""
WITH f AS (SELECT year(o_orderdate) AS year, month(o_orderdate) AS round, o_orderkey::VARCHAR AS path, o_orderdate AS modified FROM orders)
SELECT f.path, f.year, f.round, p.previous FROM f LEFT JOIN (SELECT year, round + 1 AS round, arg_max(path, (modified, path)) AS previous FROM f GROUP BY year, f.round) p USING (year, round)""")
def previous_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("bigint").alias("year"), F.month("o_orderdate").cast("bigint").alias("round"), F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderdate").alias("modified"))
    return rounds.previous_round(files).select("path", "year", "round", "previous")
