"""Queries of delta documents, load sheets, ledgers, codes and run summaries: orders of customers as the groups of pages."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.formula import basis_text, basis_value
from ..functions.numbers import unit_number, with_previous
from ..operators import codes, delta, delta_document, dims, match, personal_data, reconcile, summaries
from ..sources import delimited, sheets
from ..storage import shared_root
from .common import Book, parts, read
from .joins import _LEARN, _RESOLVE, _learned, _resolved

BOOK = Book()


def K() -> Column:  # noqa: N802
    return F.col("o_orderkey")


def C() -> Column:  # noqa: N802
    return F.col("o_custkey")


#: Orders as groups: amounts after and their change; every fifth order is one that isn't reflected.
_GROUPS = "SELECT o_custkey AS k, o_orderkey AS g, floor(o_totalprice) AS a, o_orderkey % 7 - 3 AS ch, o_orderkey % 5 = 0 AS idle FROM orders"


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    change, after = (K() % 7 - 3).cast("double"), F.floor("o_totalprice").cast("double")
    idle = K() % 5 == 0
    return read(spark, sf_dir, "orders").select(F.lit("d").alias("doc_id"), C().alias("project_no"), F.when(idle, 2).otherwise(1).alias("table_no"), K().alias("group_no"), F.when(idle, "unreflected").otherwise("change").alias("kind"), F.concat(F.lit("g"), K().cast("string")).alias("title"),
        after.alias("after"), (after - change).alias("before"), F.lit(0.0).alias("previous"), change.alias("change"), F.lit(None).cast("double").alias("own"), F.lit("").alias("formula"), F.lit(False).alias("is_total"))


_HEADS = f"""g AS ({_GROUPS}), s AS (SELECT k, sum(a) AS sa, sum(a - ch) AS sb, sum(ch) AS sc, bool_or(idle) AS idle FROM g GROUP BY k),
p AS (SELECT *, sa + CASE WHEN k % 11 = 0 THEN 5 ELSE 0 END AS a, sb AS b, sc + CASE WHEN k % 13 = 0 THEN 2 ELSE 0 END AS c FROM s)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = _groups(spark, sf_dir).groupBy("doc_id", "project_no").agg(*[F.sum(m).alias(m) for m in ("after", "before", "change")])
    k = F.col("project_no")
    return sums.withColumns({"name": F.concat(F.lit("c"), k.cast("string")), "after": F.col("after") + F.when(k % 11 == 0, 5).otherwise(0), "change": F.col("change") + F.when(k % 13 == 0, 2).otherwise(0)})


@BOOK.add(f"""
WITH {_HEADS}, q AS (SELECT *, CASE WHEN k % 3 = 0 THEN b ELSE a END AS cost, 'c' || k AS project FROM p)
SELECT project, 'error' AS severity, 'after - before is not the change' AS message FROM q WHERE a - b <> c
UNION ALL SELECT project, 'error', 'total cost is still the amount before' FROM q WHERE k % 2 = 0 AND cost <> a
UNION ALL SELECT project, 'error', 'funding is not the total cost' FROM q WHERE k % 17 = 0
UNION ALL SELECT project, 'error', 'tables do not add up to the head: change' FROM q WHERE sc <> c
UNION ALL SELECT project, 'error', 'tables do not add up to the head: after' FROM q WHERE sa <> a AND (sc <> c OR idle)
UNION ALL SELECT project, 'review', 'unchanged parts are not in the tables' FROM q WHERE sa <> a AND sc = c AND NOT idle""")
def delta_head_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads of pages with planted errors against the tables of their groups."""
    k = F.col("project_no")
    cost = F.when(k % 3 == 0, F.col("before")).otherwise(F.col("after"))
    funding = F.create_map(F.lit("a"), cost - 1, F.lit("b"), F.lit(1.0) + F.when(k % 17 == 0, 4).otherwise(0))
    pages = _pages(spark, sf_dir).withColumns({"total_cost": cost, "funding": funding, "year_from": F.lit(2026), "year_to": (F.lit(2026) + k % 2).cast("int")})
    return delta_document.check_heads(pages, _groups(spark, sf_dir)).select("project", "severity", "message")


_STATUS = """SELECT n_name AS doc, c_mktsegment AS seg, year(o_orderdate) AS y, sum(floor(o_totalprice)) AS a, count(*) AS c FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL"""


@BOOK.add(f"""
WITH y AS ({_STATUS}), ys AS (SELECT *, CASE WHEN y % 3 = 0 THEN c + 1 ELSE c END AS ch FROM y), s AS (SELECT doc, seg, sum(a) + CASE WHEN seg = 'BUILDING' THEN 4 ELSE 0 END AS a, sum(a - c) AS b, sum(ch) AS ch, sum(a) AS ra, sum(a - c) AS rb, sum(ch) AS rc FROM ys GROUP BY doc, seg),
n AS (SELECT doc, sum(a) AS a, sum(b) AS b, sum(ch) + CASE WHEN doc LIKE '%1%' THEN 2 ELSE 0 END AS ch, sum(a) AS ra, sum(b) AS rb, sum(ch) AS rc FROM s GROUP BY doc),
r AS (SELECT doc, y::VARCHAR AS name, a, a - c AS b, ch, NULL AS ra, NULL AS rb, NULL AS rc FROM ys UNION ALL SELECT doc, seg, a, b, ch, ra, rb, rc FROM s UNION ALL SELECT doc, 'all', a, b, ch, ra, rb, rc FROM n)
SELECT doc AS doc_id, name AS project, NULL AS item, ch::DOUBLE AS "left", (a - b)::DOUBLE AS "right" FROM r WHERE a - b <> ch
UNION ALL SELECT doc, name, 'after', a, ra FROM r WHERE a <> ra UNION ALL SELECT doc, name, 'before', b, rb FROM r WHERE b <> rb UNION ALL SELECT doc, name, 'change', ch, rc FROM r WHERE ch <> rc""")
def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations over segments over years as a table of status, with wrong sums on two levels and wrong changes on the third."""
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), C() == F.col("c_custkey")).join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    y = o.groupBy(F.col("n_name").alias("doc"), F.col("c_mktsegment").alias("seg"), F.year("o_orderdate").alias("y")).agg(F.sum(F.floor("o_totalprice")).alias("a"), F.count(F.lit(1)).alias("c"))
    y = y.select("doc", "seg", "y", F.lit(2).alias("level"), "a", (F.col("a") - F.col("c")).alias("b"), (F.col("c") + F.when(F.col("y") % 3 == 0, 1).otherwise(0)).alias("ch"))
    sums = [F.sum(m).alias(m) for m in ("a", "b", "ch")]
    s = y.groupBy("doc", "seg").agg(*sums).select("doc", "seg", F.lit(None).cast("int").alias("y"), F.lit(1).alias("level"), (F.col("a") + F.when(F.col("seg") == "BUILDING", 4).otherwise(0)).alias("a"), "b", "ch")
    n = s.groupBy("doc").agg(*sums).select("doc", F.lit(None).cast("string").alias("seg"), F.lit(None).cast("int").alias("y"), F.lit(0).alias("level"), "a", "b", (F.col("ch") + F.when(F.col("doc").contains("1"), 2).otherwise(0)).alias("ch"))
    at = F.row_number().over(Window.partitionBy("doc").orderBy(F.asc_nulls_first("seg"), F.asc_nulls_first("y")))
    rows = y.unionByName(s).unionByName(n).select(F.col("doc").alias("doc_id"), at.alias("row_no"), "level", F.coalesce(F.col("y").cast("string"), "seg", F.lit("all")).alias("name"), *[F.col(x).cast("double").alias(to) for x, to in (("a", "after"), ("b", "before"), ("ch", "change"))])
    return delta_document.check_status(rows).select("doc_id", "project", "item", "left", "right")


@BOOK.add(f"""
WITH {_HEADS}, r AS (SELECT k % 25 AS doc, 'c' || k AS project, a, b, c FROM p), t AS (SELECT doc, sum(a) AS a, sum(b) AS b, sum(c) AS c FROM r GROUP BY doc)
SELECT doc::VARCHAR AS doc_id, project, NULL AS item, c::DOUBLE AS "left", (a - b)::DOUBLE AS "right" FROM r WHERE a - b <> c
UNION ALL SELECT doc::VARCHAR, NULL, 'after', a + 3, a FROM t WHERE doc % 4 = 1 UNION ALL SELECT doc::VARCHAR, NULL, 'change', c - 1, c FROM t WHERE doc % 6 = 2""")
def summary_table_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pages(spark, sf_dir).select((F.col("project_no") % 25).cast("string").alias("doc_id"), "name", "after", "before", "change", F.lit(False).alias("is_total"))
    d = F.col("doc_id").cast("int")
    total = rows.groupBy("doc_id").agg(*[F.sum(m).alias(m) for m in ("after", "before", "change")]).select("doc_id", F.lit(None).cast("string").alias("name"), (F.col("after") + F.when(d % 4 == 1, 3).otherwise(0)).alias("after"), "before", (F.col("change") - F.when(d % 6 == 2, 1).otherwise(0)).alias("change"), F.lit(True).alias("is_total"))
    return delta_document.check_summary_table(rows.unionByName(total)).select("doc_id", "project", "item", "left", "right")


@BOOK.add(f"""
WITH {_HEADS}, d AS (SELECT * FROM (VALUES ('one', 7, 0), ('two', 5, 1000)) v(doc, m, plus)), pages AS (SELECT doc, m, k, a + plus AS a, b + plus AS b, c FROM p, d),
s2 AS (SELECT doc, k, CASE WHEN k % 4 = 0 THEN NULL ELSE k END AS no, CASE WHEN k % 4 = 1 THEN 'x' ELSE 'c' || k END AS name, a, b, c + CASE WHEN k % m = 0 THEN 1 ELSE 0 END AS c FROM pages WHERE k % 10 <> 9)
SELECT p.doc AS doc_id, 'c' || p.k AS project, CASE WHEN s2.k IS NULL THEN 'not in the summary' ELSE 'change differ from the summary' END AS message FROM pages p LEFT JOIN s2 USING (doc, k) WHERE s2.k IS NULL OR s2.c <> p.c""")
def pages_against_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of two documents with the same names and numbers, found in their own summary by number and name, by number alone, or by name alone."""
    k = F.col("project_no")
    docs = F.explode(F.array(*[F.struct(F.lit(d).alias("doc"), F.lit(m).alias("m"), F.lit(plus).alias("plus")) for d, m, plus in (("one", 7, 0), ("two", 5, 1000))])).alias("d")
    p = _pages(spark, sf_dir).select("project_no", "name", "change", "after", "before", docs).select("project_no", "name", "change", F.col("d.doc").alias("doc_id"), F.col("d.m").alias("m"), *[(F.col(c) + F.col("d.plus")).alias(c) for c in ("after", "before")])
    summary = p.where(k % 10 != 9).select("doc_id", F.when(k % 4 != 0, k).alias("number"), F.when(k % 4 == 1, "x").otherwise(F.col("name")).alias("name"), "after", "before", (F.col("change") + F.when(k % F.col("m") == 0, 1).otherwise(0)).alias("change"))
    pages = p.withColumn("number", k).withColumn("bundled", F.lit(False))
    return reconcile.compare_summary(pages, summary).select("doc_id", "project", "message")


@BOOK.add("SELECT c_nationkey::VARCHAR AS doc_id, 'p ' || (c_custkey % 97) AS project, count(*)::DOUBLE AS n FROM customer GROUP BY c_nationkey, c_custkey % 97 HAVING count(*) > 1")
def duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = read(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("doc_id"), k.alias("project_no"), F.concat(F.lit("p "), (k % 97).cast("string")).alias("name"))
    return delta_document.check_names(rows).select("doc_id", "project", F.col("left").alias("n"))


#: Orders below customers as a load sheet, with errors by key.
_FORM = f"""f AS (SELECT k, g, a, a - ch AS b, ch + CASE WHEN g % 31 = 0 THEN 1 ELSE 0 END AS c FROM ({_GROUPS})),
t AS (SELECT k, sum(a) + CASE WHEN k % 19 = 0 THEN 9 ELSE 0 END AS a, sum(b) AS b, sum(c) AS c, sum(a) AS ra, count(*) FILTER (g % 41 = 0 OR g % 31 = 0) AS broken FROM f GROUP BY k)"""


def _form(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _groups(spark, sf_dir).select("project_no", F.col("group_no").alias("g"), "before", F.col("after").alias("amount"), (F.col("change") + F.when(F.col("group_no") % 31 == 0, 1).otherwise(0)).alias("change"))
    top = g.groupBy("project_no").agg(*[F.sum(m).alias(m) for m in ("before", "amount", "change")]).withColumn("amount", F.col("amount") + F.when(F.col("project_no") % 19 == 0, 9).otherwise(0)).withColumn("g", F.lit(-1).cast("bigint"))
    rows = g.unionByName(top).withColumn("leaf", F.col("g") >= 0)
    shown = lambda x: F.concat(x.cast("bigint").cast("string"), F.lit("천원="))
    bottom = lambda x: F.when(F.col("leaf"), x)
    return rows.select(F.concat(F.lit("d"), F.col("project_no").cast("string")).alias("doc_id"), F.col("g").alias("row_no"), F.when(F.col("leaf"), 2).otherwise(1).alias("level"), F.when(F.col("leaf") & (F.col("g") % 53 != 0), 2).otherwise(0).alias("indent"),
        F.when(F.col("leaf"), F.concat(F.lit("r"), F.col("g").cast("string"))).otherwise("top").alias("name"), bottom(F.when(F.col("g") % 37 != 0, "2100143")).alias("code7"), bottom(F.lit("what")).alias("detail"), F.lit(None).cast("string").alias("basis_before"), "before",
        bottom(shown(F.col("amount") + F.when(F.col("g") % 41 == 0, 5).otherwise(0))).alias("basis"), "amount", "change", "leaf")


@BOOK.add(f"""
WITH {_FORM}, l AS (SELECT *, concat_ws(', ', CASE WHEN g % 41 = 0 THEN 'basis' END, CASE WHEN a - b <> c THEN 'change' END, CASE WHEN g % 53 = 0 THEN 'level' END, CASE WHEN g % 37 = 0 THEN 'no code' END) AS m FROM f)
SELECT 'd' || k AS doc_id, 'r' || g AS item, m AS message FROM l WHERE m <> ''
UNION ALL SELECT 'd' || k, 'top', 'change' FROM t WHERE a - b <> c
UNION ALL SELECT 'd' || k, 'top', 'not the sum of its rows: amount' FROM t WHERE a <> ra AND broken = 0""")
def form_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.check_form(_form(spark, sf_dir)).select("doc_id", "item", "message")


@BOOK.add(f"""
WITH {_FORM}, l AS (SELECT k, g, a + CASE WHEN g % 41 = 0 THEN 5 ELSE 0 END AS v, a FROM f)
SELECT 'd' || k AS doc_id, 'r' || g AS item, 'level is not the indent''s' AS message FROM l WHERE g % 53 = 0 UNION ALL SELECT 'd' || k, 'r' || g, 'basis is not the amount' FROM l WHERE abs(v - a) > 1 UNION ALL SELECT 'd' || k, 'r' || g, 'no code' FROM l WHERE g % 37 = 0""")
def entered_form_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.check_entered(_form(spark, sf_dir)).select("doc_id", "item", "message")


@BOOK.add(f"""
WITH {_FORM}, led AS (SELECT k, b + CASE WHEN k % 8 = 3 THEN 2 ELSE 0 END AS b, c + CASE WHEN k % 9 = 4 THEN 2 ELSE 0 END AS c FROM t WHERE k % 12 <> 7), nar AS (SELECT k, b + CASE WHEN k % 5 = 2 THEN 6 ELSE 0 END AS b, a, c + CASE WHEN k % 14 = 5 THEN 1 ELSE 0 END AS c FROM t WHERE k % 15 <> 8),
m AS (SELECT t.*, led.k AS lk, led.b AS lb, led.c AS lc, nar.k AS nk, nar.b AS nb, nar.c AS nc FROM t LEFT JOIN led USING (k) LEFT JOIN nar USING (k))
SELECT 'd' || k AS doc_id, NULL AS item, 'not in the ledger' AS message FROM m WHERE lk IS NULL UNION ALL SELECT 'd' || k, NULL, 'change differs from the ledger' FROM m WHERE lc <> c UNION ALL SELECT 'd' || k, NULL, 'before differs from the ledger' FROM m WHERE lb <> b
UNION ALL SELECT 'd' || k, NULL, 'not in the narrative' FROM m WHERE nk IS NULL UNION ALL SELECT 'd' || k, NULL, 'change differs from the narrative' FROM m WHERE nc <> c
UNION ALL SELECT 'd' || k, NULL, 'before differs from the narrative' FROM m WHERE nc = c AND nb <> b AND NOT (lk IS NOT NULL AND lb = b)
UNION ALL SELECT 'd' || k, 'g' || g, 'no row of the form has this change' FROM f JOIN m USING (k) WHERE g % 43 = 0 AND nc = m.c""")
def form_against_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Downloaded sheets against narrative and ledger, both with planted differences; some groups have a change that no row has. All documents
    have a project of the same name and number."""
    f = _form(spark, sf_dir).withColumn("k", F.substring("doc_id", 2, 20).cast("bigint"))
    rows = f.select(F.lit("d").alias("x"), "doc_id", "row_no", F.col("level").alias("depth"), F.when(F.col("leaf"), F.col("name")).otherwise("road").alias("name"), "before", F.col("amount").alias("after"), "change").drop("x")
    top, k = f.where("not leaf").select("k", "doc_id", F.lit("road").alias("name"), "before", F.col("amount").alias("after"), "change"), F.col("k")
    plus = lambda c, when, n: (F.col(c) + F.when(when, n).otherwise(0)).alias(c)
    ledger = top.where(k % 12 != 7).select("doc_id", F.lit(1).alias("row_no"), "name", plus("before", k % 8 == 3, 2), plus("change", k % 9 == 4, 2), F.lit(False).alias("unplanned"))
    pages = top.where(k % 15 != 8).select("doc_id", F.lit(1).alias("project_no"), "name", plus("before", k % 5 == 2, 6), "after", plus("change", k % 14 == 5, 1))
    groups = f.where("leaf").select("doc_id", F.lit(1).alias("project_no"), F.col("row_no").alias("group_no"), F.concat(F.lit("g"), F.col("row_no").cast("string")).alias("title"), "before", F.col("amount").alias("after"), plus("change", F.col("row_no") % 43 == 0, 1000))
    return reconcile.compare_form(rows, pages, ledger, groups, depths=2).select("doc_id", "item", "message")


@BOOK.add("""
WITH l AS (SELECT o_orderkey AS id, 'n' || (o_custkey // 3) || CASE WHEN o_orderkey % 3 = 0 THEN ' ' WHEN o_orderkey % 3 = 1 THEN ' x' ELSE 'x(신규)' END AS name, o_orderkey % 4 <> 0 AS idle FROM orders),
w AS (SELECT DISTINCT 'n' || (o_custkey // 3) || 'x' AS name FROM orders), keyed AS (SELECT id, idle, trim(name) AS e, replace(trim(name), ' ', '') AS s, replace(replace(trim(name), ' ', ''), '(신규)', '') AS m FROM l),
e AS (SELECT e AS k, min(id) AS id FROM keyed GROUP BY 1), s AS (SELECT s AS k, CASE WHEN count(*) = 1 THEN min(id) WHEN count(*) FILTER (NOT idle) = 1 THEN min(id) FILTER (NOT idle) END AS id FROM keyed GROUP BY 1), m AS (SELECT m AS k, CASE WHEN count(*) = 1 THEN min(id) WHEN count(*) FILTER (NOT idle) = 1 THEN min(id) FILTER (NOT idle) END AS id FROM keyed GROUP BY 1)
SELECT w.name, coalesce(e.id, s.id, m.id) AS match, CASE WHEN e.id IS NOT NULL THEN 1 WHEN s.id IS NOT NULL THEN 2 WHEN m.id IS NOT NULL THEN 3 END AS tier FROM w LEFT JOIN e ON e.k = w.name LEFT JOIN s ON s.k = w.name LEFT JOIN m ON m.k = w.name""")
def ledger_row_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names against a ledger in which most rows of a name were not touched."""
    o = read(spark, sf_dir, "orders")
    base = F.concat(F.lit("n"), F.floor(C() / 3).cast("string"))
    ledger = o.select(K().alias("row_no"), F.concat(base, F.when(K() % 3 == 0, " ").when(K() % 3 == 1, " x").otherwise("x(신규)")).alias("ledger_name"), (K() % 4 != 0).alias("unplanned"))
    return match.find_row(o.select(F.concat(base, F.lit("x")).alias("name")).distinct(), ledger, "name", "row_no", "ledger_name", "unplanned").select("name", "match", "tier")


@BOOK.add(f"""
WITH {_HEADS}, r AS (SELECT k % 25 AS d, sum(c) AS c, sum(b) AS b FROM p GROUP BY 1)
SELECT d::VARCHAR AS doc_id, 'change' AS item, c::DOUBLE AS "left", (c + 2)::DOUBLE AS "right" FROM r WHERE d % 3 = 0 UNION ALL SELECT d::VARCHAR, 'before', b, b - 1 FROM r WHERE d % 4 = 1""")
def agency_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _pages(spark, sf_dir).groupBy((F.col("project_no") % 25).cast("string").alias("doc_id")).agg(F.sum("change").alias("change"), F.sum("before").alias("before"))
    d = F.col("doc_id").cast("int")
    return reconcile.agency_totals(t, t.select("doc_id", (F.col("change") + F.when(d % 3 == 0, 2).otherwise(0)).alias("change"), (F.col("before") - F.when(d % 4 == 1, 1).otherwise(0)).alias("before"))).select("doc_id", "item", "left", "right")


@BOOK.add("""
WITH a AS (SELECT o_custkey AS key, (o_orderkey % 6)::DOUBLE AS amount FROM orders WHERE o_orderkey % 6 <> 0), b AS (SELECT o_custkey AS key, ((o_orderkey + o_custkey) % 6)::DOUBLE AS amount FROM orders WHERE (o_orderkey + o_custkey) % 6 <> 0)
SELECT key, amount, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT key, amount, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def differing_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single amounts of pages and ledger rows, the latter nested under headlines and a little off, one for one."""
    o = read(spark, sf_dir, "orders")
    mine = o.select(C().alias("key"), (K() % 6).cast("double").alias("amount"))
    detail = F.array(F.struct(F.lit("x").alias("label"), (K() + C()).cast("double").alias("amount")))
    line = F.struct(F.lit("h").alias("label"), F.when(K() % 2 == 0, ((K() + C()) % 6).cast("double") + 0.25).alias("amount"), F.when(K() % 2 == 1, F.transform(detail, lambda d: F.struct(d["label"].alias("label"), (d["amount"] % 6 + 0.25).alias("amount")))).alias("details"))
    theirs = o.groupBy(C().alias("key")).agg(F.collect_list(line).alias("h")).select("key", F.explode(reconcile.pieces(F.col("h"))).alias("amount"))
    return reconcile.differing_pieces(mine, theirs).select("key", F.floor("amount").cast("double").alias("amount"), "side")


@BOOK.add(_RESOLVE + """ SELECT p_partkey::VARCHAR AS project, name AS item, 'no code: ' || source || CASE WHEN code5 <> '' THEN ' (' || code5 || ')' ELSE '' END AS message FROM resolved WHERE code7 IS NULL AND p_partkey % 12 <> 0""")
def unresolved_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _resolved(spark, sf_dir).select(F.lit("d").alias("doc_id"), F.col("p_partkey").cast("string").alias("project"), "name", "code5", "code7", "source", (F.col("p_partkey") % 12 == 0).alias("handover"))
    return codes.unresolved(r).select("project", "item", "message")


@BOOK.add(_RESOLVE + """, totals AS (SELECT code5, count(*) AS n, count(*) FILTER (code7 IS NULL) AS o FROM resolved GROUP BY 1)
SELECT count(*) AS codes, count(*) FILTER (o > 0) AS open_codes, sum(n)::BIGINT AS rows, sum(n - o)::BIGINT AS settled_rows, count(*) FILTER (o > 0 AND code5 <> '') AS coded_kinds FROM totals""")
def decision_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.decision_totals(codes.open_decisions(_resolved(spark, sf_dir))).drop("split_codes")


@BOOK.add(_LEARN + """, k AS (SELECT kind, code5, account, parent, name, count(*) AS c, sum(n) AS n FROM learned GROUP BY ALL) SELECT kind, count(*) AS keys, count(*) FILTER (c = 1) AS unanimous, sum(n)::BIGINT AS rows FROM k GROUP BY kind""")
def learned_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.coverage(_learned(spark, sf_dir))


@BOOK.add("""
WITH k AS (SELECT printf('%07d', (p_size * 100000 + p_partkey % 7)::BIGINT) AS code7, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_name END AS name FROM part), i AS (SELECT printf('%05d', (p_size * 1000)::BIGINT) AS c, CASE WHEN p_size % 2 = 0 THEN 'one' ELSE p_brand END AS account FROM part),
b AS (SELECT c, min(account) AS a FROM i GROUP BY c HAVING count(DISTINCT account) = 1), o AS (SELECT code7, min(nullif(name, '')) AS name FROM k GROUP BY code7)
SELECT code7, coalesce(name, a, '') AS name FROM o LEFT JOIN b ON left(code7, 5) = c""")
def code_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k, z = read(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size").cast("bigint")
    known = p.select(F.lpad((z * 100_000 + k % 7).cast("string"), 7, "0").alias("code7"), F.when(k % 2 == 0, "").otherwise(F.col("p_name")).alias("name"))
    five = F.lpad((z * 1000).cast("string"), 5, "0")
    items = p.select(F.concat(F.substring(five, 1, 3), F.lit("-"), F.substring(five, 4, 2)).alias("code5"), F.when(z % 2 == 0, "one").otherwise(F.col("p_brand")).alias("account"))
    return codes.code_list(known, items)


@BOOK.add("""
WITH p AS (SELECT s_suppkey, CASE WHEN s_suppkey % 6 = 0 THEN 'REGION X' ELSE r_name END AS o, n_name AS i, r_name, n_nationkey, r_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT s_suppkey AS project_no, '[' || CASE WHEN o = 'REGION X' THEN '?' ELSE r_regionkey::VARCHAR END || ']' || o || ' > [' || n_nationkey || ']' || i AS described, CASE WHEN n_nationkey % 2 = 0 THEN 'even' END AS note FROM p""")
def class_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    p = read(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    projects = p.select(F.col("s_suppkey").alias("project_no"), F.when(F.col("s_suppkey") % 6 == 0, "REGION X").otherwise(F.col("r_name")).alias("outer"), F.col("n_name").alias("inner"))
    kind = lambda level, code, name, note: n.select(F.lit(level).alias("level"), F.col(code).cast("string").alias("code"), F.col(name).alias("name"), note.alias("note")).distinct()
    classes = kind("inner", "n_nationkey", "n_name", F.when(F.col("n_nationkey") % 2 == 0, "even")).unionByName(kind("outer", "r_regionkey", "r_name", F.lit(None).cast("string")))
    return dims.describe_classes(projects, classes, ["outer", "inner"]).select("project_no", "described", "note")


@BOOK.add("""SELECT count(*) FILTER (o_orderkey % 6 <> 0) AS entered, sum(CASE WHEN o_orderkey % 6 <> 0 THEN floor(o_totalprice) ELSE 0 END)::DOUBLE AS entered_amount, count(*) FILTER (o_orderkey % 6 = 0) AS handed_over, sum(CASE WHEN o_orderkey % 6 = 0 THEN floor(o_totalprice) ELSE 0 END)::DOUBLE AS handed_over_amount FROM orders""")
def goal_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.goals(read(spark, sf_dir, "orders").select(F.floor("o_totalprice").cast("double").alias("amount"), F.when(K() % 3 == 0, K() % 2 == 0).alias("handover")))


@BOOK.add("""
WITH i AS (SELECT o_custkey % 5 = 0 AS po, l_linenumber % 2 = 1 AS leaf, l_partkey % 9 = 0 AS own, l_suppkey % 4 = 0 AS open_ FROM lineitem JOIN orders ON l_orderkey = o_orderkey), p AS (SELECT DISTINCT o_custkey FROM orders)
SELECT 'projects' AS measure, count(*) AS value FROM p UNION ALL SELECT 'leaves', count(*) FROM i WHERE leaf UNION ALL SELECT 'not_entered', count(*) FROM i WHERE leaf AND (po OR own) UNION ALL SELECT 'settled', count(*) FROM i WHERE leaf AND NOT (po OR own) AND NOT open_
UNION ALL SELECT 'unsettled', count(*) FROM i WHERE leaf AND NOT (po OR own) AND open_ UNION ALL SELECT CASE o_orderstatus WHEN 'F' THEN 'error' WHEN 'O' THEN 'review' ELSE 'skipped' END, count(*) FROM orders GROUP BY 1 UNION ALL SELECT 'dropped', 0""")
def run_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    projects = o.select(C().alias("project_no")).distinct().select(F.lit("d").alias("doc_id"), "project_no", (F.col("project_no") % 5 == 0).alias("handover"))
    items = read(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == K()).select(F.lit("d").alias("doc_id"), C().alias("project_no"), (F.col("l_linenumber") % 2 == 1).alias("leaf"), (F.col("l_partkey") % 9 == 0).alias("handover"), F.when(F.col("l_suppkey") % 4 != 0, "x").alias("code7"))
    found = o.select(F.when(F.col("o_orderstatus") == "F", "error").when(F.col("o_orderstatus") == "O", "review").otherwise("skipped").alias("severity"))
    return summaries.run_numbers(projects, items, found)


@BOOK.add("""SELECT 'c' || o_custkey AS name, sum(o_orderkey % 5 - 2)::DOUBLE AS adjust FROM orders WHERE o_orderkey % 5 <> 2 AND o_orderkey % 3 <> 0 GROUP BY o_custkey HAVING sum(o_orderkey % 5 - 2) <> 0""")
def ledger_adjustments(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("c"), C().cast("string"))
    rows = read(spark, sf_dir, "orders").select(F.when(K() % 2 == 0, name).otherwise(" ").alias("name"), name.alias("item"), F.when(K() % 3 != 0, "p").alias("program"), (K() % 5 - 2).cast("double").alias("adjust"))
    return sheets.adjustments(rows).select("name", "adjust")


def _sheet(rows: DataFrame, columns: list[tuple[str, str, Column]], first: int, n: int) -> DataFrame:
    """Cells of a sheet for each document, with two header rows; documents are dealt in ``n`` partitions, once for all that follows."""
    body = rows.select("doc_id", F.lit("s").alias("sheet"), (F.col("i") + first).cast("int").alias("row_no"), F.posexplode(F.array(*[c.cast("string") for *_, c in columns])).alias("c", "value"))
    docs = rows.select("doc_id").distinct()
    head = docs.select("doc_id", F.lit("s").alias("sheet"), F.explode(F.array(*[F.struct(F.lit(r).alias("row_no"), F.lit(k).alias("c"), F.lit(x[r - 1]).alias("value")) for k, x in enumerate(columns) for r in (1, 2)])).alias("h")).select("doc_id", "sheet", "h.*")
    return body.unionByName(head).select("doc_id", "sheet", "row_no", (F.col("c") + 1).alias("col_no"), "value").repartition(n, "doc_id")


@BOOK.add("""
SELECT o_custkey::VARCHAR AS doc_id, 'n' || o_orderkey AS name, (CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END) AS depth, (o_orderkey % 4)::BIGINT AS level, floor(o_totalprice)::DOUBLE AS amount, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey % 7)::DOUBLE END AS change FROM orders""")
def load_sheet_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delta load sheets with merged headers, one a customer, read by the words of their columns."""
    table = read(spark, sf_dir, "orders")
    rows = table.select(C().cast("string").alias("doc_id"), "o_orderkey", "o_totalprice", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("i"))
    label = F.concat(F.when(K() % 2 == 0, "  ").otherwise(""), F.when(K() % 3 == 0, "1. ").when(K() % 3 == 1, "(가) ").otherwise(""), F.lit("n"), K().cast("string"))
    columns = [("레벨", "", K() % 4), ("* 사업항목", "", label), ("최종 요구", "산출기초②", F.lit("1천원=")), ("", "금액②", F.format_number(F.floor("o_totalprice"), 0)), ("추경요구", "", F.when(K() % 5 == 0, "-").otherwise((K() % 7).cast("string")))]
    return sheets.load_sheet(_sheet(rows, columns, 2, parts(table, len(columns))), {k: v for k, v in sheets.DELTA_ROLES.items() if k in ("level", "label", "basis", "amount", "change")}).select("doc_id", "name", "depth", F.col("level").cast("bigint").alias("level"), "amount", "change")


@BOOK.add("""
SELECT s_nationkey::VARCHAR AS doc_id, s_name AS name, 1 + s_suppkey % 3 AS depth, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE printf('%07d', s_suppkey) END AS code7, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'a ' || (s_suppkey % 9) END AS account FROM supplier""")
def balance_sheet_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    table = read(spark, sf_dir, "supplier")
    rows = table.select(F.col("s_nationkey").cast("string").alias("doc_id"), "s_suppkey", "s_name", F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("i"))
    cell = F.when(k % 4 == 0, F.concat(F.lit("[12] "), "s_name")).otherwise(F.concat(F.lit(" ["), F.lpad(k.cast("string"), 7, "0"), F.lit("] a "), (k % 9).cast("string")))
    columns = [("사업 항목", "", F.concat(F.repeat(F.lit("  "), (k % 3).cast("int")), "s_name")), ("원가통계비목", "", cell)]
    found = sheets.balance_sheet(_sheet(rows, columns, 2, parts(table, len(columns))))
    return found.select("doc_id", "name", F.col("depth").cast("bigint").alias("depth"), "code7", "account")


@BOOK.add("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN floor(o_totalprice)::DOUBLE WHEN 2 THEN (o_orderkey % 100) * 6.0 ELSE NULL END AS value, CASE o_orderkey % 4 WHEN 0 THEN '000=' WHEN 1 THEN format('{:,}', floor(o_totalprice)::BIGINT) || '=' WHEN 2 THEN (o_orderkey % 100) || '천원×2명×3회=' ELSE 'text=' END AS written,
 CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey::DOUBLE END AS now, CASE WHEN o_orderkey % 2 = 0 THEN -(o_orderkey % 10)::DOUBLE END AS previous, CASE WHEN o_orderkey % 2 = 1 THEN -o_orderkey::DOUBLE END AS money FROM orders""")
def basis_and_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of basis texts and how they are written; amounts with that of the year before; amounts with a unit."""
    text = F.when(K() % 4 == 0, "000").when(K() % 4 == 1, F.format_number(F.floor("o_totalprice"), 0)).when(K() % 4 == 2, F.concat((K() % 100).cast("string"), F.lit("천원×2명×3회"))).otherwise("text")
    cell = F.when(K() % 2 == 0, F.concat(F.format_number(K(), 0), F.lit("(△"), (K() % 10).cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("△"), F.format_number(K(), 0), F.lit("천원")))
    return read(spark, sf_dir, "orders").select("o_orderkey", basis_value(F.concat(text, F.lit("="))).alias("value"), basis_text(text, F.lit(1)).alias("written"), with_previous(cell)["now"].alias("now"), with_previous(cell)["previous"].alias("previous"), unit_number(cell).alias("money"))


@BOOK.add("""
WITH p AS (SELECT o_custkey AS d, o_orderkey AS ord, o_orderkey % 3 = 0 AS num, o_orderkey % 2 = 0 AS items FROM orders), h AS (SELECT *, max(CASE WHEN num THEN ord END) OVER (PARTITION BY d ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS host FROM p), j AS (SELECT h.*, q.items AS host_items FROM h LEFT JOIN p q ON q.d = h.d AND q.ord = h.host)
SELECT ord, CASE WHEN NOT num AND items AND host IS NOT NULL AND NOT host_items THEN host ELSE ord END AS host, coalesce(NOT num AND items AND host IS NOT NULL AND NOT host_items, false) AS folded, coalesce(NOT num AND items AND host IS NOT NULL AND host_items, false) AS split FROM j""")
def folded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "orders").select(C().alias("doc_id"), K().alias("ord"), (K() % 3 == 0).alias("numbered"), (K() % 2 == 0).alias("has_items"))
    return delta.fold_pages(pages).select("ord", "host", "folded", "split")


@BOOK.add("""
WITH p AS (SELECT o_custkey AS k, sum(floor(o_totalprice)) AS base FROM orders GROUP BY 1), q AS (SELECT *, base + CASE WHEN k % 3 = 0 THEN 7 ELSE 0 END AS request FROM p), w AS (SELECT k, min(o_orderkey) AS witness FROM q JOIN orders ON o_custkey = k WHERE abs(floor(o_totalprice) - request) <= 1 GROUP BY 1)
SELECT k AS project_no, request::DOUBLE AS request, base::DOUBLE AS base, witness, CASE WHEN witness IS NULL THEN 'headline wrong' ELSE 'table wrong' END AS verdict FROM q LEFT JOIN w USING (k) WHERE request <> base""")
def headline_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    items = o.select(F.lit("d").alias("doc_id"), C().alias("project_no"), K().alias("pos"), F.lit(1).alias("depth"), F.floor("o_totalprice").cast("double").alias("amount"))
    base = items.groupBy("doc_id", "project_no").agg(F.sum("amount").alias("base"))
    parts = F.array().cast("array<struct<name:string,request:double,year_request:double>>")
    projects = base.select("doc_id", "project_no", (F.col("base") + F.when(F.col("project_no") % 3 == 0, 7).otherwise(0)).alias("request"), "base", parts.alias("parts"))
    return reconcile.check_headlines(projects, items).select("project_no", "request", "base", "witness", "verdict")


@BOOK.add("""
WITH l AS (SELECT o_custkey AS k, o_orderkey AS g, l_linenumber AS n, floor(l_extendedprice) AS v, l_partkey % 29 = 0 AS bad, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey), t AS (SELECT k, g, sum(v) AS s FROM l GROUP BY ALL)
SELECT 'l' || g || '/' || line AS item, 'formula is not the amount' AS message FROM l WHERE bad UNION ALL SELECT 'h' || g, 'not the sum of its lines' FROM t WHERE g % 23 = 0 UNION ALL SELECT 'g' || g, 'first-level lines add up to neither amount' FROM t WHERE (g % 23 = 0) <> (g % 29 = 0)""")
def delta_line_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines below a head line below each order: wrong formulas, heads that aren't sums, groups that aren't their head."""
    by = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    l = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == K()).select(C(), K(), "l_partkey", F.floor("l_extendedprice").alias("v"), F.row_number().over(Window.partitionBy("o_orderkey").orderBy(*by)).alias("line"))
    group = [F.lit("d").alias("doc_id"), C().alias("project_no"), F.lit(1).alias("table_no"), K().alias("group_no")]
    name = lambda letter, *more: F.concat_ws("/", F.concat(F.lit(letter), K().cast("string")), *more)
    text = F.concat((F.col("v") + F.when(F.col("l_partkey") % 29 == 0, 4).otherwise(0)).cast("string"), F.lit("천원×1회"))
    low = l.select(*group, F.col("line").alias("line_no"), F.lit(2).alias("depth"), name("l", F.col("line").cast("string")).alias("name"), text.alias("formula"), F.col("v").cast("double").alias("amount"))
    sums = l.groupBy(C(), K()).agg(F.sum("v").cast("double").alias("s"))
    plus = lambda m, n: F.col("s") + F.when(K() % m == 0, n).otherwise(0)
    top = sums.select(*group, F.lit(0).alias("line_no"), F.lit(1).alias("depth"), name("h").alias("name"), F.lit("").alias("formula"), plus(23, 3).alias("amount"))
    groups = sums.select(*group, name("g").alias("title"), plus(29, 3).alias("change"), F.lit(None).cast("double").alias("own"))
    return delta.check_lines(low.unionByName(top), groups, depths=2).select("item", "message")


@BOOK.add("""
WITH h AS (SELECT o_custkey AS d, o_orderkey % 7 AS v, CASE WHEN o_orderkey % 2 = 0 THEN 'ocr' ELSE 'text' END AS source, (o_orderkey % 5) / 4.0 AS confidence, o_orderkey AS id FROM orders)
SELECT d AS doc_id, 'v' || v AS value_key, max(confidence)::DOUBLE AS confidence, CASE WHEN bool_or(source = 'text') FILTER (confidence = m) THEN 'text' ELSE 'ocr' END AS source FROM (SELECT *, max(confidence) OVER (PARTITION BY d, v) AS m FROM h) GROUP BY d, v""")
def best_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = read(spark, sf_dir, "orders").select(C().alias("doc_id"), F.lit("l").alias("location"), F.lit("k").alias("kind"), F.concat(F.lit("v"), (K() % 7).cast("string")).alias("value_key"), F.when(K() % 2 == 0, "ocr").otherwise("text").alias("source"), ((K() % 5) / 4.0).alias("confidence"))
    return personal_data.best_evidence(hits).select("doc_id", "value_key", "confidence", "source")


@BOOK.add("""
SELECT o_orderkey::VARCHAR AS k, 'said "' || o_orderpriority || '",' || chr(10) || 'line ' || o_custkey AS note, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'x' || (o_orderkey % 7) END AS tail FROM orders""")
def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as CSV files with commas, quotes and line breaks in their cells and a column without a name, read back in pieces."""
    folder = f"{shared_root(spark)}/{spark.sparkContext.applicationId}/csv-{uuid.uuid4().hex}"
    note = F.concat(F.lit('said "'), F.col("o_orderpriority"), F.lit('",\n'), F.lit("line "), C().cast("string"))
    table = read(spark, sf_dir, "orders")
    rows = table.select(K().cast("string").alias("k"), F.lit("unnamed").alias(" "), note.alias("note"), F.when(K() % 3 == 0, "").otherwise(F.concat(F.lit("x"), (K() % 7).cast("string"))).alias("tail"))
    rows.repartition(parts(table), "k").write.option("header", "true").option("escape", '"').option("emptyValue", "").csv(folder)
    found = delimited.csv_tables(spark, folder)
    return found.select(*[F.get("values", F.lit(n)).alias(c) for n, c in enumerate(("k", "note", "tail"))])
