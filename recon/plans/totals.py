"""Queries of whole reconciliations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import delta, reconcile
from .common import Book, cents, parts, read

BOOK = Book()


@BOOK.add("""
WITH c AS (SELECT *, (c_custkey % 2)::VARCHAR AS doc_id, 'n' || (c_custkey // 2) AS n FROM customer), p AS (SELECT doc_id, c_custkey, n || CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE '' END AS name, c_acctbal AS v, c_custkey % 7 = 0 AS split FROM c),
l AS (SELECT c_custkey, n AS ln, c_acctbal + CASE WHEN c_custkey % 5 = 0 THEN 40 ELSE 0 END AS la FROM c WHERE c_custkey % 11 <> 4),
f AS (SELECT c_custkey, c_acctbal + CASE WHEN c_custkey % 17 = 0 THEN 60 ELSE 0 END AS fa FROM c WHERE c_custkey % 13 <> 5)
SELECT doc_id, 'z' || c_custkey AS project, 'only in the load sheet' AS message, 'error' AS severity FROM c WHERE c_custkey % 97 = 1
UNION ALL SELECT doc_id, p.name, CASE WHEN fa IS NULL THEN 'not in the load sheet' ELSE 'differs from the load sheet' END, CASE WHEN fa IS NOT NULL AND split THEN 'review' ELSE 'error' END FROM p LEFT JOIN f USING (c_custkey) WHERE c_custkey % 6 <> 0 AND (fa IS NULL OR abs(fa - v) > 1)
UNION ALL SELECT doc_id, p.name AS project, CASE WHEN l.ln IS NULL THEN 'not in the ledger' ELSE 'differs from the ledger' END AS message, CASE WHEN l.ln IS NOT NULL AND split THEN 'review' ELSE 'error' END AS severity FROM p LEFT JOIN l USING (c_custkey) WHERE l.ln IS NULL OR abs(la - v) > 1""")
def three_way_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' balances as two narratives, in which names are the same, each against a ledger and a load sheet that lack some of them
    and differ for others; those handed over aren't entered."""
    k = F.col("c_custkey")
    c = read(spark, sf_dir, "customer").withColumns({"doc_id": (k % 2).cast("string"), "n": F.concat(F.lit("n"), F.floor(k / 2).cast("string"))})
    cand = F.array(F.struct(F.lit("balance").alias("label"), F.col("c_acctbal").alias("value")))
    projects = c.select("doc_id", k.alias("project_no"), F.concat("n", F.when(k % 3 == 0, F.lit(" ")).otherwise("")).alias("name"), cand.alias("candidates"), (k % 7 == 0).alias("split"), F.lit(False).alias("restarted"), F.lit(False).alias("bundled"), (k % 6 == 0).alias("handover"))
    ledger = c.where(k % 11 != 4).select("doc_id", F.col("n").alias("name"), (F.col("c_acctbal") + F.when(k % 5 == 0, 40).otherwise(0)).alias("amount"))
    form = c.where(k % 13 != 5).select("doc_id", F.col("n").alias("name"), (F.col("c_acctbal") + F.when(k % 17 == 0, 60).otherwise(0)).alias("amount")).union(c.where(k % 97 == 1).select("doc_id", F.concat(F.lit("z"), k.cast("string")), F.lit(1.0)))
    return reconcile.compare_totals(projects, ledger, form, "totals").select("doc_id", "project", "message", "severity")


@BOOK.add("""
WITH o AS (SELECT o_orderkey AS k, o_custkey % 50 AS b, (o_orderkey % 13)::DOUBLE AS b4, (o_orderkey % 7)::DOUBLE AS ch FROM orders)
SELECT (k % 3)::VARCHAR AS doc_id, 'o' || (k // 3) AS project, message FROM (
 SELECT k, 'not in the ledger' AS message FROM o WHERE k % 17 = 3 AND ch <> 0
 UNION ALL SELECT k, 'change differs from the ledger' FROM o WHERE k % 17 <> 3 AND k % 19 = 0
 UNION ALL SELECT k, 'amount before differs from the ledger' FROM o WHERE k % 17 <> 3 AND k % 23 = 0 AND k % 2 = 0
 UNION ALL SELECT k + 99999999, 'only in the ledger' FROM o WHERE k % 29 = 1)""")
def delta_against_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages of three documents, in which names and numbers of rows are the same, against their ledgers, which have changes of
    their own."""
    k = F.col("o_orderkey")
    doc, name, row = (k % 3).cast("string").alias("doc_id"), F.concat(F.lit("o"), F.floor(k / 3).cast("string")).alias("name"), F.floor(k / 3).alias("row_no")
    o = read(spark, sf_dir, "orders").select(k, doc, name, row, (k % 7).cast("double").alias("change"), (k % 13).cast("double").alias("before"))
    pages = o.select("doc_id", "name", "change", "before")
    there = o.where(k % 17 != 3).select("doc_id", "row_no", "name", (F.col("change") + F.when(k % 19 == 0, 2).otherwise(0)).alias("change"), (F.col("before") + F.when(k % 23 == 0, 3).otherwise(0)).alias("before"), F.lit(False).alias("unplanned"))
    more = o.where(k % 29 == 1).select((k + 99_999_999).alias("o_orderkey"))
    lone = more.select(doc, row, name, F.lit(5.0).alias("change"), F.lit(0.0).alias("before"), F.lit(False).alias("unplanned"))
    summary = o.where((k % 23 == 0) & (k % 2 == 1)).select("doc_id", "name", F.lit(-9.0).alias("change"), (F.col("before") + 3).alias("before"))
    return reconcile.compare_delta(pages, there.unionByName(lone), summary, parts=parts(o, 2)).select("doc_id", "project", "message")


@BOOK.add("""
WITH f AS (SELECT o_custkey AS d, o_orderkey AS k, (o_totalprice::DECIMAL(18,2))::DOUBLE AS v, CASE WHEN o_orderkey % 31 = 0 THEN 2 ELSE 0 END AS e, CASE WHEN o_orderkey % 37 = 0 THEN 2 ELSE 0 END AS w FROM orders)
SELECT 'o' || k AS item, message FROM (SELECT k, 'after - before is not the change' AS message FROM f WHERE e = 2 UNION ALL SELECT k, 'own amount is not the change' FROM f WHERE (e = 2) <> (w = 2))""")
def delta_group_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as groups of delta tables, some with a wrong change, some with a wrong amount of their own."""
    k, v = F.col("o_orderkey"), cents("o_totalprice").cast("double")
    g = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.lit(1).alias("project_no"), F.lit("change").alias("kind"), F.concat(F.lit("o"), k.cast("string")).alias("title"), (v + 10).alias("after"), F.lit(10.0).alias("before"),
        (v + F.when(k % 31 == 0, 2).otherwise(0)).alias("change"), (v + F.when(k % 37 == 0, 2).otherwise(0)).alias("own"), F.lit(None).cast("string").alias("formula"))
    return delta.check_groups(g).select("item", "message")
