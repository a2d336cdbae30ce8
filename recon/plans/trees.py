"""Queries over the forest of customers, orders and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.formula import delta_value, main_value
from ..functions.numbers import formula_ok
from ..operators import rollup, tree
from ..operators.match import families
from .common import FOREST, Book, cents, forest, parts, read

BOOK = Book()
KEYS = ["doc_id"]


@BOOK.add(FOREST + """
, tops AS (SELECT doc_id, pos FROM forest WHERE depth = 1), mids AS (SELECT doc_id, a, pos FROM forest WHERE depth = 2)
SELECT doc_id, pos, depth, NULL::BIGINT AS parent FROM forest WHERE depth = 1
UNION ALL SELECT c.doc_id, c.pos, c.depth, p.pos FROM forest c JOIN tops p ON p.doc_id = c.doc_id WHERE c.depth = 2
UNION ALL SELECT c.doc_id, c.pos, c.depth, p.pos FROM forest c JOIN mids p ON p.doc_id = c.doc_id AND p.a = c.a WHERE c.depth = 3""")
def tree_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.parents(forest(spark, sf_dir), KEYS, depths=3).select("doc_id", "pos", "depth", "parent")


@BOOK.add(FOREST + """
SELECT doc_id, pos, leaves, leaf_total FROM (
 SELECT f.doc_id, f.pos, count(*) AS leaves, sum(l.amount)::DECIMAL(28,2) AS leaf_total FROM forest f JOIN forest l ON l.doc_id = f.doc_id AND l.leaf AND (f.depth = 1 OR (f.depth = 2 AND f.a = l.a)) GROUP BY f.doc_id, f.pos)""")
def tree_subtree_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.subtree_sums(tree.parents(forest(spark, sf_dir), KEYS, depths=3), KEYS).select("doc_id", "pos", "leaves", F.col("leaf_total").cast("decimal(28,2)").alias("leaf_total"))


_BROKEN = FOREST + """,
kids AS (SELECT doc_id, 1 AS depth, NULL::BIGINT AS a, sum(amount) AS direct FROM forest WHERE depth = 2 GROUP BY doc_id
  UNION ALL SELECT doc_id, 2, a, sum(amount) FROM forest WHERE depth = 3 GROUP BY doc_id, a),
off0 AS (SELECT f.*, k.direct FROM forest f JOIN kids k ON k.doc_id = f.doc_id AND k.depth = f.depth AND (f.depth = 1 OR k.a = f.a)),
leafs AS (SELECT doc_id, sum(amount) AS t FROM forest WHERE leaf GROUP BY doc_id)
"""


@BOOK.add(_BROKEN + """
, bad AS (SELECT o.*, CASE WHEN depth = 1 THEN coalesce(l.t, 0) ELSE direct END AS leaf_total FROM off0 o LEFT JOIN leafs l USING (doc_id) WHERE abs(direct - amount) > 1),
named AS (SELECT *, CASE WHEN abs(leaf_total - amount) <= 1 THEN 'review' ELSE 'error' END AS verdict FROM bad)
SELECT doc_id, pos, depth, amount, direct::DECIMAL(28,2) AS direct, verdict FROM named n
WHERE NOT (n.depth = 1 AND EXISTS (SELECT 1 FROM named m WHERE m.doc_id = n.doc_id AND m.depth = 2 AND m.verdict = 'error'))""")
def rollup_deepest_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.check_children(forest(spark, sf_dir), KEYS, depths=3).select("doc_id", "pos", "depth", "amount", F.col("direct").cast("decimal(28,2)").alias("direct"), "verdict")


@BOOK.add(_BROKEN + " SELECT doc_id, pos, depth, amount, direct::DECIMAL(28,2) AS direct FROM off0 WHERE abs(direct - amount) >= 0.5")
def rollup_every_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.check_tree_all(forest(spark, sf_dir), KEYS, depths=3).select("doc_id", "pos", "depth", "amount", F.col("direct").cast("decimal(28,2)").alias("direct"))


@BOOK.add(FOREST + """
, n AS (SELECT *, lag(depth) OVER w AS before, lead(depth) OVER w AS after FROM forest WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, pos, depth, CASE WHEN depth > coalesce(before, 0) + 1 THEN 'depth jump' ELSE 'nothing below' END AS problem FROM n
WHERE depth > coalesce(before, 0) + 1 OR (coalesce(after, 0) <= depth AND NOT leaf)""")
def depth_shape_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.check_shape(forest(spark, sf_dir), KEYS).select("doc_id", "pos", "depth", "problem")


#: Order of the rows of the deep forest below an order: by flag, status, line number and the line itself.
_DEEP = ["l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]


def deep_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, orders, return flags, line statuses, line numbers and lines, six levels, as a pre-order list."""
    table = read(spark, sf_dir, "lineitem")
    n = parts(table)
    lines = table.repartition(n, "l_orderkey").join(read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("doc_id")), F.col("o_orderkey") == F.col("l_orderkey"))
    levels = [lines.groupBy("doc_id", *_DEEP[:k]).agg(F.count(F.lit(1)).alias("_n")).drop("_n").withColumn("depth", F.lit(k + 1)) for k in range(5)]
    rows = lines.select("doc_id", *_DEEP).withColumn("depth", F.lit(6))
    for level in levels:
        rows = rows.unionByName(level, allowMissingColumns=True)
    order = [F.asc_nulls_first(c) for c in _DEEP]
    return rows.repartition(n, "doc_id").select("doc_id", "depth", *_DEEP, F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)).alias("pos"))


_SAME_PATH = ["l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber"]


@BOOK.add(f"""
WITH l AS (SELECT o_custkey AS doc_id, {', '.join(_DEEP)} FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
rows0 AS (SELECT *, 6 AS depth FROM l
{' '.join(f"UNION ALL BY NAME SELECT DISTINCT {', '.join(['doc_id', *_DEEP[:k]])}, {k + 1} AS depth FROM l" for k in range(5))}),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {', '.join(f'{c} ASC NULLS FIRST' for c in _DEEP)}) AS pos FROM rows0),
told AS (SELECT *, CASE depth {' '.join(f"WHEN {k + 1} THEN row_number() OVER (PARTITION BY {', '.join(['doc_id', 'depth', *_SAME_PATH[:max(0, k - 1)]])} ORDER BY pos)" for k in range(6))} END AS ordinal FROM placed),
marked AS (SELECT *, CASE WHEN depth IN (1, 3, 5) THEN '' || ordinal ELSE substr('가나다라마바사아자차카타파하거너더러머버서어저처커터퍼허', ((ordinal - 1) % 28 + 1)::INT, 1) END AS sign FROM told)
SELECT doc_id, pos, depth, ordinal, CASE WHEN depth <= 2 THEN sign || '.' WHEN depth <= 4 THEN sign || ')' ELSE '(' || sign || ')' END AS mark FROM marked""")
def sibling_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers among siblings and outline marks over six levels; many customers have more than 14 orders."""
    rows = tree.sibling_ordinals(tree.parents(deep_forest(spark, sf_dir), KEYS, depths=6), KEYS)
    return rows.select("doc_id", "pos", "depth", "ordinal", tree.prefix(F.col("depth"), F.col("ordinal")).alias("mark"))


def digits_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest of nine levels: each year of order dates is a document, and an order hangs below the beginnings of its number, digit by
    digit; orders of even numbers have a row below them. A seventh level that ends in 3 says five too much."""
    o = read(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("doc_id"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0").alias("k"), cents("o_totalprice").alias("amount"))
    levels = o.select("doc_id", "amount", F.explode(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda d: F.struct(d.alias("depth"), F.substring(F.col("k"), F.lit(1), d).alias("k")))).alias("x"))
    rows = levels.groupBy("doc_id", "x.depth", "x.k").agg(F.sum("amount").alias("amount"))
    off = F.when((F.col("depth") == 7) & F.col("k").endswith("3"), 5).otherwise(0)
    rows = rows.withColumns({"amount": (F.col("amount") + off).cast("decimal(18,2)"), "leaf": F.col("depth") == 8})
    more = rows.where(F.col("leaf") & F.col("k").substr(8, 1).isin(*"02468")).withColumns({"depth": F.lit(9), "k": F.concat("k", F.lit("0"))})
    rows = rows.withColumn("leaf", F.col("leaf") & ~F.col("k").substr(8, 1).isin(*"02468")).unionByName(more)
    return tree.numbered(rows, ["doc_id"], ["k"], [F.substring("k", 1, 3), F.substring("k", 1, 5)], "pos")


_DIGITS = """
WITH o AS (SELECT year(o_orderdate) AS doc_id, lpad(o_orderkey::VARCHAR, 8, '0') AS k, o_totalprice::DECIMAL(18,2) AS amount FROM orders),
level AS (SELECT doc_id, d.d AS depth, substr(k, 1, d.d::INT) AS k, (sum(amount) + CASE WHEN d.d = 7 AND substr(k, 7, 1) = '3' THEN 5 ELSE 0 END)::DECIMAL(18,2) AS amount FROM o, (SELECT unnest(range(1, 9)) AS d) d GROUP BY doc_id, d.d, substr(k, 1, d.d::INT), CASE WHEN d.d = 7 AND substr(k, 7, 1) = '3' THEN 5 ELSE 0 END),
rows0 AS (SELECT * FROM level UNION ALL SELECT doc_id, 9, k || '0', amount FROM level WHERE depth = 8 AND k[8] IN ('0', '2', '4', '6', '8')),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS pos FROM rows0)
"""


@BOOK.add(_DIGITS + "SELECT c.doc_id, c.pos, c.depth, p.pos AS parent, c.depth - 1 AS above FROM placed c LEFT JOIN placed p ON p.doc_id = c.doc_id AND p.depth = c.depth - 1 AND p.k = substr(c.k, 1, c.depth::INT - 1)")
def tree_parents_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents in trees of nine levels, in documents that are cut into blocks of a thousand places."""
    rows = tree.parents(digits_forest(spark, sf_dir), KEYS, block=1000)
    return rows.select("doc_id", "pos", F.col("depth").cast("bigint").alias("depth"), "parent", F.size("ancestors").cast("bigint").alias("above"))


@BOOK.add(_DIGITS + """, kids AS (SELECT doc_id, substr(k, 1, depth::INT - 1) AS k, sum(amount) AS direct FROM placed WHERE depth > 1 GROUP BY ALL),
off0 AS (SELECT p.*, direct FROM placed p JOIN kids USING (doc_id, k) WHERE abs(direct - amount) > 1)
SELECT doc_id, pos, depth::BIGINT AS depth, amount, direct::DECIMAL(28,2) AS direct FROM off0 n WHERE depth = 7 OR NOT EXISTS (SELECT 1 FROM off0 m WHERE m.doc_id = n.doc_id AND m.depth > n.depth AND starts_with(m.k, n.k))""")
def rollup_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deepest wrong sums of trees of nine levels: what is wrong is at the seventh, which the sixth doesn't add up to either."""
    return rollup.check_children(digits_forest(spark, sf_dir), KEYS, block=1000).select("doc_id", "pos", F.col("depth").cast("bigint").alias("depth"), "amount", F.col("direct").cast("decimal(28,2)").alias("direct"))


@BOOK.add("SELECT o_orderkey, card, row_number() OVER (PARTITION BY card ORDER BY o_orderdate, o_orderkey) AS seq FROM (SELECT *, c_mktsegment || '/' || c_nationkey AS card FROM orders JOIN customer ON o_custkey = c_custkey)")
def sequence_per_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("card", F.concat_ws("/", "c_mktsegment", "c_nationkey"))
    return tree.sequence(rows, "card", ["o_orderdate", "o_orderkey"], [F.date_trunc("year", "o_orderdate"), F.date_trunc("day", "o_orderdate")]).select("o_orderkey", "card", "seq")


@BOOK.add("""
WITH b AS (SELECT r_name, n_name, c_mktsegment, sum(o_totalprice::DECIMAL(18,2)) AS one, sum(o_totalprice::DECIMAL(18,2)) + CASE WHEN n_nationkey % 4 = 1 THEN 50 ELSE 0 END AS two, n_nationkey
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name, c_mktsegment, n_nationkey),
s2 AS (SELECT * FROM b WHERE NOT (n_nationkey % 5 = 2 AND c_mktsegment = 'BUILDING')),
c1 AS (SELECT r_name, n_name, count(*) AS k FROM b GROUP BY ALL), c2 AS (SELECT r_name, n_name, count(*) AS k FROM s2 GROUP BY ALL)
SELECT b.r_name AS doc_id, b.n_name AS nation, b.c_mktsegment AS name_key, b.one::DECIMAL(28,2) AS amount_one, s2.two::DECIMAL(28,2) AS amount_two FROM b JOIN s2 USING (r_name, n_name, c_mktsegment) JOIN c1 USING (r_name, n_name) JOIN c2 USING (r_name, n_name)
WHERE c1.k = c2.k AND abs(b.one - s2.two) > 1""")
def family_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = (read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name", "n_name", "n_nationkey", "c_mktsegment").agg(F.sum(cents("o_totalprice")).alias("amount")))
    form = base.select(F.col("r_name").alias("doc_id"), F.array("r_name", "n_name").alias("path"), F.col("c_mktsegment").alias("name_key"), "amount", "n_nationkey")
    two = form.where(~((F.col("n_nationkey") % 5 == 2) & (F.col("name_key") == "BUILDING"))).withColumn("amount", F.col("amount") + F.when(F.col("n_nationkey") % 4 == 1, 50).otherwise(0))
    out = families(form, two, KEYS, "amount")
    return out.select("doc_id", F.element_at("path", 2).alias("nation"), "name_key", F.col("amount_one").cast("decimal(28,2)").alias("amount_one"), F.col("amount_two").cast("decimal(28,2)").alias("amount_two"))


@BOOK.add("""
WITH y AS (SELECT c_mktsegment AS segment, year(o_orderdate) AS y, sum(o_totalprice::DECIMAL(18,2)) AS after FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
t AS (SELECT a.segment, a.y, b.after AS before, a.after, a.after - b.after + CASE WHEN a.y % 3 = 0 THEN 4 ELSE 0 END AS change FROM y a LEFT JOIN y b ON b.segment = a.segment AND b.y = a.y - 1)
SELECT segment, y, (after - before - change)::DECIMAL(28,2) AS gap, CASE WHEN after - before - change IS NULL THEN 'skipped' WHEN abs(after - before - change) >= 0.5 THEN 'issue' ELSE 'ok' END AS route FROM t""")
def triple_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    y = rows.groupBy(F.col("c_mktsegment").alias("segment"), F.year("o_orderdate").alias("y")).agg(F.sum(cents("o_totalprice")).alias("after"))
    before = y.select("segment", (F.col("y") + 1).alias("y"), F.col("after").alias("before"))
    t = y.join(before, ["segment", "y"], "left").withColumn("change", F.col("after") - F.col("before") + F.when(F.col("y") % 3 == 0, 4).otherwise(0))
    return rollup.check_identity(t).select("segment", "y", F.col("gap").cast("decimal(28,2)").alias("gap"), "route")


@BOOK.add("""
SELECT l_orderkey, l_linenumber, l_partkey, round(floor(l_extendedprice) * l_quantity * round(l_discount * 100) / 100 / 1000, 5) AS value FROM lineitem""")
def formula_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas such as ``68,423원×23종×5%=`` made from lines, computed from their text."""
    text = F.concat(F.format_number(F.floor("l_extendedprice"), 0), F.lit("원×"), F.col("l_quantity").cast("bigint").cast("string"), F.lit("종 × "), F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("% = 1원"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(main_value(text), 5).alias("value"))


@BOOK.add("""
SELECT l_orderkey, l_linenumber, l_partkey, round(-floor(l_extendedprice) * l_quantity * (l_linenumber::DOUBLE / 12) + 2 * l_quantity - 1, 3) AS value FROM lineitem""")
def formula_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas with a sign, a fraction and further terms: ``△68,423천원×23명×6/12개월+2천원×23매-1천원``."""
    q = F.col("l_quantity").cast("bigint").cast("string")
    text = F.concat(F.lit("△"), F.format_number(F.floor("l_extendedprice"), 0), F.lit("천원×"), q, F.lit("명×"), F.col("l_linenumber").cast("string"), F.lit("/12개월+2천원×"), q, F.lit("매-1천원"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(delta_value(text), 3).alias("value"))


@BOOK.add("""
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE floor(l_extendedprice) * l_quantity / 1000 END AS computed,
 CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE floor(l_extendedprice) * l_quantity / 1000 + CASE WHEN l_suppkey % 19 = 0 THEN 3 ELSE 0 END END AS amount FROM lineitem)
SELECT route, count(*) AS n FROM (SELECT CASE WHEN computed IS NULL THEN 'skipped' WHEN amount IS NULL OR abs(computed - amount) > 1 THEN 'issue' ELSE 'ok' END AS route FROM x) GROUP BY route""")
def formula_leaf_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read(spark, sf_dir, "lineitem")
    exact = F.floor("l_extendedprice") * F.col("l_quantity") / 1000
    amount = F.when(F.col("l_partkey") % 17 != 0, exact + F.when(F.col("l_suppkey") % 19 == 0, 3).otherwise(0))
    text = F.concat(F.format_number(F.floor("l_extendedprice"), 0), F.when(F.col("l_partkey") % 13 == 0, F.lit("번×")).otherwise("원×"), F.col("l_quantity").cast("bigint").cast("string"), F.lit("회"))
    return rollup.check_leaves(x.select(F.lit(True).alias("leaf"), amount.alias("amount"), text.alias("formula"))).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@BOOK.add("""
WITH o AS (SELECT o_custkey, sum(o_totalprice::DECIMAL(18,2)) AS orders_sum FROM orders GROUP BY 1), l AS (SELECT o_custkey, sum(l_extendedprice::DECIMAL(18,2)) AS lines_sum FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1),
t AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN orders_sum WHEN c_custkey % 5 = 2 THEN lines_sum ELSE lines_sum + 100 END AS request, lines_sum, orders_sum, CASE WHEN c_custkey % 2 = 0 THEN lines_sum ELSE lines_sum + 100 END AS headline
 FROM customer LEFT JOIN o ON o.o_custkey = c_custkey LEFT JOIN l ON l.o_custkey = c_custkey)
SELECT c_custkey, CASE WHEN request IS NULL OR lines_sum IS NULL THEN 'cannot tell' WHEN abs(request - lines_sum) <= 1 THEN 'ok' WHEN abs(orders_sum - request) <= 1 THEN 'leaves wrong: orders' WHEN abs(orders_sum - lines_sum) <= 1 THEN 'request wrong: orders'
 WHEN abs(headline - request) <= 1 THEN 'leaves wrong: headline' WHEN abs(headline - lines_sum) <= 1 THEN 'request wrong: headline' ELSE 'no witness' END AS verdict FROM t""")
def witness_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    o = orders.groupBy("o_custkey").agg(F.sum(cents("o_totalprice")).alias("orders_sum"))
    l = read(spark, sf_dir, "lineitem").join(orders, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.sum(cents("l_extendedprice")).alias("lines_sum"))
    t = read(spark, sf_dir, "customer").select("c_custkey").join(o, F.col("c_custkey") == o.o_custkey, "left").drop("o_custkey").join(l, F.col("c_custkey") == l.o_custkey, "left")
    k, total = F.col("c_custkey") % 5, F.col("lines_sum")
    request = F.when(k == 0, None).when(k == 1, F.col("orders_sum")).when(k == 2, total).otherwise(total + 100)
    headline = F.when(F.col("c_custkey") % 2 == 0, total).otherwise(total + 100)
    return t.select("c_custkey", rollup.verdict_by_witnesses(request, total, {"orders": F.col("orders_sum"), "headline": headline}).alias("verdict"))


@BOOK.add("""
WITH g AS (SELECT o_custkey, CASE WHEN o_custkey % 11 = 0 AND o_orderkey % 2 = 0 THEN NULL ELSE o_totalprice::DECIMAL(18,2) END AS after, o_shippriority AS before FROM (SELECT *, (o_orderkey % 7)::DECIMAL(18,2) AS o_shippriority FROM orders)),
t AS (SELECT o_custkey, sum(o_totalprice::DECIMAL(18,2)) + CASE WHEN o_custkey % 13 = 0 THEN 1 ELSE 0 END AS after, sum((o_orderkey % 7)::DECIMAL(18,2)) AS before FROM orders GROUP BY 1),
s AS (SELECT o_custkey, CASE WHEN count(after) = count(*) THEN sum(after) END AS a, sum(before) AS b FROM g GROUP BY 1)
SELECT o_custkey, 'after' AS measure, round(t.after::DOUBLE, 2) AS written, round(s.a::DOUBLE, 2) AS summed FROM t JOIN s USING (o_custkey) WHERE abs(t.after - s.a) >= 0.5
UNION ALL SELECT o_custkey, 'before', round(t.before::DOUBLE, 2), round(s.b::DOUBLE, 2) FROM t JOIN s USING (o_custkey) WHERE abs(t.before - s.b) >= 0.5""")
def table_total_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals against sums that a missing amount makes null."""
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", cents("o_totalprice").alias("after"), (F.col("o_orderkey") % 7).cast("decimal(18,2)").alias("before"))
    totals = orders.groupBy("o_custkey").agg((F.sum("after") + F.when(F.col("o_custkey") % 13 == 0, 1).otherwise(0)).alias("after"), F.sum("before").alias("before"))
    groups = orders.withColumn("after", F.when(~((F.col("o_custkey") % 11 == 0) & (F.col("o_orderkey") % 2 == 0)), F.col("after")))
    found = rollup.check_table_totals(groups, totals, ["o_custkey"], ["after", "before"])
    return found.select("o_custkey", "measure", F.round("written", 2).alias("written"), F.round("summed", 2).alias("summed"))


@BOOK.add("""
SELECT o_orderkey, abs(x - round_even(x, 0)) < 1e-6 AS whole, CASE WHEN abs(x - round_even(x, 0)) < 1e-6 THEN abs(x - w) < 0.5 ELSE abs(x - w) < 1 END AS ok
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey * 1.0::DOUBLE ELSE o_orderkey + 0.25::DOUBLE END AS x, (o_orderkey + (o_orderkey % 3) * 0.7)::DOUBLE AS w FROM orders)""")
def formula_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    x, w = F.when(k % 2 == 0, k.cast("double")).otherwise(k + 0.25), (k + (k % 3) * 0.7).cast("double")
    return read(spark, sf_dir, "orders").select("o_orderkey", (F.abs(x - F.bround(x)) < 1e-6).alias("whole"), formula_ok(x, w).alias("ok"))
