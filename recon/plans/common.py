"""Tables of the driver and the frames that several queries build from them, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Book:
    """Queries by name with their SQL, filled by decorators."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return put


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cents(c: str | Column) -> Column:
    """Money as a decimal, so that sums don't depend on their order."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


#: Rows of a table that a task holds when they are dealt by a key.
TASK_ROWS = 200_000


def parts(rows: DataFrame, each: int = 1) -> int:
    """Partitions for a table and the ``each`` rows made of one of its rows, so that a task's share doesn't grow with the table; those of the
    session at least."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() * each // TASK_ROWS))


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers over their orders over their lines as a pre-order list: ``doc_id, pos, depth, name, amount, leaf``.

    An order declares the sum of its lines, every 97th five too many; a customer the sum of its orders, every 101st seven too many.
    """
    table = read(spark, sf_dir, "lineitem")
    n = parts(table)
    lines = table.select("*", cents("l_extendedprice").alias("amount")).repartition(n, "l_orderkey")
    sums = lines.groupBy("l_orderkey").agg(F.sum("amount").alias("s"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(sums, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    declared = F.coalesce("s", F.lit(0)) + F.when(F.col("o_orderkey") % 97 == 0, 5).otherwise(0)
    orders = orders.select("o_orderkey", "o_custkey", declared.cast("decimal(18,2)").alias("amount"))
    heads = orders.groupBy("o_custkey").agg(F.sum("amount").alias("s")).select(F.col("o_custkey").alias("doc_id"), (F.col("s") + F.when(F.col("o_custkey") % 101 == 0, 7).otherwise(0)).cast("decimal(18,2)").alias("amount"))
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    leaves = lines.withColumn("line", F.row_number().over(w)).join(orders.select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = heads.select("doc_id", F.lit(-1).cast("bigint").alias("a"), F.lit(0).alias("b"), F.lit(1).alias("depth"), F.lit("customer").alias("name"), "amount", F.lit(False).alias("leaf"))
    rows = rows.unionByName(orders.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("a"), F.lit(0).alias("b"), F.lit(2).alias("depth"), F.lit("order").alias("name"), "amount", F.lit(False).alias("leaf")))
    rows = rows.unionByName(leaves.select(F.col("o_custkey").alias("doc_id"), F.col("l_orderkey").alias("a"), F.col("line").alias("b"), F.lit(3).alias("depth"), F.lit("line").alias("name"), "amount", F.lit(True).alias("leaf")))
    return rows.repartition(n, "doc_id").withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("a", "b"))).drop("a", "b")


FOREST = f"""
WITH lines AS (SELECT *, l_extendedprice::DECIMAL(18,2) AS amount, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)}) AS line FROM lineitem),
sums AS (SELECT l_orderkey, sum(amount) AS s FROM lines GROUP BY l_orderkey),
ords AS (SELECT o_orderkey, o_custkey, (coalesce(s, 0) + CASE WHEN o_orderkey % 97 = 0 THEN 5 ELSE 0 END)::DECIMAL(18,2) AS amount FROM orders LEFT JOIN sums ON o_orderkey = l_orderkey),
heads AS (SELECT o_custkey, (sum(amount) + CASE WHEN o_custkey % 101 = 0 THEN 7 ELSE 0 END)::DECIMAL(18,2) AS amount FROM ords GROUP BY o_custkey),
rows0 AS (SELECT o_custkey AS doc_id, -1 AS a, 0 AS b, 1 AS depth, amount, false AS leaf FROM heads
  UNION ALL SELECT o_custkey, o_orderkey, 0, 2, amount, false FROM ords
  UNION ALL SELECT o_custkey, l_orderkey, line, 3, lines.amount, true FROM lines JOIN ords ON o_orderkey = l_orderkey),
forest AS (SELECT doc_id, a, b, depth, amount, leaf, row_number() OVER (PARTITION BY doc_id ORDER BY a, b) AS pos FROM rows0)
"""
