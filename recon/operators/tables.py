"""Ad-hoc table operators: group, filter, sort, duplicates, row sums. Text keys are trimmed; numbers are read tolerantly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import strip
from ..functions.numbers import coerced


def _text(c: str) -> Column:
    return strip(F.col(c).cast("string"))


def group_table(df: DataFrame, keys: list[str], value: str, how: str = "sum") -> DataFrame:
    """``keys, count, value``: sum, average or count by trimmed keys. Rows with a blank key or, unless counting, without a number are
    left out. The average is over the rows that are counted."""
    if how not in ("sum", "average", "count"):
        raise ValueError(f"unknown aggregation {how}")
    n = coerced(F.col(value))
    ok = reduce(lambda a, b: a & b, [F.col(k).isNotNull() & (F.col(k).cast("string") != "") for k in keys])
    rows = df.where(ok if how == "count" else ok & n.isNotNull())
    total = {"sum": F.sum(n), "average": F.avg(n), "count": F.count(F.lit(1)).cast("double")}[how]
    return rows.groupBy(*[_text(k).alias(k) for k in keys]).agg(F.count(F.lit(1)).alias("count"), total.alias("value"))


def group_stats(grouped: DataFrame, keys: list[str]) -> DataFrame:
    """One row on a grouped table: largest and smallest group, ties by key, and the mean of the groups."""
    name = F.concat_ws(" / ", *keys)
    return grouped.agg(F.max(F.struct("value", name.alias("n")))["n"].alias("maximum_group"), F.max("value").alias("maximum"), F.min(F.struct("value", name.alias("n")))["n"].alias("minimum_group"), F.min("value").alias("minimum"), F.avg("value").alias("average"))


def filter_rows(df: DataFrame, column: str, how: str, value: object) -> DataFrame:
    """eq, ne, contains on trimmed text without regard to case; gt, gte, lt, lte on numbers, which text never matches."""
    if how in ("gt", "gte", "lt", "lte"):
        n = coerced(F.col(column))
        return df.where({"gt": n > value, "gte": n >= value, "lt": n < value, "lte": n <= value}[how])
    actual, wanted = F.lower(F.coalesce(_text(column), F.lit(""))), F.lower(strip(F.lit(str(value))))
    return df.where({"eq": actual == wanted, "ne": actual != wanted, "contains": F.contains(actual, wanted)}[how])


def mixed_sort(df: DataFrame, column: str, descending: bool = False, ties: tuple[str, ...] = ()) -> DataFrame:
    """Numbers before text, the other way round if descending; blanks are last either way."""
    raw = F.col(column).cast("string")
    blank, n = F.coalesce(raw == "", F.lit(True)), coerced(F.col(column))
    keys = [F.when(n.isNotNull(), 0).otherwise(1), n, F.lower(raw)]
    return df.orderBy(blank, *[k.desc_nulls_first() if descending else k.asc_nulls_last() for k in keys], *ties)


def duplicate_rows(df: DataFrame, key: str) -> DataFrame:
    """All rows whose trimmed key occurs more than once; the case counts."""
    keyed = df.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).withColumn("_k", _text(key))
    often = keyed.groupBy("_k").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_k")
    return keyed.join(often, "_k", "left_semi").drop("_k")


def row_sum_check(df: DataFrame, parts: list[str], total: str, tolerance: float = 1e-6) -> DataFrame:
    """``df`` with ``calculated, difference, result``: match, mismatch, or cannot tell if any number is missing."""
    values = F.array(*[coerced(F.col(c)) for c in parts])
    calculated = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    declared = coerced(F.col(total))
    out = df.withColumn("calculated", F.when(declared.isNotNull(), calculated)).withColumn("difference", declared - calculated)
    return out.withColumn("result", F.when(F.col("difference").isNull(), "cannot tell").when(F.abs("difference") < tolerance, "match").otherwise("mismatch"))
