"""Checks of hierarchical amounts. Findings say where the deepest error is; what can't be checked isn't called right."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formula import main_value
from .tree import deepest, parents, with_family


def check_children(items: DataFrame, keys: list[str], tolerance: float = 1.0, reported: DataFrame | None = None, heads: tuple[str, str] | None = None, depths: int | None = None, block: int | None = None) -> DataFrame:
    """Rows whose amount isn't the sum of their direct children, the deepest of each chain alone.

    ``items(keys, pos, depth, amount, leaf)``. Columns: ``keys, pos, depth, amount, direct, leaf_total, verdict``; ``error``, or
    ``review`` where all leaves below agree with the amount, so that only the levels were read otherwise, or where the row repeats a
    headline that is wrong itself: ``heads`` names two columns of ``items``, the headline and the amount that it should be, of which
    the first is the row's amount and the second the sum of its children. A row of ``reported`` and any row above one is silent: one
    cause, one finding.

    Defined results: a null amount is not checked and counts as 0 above; a row without children is not checked; rows that repeat a
    place count once each in sums and are one row here; an empty table gives none. ``depths`` and ``block`` as in :func:`parents`: depths
    are any numbers without the one, a document is a single task's without either.
    """
    own = ["depth", "amount", *(heads or [])]
    tree = parents(items, keys, depths=depths, block=block)
    if reported is not None:
        known = reported.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*keys, "pos"])], F.lit(True).alias("_known")).distinct()
        on = [tree[c] == F.col(f"_k{i}") for i, c in enumerate([*keys, "pos"])]
        tree = tree.join(known, on, "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
        own = [*own, "_known"]
    rows = with_family(tree, keys, own, depths=depths)
    off = F.col("amount").isNotNull() & (F.col("children") > 0) & (F.abs(F.col("direct") - F.col("amount")) > tolerance)
    near = lambda a, b: F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))
    review = F.when(F.col("leaves") > 0, near(F.col("leaf_total"), F.col("amount"))).otherwise(F.lit(False))
    if heads:
        review = review | (near(F.col("amount"), F.col(heads[0])) & near(F.col("direct"), F.col(heads[1])))
    rows = rows.withColumn("verdict", F.when(off, F.when(review, "review").otherwise("error"))).withColumn("leaf_total", F.when(F.col("leaves") > 0, F.col("leaf_total")))
    bad = F.coalesce(F.col("verdict") == "error", F.lit(False))
    if reported is not None:
        rows, bad = rows.withColumn("verdict", F.when(~F.col("_known"), F.col("verdict"))), bad | F.col("_known")
    found = deepest(rows.withColumn("_bad", bad).where("verdict is not null or _bad"), keys, ["depth", "amount", "direct", "leaf_total", "verdict"], "_bad")
    return found.where("verdict is not null").select(*keys, "pos", "depth", "amount", "direct", "leaf_total", "verdict")


def check_tree_all(items: DataFrame, keys: list[str], tolerance: float = 0.5, depths: int | None = None) -> DataFrame:
    """As :func:`check_children` without the rule of the deepest: every broken row is reported."""
    rows = with_family(parents(items, keys, depths=depths), keys, ["depth", "amount"], depths=depths)
    return rows.where((F.col("children") > 0) & (F.abs(F.col("direct") - F.col("amount")) >= tolerance)).select(*keys, "pos", "depth", "amount", "direct")


def check_leaves(items: DataFrame, tolerance: float = 1.0, value: Column | None = None) -> DataFrame:
    """``items`` with ``computed`` and ``route``: of leaves with a formula, ``issue`` for a wrong or missing amount, ``skipped`` if the
    formula can't be computed, ``ok`` otherwise."""
    computed = main_value(F.col("formula")) if value is None else value
    rows = items.where(F.coalesce("leaf", F.col("formula") != "") & (F.coalesce("formula", F.lit("")) != "")).withColumn("computed", computed)
    route = F.when(F.col("computed").isNull(), "skipped").when(F.col("amount").isNull() | (F.abs(F.col("computed") - F.col("amount")) > tolerance), "issue").otherwise("ok")
    return rows.withColumn("route", route)


def check_shape(items: DataFrame, keys: list[str]) -> DataFrame:
    """Rows more than one level below the row before them, and rows that hold an amount with nothing below and aren't leaves."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("pos")
    rows = items.select("*", F.lag("depth").over(w).alias("_before"), F.lead("depth").over(w).alias("_after"))
    jump = F.col("depth") > F.coalesce("_before", F.lit(0)) + 1
    hollow = (F.coalesce("_after", F.lit(0)) <= F.col("depth")) & ~F.col("leaf") & F.col("amount").isNotNull()
    return rows.withColumn("problem", F.when(jump, "depth jump").when(hollow, "nothing below")).where("problem is not null").drop("_before", "_after")


def check_identity(rows: DataFrame, before: str = "before", after: str = "after", change: str = "change", tolerance: float = 0.5) -> DataFrame:
    """Rows whose change isn't what is after less what was before; a row with a null can't be checked."""
    gap = F.col(after) - F.col(before) - F.col(change)
    return rows.withColumn("gap", gap).withColumn("route", F.when(gap.isNull(), "skipped").when(F.abs(gap) >= tolerance, "issue").otherwise("ok"))


def verdict_by_witnesses(request: Column, leaf_total: Column, witnesses: dict[str, Column], tolerance: float = 1.0) -> Column:
    """Whether a request is its leaf total; if not, the first witness that agrees with the one or the other says which is wrong."""
    near = lambda a, b: F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))
    out = F.when(request.isNull() | leaf_total.isNull(), "cannot tell").when(near(request, leaf_total), "ok")
    for name, w in witnesses.items():
        out = out.when(near(w, request), F.lit(f"leaves wrong: {name}")).when(near(w, leaf_total), F.lit(f"request wrong: {name}"))
    return out.otherwise("no witness")


def poisoned_sum(x: str) -> Column:
    """A sum that is null if any part is; 0 for no parts."""
    return F.when(F.count(x) == F.count(F.lit(1)), F.coalesce(F.sum(x), F.lit(0)))


def check_table_totals(groups: DataFrame, totals: DataFrame, keys: list[str], measures: list[str], tolerance: float = 0.5) -> DataFrame:
    """``keys, measure, written, summed``: measures of a total row that aren't the sums of the rows; poisoned sums aren't compared."""
    sums = groups.groupBy(*keys).agg(*[poisoned_sum(m).alias(f"_{m}") for m in measures])
    both = totals.select(*keys, *measures).join(sums, keys)
    long = both.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("written"), F.col(f"_{m}").cast("double").alias("summed")) for m in measures])).alias("x")).select(*keys, "x.*")
    return long.where(F.abs(F.col("written") - F.col("summed")) >= tolerance)


def duplicate_pages(pages: DataFrame, key: list[str], order: str) -> DataFrame:
    """Pages that repeat an earlier one in every column of the key, with the first of them as ``first``. Firsts are aggregated and
    joined, so a page that is repeated very often is no single window. Nulls in the key are equal."""
    first = pages.groupBy(*key).agg(F.min(order).alias("first"))
    first = first.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], "first")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(key)])
    return pages.drop("first").join(first, same).where(F.col(order) != F.col("first")).drop(*[f"_k{i}" for i in range(len(key))])
