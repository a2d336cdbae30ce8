"""Checks against small dimensions: classifications by level, and cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import card_key, class_key
from .match import prefix_join


def check_classes(projects: DataFrame, classes: DataFrame, levels: list[str], inner: str, outer: str) -> DataFrame:
    """``project_no, level, name, problem``: names that their level's classification doesn't have, and inner classes whose parent in
    the classification isn't the stated one. ``classes(level, name, parent_name)``; the first entry of a name counts."""
    long = projects.select("project_no", F.explode(F.array(*[F.struct(F.lit(c).alias("level"), F.col(c).alias("name")) for c in levels])).alias("x")).select("project_no", "x.*")
    known = classes.groupBy("level", class_key(F.col("name")).alias("_k")).agg(F.min("parent_name").alias("_parent"))
    joined = long.withColumn("_k", class_key(F.col("name"))).join(known.withColumn("_known", F.lit(True)), ["level", "_k"], "left")
    unknown = joined.where("_known is null").select("project_no", "level", "name", F.lit("not in the classification").alias("problem"))
    stated = projects.select("project_no", class_key(F.col(outer)).alias("_stated"))
    wrong = joined.where((F.col("level") == inner) & F.col("_known")).join(stated, "project_no").where(class_key(F.col("_parent")) != F.col("_stated"))
    return unknown.unionByName(wrong.select("project_no", "level", "name", F.lit("another parent").alias("problem")))


def assign_cards(projects: DataFrame, cards: DataFrame) -> DataFrame:
    """``projects(project_no, name)`` with ``card``: the matched card's name, else the project is its own card."""
    keyed = cards.select("card_no", F.col("name").alias("card_name"), card_key(F.col("name")).alias("card_key"))
    found = prefix_join(projects.withColumn("_key", card_key(F.col("name"))), keyed, "_key", "card_key", "card_no").withColumnRenamed("card", "_card")
    names = keyed.groupBy("card_key").agg(F.min_by("card_name", "card_no").alias("_name"))
    return found.join(names, found["_card"] == names["card_key"], "left").withColumn("card", F.coalesce("_name", "name")).withColumn("matched", F.col("_name").isNotNull()).drop("_key", "_card", "card_key", "_name")


def card_coverage(assigned: DataFrame, cards: DataFrame) -> DataFrame:
    """``name, side``: projects without a card, and cards without a project."""
    lone = assigned.where("not matched").select("name", F.lit("project").alias("side"))
    idle = cards.select("name").join(assigned.where("matched").select(F.col("card").alias("name")), "name", "left_anti").select("name", F.lit("card").alias("side"))
    return lone.unionByName(idle)


def in_scope(projects: DataFrame, cards: DataFrame) -> DataFrame:
    """The projects that one of the cards is for; cards without a name are for none."""
    return assign_cards(projects, cards.where("coalesce(name, '') <> ''")).where("matched").select(*projects.columns)


def full_code(parents: Column, code: Column) -> Column:
    """The codes of all outer classes and a class's own, joined: ``parents array<struct<code, name>>``, outermost first."""
    return F.array_join(F.concat(F.transform(F.coalesce(parents, F.array().cast("array<struct<code:string,name:string>>")), lambda p: p["code"]), F.array(code)), "-")


def describe_classes(projects: DataFrame, classes: DataFrame, levels: list[str]) -> DataFrame:
    """``projects`` with ``described``: each level's name after its code in the classification (``?`` if that doesn't have it), outer
    ones first, and ``note`` of the innermost class. ``classes(level, code, name, note)``; of a repeated name the first code counts."""
    known = classes.groupBy("level", class_key(F.col("name")).alias("_k")).agg(F.min(F.struct("code", "note")).alias("_c"))
    out = projects
    for k, level in enumerate(levels):
        side = known.where(F.col("level") == level).select(F.col("_k").alias(f"_k{k}"), F.col("_c").alias(f"_c{k}"))
        out = out.withColumn("_own", class_key(F.col(level))).join(side, F.col("_own") == F.col(f"_k{k}"), "left").drop("_own", f"_k{k}")
    parts = [F.concat(F.lit("["), F.coalesce(F.col(f"_c{k}.code"), F.lit("?")), F.lit("]"), F.coalesce(level, F.lit(""))) for k, level in enumerate(levels)]
    return out.select(*projects.columns, F.concat_ws(" > ", *parts).alias("described"), F.col(f"_c{len(levels) - 1}.note").alias("note"))


def class_counts(classes: DataFrame) -> DataFrame:
    """``level, classes``: how many different names each level has."""
    return classes.groupBy("level").agg(F.count_distinct(class_key(F.col("name"))).alias("classes"))
