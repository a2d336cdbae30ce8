"""Numbers about a whole run, and how projects are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label(number: Column, name: Column) -> Column:
    """``15. name``, or the name where there is no number."""
    return F.when(F.coalesce(number.cast("string"), F.lit("")) != "", F.concat_ws(". ", number.cast("string"), name)).otherwise(name)


def charge(organisation: Column) -> Column:
    """Who is in charge: what follows the first comma of an organisation, else all of it."""
    text = F.trim(F.coalesce(organisation, F.lit("")))
    rest = F.trim(F.regexp_extract(text, r"(?s)^[^,]*,(.*)$", 1))
    return F.when(rest != "", rest).otherwise(text)


def code_digits(code: Column) -> Column:
    return F.replace(code, F.lit("-"), F.lit(""))


def labelled(findings: DataFrame, projects: DataFrame) -> DataFrame:
    """``findings`` with ``label``: that of the project of this name, else the name. Of repeated names the least number counts."""
    known = projects.groupBy(F.col("name").alias("_n")).agg(F.min("number").alias("_no"))
    return findings.join(known, F.col("project") == F.col("_n"), "left").withColumn("label", label(F.col("_no"), F.col("project"))).drop("_n", "_no")


def ledger_totals(ledger: DataFrame) -> DataFrame:
    """``name, amount`` of a ledger, one row a name. Nulls count as 0, rows without a name go."""
    return ledger.where("coalesce(name, '') <> ''").groupBy("name").agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("amount"))


def goals(projects: DataFrame) -> DataFrame:
    """One row: number and amount of projects to be entered and of those handed over; ``projects(amount, handover)``."""
    over, amount = F.coalesce("handover", F.lit(False)), F.coalesce("amount", F.lit(0))
    side = lambda c, n: [F.count_if(c).alias(n), F.coalesce(F.sum(F.when(c, amount)), F.lit(0)).alias(f"{n}_amount")]
    return projects.agg(*side(~over, "entered"), *side(over, "handed_over"))


def run_numbers(projects: DataFrame, items: DataFrame, findings: DataFrame) -> DataFrame:
    """``measure, value`` of a run: projects, leaves, those handed over, with a code and without, and findings by severity.

    ``items(doc_id, project_no, leaf, handover, code7)``, ``projects(doc_id, project_no, handover)``. Each table is added up once.
    """
    over = projects.select("doc_id", "project_no", F.coalesce("handover", F.lit(False)).alias("_over"))
    leaf = items.where("leaf").join(over, ["doc_id", "project_no"], "left").withColumn("_passed", F.coalesce("handover", F.lit(False)) | F.coalesce("_over", F.lit(False)))
    tall = lambda df, names: df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).cast("bigint").alias("value")) for n in names])).alias("x")).select("x.*")
    a = projects.agg(F.count(F.lit(1)).alias("projects"))
    b = leaf.agg(F.count(F.lit(1)).alias("leaves"), F.count_if("_passed").alias("not_entered"), F.count_if(~F.col("_passed") & F.col("code7").isNotNull()).alias("settled"), F.count_if(~F.col("_passed") & F.col("code7").isNull()).alias("unsettled"))
    c = findings.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("error", "review", "skipped", "dropped")])
    return tall(a, ["projects"]).unionByName(tall(b, ["leaves", "not_entered", "settled", "unsettled"])).unionByName(tall(c, ["error", "review", "skipped", "dropped"]))


def ordered_groups(grouped: DataFrame, keys: list[str], by_value: bool = False) -> DataFrame:
    """A grouped table by its keys, or by value from the largest down with ties by key."""
    return grouped.orderBy(*([F.desc("value")] if by_value else []), *keys)
