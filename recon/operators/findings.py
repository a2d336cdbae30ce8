"""One table of findings: routed, joined, counted; and the gate before anything is written."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ["goal", "severity", "route", "doc_id", "project", "item", "place", "message", "left", "right"]
SEVERITIES = ("error", "review", "skipped", "dropped")


def finding(goal: str, severity: Column | str, **columns: Column) -> list[Column]:
    """The columns of a finding; what isn't given is null. ``place`` is where it is in its document: a row, a table or a group."""
    severity = F.lit(severity) if isinstance(severity, str) else severity
    kinds = {"left": "double", "right": "double"}
    given = {"goal": F.lit(goal), "severity": severity, "route": route(severity)} | columns
    return [given.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS]


def route(severity: Column) -> Column:
    """Errors and reviews are issues; what couldn't be checked is skipped; what was explained is dropped."""
    return F.when(severity.isin("error", "review"), "issue").otherwise(severity)


def union_findings(*reports: DataFrame) -> DataFrame:
    """All findings with their gap, each once: findings that differ in their place or in one of their amounts are two, as rows of one name
    may be wrong in one way for several reasons. Nulls are equal; no reports aren't a table."""
    return reduce(lambda a, b: a.unionByName(b), [r.drop("gap") for r in reports]).dropDuplicates(COLUMNS).withColumn("gap", F.col("left") - F.col("right"))


def search(findings: DataFrame, severity: str | None = None, text: str = "") -> DataFrame:
    """Findings of a severity whose project or item holds a text."""
    out = findings if severity is None else findings.where(F.col("severity") == severity)
    return out.where(F.coalesce(F.col("project").contains(text), F.lit(False)) | F.coalesce(F.col("item").contains(text), F.lit(False))) if text else out


def by_severity(findings: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return findings.orderBy(rank, "goal", "doc_id", "project", "item")


def summary(findings: DataFrame) -> DataFrame:
    """``goal, errors, reviews, skipped, dropped``."""
    return findings.groupBy("goal").agg(*[F.count_if(F.col("severity") == s).alias(f"{s}s" if s in ("error", "review") else s) for s in SEVERITIES])


def gate(findings: DataFrame, blocking: list[str]) -> DataFrame:
    """One row: ``blocked``, and the numbers that decide it."""
    bad = F.count_if((F.col("severity") == "error") & F.col("goal").isin(blocking))
    return findings.agg(bad.alias("blocking"), F.count_if(F.col("severity") == "error").alias("errors")).withColumn("blocked", F.col("blocking") > 0)
