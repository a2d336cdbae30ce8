"""Continuity from one budget round to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def closing(ledger: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, closing``: the request of a main round, before and change of a later one; adjustments don't count."""
    return ledger.groupBy(*keys).agg(F.sum(F.coalesce("request", F.coalesce("before", F.lit(0)) + F.coalesce("change", F.lit(0)))).alias("closing"))


def continuity(current: DataFrame, previous: DataFrame, keys: list[str], tolerance: float = 0.5) -> DataFrame:
    """``keys, before, closing, problem``: keys whose opening amount isn't the closing one of the round before. Keys that only the
    round before has are silent; a key that it lacks is a finding unless it opens at nothing."""
    now = current.groupBy(*keys).agg(F.sum("before").alias("before"))
    both = now.join(previous.select(*keys, "closing"), keys, "left")
    problem = F.when(F.col("closing").isNull() & (F.abs("before") >= tolerance), "not in the round before").when(F.abs(F.col("before") - F.col("closing")) >= tolerance, "differs")
    return both.withColumn("problem", problem).where("problem is not null")


def previous_round(files: DataFrame) -> DataFrame:
    """``files(year, round, path, modified)`` with ``previous``: the newest file of the round before in the same year."""
    newest = files.groupBy("year", "round").agg(F.max_by("path", F.struct("modified", "path")).alias("previous"))
    return files.join(newest.select("year", (F.col("round") + 1).alias("round"), "previous"), ["year", "round"], "left")
