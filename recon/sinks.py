"""Outputs: load sheets by card, findings by route, result logs and processing reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.summaries import labelled
from .operators.tree import sequence


def write_load_sheets(rows: DataFrame, path: str) -> None:
    """``rows(card, project_ord, pos, code7, handover, …)`` as ``path/entry`` (by card, numbered within it), ``path/guide`` (with a flag
    for missing codes) and ``path/not_entered`` (with the reason)."""
    entry = sequence(rows.where("not handover"), "card", ["project_ord", "pos"], [F.floor(F.col("project_ord") / 4096), F.col("project_ord")])
    # Cards are dealt out with their rows; a large card is written by several tasks.
    entry.repartition("card", F.floor(F.col("seq") / 1_000_000)).sortWithinPartitions("card", "seq").write.partitionBy("card").parquet(f"{path}/entry")
    rows.where("not handover").withColumn("code_missing", F.coalesce("code7", F.lit("")) == "").write.parquet(f"{path}/guide")
    rows.where("handover").withColumn("reason", F.lit("entered elsewhere")).write.parquet(f"{path}/not_entered")


def write_findings(findings: DataFrame, path: str) -> None:
    """One table, a folder for each route."""
    findings.write.partitionBy("route").parquet(path)


def write_report(findings: DataFrame, resolved: DataFrame, projects: DataFrame, numbers: DataFrame, path: str) -> None:
    """What one reads after a run: ``path/issues`` (findings with their project's label), ``path/skipped`` (what couldn't be checked, so that no
    findings isn't read as all right), ``path/unresolved`` (a row for each code, account, project, name and reason that is left without a
    code, with how many rows it has) and ``path/summary`` (``measure, value``: ``numbers``, and the findings of each goal and severity).

    ``resolved(project, name, code5, account, code7, source)`` with ``handover`` where rows may be handed over, ``projects(number, name)``,
    ``numbers(measure, value)``. A missing code is the empty text; rows that repeat are counted; empty tables give empty parts.
    """
    named = labelled(findings, projects)
    named.where("route = 'issue'").select("severity", "goal", "doc_id", "label", "item", "place", "message", "left", "right", "gap").write.parquet(f"{path}/issues")
    named.where("route = 'skipped'").select("goal", "doc_id", "label", "item", "place", "message").write.parquet(f"{path}/skipped")
    open_ = resolved.where("code7 is null")
    open_ = open_.where(~F.coalesce("handover", F.lit(False))) if "handover" in resolved.columns else open_
    rows = labelled(open_, projects).groupBy(F.coalesce("code5", F.lit("")).alias("code5"), F.coalesce("account", F.lit("")).alias("account"), "label", "name", F.col("source").alias("reason"))
    rows.agg(F.count(F.lit(1)).alias("rows")).write.parquet(f"{path}/unresolved")
    counted = findings.groupBy(F.concat_ws(" ", "goal", "severity").alias("measure")).agg(F.count(F.lit(1)).alias("value"))
    numbers.select("measure", F.col("value").cast("bigint").alias("value")).unionByName(counted).write.parquet(f"{path}/summary")


def write_result(result: DataFrame, source: DataFrame, path: str, plan: str) -> None:
    """A result and its log: rows of the source, of the result, and left out."""
    result.write.parquet(f"{path}/result")
    spark = source.sparkSession
    written = spark.read.schema(result.schema).parquet(f"{path}/result")
    counts = source.agg(F.count(F.lit(1)).alias("n")).withColumn("of", F.lit("source")).unionByName(written.agg(F.count(F.lit(1)).alias("n")).withColumn("of", F.lit("result")))
    log = counts.agg(F.max(F.when(F.col("of") == "source", F.col("n"))).alias("source_rows"), F.max(F.when(F.col("of") == "result", F.col("n"))).alias("result_rows"))
    log.select("source_rows", "result_rows", (F.col("source_rows") - F.col("result_rows")).alias("excluded"), F.lit(plan).alias("plan")).write.parquet(f"{path}/log")


def processing_report(files: DataFrame, hits: DataFrame) -> DataFrame:
    """``file, sha256, found, selected`` of each source; names are withheld, files are told by the head of their hash.
    ``files(doc_id, content)``."""
    counts = hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("found"), F.count_if("selected").alias("selected"))
    sha = F.sha2("content", 256)
    rows = files.select("doc_id", sha.alias("sha256"), F.substring(sha, 1, 12).alias("file")).join(counts, "doc_id", "left")
    return rows.select("file", "sha256", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("selected", F.lit(0)).alias("selected"))


def read_overrides(settings: DataFrame) -> DataFrame:
    """``code5, name, code7`` out of ``settings(json)``, a map of ``code5`` or ``code5|name`` to a code."""
    pair = settings.select(F.explode(F.from_json("json", "map<string,string>")).alias("k", "code7"))
    parts = F.split("k", r"\|", 2)
    return pair.select(parts[0].alias("code5"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("name"), "code7")


def write_overrides(overrides: DataFrame, most: int = 100_000) -> DataFrame:
    """``json``: one map of all decisions, as the settings file of one user holds them. More than ``most`` of them raise an error when
    the result is read: such a table is kept as rows instead."""
    key = F.when(F.coalesce("name", F.lit("")) == "", F.col("code5")).otherwise(F.concat_ws("|", "code5", "name"))
    rows = overrides.select(F.struct(key.alias("k"), F.col("code7").alias("v")).alias("e"))
    # One row beyond the bound is enough to know; nothing larger is ever gathered.
    held = rows.limit(most + 1).agg(F.collect_list("e").alias("e"))
    return held.select(F.when(F.size("e") > most, F.raise_error(F.lit("more decisions than one settings map holds"))).otherwise(F.to_json(F.map_from_entries("e"))).alias("json"))
