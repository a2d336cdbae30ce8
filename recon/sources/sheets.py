"""Sheets as cell tables: columns found by header names, values carried down, rows attached to the row they belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHEET = ["doc_id", "sheet"]


def carried(rows: DataFrame, keys: list[str], order: str, values: dict[str, Column]) -> DataFrame:
    """``rows`` with each value carried down until the next one that isn't null; one window for all."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("*", *[F.last(v, ignorenulls=True).over(w).alias(k) for k, v in values.items()])


def attach_group(rows: DataFrame, keys: list[str], order: str, starts: Column) -> DataFrame:
    """``rows`` with ``group_no``: how many rows that start a group there were, itself included; 0 before the first."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("group_no", F.sum(starts.cast("bigint")).over(w))


def restarts(rows: DataFrame, keys: list[str], order: str, number: str) -> DataFrame:
    """``rows`` with ``restart``: whether the number is smaller than one before it."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("restart", F.coalesce(F.col(number) < F.max(number).over(w), F.lit(False)))


def roles(cells: DataFrame, rules: dict[str, list[str]], header_rows: int = 2) -> DataFrame:
    """``doc_id, sheet, col_no, role``: columns by the words of their header, the top row's merged names carried right.

    ``cells(doc_id, sheet, row_no, col_no, value)``. A role needs all its words in the joined header; of several columns the first.
    """
    top = cells.where(F.col("row_no") <= header_rows).groupBy(*SHEET, "col_no").agg(*[F.max(F.when(F.col("row_no") == r, F.nullif(F.regexp_replace("value", r"[\s*]", ""), F.lit("")))).alias(f"_{r}") for r in range(1, header_rows + 1)])
    w = Window.partitionBy(*SHEET).orderBy("col_no").rowsBetween(Window.unboundedPreceding, 0)
    joined = top.select(*SHEET, "col_no", F.concat(F.coalesce(F.last("_1", ignorenulls=True).over(w), F.lit("")), *[F.coalesce(f"_{r}", F.lit("")) for r in range(2, header_rows + 1)]).alias("_h"))
    each = []
    for role, words in rules.items():
        ok = F.lit(True)
        for x in words:
            ok = ok & F.contains("_h", F.lit(x))
        each.append(F.when(ok, role))
    hit = joined.select(*SHEET, "col_no", F.explode(F.filter(F.array(*each), lambda r: r.isNotNull())).alias("role"))
    return hit.groupBy(*SHEET, "role").agg(F.min("col_no").alias("col_no"))


def by_role(cells: DataFrame, rules: dict[str, list[str]], header_rows: int = 2) -> DataFrame:
    """Rows of a sheet below its header with a column for each role; missing columns are null."""
    body = cells.where(F.col("row_no") > header_rows).join(roles(cells, rules, header_rows), [*SHEET, "col_no"])
    return body.groupBy(*SHEET, "row_no").agg(*[F.max(F.when(F.col("role") == r, F.col("value"))).alias(r) for r in rules])


def ledger(rows: DataFrame) -> DataFrame:
    """Ledger rows: the name, or the item where there is none; rows without a program are an agency's totals and go."""
    return rows.where(F.coalesce("program", F.lit("")) != "").withColumn("name", F.coalesce(F.nullif(F.trim("name"), F.lit("")), "item"))


def with_headlines(rows: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """Ledger rows with the headline (◎) and detail (-) lines below them as ``headlines`` and ``details``."""
    mark = F.regexp_extract(F.col(text), r"^\s*([◎\-])", 1)
    grouped = attach_group(rows.withColumn("_m", F.coalesce(mark, F.lit(""))), keys, order, F.coalesce(mark, F.lit("")) == "")
    lines = lambda m: F.transform(F.array_sort(F.collect_list(F.when(F.col("_m") == m, F.struct(F.col(order), F.regexp_replace(text, r"^\s*[◎\-]\s*", "").alias("t"))))), lambda x: x["t"])
    below = grouped.where("group_no > 0").groupBy(*keys, "group_no").agg(lines("◎").alias("headlines"), lines("-").alias("details"))
    return grouped.where("_m = ''").drop("_m").join(below, [*keys, "group_no"])


def classification(cells: DataFrame, levels: int = 5) -> DataFrame:
    """``doc_id, row_no, level, code, name, path``: the column that holds ``[NN]name`` is the level; the path is carried down and cut
    at each less deep one."""
    marked = cells.where(F.col("value").rlike(r"^\[[0-9]+\]")).select("doc_id", "row_no", (F.col("col_no") - 1).alias("level"), F.regexp_extract("value", r"^\[([0-9]+)\]\s*(.+)$", 1).alias("code"), F.regexp_extract("value", r"^\[([0-9]+)\]\s*(.+)$", 2).alias("name"))
    w = Window.partitionBy("doc_id").orderBy("row_no", "level").rowsBetween(Window.unboundedPreceding, 0)
    at = F.struct("row_no", "level", "name")
    kept = marked.select("*", *[F.last(F.when(F.col("level") == k, at), ignorenulls=True).over(w).alias(f"_{k}") for k in range(levels)])
    path = [F.when((F.lit(k) <= F.col("level")) & F.col(f"_{k}").isNotNull() & (F.array_max(F.array(F.lit(-1), *[F.col(f"_{e}.row_no") for e in range(k)])) <= F.col(f"_{k}.row_no")), F.col(f"_{k}.name")) for k in range(levels)]
    return kept.withColumn("path", F.filter(F.array(*path), lambda x: x.isNotNull())).select("doc_id", "row_no", "level", "code", "name", "path")


def cards(rows: DataFrame) -> DataFrame:
    """``card_no, name, code`` out of ``name [CODE]``; totals go."""
    code = F.regexp_extract("value", r"\[([A-Z0-9]+)\]\s*$", 1)
    return rows.where(~F.regexp_replace("value", " ", "").isin("합계", "계", "소계", "총계")).select("card_no", F.trim(F.regexp_replace("value", r"\[[A-Z0-9]+\]\s*$", "")).alias("name"), F.nullif(code, F.lit("")).alias("code"))


def table_data(cells: DataFrame, header_row: int, end_row: int, note: int = 60) -> DataFrame:
    """The rows of one region without blank ones and without notes: a single cell that is long or tells of totals and notices."""
    body = cells.where(F.col("row_no").between(header_row + 1, end_row) & (F.coalesce("value", F.lit("")) != ""))
    rows = body.groupBy(*SHEET, "row_no").agg(F.count(F.lit(1)).alias("_n"), F.max("value").alias("_v"))
    noted = (F.col("_n") == 1) & ((F.length("_v") > note) | F.col("_v").rlike("참고|주의|비고|합계|※"))
    return body.join(rows.where(~noted).select(*SHEET, "row_no"), [*SHEET, "row_no"], "left_semi")


# Words by which the columns of load sheets are found.
FORM_ROLES = {"level": ["레벨"], "seq": ["순번"], "label": ["사업항목"], "code7": ["원가통계"], "detail": ["상세내역"], "basis": ["산출기초"], "amount": ["금액"]}
DELTA_ROLES = {"level": ["레벨"], "seq": ["순번"], "label": ["사업항목"], "code7": ["원가통계"], "detail": ["상세내역"], "basis_before": ["기정", "산출기초"], "before": ["기정", "금액"], "basis": ["최종요구", "산출기초"], "amount": ["최종요구", "금액"], "change": ["추경요구"]}
BALANCE_ROLES = {"label": ["사업항목"], "code": ["원가통계비목"], "basis": ["산출기초"]}
GRAND_TOTAL, OUTLINE = "총계", r"^\s*(?:\(?(?:[0-9]{1,3}|[가-힣])[.)]\s*)+"


def number(value: Column) -> Column:
    """A number as a sheet writes it; null for other text."""
    return F.replace(F.trim(value), F.lit(","), F.lit("")).try_cast("double")


def load_sheet(cells: DataFrame, rules: dict[str, list[str]] | None = None, header_rows: int = 2) -> DataFrame:
    """Rows of a load sheet, of a delta one with ``rules=DELTA_ROLES``: the roles' columns, numbers as such, and ``name`` (the label without
    outline marks), ``indent``, ``depth``, ``is_total`` for the row of the grand total. Rows without a label go."""
    rules = rules or FORM_ROLES
    rows = by_role(cells, rules, header_rows).where("trim(coalesce(label, '')) <> ''")
    numbers = {c: number(F.col(c)) for c in ("level", "seq", "before", "amount", "change") if c in rules}
    indent = F.length("label") - F.length(F.ltrim("label"))
    named = rows.withColumns(numbers).withColumns({"indent": indent, "depth": (F.floor(indent / 2) + 1).cast("int"), "name": F.trim(F.regexp_replace("label", OUTLINE, "")), "is_total": F.trim("label") == GRAND_TOTAL})
    texts = {c: F.trim(F.coalesce(c, F.lit(""))) for c in ("code7", "detail", "basis", "basis_before") if c in rules}
    return named.withColumns(texts | {c: F.col(c).cast("int") for c in ("level", "seq") if c in rules})


def grand_total(rows: DataFrame) -> DataFrame:
    """``doc_id, sheet, amount`` of the first row of the grand total in each load sheet."""
    return rows.where("is_total").groupBy(*SHEET).agg(F.min_by("amount", "row_no").alias("amount"))


def balance_sheet(cells: DataFrame) -> DataFrame:
    """Rows of a budget balance: ``doc_id, sheet, row_no, name, indent, depth, code7, account, basis``; the code's cell is
    ``[seven digits] account``, the hierarchy the indent. Rows without a name go; other cells of codes give no code."""
    rows = by_role(cells, BALANCE_ROLES, 1).where("trim(coalesce(label, '')) <> ''")
    indent, cell = F.length("label") - F.length(F.ltrim("label")), F.trim(F.coalesce("code", F.lit("")))
    return rows.select(*SHEET, "row_no", F.trim("label").alias("name"), indent.alias("indent"), (F.floor(indent / 2) + 1).cast("int").alias("depth"), F.regexp_extract(cell, r"^\[([0-9]{7})\]\s*(.*)$", 1).alias("code7"),
                       F.trim(F.regexp_extract(cell, r"^\[([0-9]{7})\]\s*(.*)$", 2)).alias("account"), F.trim(F.coalesce("basis", F.lit(""))).alias("basis"))


def adjustments(rows: DataFrame) -> DataFrame:
    """``name, adjust`` of ledger rows ``(name, item, program, adjust)`` that were adjusted, added up by name; rows of agencies go."""
    return ledger(rows).where("coalesce(adjust, 0) <> 0 and coalesce(name, '') <> ''").groupBy("name").agg(F.sum("adjust").alias("adjust")).where("adjust <> 0")
