"""Whole delta documents: their tables read into groups and lines, and heads, tables, summary and status held against each other.

``rows(doc_id, project_no, table_no, row_no, cells array<string>)`` are the rows of tables. Amounts are in thousand-won; equal means
nearer than a half. Rows of a table are windows of one partition; everything above tables is grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formula import name_and_formula
from ..functions.keys import squeeze
from ..functions.numbers import same, signed_number, unit_number, with_previous
from .delta import GROUP, TOTAL_WORDS, check_groups, check_lines, check_tables
from .findings import finding, union_findings
from .reconcile import compare_summary
from .tree import parents

TABLE = ["doc_id", "project_no", "table_no"]
# The word that names a table's columns, a row that repeats them, the words of a head table, dots and arrows before lines.
HEAD_WORD, REPEATED, AFTER_WORD, DOTS, ARROWS = "사업명", "산출내역요구액", "추경예산안(A)", "․·ㆍ∙・", "▸▶►"
_GLYPH = rf"^([{DOTS}{ARROWS}\x{{E000}}-\x{{F8FF}}\x{{F0000}}-\x{{FFFFD}}\x{{100000}}-\x{{10FFFD}}])\s*"
MEASURES = ("after", "before", "change")


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def _behind(cells: str) -> Column:
    """All cells but the first."""
    return F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0)))


def change_rows(rows: DataFrame) -> DataFrame:
    """``rows(…, kind)`` of change tables below the row that names their columns, with ``role`` (group, total, line) and ``group_no``.

    A group has, side by side, a number and a number with that of the year before in brackets; ``at`` is the place of the latter. Rows
    below it are its lines until the next group or total; the kind ``unreflected`` has no lines. Blank rows go; null cells are blank.
    """
    w = Window.partitionBy(*TABLE).orderBy("row_no")
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    clean = rows.withColumn("cells", F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit("")))))
    text = F.replace(F.array_join("cells", ""), F.lit(" "), F.lit(""))
    body = clean.withColumn("_text", text).withColumn("_began", F.max(F.col("_text").contains(HEAD_WORD).cast("int")).over(before)).where((F.col("_began") == 1) & ~F.col("_text").isin("", REPEATED))
    pair = F.transform("cells", lambda c, i: (i > 0) & with_previous(c).isNotNull() & F.coalesce(signed_number(F.get("cells", i - 1)).isNotNull(), F.lit(False)))
    at = F.array_position(pair, True).cast("int") - 1
    role = F.when(F.replace(F.get("cells", F.lit(0)), F.lit(" "), F.lit("")).isin(*TOTAL_WORDS), "total").when(at >= 0, "group").otherwise("line")
    told = body.withColumn("at", at).withColumn("role", role)
    told = told.withColumn("_open", F.last(F.when(F.col("role") != "line", F.col("role")), ignorenulls=True).over(upto)).withColumn("group_no", F.sum((F.col("role") == "group").cast("int")).over(upto))
    return told.where((F.col("role") != "line") | ((F.col("_open") == "group") & (F.col("kind") == "change"))).drop("_text", "_began", "_open")


def groups_of(told: DataFrame) -> DataFrame:
    """``GROUP, kind, title, business, formula, after, before, previous, change, own, is_total, row_no`` of :func:`change_rows`.

    In change tables the label behind the amounts has the title and in brackets the formula; then an amount with a unit is the group's
    own, and the first plain number the change. In unreflected ones the name before the amounts is the title.
    """
    label = [*TABLE, "group_no", "kind"]
    g = told.where("role = 'group'")
    pair = with_previous(F.get("cells", F.col("at")))
    rest = F.slice("cells", F.col("at") + 2, F.greatest(F.size("cells") - F.col("at") - 1, F.lit(0)))
    business = F.when(F.col("at") >= 2, F.get("cells", F.col("at") - 2)).otherwise("")
    g = g.withColumn("_rest", rest).withColumn("_numbers", F.transform(_behind("_rest"), signed_number)).withColumn("_own", F.transform(_behind("_rest"), unit_number))
    first = F.array_position(F.transform("_numbers", lambda v: v.isNotNull()), True).cast("int")
    own = _first(F.filter("_own", lambda v, i: (F.col("_at") == 0) | (i < F.col("_at") - 1)))
    is_change = F.col("kind") == "change"
    title, formula = name_and_formula(F.coalesce(F.get("_rest", F.lit(0)), F.lit("")))
    one = g.withColumn("_at", first).select(*label, F.when(is_change, title).otherwise(business).alias("title"), business.alias("business"), F.when(is_change, formula).otherwise("").alias("formula"), signed_number(F.get("cells", F.col("at") - 1)).alias("after"),
        pair["now"].alias("before"), pair["previous"].alias("previous"), F.when(is_change, _first(F.col("_numbers"))).otherwise(signed_number(F.get("_rest", F.lit(0)))).alias("change"), F.when(is_change, own).alias("own"), F.lit(False).alias("is_total"), "row_no")
    said = F.filter(_behind("cells"), lambda c: c != "")
    t = told.where("role = 'total'").withColumn("_said", said).withColumn("_pair", _first(F.transform("_said", with_previous))).withColumn("_n", F.filter(F.transform("_said", signed_number), lambda v: v.isNotNull()))
    none = F.lit(None).cast("double")
    total = t.select(*label, F.lit("합계").alias("title"), F.lit("").alias("business"), F.lit("").alias("formula"), F.get("_n", F.lit(0)).alias("after"), F.col("_pair.now").alias("before"), F.col("_pair.previous").alias("previous"),
        F.get("_n", F.lit(1)).alias("change"), none.alias("own"), F.lit(True).alias("is_total"), "row_no")
    return one.unionByName(total)


def lines_of(told: DataFrame) -> DataFrame:
    """``GROUP, line_no, glyph, name, formula, amount`` of :func:`change_rows`: the amount is the first later cell with a number."""
    text = F.get("cells", F.lit(0))
    name, formula = name_and_formula(F.trim(F.regexp_replace(text, _GLYPH, "")))
    amount = _first(F.transform(_behind("cells"), lambda c: F.coalesce(unit_number(c), signed_number(c))))
    return told.where("role = 'line'").select(*TABLE, "group_no", F.col("row_no").alias("line_no"), F.regexp_extract(text, _GLYPH, 1).alias("glyph"), name.alias("name"), formula.alias("formula"), amount.alias("amount"))


def head_values(rows: DataFrame) -> DataFrame:
    """``TABLE, label, after, before, last_final, change``: below the row that names the columns of a page's head table, the first row with a number."""
    w = Window.partitionBy(*TABLE).orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    named = rows.withColumn("_is", F.exists("cells", lambda c: F.coalesce(F.replace(c, F.lit(" "), F.lit("")).contains(AFTER_WORD), F.lit(False))))
    below = named.withColumn("_label", F.first(F.when(F.col("_is"), F.trim(F.get("cells", F.lit(0)))), ignorenulls=True).over(w)).withColumn("_v", F.transform("cells", signed_number))
    first = below.where(F.col("_label").isNotNull() & F.exists("_v", lambda v: v.isNotNull())).groupBy(*TABLE).agg(F.min_by(F.struct("_label", "_v"), "row_no").alias("_x"))
    return first.select(*TABLE, F.col("_x._label").alias("label"), *[F.get("_x._v", F.lit(k)).alias(c) for k, c in enumerate(("after", "before", "last_final", "change"))])


def summary_rows(rows: DataFrame) -> DataFrame:
    """``TABLE, row_no, number, name, after, before, change, page, is_total`` of summary tables; rows without all three amounts are no projects."""
    is_total = F.replace(F.get("cells", F.lit(0)), F.lit(" "), F.lit("")).isin(*TOTAL_WORDS) & (F.size("cells") >= 4)
    v = F.when(is_total, F.slice("cells", 2, 3)).otherwise(F.slice("cells", 3, 3))
    t = rows.withColumn("cells", F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))))).withColumn("is_total", F.coalesce(is_total, F.lit(False))).withColumn("_v", F.transform(v, signed_number))
    whole = (F.size("cells") >= 5) & (F.size(F.filter("_v", lambda x: x.isNotNull())) == 3)
    cell = lambda k: F.when(~F.col("is_total"), F.coalesce(F.get("cells", F.lit(k)), F.lit("")))
    return t.where(F.col("is_total") | whole).select(*TABLE, "row_no", cell(0).alias("number"), cell(1).alias("name"), *[F.get("_v", F.lit(k)).alias(c) for k, c in enumerate(MEASURES)], cell(5).alias("page"), "is_total")


def status_rows(rows: DataFrame) -> DataFrame:
    """``TABLE, row_no, level, name, after, before, change`` of status tables: blank cells before a name are its level."""
    clean = rows.withColumn("cells", F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit("")))))
    level = F.array_position(F.transform("cells", lambda c: c != ""), True).cast("int") - 1
    at = clean.withColumn("level", level).where("level >= 0").withColumn("_v", F.transform(F.slice("cells", F.col("level") + 2, F.lit(3)), signed_number))
    return at.where(F.size(F.filter("_v", lambda x: x.isNotNull())) == 3).select(*TABLE, "row_no", "level", F.get("cells", F.col("level")).alias("name"), *[F.get("_v", F.lit(k)).alias(c) for k, c in enumerate(MEASURES)])


def single_year(start: Column, end: Column) -> Column:
    return F.coalesce(start == end, F.lit(False))


def table_values(groups: DataFrame) -> DataFrame:
    """``TABLE, kind, after, before, change``: what a table's total says, else the sum of its groups, null if any group says nothing."""
    plain = ~F.col("is_total")
    told = lambda m: F.max(F.when(F.col("is_total"), F.col(m))).cast("double")
    summed = lambda m: F.when(F.count_if(plain & F.col(m).isNull()) == 0, F.coalesce(F.sum(F.when(plain, F.col(m))), F.lit(0))).cast("double")
    return groups.groupBy(*TABLE).agg(F.max("kind").alias("kind"), *[F.coalesce(told(m), summed(m)).alias(m) for m in MEASURES])


def check_heads(projects: DataFrame, groups: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """Findings of pages' heads: ``projects(doc_id, project_no, name, after, before, change, total_cost, funding map, year_from,
    year_to)``, ``groups`` as of :func:`groups_of`, ``sections(TABLE, section, section_cost)``.

    After less before is the change; the total cost of a single year is the amount after (else it may be stale); parts of funding add
    up to it; a section's cost is its table's change; all tables add up to the head. Where the change does and nothing is listed as
    unreflected, unchanged parts were left out of the tables, which is a review. A page without head or tables is skipped. Null
    amounts aren't compared.
    """
    values = table_values(groups)
    sums = values.groupBy("doc_id", "project_no").agg(*[F.when(F.count(m) == F.count(F.lit(1)), F.sum(m)).alias(f"_{m}") for m in MEASURES], F.bool_or(F.col("kind") == "unreflected").alias("_idle"))
    p = projects.join(sums, ["doc_id", "project_no"], "left")
    for m in MEASURES:
        p = p.withColumn(m, F.col(m).cast("double"))
    known = lambda *cs: F.lit(True) if not cs else cs[0].isNotNull() & known(*cs[1:])
    differ = lambda a, b: known(a, b) & ~same(a, b)
    after, before, change, cost = (F.col(c) for c in ("after", "before", "change", "total_cost"))
    funded = F.aggregate(F.map_values("funding"), F.lit(0.0), lambda a, v: a + v.cast("double"))
    change_ok = same(F.col("_change"), change)
    left_out = change_ok & ~F.coalesce("_idle", F.lit(False))
    one = lambda when, severity, message, left=F.lit(None), right=F.lit(None): F.when(when, F.struct(F.lit(severity).alias("severity") if isinstance(severity, str) else severity.alias("severity"), (F.lit(message) if isinstance(message, str) else message).alias("message"), left.cast("double").alias("left"), right.cast("double").alias("right")))
    stale = F.when(same(cost, before), "total cost is still the amount before").otherwise("total cost is not the amount after")
    sides = [one(differ(F.col(f"_{m}"), F.col(m)) & ~left_out, "error", f"tables do not add up to the head: {m}", F.col(m), F.col(f"_{m}")) for m in ("after", "before")]
    checks = [
        one(~known(after, change), "skipped", "no head"), one(known(after, before, change) & ~same(after - before, change), "error", "after - before is not the change", change, after - before),
        one(differ(cost.cast("double"), after) & single_year(F.col("year_from"), F.col("year_to")), "error", stale, cost, after), one((F.size("funding") > 1) & differ(funded, cost.cast("double")), "error", "funding is not the total cost", cost, funded),
        one(F.col("_idle").isNull() & known(change) & ~same(change, F.lit(0.0)), "skipped", "no tables"), one(differ(F.col("_change"), change), "error", "tables do not add up to the head: change", change, F.col("_change")), *sides,
        one((differ(F.col("_after"), after) | differ(F.col("_before"), before)) & left_out, "review", "unchanged parts are not in the tables"),
    ]
    found = p.select("doc_id", "name", F.explode(F.filter(F.array(*checks), lambda c: c.isNotNull())).alias("c"))
    heads = found.select(*finding("delta heads", F.col("c.severity"), doc_id=F.col("doc_id"), project=F.col("name"), message=F.col("c.message"), left=F.col("c.left"), right=F.col("c.right")))
    if sections is None:
        return union_findings(heads)
    costs = values.where("kind = 'change'").join(sections, TABLE).join(projects.select("doc_id", "project_no", "name"), ["doc_id", "project_no"])
    off = costs.where(differ(F.col("section_cost").cast("double"), change))
    return union_findings(heads, off.select(*finding("delta heads", "error", doc_id=F.col("doc_id"), project=F.col("name"), item=F.col("section"), message=F.lit("section cost is not the change of its table"), left=F.col("section_cost"), right=change)))


def check_status(rows: DataFrame) -> DataFrame:
    """Findings of status tables ``rows(doc_id, row_no, level, name, after, before, change)``: the change of a row, and in each of three
    measures every row with rows one level below that isn't their sum."""
    tree = parents(rows.withColumns({"pos": F.col("row_no"), "depth": F.col("level") + 1}), ["doc_id"])
    sums = tree.where("parent_depth = depth - 1").groupBy("doc_id", F.col("parent").alias("pos")).agg(*[F.sum(m).cast("double").alias(f"_{m}") for m in MEASURES])
    label = {"doc_id": F.col("doc_id"), "project": F.col("name")}
    own = rows.where(~same((F.col("after") - F.col("before")).cast("double"), F.col("change").cast("double"))).select(*finding("delta status", "error", place=F.col("row_no"), message=F.lit("after - before is not the change"), left=F.col("change"), right=F.col("after") - F.col("before"), **label))
    both = tree.join(sums, ["doc_id", "pos"])
    off = F.filter(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).cast("double").alias("is"), F.col(f"_{m}").alias("sum")) for m in MEASURES]), lambda d: ~same(d["is"], d["sum"]))
    nodes = both.select("doc_id", "name", "pos", F.explode(off).alias("d")).select(*finding("delta status", "error", item=F.col("d.m"), place=F.col("pos"), message=F.lit("not the sum of the rows below"), left=F.col("d.is"), right=F.col("d.sum"), **label))
    return union_findings(own, nodes)


def check_names(projects: DataFrame) -> DataFrame:
    """Findings of names that several pages of a document have, once a name, by its first page."""
    n = projects.groupBy("doc_id", squeeze(F.col("name")).alias("_k")).agg(F.count(F.lit(1)).alias("_n"), F.min_by("name", "project_no").alias("name")).where("_n > 1")
    return union_findings(n.select(*finding("delta names", "error", doc_id=F.col("doc_id"), project=F.col("name"), message=F.lit("several pages of one name"), left=F.col("_n"))))


def check_summary_table(summary: DataFrame) -> DataFrame:
    """Findings within summary tables: the change of a row, and the written totals against the sums of the rows."""
    rows, total = summary.where("not is_total"), summary.where("is_total")
    place = F.concat_ws("/", *[F.col(c).cast("string") for c in ("table_no", "row_no") if c in summary.columns])
    own = rows.where(~same((F.col("after") - F.col("before")).cast("double"), F.col("change").cast("double"))).select(*finding("delta summary", "error", doc_id=F.col("doc_id"), project=F.col("name"), place=place, message=F.lit("after - before is not the change"), left=F.col("change"), right=F.col("after") - F.col("before")))
    sums = rows.groupBy("doc_id").agg(*[F.coalesce(F.sum(m), F.lit(0)).cast("double").alias(f"_{m}") for m in MEASURES])
    off = F.filter(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).cast("double").alias("is"), F.col(f"_{m}").alias("sum")) for m in MEASURES]), lambda d: d["is"].isNotNull() & ~same(d["is"], d["sum"]))
    totals = total.join(sums, "doc_id").select("doc_id", F.explode(off).alias("d")).select(*finding("delta summary", "error", doc_id=F.col("doc_id"), item=F.col("d.m"), message=F.lit("total is not the sum"), left=F.col("d.is"), right=F.col("d.sum")))
    return union_findings(own, totals)


def check_document(projects: DataFrame, groups: DataFrame, lines: DataFrame, summary: DataFrame, status: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """All findings of delta documents in one table: heads, groups, lines, tables, summary, status and names. ``lines`` have their
    ``depth``; ``projects`` may say that they are ``bundled`` in the summary."""
    pages = projects if "bundled" in projects.columns else projects.withColumn("bundled", F.lit(False))
    listed = summary.where("not is_total")
    return union_findings(*[x.drop("gap") for x in (
        check_heads(projects, groups, sections), check_groups(groups), check_lines(lines, groups.where("not is_total")), check_tables(groups),
        check_summary_table(summary), compare_summary(pages, listed), check_status(status), check_names(projects))])
