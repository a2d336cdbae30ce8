"""Delta tables: groups of lines with amounts before, after and their change, and the state machines that read them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formula import basis_value, delta_value, main_value
from ..functions.numbers import formula_ok, same
from .findings import finding, union_findings
from .rollup import check_table_totals
from .tree import child_sums, parents

GROUP = ["doc_id", "project_no", "table_no", "group_no"]
# Fixed value: words of rows that are sums.
TOTAL_WORDS = ("합계", "계", "소계", "총계")


def classify_rows(rows: DataFrame) -> DataFrame:
    """``rows(doc_id, table_no, row_no, head, after)`` with ``role`` (total, group, line) and ``group_no``: lines belong to the last
    group until a total closes it (then none). A group has an amount after; a line has none."""
    label = F.regexp_replace(F.coalesce("head", F.lit("")), " ", "")
    role = F.when(label.isin(*TOTAL_WORDS), "total").when(F.col("after").isNotNull(), "group").otherwise("line")
    w = Window.partitionBy("doc_id", "table_no").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    with_role = rows.withColumn("role", role)
    at = with_role.withColumn("_n", F.sum((F.col("role") != "line").cast("int")).over(w)).withColumn("_open", F.last(F.when(F.col("role") != "line", F.col("role")), ignorenulls=True).over(w))
    number = F.sum((F.col("role") == "group").cast("int")).over(w)
    return at.withColumn("group_no", F.when(F.col("_open") == "group", number)).drop("_n", "_open")


def line_depths(lines: DataFrame, dots: str = "") -> DataFrame:
    """``lines(GROUP, line_no, glyph)`` with ``depth``. A dot is of depth 1. Another glyph has the depth that it had before in the group,
    a new one is one deeper than the line before; either closes what is deeper. A line without a glyph is one deeper than a line with
    one before it, and beside one without. Sequential by nature; a group has some tens of lines. Null glyphs are none."""
    kinds = {f.name: f.dataType.simpleString() for f in lines.schema if f.name != "depth"}

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, known, depths, plain = pdf.sort_values("line_no"), {}, [], False
        for glyph in pdf["glyph"].fillna(""):
            last = depths[-1] if depths else 0
            if glyph == "":
                depth = last if plain else last + 1
            else:
                depth = 1 if glyph in dots else known.setdefault(glyph, last + 1)
                known = {g: d for g, d in known.items() if d <= depth}
            depths.append(depth)
            plain = glyph == ""
        return pdf.assign(depth=depths)[[*kinds, "depth"]]

    return lines.drop("depth").groupBy(*GROUP).applyInPandas(walk, ", ".join(f"{k} {t}" for k, t in kinds.items()) + ", depth int")


def bullet_depths(items: DataFrame) -> DataFrame:
    """``doc_id, glyph, depth`` learned from ``items(doc_id, table_no, row_no, glyph)``: in each table a new glyph votes for one more
    than the row before has, six at most; the most votes win, of as many the depth that was seen first."""
    def votes(pdf: pd.DataFrame) -> pd.DataFrame:
        known: dict[str, int] = {}
        out, before = [], 0
        for doc, table, row, glyph in pdf.sort_values("row_no")[["doc_id", "table_no", "row_no", "glyph"]].itertuples(index=False):
            depth = known.setdefault(glyph, min(before + 1, 6))
            out.append((doc, table, row, glyph, depth))
            before = depth
        return pd.DataFrame(out, columns=["doc_id", "table_no", "row_no", "glyph", "depth"])

    kinds = {f.name: f.dataType.simpleString() for f in items.schema}
    cast = items.groupBy("doc_id", "table_no").applyInPandas(votes, f"doc_id {kinds['doc_id']}, table_no {kinds['table_no']}, row_no {kinds['row_no']}, glyph string, depth int")
    n = cast.groupBy("doc_id", "glyph", "depth").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("table_no", "row_no")).alias("at"))
    return n.groupBy("doc_id", "glyph").agg(F.min(F.struct((-F.col("n")).alias("n"), "at", "depth"))["depth"].alias("depth"))


def fold_pages(pages: DataFrame) -> DataFrame:
    """``pages(doc_id, ord, numbered, has_items)`` with ``host`` and ``folded``: a page without a number that has items belongs to the
    last numbered page, if that has none of its own; if it has, both stay and are ``split``."""
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    host = F.last(F.when(F.col("numbered"), F.struct("ord", "has_items")), ignorenulls=True).over(w)
    at = pages.withColumn("_h", host)
    loose = ~F.col("numbered") & F.col("has_items") & F.col("_h").isNotNull()
    folded = loose & ~F.col("_h.has_items")
    return at.withColumn("folded", F.coalesce(folded, F.lit(False))).withColumn("split", F.coalesce(loose & F.col("_h.has_items"), F.lit(False))).withColumn("host", F.when(folded, F.col("_h.ord")).otherwise(F.col("ord"))).drop("_h")


def check_groups(groups: DataFrame) -> DataFrame:
    """Findings on groups: after less before isn't the change; the group's own amount or its formula isn't the change; what is marked
    as not reflected isn't zero."""
    change = F.col("change").cast("double")
    gap = F.col("after").cast("double") - F.col("before").cast("double")
    value = delta_value(F.col("formula"))
    label = {"doc_id": F.col("doc_id"), "project": F.col("project_no"), "item": F.col("title"), "place": F.concat_ws("/", *[F.col(c).cast("string") for c in ("table_no", "group_no") if c in groups.columns])}
    identity = groups.where(~same(gap, change) & gap.isNotNull() & change.isNotNull()).select(*finding("delta", "error", message=F.lit("after - before is not the change"), left=gap, right=change, **label))
    own = groups.where(F.col("own").isNotNull() & ~same(F.col("own").cast("double"), change)).select(*finding("delta", "error", message=F.lit("own amount is not the change"), left=F.col("own"), right=change, **label))
    aim = F.coalesce(F.col("own").cast("double"), change)
    formula = groups.where(~formula_ok(value, aim)).select(*finding("delta", "error", message=F.lit("formula is not the amount"), left=value, right=aim, **label))
    idle = groups.where((F.col("kind") == "unreflected") & ~same(change, F.lit(0.0)) & change.isNotNull()).select(*finding("delta", "error", message=F.lit("not reflected, but not zero"), left=change, right=F.lit(0.0), **label))
    return union_findings(identity, own, formula, idle)


def check_lines(lines: DataFrame, groups: DataFrame, depths: int | None = None) -> DataFrame:
    """Findings on lines: a formula that isn't the amount, a parent that isn't the sum of its children (every one), and first-level
    lines that add up neither to the group's own amount nor to its change. ``lines(GROUP, line_no, depth, name, formula, amount)``;
    ``depths`` as in :func:`parents`."""
    place = F.concat_ws("/", *[F.col(c).cast("string") for c in ("table_no", "group_no", "line_no") if c in lines.columns])
    label = {"doc_id": F.col("doc_id"), "project": F.col("project_no"), "item": F.col("name"), "place": place}
    amount, value = F.col("amount").cast("double"), delta_value(F.col("formula"))
    formula = lines.where(~formula_ok(value, amount)).select(*finding("delta lines", "error", message=F.lit("formula is not the amount"), left=amount, right=value, **label))
    tree = parents(lines, GROUP, pos="line_no", depths=depths)
    sums = child_sums(tree, GROUP, pos="line_no").withColumnRenamed("parent", "line_no")
    direct = F.col("direct").cast("double")
    nodes = lines.join(sums, [*GROUP, "line_no"]).where(amount.isNotNull() & ~same(amount, direct)).select(*finding("delta lines", "error", message=F.lit("not the sum of its lines"), left=amount, right=direct, **label))
    top = lines.where("depth = 1").groupBy(*GROUP).agg(F.sum("amount").cast("double").alias("top"))
    both = groups.join(top, GROUP)
    off = both.where(~same(F.col("top"), F.col("change").cast("double")) & ~same(F.col("top"), F.col("own").cast("double")) & F.col("top").isNotNull())
    heads = off.select(*finding("delta lines", "error", doc_id=F.col("doc_id"), project=F.col("project_no"), item=F.col("title"), message=F.lit("first-level lines add up to neither amount"), left=F.col("top"), right=F.col("change")))
    return union_findings(formula, nodes, heads)


def check_tables(groups: DataFrame) -> DataFrame:
    """Total rows that aren't the sums of their table's groups, in any of four measures."""
    keys = ["doc_id", "project_no", "table_no"]
    found = check_table_totals(groups.where("not is_total"), groups.where("is_total"), keys, ["after", "before", "previous", "change"])
    return found.select(*finding("delta tables", "error", doc_id=F.col("doc_id"), project=F.col("project_no"), item=F.col("measure"), message=F.lit("total is not the sum"), left=F.col("written"), right=F.col("summed")))


def check_form(rows: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Findings on a delta load sheet, one a row: ``rows(doc_id, row_no, level, name, code7, basis_before, before, basis, amount, change,
    leaf)`` and, where known, ``indent`` and ``detail``; ``totals(doc_id, before, amount, change)`` is what the sheet says in all.

    The level is half the indent and one; basis texts are the amounts (one that can't be computed is skipped), after less before is the
    change; bottom rows with an amount have a code, a detail text and a basis. Parents are the sums of their children in three measures,
    of which the first that differs is named; rows above one whose amounts are broken are silent. First-level rows add up to the
    totals. Null amounts count as 0 in sums; an empty table gives none.
    """
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    shown = F.floor(F.col("indent") / 2) + 1 if "indent" in rows.columns else F.col("level")
    said = [("code7", "code"), ("detail", "detail"), ("basis", "basis")] if "detail" in rows.columns else [("code7", "code")]
    bottom = F.col("leaf") & ((zero("amount") != 0) | (zero("before") != 0))
    missing = F.filter(F.array(*[F.when(F.coalesce(c, F.lit("")) == "", word) for c, word in said]), lambda w: w.isNotNull())
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    values = {"before": F.col("_value_before"), "amount": F.col("_value")}
    amounts = [F.when(~formula_ok(values["before"], F.col("before").cast("double")), "basis before"), F.when(~formula_ok(values["amount"], F.col("amount").cast("double")), "basis"),
               F.when(F.col("change").isNotNull() & ~same(zero("amount") - zero("before"), zero("change")), "change")]
    others = [F.when(F.col("level") != shown, "level"), F.when(bottom & (F.size(missing) > 0), F.concat(F.lit("no "), F.array_join(missing, ", no ")))]
    # Values are columns of their own, so that each text is computed once.
    valued = rows.withColumns({"_value_before": basis_value(text("basis_before")), "_value": basis_value(text("basis"))})
    tree = parents(valued.withColumnsRenamed({"row_no": "pos", "level": "depth"}).withColumn("level", F.col("depth")), ["doc_id"])
    problems = tree.withColumn("_a", F.filter(F.array(*amounts), lambda x: x.isNotNull())).withColumn("_p", F.concat("_a", F.filter(F.array(*others), lambda x: x.isNotNull())))
    own = problems.where(F.size("_p") > 0)
    blind = problems.select("doc_id", "pos", "name", F.explode(F.filter(F.array(*[F.when(text(c).isNotNull() & F.col(m).isNotNull() & values[m].isNull(), F.lit(c)) for c, m in (("basis_before", "before"), ("basis", "amount"))]), lambda x: x.isNotNull())).alias("_c"))
    # Children and parents are in one document; sums of all measures are one grouping.
    sums = tree.where("parent_depth = depth - 1").groupBy("doc_id", F.col("parent").alias("pos")).agg(*[F.sum(zero(m)).alias(f"_{m}") for m in ("before", "amount", "change")])
    off = F.coalesce(*[F.when(~same(zero(m), F.col(f"_{m}")), m) for m in ("before", "amount", "change")])
    broken = tree.join(sums, ["doc_id", "pos"]).withColumn("_off", off).where("_off is not null")
    above = broken.select("doc_id", "ancestors").union(own.where(F.size("_a") > 0).select("doc_id", "ancestors")).select("doc_id", F.explode("ancestors").alias("pos")).distinct()
    deepest = broken.join(above, ["doc_id", "pos"], "left_anti")
    who = {"doc_id": F.col("doc_id"), "project": F.col("pos"), "item": F.col("name"), "place": F.col("pos")}
    found = [own.select(*finding("form", "error", message=F.array_join("_p", ", "), **who)), deepest.select(*finding("form", "error", message=F.concat(F.lit("not the sum of its rows: "), "_off"), **who)),
             blind.select(*finding("form", "skipped", message=F.concat(F.lit("can't be computed: "), "_c"), **who))]
    if totals is not None:
        tops = tree.where("depth = 1").groupBy("doc_id").agg(*[F.sum(zero(m)).alias(f"_{m}") for m in ("before", "amount", "change")])
        each = F.filter(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).cast("double").alias("is"), F.col(f"_{m}").alias("sum")) for m in ("before", "amount", "change")]), lambda d: d["is"].isNotNull() & ~same(d["is"], d["sum"]))
        found.append(totals.join(tops, "doc_id").select("doc_id", F.explode(each).alias("d")).select(*finding("form", "error", doc_id=F.col("doc_id"), item=F.col("d.m"), message=F.lit("total is not the sum of the projects"), left=F.col("d.is"), right=F.col("d.sum"))))
    return union_findings(*found)


def check_entered(rows: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Findings on a main load sheet after entry: ``rows(doc_id, row_no, level, indent, name, basis, amount, code7)``. The level is half
    the indent and one, the basis is the amount, and what has a basis has a code; what is null isn't compared."""
    shown, value = F.floor(F.col("indent") / 2) + 1, main_value(F.col("basis"))
    has = F.coalesce(F.col("basis") != "", F.lit(False))
    one = lambda when, message, left, right: F.when(when, F.struct(F.lit(message).alias("message"), left.cast("double").alias("left"), right.cast("double").alias("right")))
    checks = [one(F.col("level") != shown, "level is not the indent's", F.col("level"), shown), one(has & (F.abs(value - F.col("amount")) > tolerance), "basis is not the amount", F.col("amount"), value),
              one(has & (F.coalesce("code7", F.lit("")) == ""), "no code", F.lit(None), F.lit(None))]
    found = rows.select("doc_id", "row_no", "name", F.explode(F.filter(F.array(*checks), lambda c: c.isNotNull())).alias("c"))
    return union_findings(found.select(*finding("entered", "error", doc_id=F.col("doc_id"), project=F.col("row_no"), item=F.col("name"), message=F.col("c.message"), left=F.col("c.left"), right=F.col("c.right"))))
