"""Codes inferred from earlier years: learn what always held, resolve by an explicit cascade, list what is left to decide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import without_markers
from .findings import finding, union_findings

#: The keys of the dictionaries, by kind.
SHAPES = {"account": ["code5", "account"], "parent": ["code5", "parent", "name"], "name": ["code5", "name"], "code": ["code5"], "parent_only": ["parent", "name"], "name_only": ["name"]}


def learn(rows: DataFrame) -> DataFrame:
    """``kind, code5, account, parent, name, code7, n`` over all confirmed ``rows(code7, name, parent, account)``, however many files.

    One pass: grouping sets count the code under every key shape.
    """
    norm = rows.where("coalesce(code7, '') <> '' and coalesce(name, '') <> ''").select(
        F.substring("code7", 1, 5).alias("code5"), without_markers(F.coalesce("account", F.lit(""))).alias("account"), without_markers(F.coalesce("parent", F.lit(""))).alias("parent"),
        without_markers(F.col("name")).alias("name"), "code7")
    sets = [[F.col(c) for c in [*cols, "code7"]] for cols in SHAPES.values()]
    grouped = norm.groupingSets(sets, "code5", "account", "parent", "name", "code7").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g"))
    kind, columns = F.lit(None).cast("string"), ["code5", "account", "parent", "name", "code7"]
    for k, cols in SHAPES.items():
        bits = sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in [*cols, "code7"])
        kind = F.when(F.col("_g") == bits, k).otherwise(kind)
    out = grouped.select(kind.alias("kind"), "code5", "account", "parent", "name", "code7", "n")
    return out.where("not (kind = 'account' and account = '')")


def decided(learned: DataFrame, kind: str) -> DataFrame:
    """The keys of a kind: ``n_codes``, and the code where it is the only one."""
    return learned.where(F.col("kind") == kind).groupBy(*SHAPES[kind]).agg(F.count(F.lit(1)).alias("n_codes"), F.min("code7").alias("code7"))


def resolve(items: DataFrame, learned: DataFrame) -> DataFrame:
    """``items(code5, name, parent, account)`` with ``code7, source``: the narrowest dictionary that has one code for the item.

    With a code: account name, parent and name, account as parent and name, code and name (which stops if it has several), code.
    Without: parent and name, name. ``source`` says which, or why none.
    """
    i = items.select("*", F.regexp_replace(F.coalesce("code5", F.lit("")), "-", "").alias("_c"), without_markers(F.coalesce("name", F.lit(""))).alias("_n"),
                     without_markers(F.coalesce("parent", F.lit(""))).alias("_p"), without_markers(F.coalesce("account", F.lit(""))).alias("_a"))
    steps = [("account", {"code5": "_c", "account": "_a"}), ("parent", {"code5": "_c", "parent": "_p", "name": "_n"}), ("as_parent", {"code5": "_c", "parent": "_a", "name": "_n"}),
             ("name", {"code5": "_c", "name": "_n"}), ("code", {"code5": "_c"}), ("parent_only", {"parent": "_p", "name": "_n"}), ("name_only", {"name": "_n"})]
    for step, cols in steps:
        d = decided(learned, "parent" if step == "as_parent" else step).select(*[F.col(k).alias(f"_{step}_{k}") for k in cols], F.col("n_codes").alias(f"_{step}_n"), F.when(F.col("n_codes") == 1, F.col("code7")).alias(f"_{step}"))
        on = None
        for k, own in cols.items():
            e = F.col(own) == F.col(f"_{step}_{k}")
            on = e if on is None else on & e
        i = i.join(d, on, "left")
    has, only = F.col("_c") != "", F.lit(None).cast("string")
    ways = [(has & (F.col("_a") != "") & F.col("_account").isNotNull(), F.col("_account"), "account"), (has & (F.col("_p") != "") & F.col("_parent").isNotNull(), F.col("_parent"), "parent"),
            (has & (F.col("_a") != "") & F.col("_as_parent").isNotNull(), F.col("_as_parent"), "account as parent"), (has & F.col("_name").isNotNull(), F.col("_name"), "name"),
            (has & (F.col("_name_n") > 1), only, "several by name"), (has & F.col("_code").isNotNull(), F.col("_code"), "code"), (has & (F.col("_code_n") > 1), only, "several by code"), (has, only, "unknown code"),
            ((F.col("_p") != "") & F.col("_parent_only").isNotNull(), F.col("_parent_only"), "parent only"), (F.col("_name_only").isNotNull(), F.col("_name_only"), "name only"), (F.col("_name_only_n") > 1, only, "several by name only")]
    code, source = only, F.lit("unknown name")
    for when, value, name in reversed(ways):
        code, source = F.when(when, value).otherwise(code), F.when(when, F.lit(name)).otherwise(source)
    return i.select(*items.columns, code.alias("code7"), source.alias("source"))


def decide(items: DataFrame, overrides: DataFrame) -> DataFrame:
    """``items`` with what people decided before what was learned: by name (by parent and name without a code), by bare name without
    a code, by code; ``overrides(code5, name, code7)``, where a decision for a whole code has no name.

    A decision that is repeated counts once, two different ones for the same are none; null codes and names are empty; rows stay as many as
    they are; no overrides change nothing.
    """
    o = overrides.select(F.coalesce("code5", F.lit("")).alias("_oc"), F.coalesce("name", F.lit("")).alias("_on"), F.col("code7").alias("_o"))
    o = o.groupBy("_oc", "_on").agg(F.count_distinct("_o").alias("_n"), F.max("_o").alias("_o")).where("_n = 1").drop("_n")
    own = F.coalesce("code5", F.lit(""))
    keys = [("_1", own, F.when(own == "", F.concat_ws(" > ", F.nullif(F.coalesce("parent", F.lit("")), F.lit("")), "name")).otherwise(F.col("name"))), ("_2", F.when(own == "", own), F.col("name")), ("_3", F.when(own != "", own), F.lit(""))]
    out = items
    for k, c, n in keys:
        side = o.select(F.col("_oc").alias(f"{k}c"), F.col("_on").alias(f"{k}n"), F.col("_o").alias(f"{k}v"))
        out = out.withColumn(f"{k}a", c).withColumn(f"{k}b", n)
        out = out.join(side, (F.col(f"{k}a") == F.col(f"{k}c")) & (F.col(f"{k}b") == F.col(f"{k}n")), "left").drop(f"{k}a", f"{k}b", f"{k}c", f"{k}n")
    over = F.coalesce("_1v", "_2v", "_3v")
    return out.withColumn("source", F.when(over.isNotNull(), "decided").otherwise(F.col("source"))).withColumn("code7", F.coalesce(over, "code7")).drop("_1v", "_2v", "_3v")


def open_decisions(resolved: DataFrame) -> DataFrame:
    """Codes with something to decide first: ``code5, rows, open_rows, groups`` and ``split`` (names end in different codes)."""
    by_name = resolved.groupBy(F.coalesce("code5", F.lit("")).alias("code5"), without_markers(F.col("name")).alias("name")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("code7").isNull()).alias("open_rows"), F.min("code7").alias("lo"), F.max("code7").alias("hi"))
    end = F.when(F.col("open_rows") > 0, F.lit(None)).when(F.col("lo") == F.col("hi"), F.col("lo"))
    groups = by_name.withColumn("end", end).groupBy("code5", "end").agg(F.sum("rows").alias("rows"), F.sum("open_rows").alias("open_rows"), F.count(F.lit(1)).alias("names"))
    return groups.groupBy("code5").agg(F.sum("rows").alias("rows"), F.sum("open_rows").alias("open_rows"), F.count(F.lit(1)).alias("groups"), (F.count_distinct("end") > 1).alias("split"))


def common_names(rows: DataFrame, k: int = 3) -> DataFrame:
    """``code7, name, n, rank``: the ``k`` most common names of a code, ties by name."""
    from pyspark.sql import Window

    n = rows.groupBy("code7", "name").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("code7").orderBy(F.desc("n"), "name"))).where(F.col("rank") <= k)


def unanimous_detail(rows: DataFrame) -> DataFrame:
    """``code7, detail`` where a code always had one detail text."""
    return rows.where("coalesce(detail, '') <> ''").groupBy("code7").agg(F.min("detail").alias("detail"), F.max("detail").alias("_hi")).where("detail = _hi").drop("_hi")


def unresolved(resolved: DataFrame, goal: str = "codes") -> DataFrame:
    """Findings of rows ``resolved(doc_id, project, name, code5, code7, source)`` that the cascade left without a code: one a row, with
    the reason. Rows that are handed over (``handover``, where there) are none."""
    rows = resolved.where("code7 is null")
    rows = rows.where(~F.coalesce("handover", F.lit(False))) if "handover" in rows.columns else rows
    message = F.concat(F.lit("no code: "), "source", F.when(F.coalesce("code5", F.lit("")) != "", F.concat(F.lit(" ("), "code5", F.lit(")"))).otherwise(""))
    return union_findings(rows.select(*finding(goal, "review", doc_id=F.col("doc_id"), project=F.col("project"), item=F.col("name"), message=message)))


def code_list(known: DataFrame, items: DataFrame) -> DataFrame:
    """``code7, name`` of all codes that can be chosen: ``known(code7, name)`` with the name of a code that has none borrowed from
    ``items(code5, account)``, if its first five digits have one account name only. Repeated codes are one, with the first name."""
    names = items.where("coalesce(account, '') <> ''").groupBy(F.regexp_replace("code5", "-", "").alias("_c")).agg(F.min("account").alias("_lo"), F.max("account").alias("_hi")).where("_lo = _hi and _c <> ''")
    one = known.where("coalesce(code7, '') <> ''").groupBy("code7").agg(F.min(F.nullif(F.col("name"), F.lit(""))).alias("name"))
    return one.join(names, F.substring("code7", 1, 5) == F.col("_c"), "left").select("code7", F.coalesce("name", "_lo", F.lit("")).alias("name"))


def work_order(decisions: DataFrame) -> DataFrame:
    """Open decisions first, those with most open rows, then most rows; ties by code."""
    return decisions.orderBy(F.col("open_rows") == 0, F.desc("open_rows"), F.desc("rows"), "code5")


def decision_totals(decisions: DataFrame) -> DataFrame:
    """One row on :func:`open_decisions`: ``codes, open_codes, rows, settled_rows, split_codes, coded_kinds``; ``coded_kinds`` are the
    codes with something to decide, those without a code apart."""
    return decisions.agg(F.count(F.lit(1)).alias("codes"), F.count_if(F.col("open_rows") > 0).alias("open_codes"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
                         F.coalesce(F.sum(F.col("rows") - F.col("open_rows")), F.lit(0)).alias("settled_rows"), F.count_if("split").alias("split_codes"), F.count_if((F.col("open_rows") > 0) & (F.col("code5") != "")).alias("coded_kinds"))


def named_kinds(resolved: DataFrame) -> DataFrame:
    """One row: how many different names have to be decided among rows without a code (the part of ``parent > name`` that is the name)."""
    open_ = resolved.where("code7 is null and coalesce(code5, '') = ''")
    return open_.agg(F.count_distinct(without_markers(F.substring_index("name", " > ", -1))).alias("named_kinds"))


def coverage(learned: DataFrame) -> DataFrame:
    """``kind, keys, unanimous, rows`` of learned dictionaries: how many keys of each kind there are, and how many always had one code."""
    each = None
    for kind, cols in SHAPES.items():
        one = learned.where(F.col("kind") == kind).groupBy(*cols).agg(F.count(F.lit(1)).alias("_codes"), F.sum("n").alias("_rows")).agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("_codes") == 1).alias("unanimous"), F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows")).select(F.lit(kind).alias("kind"), "keys", "unanimous", "rows")
        each = one if each is None else each.unionByName(one)
    return each
