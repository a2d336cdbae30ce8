"""Whole reconciliations composed of the joins: three-way totals, delta documents against ledger, summary and load sheet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import match_key, squeeze, without_markers
from ..functions.numbers import same
from .findings import finding, union_findings
from .tree import parents
from .match import amount_join, deal, find_row, greedy_amounts, multiset_gap, name_join, nearest_candidate, scope

TIERS = [without_markers, squeeze]


def _compared(projects: DataFrame, amount: str, goal: str, other: str) -> DataFrame:
    """Findings where no candidate amount of a project is near the other side's; a review where pages were split."""
    best = nearest_candidate(F.col("candidates"), F.col(amount))
    off = projects.withColumn("_b", best).where("not _b.ok")
    severity = F.when(F.col("split"), "review").otherwise("error")
    return off.select(*finding(goal, severity, doc_id=F.col("doc_id"), project=F.col("name"), item=F.col("_b.label"), message=F.lit(f"differs from {other}"), left=F.col("_b.value"), right=F.col(amount)))


def compare_totals(projects: DataFrame, ledger: DataFrame, form: DataFrame | None, goal: str) -> DataFrame:
    """Findings of narrative against ledger and load sheet.

    ``projects(doc_id, project_no, name, candidates array<struct<label, value>>, split, restarted, bundled, handover)``,
    ``ledger(name, amount)`` and ``form(name, amount)``, a row a name. Where these have a ``doc_id``, each document is compared with its
    own; else they are all documents' alike. A name that the ledger lacks is no error if exactly one ledger
    row that no other project's name takes has one of its amounts, or if pages were numbered anew or bundled.
    """
    cands = F.filter("candidates", lambda c: c["value"].isNotNull())
    rows = projects.withColumn("candidates", cands)
    usable = rows.where(F.size("candidates") > 0)
    blind = rows.where(F.size("candidates") == 0).select(*finding(goal, "skipped", doc_id=F.col("doc_id"), project=F.col("name"), message=F.lit("no amount in the narrative")))
    own = scope(projects, ledger)
    led = ledger.select(F.struct("name", *own).alias("_id"), F.col("name").alias("_ln"), F.col("amount").cast("double").alias("_la"), *own)
    named = name_join(usable, led, "name", "_id", "_ln", TIERS, own)
    found = named.join(led.drop(*own).withColumnRenamed("_id", "_lid"), F.col("match") == F.col("_lid"), "left")
    free = led.join(named.where("match is not null").select(F.col("match").alias("_id")).distinct(), "_id", "left_anti")
    lost = found.where("match is null").select("doc_id", "project_no", "name", "candidates", "restarted", "bundled")
    each = lost.select(F.struct("doc_id", "project_no").alias("_p"), F.explode("candidates.value").alias("_v"), *own).distinct()
    by_amount = amount_join(each.withColumn("_q", F.struct("_p", "_v")), free.withColumn("_r", F.col("_ln")), "_q", "_v", "_r", "_la", by=own)
    one = by_amount.groupBy(F.col("_q._p").alias("_p")).agg(F.count_distinct("_r").alias("_n")).where("_n = 1").select("_p")
    missing = lost.where(~F.coalesce("restarted", F.lit(False)) & ~F.coalesce("bundled", F.lit(False))).withColumn("_p", F.struct("doc_id", "project_no")).join(one, "_p", "left_anti")
    missing = missing.select(*finding(goal, "error", doc_id=F.col("doc_id"), project=F.col("name"), message=F.lit("not in the ledger")))
    reports = [blind, missing, _compared(found.where("match is not null"), "_la", goal, "the ledger")]
    if form is not None:
        mine = scope(projects, form)
        sheet = form.select(F.struct("name", *mine).alias("_id"), F.col("name").alias("_fn"), F.col("amount").cast("double").alias("_fa"), *mine)
        entered = usable.where("not handover")
        joined = name_join(entered, sheet, "name", "_id", "_fn", TIERS, mine)
        with_form = joined.join(sheet.drop(*mine).withColumnRenamed("_id", "_fid"), F.col("match") == F.col("_fid"), "left")
        reports.append(with_form.where("match is null").select(*finding(goal, "error", doc_id=F.col("doc_id"), project=F.col("name"), message=F.lit("not in the load sheet"))))
        reports.append(_compared(with_form.where("match is not null"), "_fa", goal, "the load sheet"))
        known = projects.select(without_markers(F.col("name")).alias("k"), *mine).union(projects.select(squeeze(F.col("name")), *mine)).distinct()
        extra = sheet
        for key in (without_markers, squeeze):
            extra = extra.withColumn("k", key(F.col("_fn"))).join(known, ["k", *mine], "left_anti").drop("k")
        reports.append(extra.select(*finding(goal, "error", project=F.col("_fn"), message=F.lit("only in the load sheet"), right=F.col("_fa"), **{c: F.col(c) for c in mine})))
    return union_findings(*reports)


def _neq(a: Column, b: Column) -> Column:
    return a.isNotNull() & ~same(a.cast("double"), b.cast("double"))


def compare_delta(projects: DataFrame, ledger: DataFrame, summary: DataFrame, goal: str = "delta ledger", parts: int | None = None) -> DataFrame:
    """Findings of delta pages against the ledger: ``projects(doc_id, name, change, before)``, ``ledger(row_no, name, change, before,
    unplanned)``, ``summary(name, change, before)``. Where ledger and summary have a ``doc_id``, each document is compared with its own;
    else they are all documents' alike.

    A page's change or amount before that isn't the ledger's; a page with a change that the ledger lacks; a ledger row with a change
    that neither a page nor, under a name that holds its own, the summary has. A page that holds a part of what summary and ledger
    agree on is right. Pages and ledger are dealt in ``parts`` partitions, if given, else in the session's.
    """
    own, told = scope(projects, ledger), scope(ledger, summary)
    rows = ledger.withColumn("_rid", F.struct("row_no", *own))
    led = rows.select(F.col("_rid").alias("_id"), F.col("change").alias("_lc"), F.col("before").alias("_lb"))
    found = find_row(projects, rows, "name", "_rid", "name", "unplanned", own, parts)
    who = {"doc_id": F.col("doc_id"), "project": F.col("name")}
    # Pages without a row are told here: joined with the ledger, all of them would be one task's.
    gone = found.where(F.col("match").isNull() & _neq(F.col("change"), F.lit(0))).select(*finding(goal, "error", message=F.lit("not in the ledger"), left=F.col("change"), **who))
    hit = deal(found.where("match is not null"), "match", parts).join(deal(led, "_id", parts), F.col("match") == F.col("_id"))
    named = scope(projects, summary)
    total = summary.groupBy(match_key(F.col("name")).alias("_k"), *named).agg(F.max("before").alias("_sb"))
    # Both amounts in one pass over the pages.
    differs = {c: _neq(F.col(c), F.col(other)) for c, other in (("change", "_lc"), ("before", "_lb"))}
    off = hit.where(differs["change"] | differs["before"]).withColumn("_k", match_key(F.col("name"))).join(total, ["_k", *named], "left")
    partial = same(F.col("_sb").cast("double"), F.col("_lb").cast("double"))
    entry = lambda message, c, other: F.struct(F.lit(message).alias("m"), F.col(c).cast("double").alias("mine"), F.col(other).cast("double").alias("theirs"))
    reasons = F.array_compact(F.array(F.when(differs["change"], entry("change differs from the ledger", "change", "_lc")), F.when(differs["before"] & ~partial, entry("amount before differs from the ledger", "before", "_lb"))))
    wrong = off.select("doc_id", "name", F.explode(reasons).alias("d")).select(*finding(goal, "error", message=F.col("d.m"), left=F.col("d.mine"), right=F.col("d.theirs"), **who))
    used = deal(found.where("match is not null").select(F.col("match").alias("_rid")), "_rid", parts)
    orphan = deal(rows.where(~same(F.col("change").cast("double"), F.lit(0.0))), "_rid", parts).join(used, "_rid", "left_anti").withColumn("_k", match_key(F.col("name"))).withColumn("_c", F.bround(F.col("change")))
    # A popular name is one row on either side, however many rows have it.
    listed = summary.select(match_key(F.col("name")).alias("_sk"), F.bround(F.col("change")).alias("_c"), *told).distinct()
    held = holders(orphan.where("_k <> ''").select("_k", "_c", *told).distinct(), listed, ["_c", *told])
    lone = orphan.join(held, reduce(lambda p, q: p & q, [orphan[c].eqNullSafe(held[c]) for c in ("_k", "_c", *told)]), "left_anti")
    lone = lone.select(*finding(goal, "error", project=F.col("name"), place=F.col("row_no"), message=F.lit("only in the ledger"), right=F.col("change"), **{c: F.col(c) for c in own}))
    return union_findings(gone, wrong, lone)


#: Characters of the pieces over which names meet names that hold them.
PIECE = 3


def holders(short: DataFrame, long: DataFrame, by: list[str]) -> DataFrame:
    """The rows of ``short(_k, by)`` whose ``_k`` is within an ``_sk`` of ``long(_sk, by)``.

    They meet over a piece of three characters of the shorter name, the one that fewest of the longer names have, so a popular amount makes
    no pairs of all names that have it; names of fewer characters meet over themselves. Both sides have each row once.
    """
    cut = lambda x: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - (PIECE - 1), F.lit(1))), lambda i: F.substring(x, i, F.lit(PIECE))))
    every = lambda x: F.array_distinct(F.flatten(F.array(cut(x), *[F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - (n - 1), F.lit(1))), lambda i, n=n: F.substring(x, i, F.lit(n))) for n in range(1, PIECE)])))
    held = long.select("_sk", *by, F.explode(every(F.col("_sk"))).alias("_p"))
    often = held.groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("_n"))
    asked = short.select("_k", *by, F.explode(F.when(F.length("_k") < PIECE, F.array("_k")).otherwise(cut(F.col("_k")))).alias("_p"))
    # A piece that no longer name has, has no row here: its short name is held by none, and no piece of it is asked for.
    met = asked.join(often, [*by, "_p"], "left").groupBy("_k", *by).agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_p")).alias("_r")).where("_r.n > 0").select("_k", *by, F.col("_r._p").alias("_p"))
    return met.join(held, [*by, "_p"]).where(F.col("_sk").contains(F.col("_k"))).select("_k", *by).distinct()


def agency_totals(total: DataFrame, ledger_total: DataFrame, goal: str = "delta ledger") -> DataFrame:
    """Findings where the total of the summary table isn't the agency's in the ledger: both ``(change, before)`` and ``doc_id`` of the
    document. A missing side is no finding."""
    both = total.select("doc_id", "change", "before").join(ledger_total.select("doc_id", F.col("change").alias("_c"), F.col("before").alias("_b")), "doc_id")
    off = F.filter(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).cast("double").alias("mine"), F.col(t).cast("double").alias("theirs")) for m, t in (("change", "_c"), ("before", "_b"))]), lambda d: d["mine"].isNotNull() & ~same(d["mine"], d["theirs"]))
    return union_findings(both.select("doc_id", F.explode(off).alias("d")).select(*finding(goal, "error", doc_id=F.col("doc_id"), item=F.col("d.m"), message=F.lit("total differs from the agency's"), left=F.col("d.mine"), right=F.col("d.theirs"))))


def unplanned(headlines: Column, change: Column) -> Column:
    """Whether a ledger row is not touched in this round: it has no headlines and no change."""
    return (F.coalesce(F.size(headlines), F.lit(0)) <= 0) & same(change.cast("double"), F.lit(0.0))


def pieces(headlines: Column) -> Column:
    """The single amounts of a ledger row ``array<struct<label, amount, details array<struct<label, amount>>>>``: those of a headline's
    details, or its own if no detail has one."""
    def of(h: Column) -> Column:
        details = F.filter(F.transform(F.coalesce(h["details"], F.array().cast("array<struct<label:string,amount:double>>")), lambda d: d["amount"]), lambda x: x.isNotNull())
        return F.when(F.size(details) > 0, details).when(h["amount"].isNotNull(), F.array(h["amount"])).otherwise(F.array().cast("array<double>"))

    return F.flatten(F.transform(headlines, of))


def differing_pieces(groups: DataFrame, ledger: DataFrame) -> DataFrame:
    """``key, amount, side``: amounts of a page's groups ``groups(key, amount)`` and of its ledger row ``ledger(key, amount)`` that the
    other side lacks, one for one and nearer than a half. Zeros and nulls are no pieces."""
    some = lambda df: df.select("key", F.col("amount").cast("double").alias("amount")).where("abs(amount) >= 0.5")
    return multiset_gap(some(groups), some(ledger), "amount")


def compare_form(form: DataFrame, projects: DataFrame | None, ledger: DataFrame | None, groups: DataFrame | None = None, goal: str = "delta form", depths: int | None = None) -> DataFrame:
    """Findings of a downloaded delta load sheet against narrative and ledger.

    Where narrative, ledger and groups have a ``doc_id``, each form is compared with its own document's; else they are all forms' alike.
    ``form(doc_id, row_no, depth, name, before, after, change)``; its first-level rows are projects. ``projects(project_no, name, before,
    after, change)``, ``ledger(row_no, name, before, change, unplanned)``, ``groups(project_no, group_no, title, before, after, change)``.
    A project that the other side lacks or whose amounts differ is an error; where the change differs from the narrative's, nothing
    else of that project is told; amounts before and after may differ where the form's is the ledger's (a page tells a part of it).
    Each group with a change must be a row of its project with that change, used once, one with all amounts alike first.
    Null amounts of the form count as 0. ``depths`` as in :func:`parents`.
    """
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    tree = parents(form.withColumn("pos", F.col("row_no")), ["doc_id"], depths=depths)
    tree = tree.select("doc_id", "pos", "depth", "name", *[zero(c).alias(c) for c in ("before", "after", "change")], F.coalesce(F.get("ancestors", F.lit(0)), "pos").alias("top"))
    tops = tree.where("depth = 1")
    who = {"doc_id": F.col("doc_id"), "project": F.col("name")}
    reports = []
    if ledger is not None:
        own = scope(ledger)
        rows = ledger.withColumn("_rid", F.struct("row_no", *own))
        led = rows.select(F.col("_rid").alias("_id"), F.col("change").alias("_lc"), F.col("before").alias("_lb"))
        tops = find_row(tops, rows, "name", "_rid", "name", "unplanned", own).withColumnRenamed("match", "_row").drop("tier").join(led, F.col("_row") == F.col("_id"), "left").drop("_id")
        reports.append(tops.where("_row is null").select(*finding(goal, "error", message=F.lit("not in the ledger"), **who)))
        for c, other in (("change", "_lc"), ("before", "_lb")):
            off = tops.where(F.col("_row").isNotNull() & ~same(F.col(c), zero(other)))
            reports.append(off.select(*finding(goal, "error", message=F.lit(f"{c} differs from the ledger"), left=F.col(c), right=F.col(other), **who)))
    if projects is not None:
        partial = F.col("_row").isNotNull() & same(F.col("before"), zero("_lb")) if ledger is not None else F.lit(False)
        own = scope(projects)
        pages = projects.groupBy(match_key(F.col("name")).alias("_k"), *own).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(F.col("project_no"), *[F.col(c).cast("double").alias(c) for c in ("before", "after", "change")])).alias("_p")).where("_n = 1")
        met = tops.withColumn("_k", match_key(F.col("name"))).join(pages, ["_k", *own], "left")
        reports.append(met.where("_p is null").select(*finding(goal, "error", message=F.lit("not in the narrative"), **who)))
        wrong = _neq(F.col("_p.change"), F.col("change"))
        reports.append(met.where(wrong).select(*finding(goal, "error", message=F.lit("change differs from the narrative"), left=F.col("change"), right=F.col("_p.change"), **who)))
        right = met.where(F.col("_p").isNotNull() & ~wrong)
        for c in ("before", "after"):
            reports.append(right.where(_neq(F.col(f"_p.{c}"), F.col(c)) & ~partial).select(*finding(goal, "error", message=F.lit(f"{c} differs from the narrative"), left=F.col(c), right=F.col(f"_p.{c}"), **who)))
        if groups is not None:
            page = right.select("doc_id", F.col("pos").alias("top"), "name", F.col("_p.project_no").alias("project_no"))
            shared = scope(groups)
            need = groups.where("abs(change) >= 0.5").select("project_no", *shared, F.col("group_no").alias("pos"), "title", *[F.col(c).cast("double").alias(c) for c in ("before", "after", "change")]).join(page, ["project_no", *shared])
            have = tree.where("pos <> top").select("doc_id", "top", "pos", "before", "after", "change")
            used = greedy_amounts(need, have, ["doc_id", "top"], "change", ["before", "after"])
            lost = need.join(used, ["doc_id", "top", "pos"], "left_anti")
            reports.append(lost.select(*finding(goal, "error", item=F.col("title"), message=F.lit("no row of the form has this change"), left=F.col("change"), **who)))
    return union_findings(*reports)


# Fixed value: words of projects that a ledger holds together with others.
BUNDLED_WORDS = ("총액배분", "재원배분", "경상운영비")


def bundled(projects: DataFrame) -> DataFrame:
    """``projects(name, …)`` with ``bundled``: the ledger has no row of their own for those that are handed over, have no number, were
    split or have parts (``handover, unnumbered, split, parts``, where there), or say so in their name."""
    flags = [F.coalesce(F.col(c), F.lit(False)) for c in ("handover", "unnumbered", "split") if c in projects.columns]
    flags += [F.coalesce(F.size("parts") > 0, F.lit(False))] if "parts" in projects.columns else []
    named = [F.coalesce(F.col("name").contains(w), F.lit(False)) for w in BUNDLED_WORDS]
    return projects.withColumn("bundled", reduce(lambda a, b: a | b, [*flags, *named]))


def compare_summary(projects: DataFrame, summary: DataFrame, goal: str = "delta summary") -> DataFrame:
    """Findings of pages against the summary table, one a page: by number if the name agrees, else by name, else by number;
    ``projects(doc_id, number, name, change, after, before, bundled)``, ``summary(doc_id, number, name, change, after, before)``; without a
    ``doc_id`` the summary is all documents' alike. Of summary rows that share number or name the least counts. A page whose
    change agrees and that is part of a bundle is a review."""
    own = scope(projects, summary)
    s = summary.select(F.col("number").alias("_no"), squeeze(F.col("name")).alias("_pk"), F.struct("change", "after", "before").alias("_s"), *own)
    p = projects.withColumns({"_pk": squeeze(F.col("name")), "_no": F.col("number")})
    by_number = s.where("_no is not null").groupBy("_no", *own).agg(F.min(F.struct(F.col("_pk").alias("_k"), "_s")).alias("_n"))
    by_name = s.groupBy("_pk", *own).agg(F.min("_s").alias("_m"))
    both = p.join(by_number, ["_no", *own], "left").join(by_name, ["_pk", *own], "left")
    row = F.when(F.col("_n._k") == F.col("_pk"), F.col("_n._s")).otherwise(F.coalesce("_m", F.col("_n._s")))
    both = both.withColumn("_row", row)
    who = {"doc_id": F.col("doc_id"), "project": F.col("name")}
    missing = both.where("_row is null").select(*finding(goal, "error", message=F.lit("not in the summary"), **who))
    diffs = F.filter(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).cast("double").alias("mine"), F.col(f"_row.{m}").cast("double").alias("theirs")) for m in ("change", "after", "before")]), lambda d: d["mine"].isNotNull() & d["theirs"].isNotNull() & ~same(d["mine"], d["theirs"]))
    off = both.where("_row is not null").withColumn("_d", diffs).where(F.size("_d") > 0).withColumn("_f", F.element_at("_d", 1))
    severity = F.when((F.col("_f.m") != "change") & F.col("bundled"), "review").otherwise("error")
    message = F.concat(F.array_join(F.transform("_d", lambda d: d["m"]), ", "), F.lit(" differ from the summary"))
    return union_findings(missing, off.select(*finding(goal, severity, message=message, left=F.col("_f.mine"), right=F.col("_f.theirs"), **who)))


def check_headlines(projects: DataFrame, items: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """``doc_id, project_no, part, request, base, witness, verdict`` of pages and their parts whose headline isn't their table's amount.

    ``projects(doc_id, project_no, request, base, parts array<struct<name, request, year_request>>)``,
    ``items(doc_id, project_no, pos, depth, amount)``. The first first-level row with a part's request is its witness: with one the
    table is wrong, else the headline.
    """
    page = projects.select("doc_id", "project_no", F.lit("").alias("part"), "request", "base")
    part = projects.select("doc_id", "project_no", F.explode("parts").alias("x")).select("doc_id", "project_no", F.col("x.name").alias("part"), F.col("x.request").alias("request"), F.coalesce("x.year_request", "x.request").alias("base"))
    off = page.unionByName(part).where(F.abs(F.col("request") - F.col("base")) > tolerance)
    near = F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("request")) + d))
    tops = items.where("depth = 1 and amount is not null").select("doc_id", "project_no", "pos", "amount", F.floor("amount").alias("_b"))
    met = off.withColumn("_b", near).join(tops, ["doc_id", "project_no", "_b"]).where(F.abs(F.col("request") - F.col("amount")) <= tolerance)
    first = met.groupBy("doc_id", "project_no", "part").agg(F.min("pos").alias("witness"))
    return off.join(first, ["doc_id", "project_no", "part"], "left").withColumn("verdict", F.when(F.col("witness").isNotNull(), "table wrong").otherwise("headline wrong"))


def amount_candidates(request: Column, year_request: Column, leaves: Column) -> Column:
    """The amounts that a page states, labelled; the sum of its leaves only if it is another one."""
    each = F.array(*[F.struct(F.lit(k).alias("label"), v.cast("double").alias("value")) for k, v in (("this year", year_request), ("headline", request), ("leaves", F.when(~F.coalesce(same(leaves, F.coalesce(year_request, request)), F.lit(False)), leaves)))])
    return F.filter(each, lambda c: c["value"].isNotNull())


def handed_over(items: DataFrame, projects: DataFrame, code: str = "620-02", tag: str = "재배정") -> DataFrame:
    """``projects`` with ``handover``: named so, or every leaf has the code; a page without leaves goes by its name."""
    leaves = items.where("leaf").groupBy("doc_id", "project_no").agg(F.bool_and(F.coalesce(F.col("code5") == code, F.lit(False))).alias("_all"))
    return projects.join(leaves, ["doc_id", "project_no"], "left").withColumn("handover", F.col("name").contains(tag) | F.coalesce("_all", F.lit(False))).drop("_all")
