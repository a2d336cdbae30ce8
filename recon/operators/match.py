"""Reconciliation joins: names by exact and loose keys, amounts by buckets, rows one to one. Two answers are no answer."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import match_key, squeeze, strip
from .tree import _joined


def unique_by(df: DataFrame, key: Column, name: str = "_key", by: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``df`` whose key no other row has, within ``by``; the columns as they are, and the key. Aggregated, so no window over a
    hot key."""
    keyed = df.withColumn(name, key)
    one = keyed.where(F.col(name).isNotNull()).groupBy(name, *by).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*df.columns)).alias("_r")).where("_n = 1")
    return one.select(name, *[F.col(f"_r.{c}").alias(c) for c in df.columns])


def scope(*tables: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> tuple[str, ...]:
    """Those of ``by`` that all tables have: rows are compared within a document, or with a table that is all documents' alike."""
    return tuple(c for c in by if all(c in t.columns for t in tables))


def deal(rows: DataFrame, key: str, parts: int | None) -> DataFrame:
    """``rows`` in ``parts`` partitions by a key; as they are where no number is given."""
    return rows.repartition(parts, key) if parts else rows


def _within(out: DataFrame, side: DataFrame, k: int, by: tuple[str, ...]) -> DataFrame:
    on = reduce(lambda p, q: p & q, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by], F.col("_own") == F.col(f"_k{k}"))
    return out.join(side, on, "left").drop("_own", f"_k{k}", *[f"_by_{c}" for c in by])


def name_join(left: DataFrame, right: DataFrame, name: str, right_id: str, right_name: str, tiers: list | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """``left`` with ``match`` (``right_id``) and ``tier``: the right row of the same name in the first tier that has just one.

    Tiers are functions of a name; by default as it is written, squeezed, and squeezed without status tags. ``by`` are columns of both
    sides within which names count, nulls being equal. Null names match nothing; repeated left rows are matched alike, a right row that
    is repeated is two answers; columns named ``match`` and ``tier`` are replaced; an empty side matches nothing.
    """
    out = left.drop("match", "tier")
    for k, tier in enumerate(tiers or [strip, squeeze, match_key]):
        side = unique_by(right.select(F.col(right_id).alias("_id"), F.col(right_name).alias("_name"), *by), tier(F.col("_name")), by=by)
        side = side.select(F.col("_key").alias(f"_k{k}"), F.col("_id").alias(f"_m{k}"), *[F.col(c).alias(f"_by_{c}") for c in by])
        out = _within(out.withColumn("_own", tier(F.col(name))), side, k, by)
    n = len(tiers or [0, 0, 0])
    tier = F.coalesce(*[F.when(F.col(f"_m{k}").isNotNull(), k + 1) for k in range(n)])
    return out.withColumn("match", F.coalesce(*[f"_m{k}" for k in range(n)])).withColumn("tier", tier).drop(*[f"_m{k}" for k in range(n)])


def find_row(left: DataFrame, rows: DataFrame, name: str, row_id: str, row_name: str, idle: str, by: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """``left`` with ``match`` and ``tier``: the ledger row of a name. Of rows that are written the same the first counts; else the only
    one that is the same once squeezed, or without status tags too; of several such rows only those count that aren't ``idle``.

    Each tier is one grouping by its key, so a name that very many rows have is one row. ``by`` as in :func:`name_join`. Both sides are
    dealt in ``parts`` partitions for each tier, if given, else in the session's. Null names match nothing; columns named ``match`` and
    ``tier`` are replaced.
    """
    r = rows.select(F.col(row_id).alias("_id"), F.col(row_name).alias("_name"), F.coalesce(idle, F.lit(False)).alias("_idle"), *by)
    # Name and scope are one key, in which nulls of the scope are equal, so that a table dealt by it needn't be dealt again for the join.
    whole = lambda name: F.when(name.isNotNull(), F.struct(name.alias("name"), *by))
    out = left.drop("match", "tier")
    for k, tier in enumerate((strip, squeeze, match_key)):
        n, busy = F.count(F.lit(1)), F.count_if(~F.col("_idle"))
        only = F.min("_id") if k == 0 else F.when(n == 1, F.min("_id")).when(busy == 1, F.min(F.when(~F.col("_idle"), F.col("_id"))))
        side = deal(r.withColumn(f"_k{k}", whole(tier(F.col("_name")))), f"_k{k}", parts).groupBy(f"_k{k}").agg(only.alias(f"_m{k}"))
        out = deal(out.withColumn("_own", whole(tier(F.col(name)))), "_own", parts).join(side, F.col("_own") == F.col(f"_k{k}"), "left").drop("_own", f"_k{k}")
    tier = F.coalesce(*[F.when(F.col(f"_m{k}").isNotNull(), k + 1) for k in range(3)])
    return out.withColumn("match", F.coalesce("_m0", "_m1", "_m2")).withColumn("tier", tier).drop("_m0", "_m1", "_m2")


def amount_join(left: DataFrame, right: DataFrame, left_id: str, left_amount: str, right_id: str, right_amount: str, tolerance: float = 1.0, by: tuple[str, ...] = ()) -> DataFrame:
    """``left_id, right_id`` where exactly one right row is within the tolerance of the left amount.

    An equi-join on buckets as wide as the tolerance: a left row goes to its bucket and both beside it. Null amounts match nothing;
    left ids tell rows apart, repeated right rows are several answers, hence none; ``by`` are columns of both sides within which amounts
    count, null in none; empty tables give none.
    """
    bucket = lambda x: F.floor(x / tolerance)
    a = left.where(F.col(left_amount).isNotNull()).select(F.col(left_id).alias("_l"), F.col(left_amount).cast("double").alias("_a"), *by)
    a = a.withColumn("_b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: bucket(F.col("_a")) + d)))
    b = right.where(F.col(right_amount).isNotNull()).select(F.col(right_id).alias("_r"), F.col(right_amount).cast("double").alias("_v"), *by)
    # A popular amount is one row here, however many have it.
    b = b.groupBy("_v", *by).agg(F.count(F.lit(1)).alias("_c"), F.min("_r").alias("_r")).withColumn("_b", bucket(F.col("_v")))
    near = a.join(b, ["_b", *by]).where(F.abs(F.col("_a") - F.col("_v")) <= tolerance)
    return near.groupBy("_l").agg(F.sum("_c").alias("_n"), F.min("_r").alias("_r")).where("_n = 1").select(F.col("_l").alias(left_id), F.col("_r").alias(right_id))


def coverage(left: DataFrame, right: DataFrame, key: str, left_value: str, right_value: str, tolerance: float = 0.5) -> DataFrame:
    """``key, left_value, right_value, status``: missing left or right, differs, or same. Both sides have a row a key at most."""
    both = left.select(F.col(key), F.col(left_value), F.lit(1).alias("_l")).join(right.select(F.col(key), F.col(right_value), F.lit(1).alias("_r")), key, "full_outer")
    status = F.when(F.col("_r").isNull(), "missing right").when(F.col("_l").isNull(), "missing left").when(F.abs(F.col(left_value) - F.col(right_value)) < tolerance, "same").otherwise("differs")
    return both.withColumn("status", status).drop("_l", "_r")


def nearest_candidate(candidates: Column, other: Column, tolerance: float = 1.0) -> Column:
    """``struct(ok, label, value)`` of the candidate ``struct(label, value)`` nearest to a value; null if there is none."""
    ranked = F.array_sort(F.transform(F.filter(candidates, lambda c: c["value"].isNotNull()), lambda c, i: F.struct(F.abs(c["value"] - other).alias("gap"), i.alias("at"), c["label"].alias("label"), c["value"].alias("value"))))
    best = F.get(ranked, F.lit(0))
    return F.when(best.isNotNull() & other.isNotNull(), F.struct((best["gap"] <= tolerance).alias("ok"), best["label"].alias("label"), best["value"].alias("value")))


def diff_one_to_one(made: DataFrame, got: DataFrame, keys: list[str], code: str, amount: str | None = None, tolerance: float = 0.5) -> DataFrame:
    """Rows of one side that no row of the other answers, one for one: ``keys, code, side`` (and ``amount``).

    Rows answer each other if key and code are equal; a made row without a code then takes any row left with its key, the first codes
    first. Coded rows are matched first, so a row without a code never takes what a coded one needs. With ``amount`` rows also have to
    be nearer than the tolerance in it, and as many are paired as can be. Rows are counted, not numbered: a key that is repeated very
    often is one row. Nulls are equal to each other; an empty code is none; an empty side answers nothing.
    """
    none = F.coalesce(code, F.lit("")) == ""
    by = [*keys, "_code", *([amount] if amount else [])]
    m, g = (df.select(*keys, F.when(~none, F.col(code)).alias("_code"), *([amount] if amount else [])) for df in (made, got))
    coded = _counted(m.where("_code is not null"), g, by)
    coded = _nearest(coded, [*keys, "_code"], amount, tolerance) if amount else _answered(coded)
    loose = coded.where("n_r > 0").select(*by, F.lit(0).cast("bigint").alias("n_l"), "n_r").unionByName(m.where("_code is null").groupBy(*by).agg(F.count(F.lit(1)).alias("n_l")).withColumn("n_r", F.lit(0).cast("bigint")))
    left = _nearest(loose, keys, amount, tolerance, "_code") if amount else _taken(loose, keys)
    lost = coded.where("n_l > 0").withColumn("n_r", F.lit(0).cast("bigint")).unionByName(left)
    each = _each(lost, by)
    return each.select(*keys, F.coalesce("_code", F.lit("")).alias(code), *([amount] if amount else []), F.when(F.col("side") == "left", "made").otherwise("got").alias("side"))


def _counted(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """``by, n_l, n_r``: how often each row is on each side; nulls are equal."""
    both = left.select(*by, F.lit(1).alias("_s")).unionByName(right.select(*by, F.lit(0).alias("_s")))
    return both.groupBy(*by).agg(F.sum("_s").cast("bigint").alias("n_l"), F.sum(1 - F.col("_s")).cast("bigint").alias("n_r"))


def _answered(counted: DataFrame) -> DataFrame:
    """What equal rows leave of each side."""
    both = F.least("n_l", "n_r")
    return counted.withColumns({"n_l": F.col("n_l") - both, "n_r": F.col("n_r") - both}).where("n_l + n_r > 0")


def _taken(rows: DataFrame, keys: list[str]) -> DataFrame:
    """What is left when the left rows of each key take its right rows in the order of their codes."""
    w = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("n_r").over(w.orderBy(F.asc_nulls_first("_code")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = rows.withColumns({"_want": F.sum("n_l").over(w), "_have": F.sum("n_r").over(w), "_before": before})
    right = F.greatest(F.lit(0), F.least("n_r", F.col("_before") + F.col("n_r") - F.col("_want")))
    return at.withColumns({"n_l": F.when(F.col("n_l") > 0, F.greatest(F.lit(0), F.col("n_l") - F.col("_have"))).otherwise(0).cast("bigint"), "n_r": right.cast("bigint")}).drop("_want", "_have", "_before").where("n_l + n_r > 0")


def _each(counted: DataFrame, by: list[str]) -> DataFrame:
    """A row for each that is counted, with its side."""
    sides = F.explode(F.array(F.struct(F.lit("left").alias("side"), F.col("n_l").alias("n")), F.struct(F.lit("right").alias("side"), F.col("n_r").alias("n"))))
    rows = counted.select(*by, sides.alias("_x")).where("_x.n > 0")
    return rows.select(*by, F.col("_x.side").alias("side"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_x.n")))).drop("col")


def multiset_gap(left: DataFrame, right: DataFrame, amount: str | None = None, tolerance: float = 0.5) -> DataFrame:
    """Rows that one side has more often than the other: the columns, and ``side``.

    With ``amount`` rows are equal if their other columns are and their amounts nearer than the tolerance, one for one, and as many are
    paired as can be. Nulls equal nothing but nulls; rows are counted, so that one repeated very often is one row.
    """
    if not amount:
        return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
    keys = [c for c in left.columns if c != amount]
    return _each(_nearest(_counted(left, right, [*keys, amount]), keys, amount, tolerance), left.columns)


#: Tolerances in a cell of amounts, within which runs of neighbours are told by one window.
CELL = 1024


def _nearest(counted: DataFrame, keys: list[str], amount: str, tolerance: float, label: str | None = None) -> DataFrame:
    """``counted(keys, amount, n_l, n_r)``, and a ``label`` of rows where there is one, without the pairs of a greatest matching of left
    and right rows whose amounts are nearer than ``tolerance``.

    The amounts of a key are a line, on which the least row of one side and the least of the other are paired if they are near, else the
    lesser one is left: that pairs as many as any matching can. Where two neighbours are not near nothing pairs across, so a key is cut
    there into runs; a run with one amount or of one side needs no walk.
    """
    runs = _runs(counted, keys, amount, tolerance).where(f"`{amount}` is not null")
    per = [*keys, "_run"]
    size = runs.groupBy(*per).agg((F.count_distinct(amount) if label is None else F.count(F.lit(1))).alias("_n"), F.sum("n_l").alias("_l"), F.sum("n_r").alias("_r"))
    known = _joined(runs, size, per)
    plain, walk = (known.where(c).drop("_n", "_l", "_r") for c in ("_n = 1 or _l = 0 or _r = 0", "not (_n = 1 or _l = 0 or _r = 0)"))
    order = [amount, *([label] if label else [])]
    columns = [f for f in counted.schema if f.name not in ("n_l", "n_r")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in columns), "n_l bigint", "n_r bigint"])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order; those that wait for a partner are all of one side."""
        last, waiting, where = None, deque(), 0
        for b in batches:
            out: list[tuple] = []
            rows = list(zip(*(b.column(f.name).to_pylist() for f in columns)))
            at = [f.name for f in columns].index(amount)
            for row, key, n_l, n_r in zip(rows, zip(*(b.column(k).to_pylist() for k in per)), b.column("n_l").to_pylist(), b.column("n_r").to_pylist()):
                if key != last:
                    out += [(*r, *((n, 0) if where == 0 else (0, n))) for r, n in waiting]
                    last, waiting = key, deque()
                while waiting and float(row[at]) - float(waiting[0][0][at]) >= tolerance:
                    r, n = waiting.popleft()
                    out.append((*r, *((n, 0) if where == 0 else (0, n))))
                here = [n_l, n_r]
                while waiting and here[1 - where]:
                    r, n = waiting.popleft()
                    pairs = min(n, here[1 - where])
                    here[1 - where] -= pairs
                    if n > pairs:
                        waiting.appendleft((r, n - pairs))
                pairs = min(here)
                here = [here[0] - pairs, here[1] - pairs]
                for side in (0, 1):
                    if here[side]:
                        where = side if not waiting else where
                        waiting.append((row, here[side]))
            yield _batch(out, b, columns)
        if waiting:
            yield _batch([(*r, *((n, 0) if where == 0 else (0, n))) for r, n in waiting], b, columns)

    walked = walk.repartition(*per).sortWithinPartitions(*per, *order).mapInArrow(pair, schema)
    empty = _answered(counted.where(F.col(amount).isNull()))
    names = [f.name for f in columns]
    return _answered(plain.select(*names, "n_l", "n_r")).unionByName(walked).unionByName(empty.select(*names, "n_l", "n_r"))


def _batch(rows: list[tuple], like: pa.RecordBatch, columns: list) -> pa.RecordBatch:
    kinds = [like.schema.field(f.name).type for f in columns] + [pa.int64()] * 2
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [*(f.name for f in columns), "n_l", "n_r"])


def _runs(rows: DataFrame, keys: list[str], amount: str, tolerance: float) -> DataFrame:
    """``rows`` with ``_run``: a number for the neighbours on a key's line that are nearer than the tolerance, one after the other.

    Gaps are counted within cells of amounts, then between the cells of a key, which are few; so no window holds a key with many amounts.
    """
    x = rows.withColumns({"_a": F.col(amount).cast("double"), "_cell": F.floor(F.col(amount).cast("double") / (tolerance * CELL))})
    inner = Window.partitionBy(*keys, "_cell").orderBy("_a")
    x = x.withColumn("_gap", F.coalesce((F.col("_a") - F.lag("_a").over(inner) >= tolerance).cast("int"), F.lit(0)))
    x = x.withColumn("_inner", F.sum("_gap").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    cells = x.groupBy(*keys, "_cell").agg(F.min("_a").alias("_lo"), F.max("_a").alias("_hi"), F.max("_inner").alias("_gaps"))
    outer = Window.partitionBy(*keys).orderBy("_cell")
    step = F.coalesce((F.col("_lo") - F.lag("_hi").over(outer) >= tolerance).cast("int"), F.lit(0)) + F.coalesce(F.lag("_gaps").over(outer), F.lit(0))
    cells = cells.withColumn("_step", step).withColumn("_base", F.sum("_step").over(outer.rowsBetween(Window.unboundedPreceding, 0))).select(*keys, "_cell", "_base")
    return _joined(x, cells, [*keys, "_cell"]).withColumn("_run", F.col("_base") + F.col("_inner")).drop("_a", "_cell", "_gap", "_inner", "_base")


def families(one: DataFrame, two: DataFrame, keys: list[str], amount: str, tolerance: float = 1.0) -> DataFrame:
    """Rows of two forms that belong together and differ: same ``path`` above, as many siblings, a name that is unique on both sides.

    Both have ``keys, path (array), name_key`` and the amount.
    """
    def side(df: DataFrame, to: str) -> DataFrame:
        n = df.groupBy(*keys, "path").agg(F.count(F.lit(1)).alias("_size"))
        one_ = df.groupBy(*keys, "path", "name_key").agg(F.count(F.lit(1)).alias("_same"), F.first(amount).alias(to)).where("_same = 1").drop("_same")
        return one_.join(n, [*keys, "path"]).withColumnRenamed("_size", f"_n_{to}")

    both = side(one, "amount_one").join(side(two, "amount_two"), [*keys, "path", "name_key"])
    return both.where((F.col("_n_amount_one") == F.col("_n_amount_two")) & (F.abs(F.col("amount_one") - F.col("amount_two")) > tolerance)).drop("_n_amount_one", "_n_amount_two")


def prefix_join(names: DataFrame, cards: DataFrame, name: str, card: str, order: str) -> DataFrame:
    """``names`` with ``card``: the card of the same key, else the first in order of which one key begins the other.

    Beginnings of every length are exploded on either side and joined by equality, so nothing is compared with everything.
    """
    n = names.select(F.col(name).alias("_n")).where("_n <> ''").distinct()
    c = cards.select(F.col(card).alias("_c"), F.col(order).alias("_o")).where("_c <> ''").groupBy("_c").agg(F.min("_o").alias("_o"))
    cut = lambda x: F.explode(F.transform(F.sequence(F.lit(1), F.length(x)), lambda k: F.substring(x, F.lit(1), k)))
    longer = n.select("_n", cut(F.col("_n")).alias("_c")).join(c, "_c").select("_n", "_c", "_o")
    shorter = c.select("_c", "_o", cut(F.col("_c")).alias("_n")).join(n, "_n").select("_n", "_c", "_o")
    rank = F.struct((F.col("_n") != F.col("_c")).alias("loose"), F.col("_o"), F.col("_c"))
    best = longer.union(shorter).groupBy("_n").agg(F.min(rank)["_c"].alias("card"))
    return names.join(best, names[name] == best["_n"], "left").drop("_n")


def explain_by_adjustment(findings: DataFrame, adjustments: DataFrame, key: str) -> DataFrame:
    """Findings whose gap is an adjustment of the same key, with either sign, become ``skipped``."""
    a = adjustments.where("adjust <> 0").groupBy(key).agg(F.collect_set(F.abs("adjust")).alias("_a"))
    hit = F.exists(F.coalesce("_a", F.array().cast("array<double>")), lambda x: F.abs(x - F.abs(F.col("gap"))) < 0.5)
    return findings.join(a, key, "left").withColumn("route", F.when(hit, "skipped").otherwise(F.col("route"))).drop("_a")


def contained_join(orphans: DataFrame, candidates: DataFrame, name: str, other: str, amount: str) -> DataFrame:
    """``name, other`` with equal rounded amounts, one name holding the other: what is left of a ledger after all keys failed.

    Names meet by their amount and three characters in a row that both have, the rarest ones of the shorter name first; a shorter
    name meets any name that holds it. So a very common amount, such as 0, isn't every name against every name. Null names and
    amounts match nothing, an empty name is in every name of its amount; repeated rows are one.
    """
    a = orphans.select(F.col(name).alias("_n"), F.bround(amount).alias("_a")).where("_n is not null and _a is not null").distinct()
    b = candidates.select(F.col(other).alias("_o"), F.bround(amount).alias("_a")).where("_o is not null and _a is not null").distinct()
    held = holders(a, b, "_n", "_o").union(holders(b.toDF("_n", "_a"), a.toDF("_o", "_a"), "_n", "_o").select("_o", "_n", "_a"))
    return held.distinct().select(F.col("_n").alias(name), F.col("_o").alias(other))


def holders(long: DataFrame, short: DataFrame, l: str, s: str, size: int = 3) -> DataFrame:
    """``l, s, _a`` where a name of ``long(l, _a)`` holds one of ``short(s, _a)``, both with one amount.

    Every piece of ``size`` characters of a long name is a row, counted by amount; a short name looks for the one of its own pieces
    that the fewest long names have. Names shorter than a piece look for themselves among the pieces of their length.
    """
    cut = lambda x, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - n + 1, F.lit(1))), lambda i: F.substring(x, i, n)))
    n = F.least(F.length(s), F.lit(size))
    kinds = F.array(*[F.lit(k) for k in range(1, size + 1)])
    pieces = long.select(l, "_a", F.explode(F.array_distinct(F.flatten(F.transform(kinds, lambda k: cut(F.col(l), k))))).alias("_p"))
    often = pieces.groupBy("_a", "_p").agg(F.count(F.lit(1)).alias("_c"))
    wanted = short.where(F.length(s) > 0).select(s, "_a", F.explode(cut(F.col(s), n)).alias("_p"))
    # A piece that no long name has rules the short name out: it is the rarest, with no row to meet.
    rare = wanted.join(often, ["_a", "_p"], "left").groupBy(s, "_a").agg(F.min(F.struct(F.coalesce("_c", F.lit(0)).alias("c"), F.col("_p").alias("p")))["p"].alias("_p"))
    met = pieces.join(rare, ["_a", "_p"]).where(F.col(l).contains(F.col(s))).select(l, s, "_a")
    return met.union(long.join(short.where(F.length(s) == 0), "_a").select(l, s, "_a"))


def greedy_amounts(need: DataFrame, have: DataFrame, keys: list[str], amount: str, exact: list[str]) -> DataFrame:
    """Pairs of rows with equal rounded amount, each used once: rows that agree in the ``exact`` columns too first, then by place.

    Both sides have ``keys, pos``, the amount and the exact columns; the result ``keys, pos, other``.
    """
    a = need.select(*keys, "pos", F.bround(amount).alias("_a"), F.struct(*exact).alias("_x"))
    b = have.select(*keys, F.col("pos").alias("other"), F.bround(amount).alias("_a"), F.struct(*exact).alias("_x"))

    def paired(x: DataFrame, y: DataFrame, by: list[str]) -> DataFrame:
        x = x.withColumn("_i", F.row_number().over(Window.partitionBy(*keys, *by).orderBy("pos")))
        y = y.withColumn("_i", F.row_number().over(Window.partitionBy(*keys, *by).orderBy("other")))
        return x.join(y.select(*keys, *by, "_i", "other"), [*keys, *by, "_i"]).select(*keys, "pos", "other")

    first = paired(a, b, ["_a", "_x"])
    a, b = a.join(first, [*keys, "pos"], "left_anti"), b.join(first, [*keys, "other"], "left_anti")
    return first.unionByName(paired(a, b, ["_a"]))
