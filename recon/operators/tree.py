"""Pre-order forests stored flat: rows have a place and a depth, edges are implied.

Where depths are few and known, windows over each document find all edges; else a stack over its rows in order, whatever their depths.
A document of any size can be cut into blocks, each with a stack of its own, and what is open where a block begins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Depths of narratives and of load sheets of the main budget.
DEPTHS = 6


def parents(items: DataFrame, keys: list[str], pos: str = "pos", depth: str = "depth", depths: int | None = None, block: int | None = None) -> DataFrame:
    """``items`` with ``parent`` (place of the nearest row before it that is less deep), ``parent_depth`` and ``ancestors`` (places,
    outermost first).

    With ``depths``, the greatest depth there is (a deeper row is an error), all of it is windows of one select: one exchange, one sort.
    Without, depths may be any numbers. ``block``: documents are cut wherever the place passes a multiple of it, so that none is too
    large for a task; places are whole numbers then. Columns of these names are replaced; a row without a place or depth has no parent;
    repeated places are in the order of their depths; null keys are equal; an empty table gives none.
    """
    items = items.drop("parent", "parent_depth", "ancestors")
    return _by_windows(items, keys, pos, depth, depths) if depths else _by_stacks(items, keys, pos, depth, block)


def _by_windows(items: DataFrame, keys: list[str], pos: str, depth: str, depths: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(pos, depth).rowsBetween(Window.unboundedPreceding, -1)
    marks = [F.last(F.when(F.col(depth) == k, F.col(pos)), ignorenulls=True).over(w).alias(f"_l{k}") for k in range(1, depths)]
    marked = items.select("*", *marks)
    deep = F.when(F.col(depth) > depths, F.raise_error(F.concat(F.lit(f"a row deeper than {depths}: "), F.col(depth).cast("string"))).cast("int")).otherwise(F.col(depth))

    def open_(k: int) -> Column:
        """The last row of depth k is still open: nothing less deep came after it."""
        newer = [F.coalesce(F.col(f"_l{k}") > F.col(f"_l{e}"), F.lit(True)) for e in range(1, k)]
        return F.when(reduce(lambda a, b: a & b, newer, ((deep if k == 1 else F.col(depth)) > k) & F.col(f"_l{k}").isNotNull()), F.struct(F.col(f"_l{k}").alias("at"), F.lit(k).alias("depth")))

    chain = F.filter(F.array(*[open_(k) for k in range(1, depths)]), lambda x: x.isNotNull())
    chained = marked.select(*[F.col(c) for c in items.columns], chain.alias("_chain"))
    nearest = F.get("_chain", F.size("_chain") - 1)
    return chained.select(*items.columns, nearest["at"].alias("parent"), nearest["depth"].alias("parent_depth"), F.transform("_chain", lambda x: x["at"]).alias("ancestors"))


def _by_stacks(items: DataFrame, keys: list[str], pos: str, depth: str, block: int | None) -> DataFrame:
    """Each task reads its rows in order, with a stack of the rows that are open; rows aren't gathered."""
    kind, names = items.schema[pos].dataType, items.columns
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    cell = F.floor(F.col(pos) / block) if block else F.lit(0)
    rows = items.withColumns({"_cell": cell.cast("bigint"), "_there": F.lit(True)})
    if block:
        opened = open_rows(items, keys, pos, depth, block)
        rows = rows.unionByName(opened.withColumn("_there", F.lit(False)), allowMissingColumns=True)

    def stack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at, deep = None, [], []
        for b in batches:
            own, deepness, up = [], [], []
            for *key, p, d in zip(*(b.column(c).to_pylist() for c in [*keys, "_cell", pos, depth])):
                if key != last:
                    last, at, deep = key, [], []
                if p is None or d is None:
                    own.append(None), deepness.append(None), up.append([])
                    continue
                while deep and deep[-1] >= d:
                    deep.pop(), at.pop()
                own.append(at[-1] if at else None), deepness.append(deep[-1] if deep else None), up.append(at[:])
                deep.append(d), at.append(p)
            one = pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *(pa.array(x, t) for x, t in ((own, b.schema.field(pos).type), (deepness, pa.int32()), (up, pa.list_(b.schema.field(pos).type))))], [*names, "parent", "parent_depth", "ancestors"])
            yield one.filter(b.column("_there"))

    dealt = rows.repartition(*keys, "_cell").sortWithinPartitions(*keys, "_cell", pos, depth)
    return dealt.mapInArrow(stack, f"{columns}, parent {kind.simpleString()}, parent_depth int, ancestors array<{kind.simpleString()}>")


def open_rows(items: DataFrame, keys: list[str], pos: str, depth: str, block: int) -> DataFrame:
    """``keys, _cell, pos, depth``: the rows of earlier blocks that are open where a block of ``block`` places begins.

    Of a block only the last row of each depth counts, and of those only the ones after all that are less deep; a stack over these, block
    after block, tells what is open. That is a row for each open depth and block, whatever the size of a document.
    """
    known = items.where(F.col(pos).isNotNull() & F.col(depth).isNotNull())
    ends = known.groupBy(*keys, F.floor(F.col(pos) / block).cast("bigint").alias("_cell"), F.col(depth).alias(depth)).agg(F.max(pos).alias(pos))
    schema = StructType([*(items.schema[k] for k in keys), StructField("_cell", ends.schema["_cell"].dataType), items.schema[pos], items.schema[depth]])

    def stack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, cell, at, deep = None, None, [], []
        for b in batches:
            out: list[tuple] = []
            for *key, c, p, d in zip(*(b.column(x).to_pylist() for x in [*keys, "_cell", pos, depth])):
                if key != last:
                    last, cell, at, deep = key, c, [], []
                if c != cell:
                    cell = c
                    out += [(*key, c, x, y) for x, y in zip(at, deep)]
                while deep and deep[-1] >= d:
                    deep.pop(), at.pop()
                deep.append(d), at.append(p)
            names = [*keys, "_cell", pos, depth]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], b.schema.field(n).type) for k, n in enumerate(names)], names)

    return ends.repartition(*keys).sortWithinPartitions(*keys, "_cell", pos).mapInArrow(stack, schema)


def child_sums(tree: DataFrame, keys: list[str], measure: str = "amount", pos: str = "pos", depth: str = "depth") -> DataFrame:
    """``keys, parent, children, direct``: number and sum of the direct children, one level down; null counts as 0."""
    down = tree.where(F.col("parent_depth") == F.col(depth) - 1)
    return down.groupBy(*keys, "parent").agg(F.count(F.lit(1)).alias("children"), F.sum(F.coalesce(measure, F.lit(0))).alias("direct"))


def subtree_sums(tree: DataFrame, keys: list[str], measure: str = "amount", leaf: str = "leaf") -> DataFrame:
    """``keys, pos, leaves, leaf_total`` of every row with leaves below it; rows are exploded by their ancestors."""
    rows = tree.where(F.col(leaf)).select(*keys, F.explode("ancestors").alias("pos"), F.col(measure).alias("_m"))
    return rows.groupBy(*keys, "pos").agg(F.count(F.lit(1)).alias("leaves"), F.sum(F.coalesce("_m", F.lit(0))).alias("leaf_total"))


def with_family(tree: DataFrame, keys: list[str], own: list[str], measure: str = "amount", depths: int | None = None) -> DataFrame:
    """A row for each place of ``tree``: the columns ``own``, its ``ancestors``, and ``children, direct, leaves, leaf_total`` of what is
    below it (null sums if nothing is).

    Every row goes to itself and to its ancestors, and one grouping by place adds up what arrived, without a join. With ``depths``, that of
    :func:`parents`, a document is in one partition already, and ancestors go along as plain columns: no exchange, no sort.
    """
    none = {c: F.lit(None).cast(tree.schema[c].dataType) for c in [*own, measure]}
    value = F.coalesce(F.col(measure), F.lit(0).cast(tree.schema[measure].dataType))
    chain = [F.get("ancestors", F.lit(k)).alias(f"_a{k}") for k in range(depths - 1)] if depths else [F.col("ancestors").alias("_a0")]
    up_ = [f"_a{k}" for k in range(len(chain))]
    direct = F.col("parent_depth") == F.col("depth") - 1
    self_ = F.struct(F.col("pos").alias("at"), F.lit(True).alias("self"), *[F.col(c).alias(f"o_{c}") for c in own], none[measure].alias("child"), none[measure].alias("leaf"))
    up = F.transform("ancestors", lambda a: F.struct(a.alias("at"), F.lit(False).alias("self"), *[none[c].alias(f"o_{c}") for c in own], F.when(direct & (a == F.col("parent")), value).alias("child"), F.when(F.col("leaf"), value).alias("leaf")))
    sent = tree.select(*keys, *chain, F.explode(F.concat(F.array(self_), up)).alias("x")).select(*keys, "x.*", *[F.when(F.col("x.self"), F.col(a)).alias(a) for a in up_])
    sums = [F.count("child").alias("children"), F.sum("child").alias("direct"), F.count("leaf").alias("leaves"), F.sum("leaf").alias("leaf_total")]
    met = sent.groupBy(*keys, F.col("at").alias("pos")).agg(*[F.max(f"o_{c}").alias(c) for c in own], *[F.max(a).alias(a) for a in up_], *sums)
    above = F.filter(F.array(*up_), lambda a: a.isNotNull()) if depths else F.col("_a0")
    return met.select(*keys, "pos", *own, above.alias("ancestors"), "children", "direct", "leaves", "leaf_total")


def deepest(rows: DataFrame, keys: list[str], own: list[str], bad: str) -> DataFrame:
    """``keys, pos`` and the columns ``own`` of the rows with nothing ``bad`` below them. Bad rows tell their ancestors, so that again
    one grouping does without a join."""
    none = {c: F.lit(None).cast(rows.schema[c].dataType) for c in own}
    self_ = F.struct(F.col("pos").alias("at"), F.lit(True).alias("self"), *[F.col(c).alias(f"o_{c}") for c in own])
    up = F.transform("ancestors", lambda a: F.struct(a.alias("at"), F.lit(False).alias("self"), *[none[c].alias(f"o_{c}") for c in own]))
    sent = rows.select(*keys, F.explode(F.concat(F.array(self_), F.when(F.col(bad), up).otherwise(F.slice(up, 1, 0)))).alias("x")).select(*keys, "x.*")
    met = sent.groupBy(*keys, F.col("at").alias("pos")).agg(*[F.max(f"o_{c}").alias(c) for c in own], F.bool_and("self").alias("_alone"))
    return met.where("_alone").select(*keys, "pos", *own)


def without_ancestors(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` that have none of ``other`` below them: the deepest ones. Both have ``keys, pos, ancestors``."""
    above = other.select(*keys, F.explode("ancestors").alias("pos")).distinct()
    return rows.join(above, [*keys, "pos"], "left_anti")


def look_ahead_leaf(keys: list[str], pos: str = "pos", depth: str = "depth") -> Column:
    """Whether the next row is not deeper."""
    return F.coalesce(F.lead(depth).over(Window.partitionBy(*keys).orderBy(pos)) <= F.col(depth), F.lit(True))


def sibling_ordinals(tree: DataFrame, keys: list[str], pos: str = "pos", depth: str = "depth") -> DataFrame:
    """``tree`` with ``ordinal``: its number among the rows of its level since the last less deep row."""
    w = Window.partitionBy(*keys, depth, F.coalesce("parent", F.lit(-1))).orderBy(pos)
    return tree.withColumn("ordinal", F.row_number().over(w))


def numbered(rows: DataFrame, by: list[str], order: list[Column | str], cells: list[Column] | None = None, name: str = "seq") -> DataFrame:
    """``rows`` with their number, from 1, within ``by`` in an order.

    ``cells`` are values that never fall along the order (the year and the month of a date, beginnings of a text), coarse ones first
    and each fixed by the next. With them rows are numbered within their finest cell and the rows of earlier cells are added level by
    level, so that no window holds a whole ``by``, however large. Nulls are values like others and come first.
    """
    if not cells:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    at = [f"_cell{k}" for k in range(len(cells))]
    placed = rows.withColumns(dict(zip(at, cells)))
    inner = placed.withColumn("_n", F.row_number().over(Window.partitionBy(*by, *at).orderBy(*order)))
    sizes = placed.groupBy(*by, *at).agg(F.count(F.lit(1)).alias("_size"))
    for k in range(len(at), 0, -1):
        level = sizes.groupBy(*by, *at[:k]).agg(F.sum("_size").alias("_size"))
        earlier = F.coalesce(F.sum("_size").over(Window.partitionBy(*by, *at[:k - 1]).orderBy(at[k - 1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        inner = _joined(inner, level.withColumn("_before", earlier).drop("_size"), [*by, *at[:k]]).withColumn("_n", F.col("_n") + F.col("_before")).drop("_before")
    return inner.withColumn(name, F.col("_n").cast("bigint")).drop("_n", *at)


def _joined(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the further columns of their row in ``other``; null keys are equal."""
    renamed = other.withColumnsRenamed({c: f"_j_{c}" for c in keys})
    return rows.join(renamed, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_j_{c}")) for c in keys])).drop(*[f"_j_{c}" for c in keys])


def sequence(items: DataFrame, card: str, order: list[str], cells: list[Column] | None = None) -> DataFrame:
    """``items`` with ``seq``, numbered within each card; ``cells`` as in :func:`numbered`, for cards of any size."""
    return numbered(items, [card], order, cells)


def paths(tree: DataFrame, keys: list[str], name: str = "name", pos: str = "pos") -> DataFrame:
    """``tree`` with ``path``: the names from the outermost ancestor to the row itself."""
    up = tree.select(*keys, F.col(pos).alias("_at"), F.col(name).alias("_n"))
    flat = tree.select(*keys, pos, F.explode("ancestors").alias("_at")).join(up, [*keys, "_at"])
    named = flat.groupBy(*keys, pos).agg(F.array_sort(F.collect_list(F.struct("_at", "_n"))).alias("_p"))
    joined = tree.join(named, [*keys, pos], "left")
    above = F.coalesce(F.transform("_p", lambda x: x["_n"]), F.array().cast("array<string>"))
    return joined.withColumn("path", F.concat(above, F.array(F.col(name)))).drop("_p")


def indent_depth(x: Column) -> Column:
    """The depth that two blanks a level give: half the indent, and one."""
    return F.floor((F.length(x) - F.length(F.ltrim(x))) / 2).cast("int") + 1


# Letters of outline marks, and how a mark is written at each level (n: number, k: letter); the last holds beyond.
LETTERS = "가나다라마바사아자차카타파하거너더러머버서어저처커터퍼허"
MARKS = ("{n}.", "{k}.", "{n})", "{k})", "({n})", "({k})")


def prefix(level: Column, ordinal: Column) -> Column:
    """The outline mark of a row by its level and its number among its siblings, from 1; letters start again after the last."""
    letter = F.substr(F.lit(LETTERS), F.pmod(ordinal - 1, F.lit(len(LETTERS))).cast("int") + 1, F.lit(1))
    shape = F.element_at(F.array(*map(F.lit, MARKS)), F.least(level.cast("int"), F.lit(len(MARKS))))
    return F.replace(F.replace(shape, F.lit("{n}"), ordinal.cast("string")), F.lit("{k}"), letter)
