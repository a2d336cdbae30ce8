"""Numbers as they are written, tolerances, and how amounts are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import strip


def _plain(x: Column) -> Column:
    return F.regexp_replace(x, ",", "").try_cast("double")


def signed_number(x: Column) -> Column:
    """``△1,000`` is -1000, ``2,376,941`` is 2376941; null for anything else."""
    x, pattern = strip(x), r"^([△▲-])?\s*([0-9,]+(?:\.[0-9]+)?)$"
    value = _plain(F.regexp_extract(x, pattern, 2))
    return F.when(x.rlike(pattern), F.when(F.regexp_extract(x, pattern, 1) != "", -value).otherwise(value))


def unit_number(x: Column) -> Column:
    """As :func:`signed_number` for values that end in the thousand-won unit, null for others."""
    return F.when(strip(x).rlike(r"^[△▲-]?\s*[0-9,]+\s*천원$"), signed_number(F.regexp_replace(strip(x), r"\s*천원$", "")))


def with_previous(x: Column) -> Column:
    """``2,376,941(0)`` as ``struct(now, previous)``; null for anything else."""
    pattern = r"^([△▲-]?\s*[0-9,]+)\s*\(\s*([△▲-]?\s*[0-9,]+)\s*\)$"
    x = strip(x)
    return F.when(x.rlike(pattern), F.struct(signed_number(F.regexp_extract(x, pattern, 1)).alias("now"), signed_number(F.regexp_extract(x, pattern, 2)).alias("previous")))


def coerced(x: Column) -> Column:
    """A number out of tolerant currency text: whatever isn't digit, point or minus is dropped; brackets around mean negative."""
    text = strip(x.cast("string"))
    value = F.regexp_replace(text, r"[^0-9.\-]", "").try_cast("double")
    return F.when(text.rlike(r"(?s)^\(.*\)$"), -value).otherwise(value)


def formula_ok(value: Column, written: Column) -> Column:
    """Whether a computed value is the written one: within a half, or within one if the computed one has a fraction. Nulls pass."""
    gap = F.abs(value - written)
    return F.coalesce(F.when(F.abs(value - F.bround(value)) < 1e-6, gap < 0.5).otherwise(gap < 1), F.lit(True))


def same(a: Column, b: Column) -> Column:
    """Equal amounts; null equals nothing."""
    return F.coalesce(F.abs(a - b) < 0.5, F.lit(False))


def same_or_both_null(a: Column, b: Column) -> Column:
    return (a.isNull() & b.isNull()) | same(a, b)


def money(x: Column) -> Column:
    """Thousands separated, rounded half to even; a dash for null."""
    return F.coalesce(F.format_number(F.bround(x), 0), F.lit("-"))


def signed(x: Column) -> Column:
    """Money with its sign: + or △."""
    return F.when(x > 0, F.concat(F.lit("+"), money(x))).when(x < 0, F.concat(F.lit("△"), money(-x))).otherwise(money(x))


def fiscal_year(name: Column) -> Column:
    """The year in a name, if no point or digit follows it."""
    return F.regexp_extract(name, r"(?<![0-9])(20[0-9]{2})(?![.0-9])", 1).try_cast("int")


def budget_round(name: Column) -> Column:
    """The round of a title: ``제2회`` or ``2회``, or 0 for the main budget."""
    n = F.regexp_extract(name, r"제?\s*([0-9]+)\s*회", 1).try_cast("int")
    return F.coalesce(n, F.when(name.contains("본예산"), 0))
