"""Name keys: how two spellings of a name are made alike before they are compared. All are native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# List markers such as "(1)", "2.", "가)", and words that tell a status, not a name.
MARKER = r"(?:\(?[0-9]+\)?[.)]|\(?[가-힣]\)?[.)])"
STATUS_WORDS = ("신규", "성립전", "목변경", "계속", "포함")


def strip(x: Column) -> Column:
    """Without white space at either end, of any kind, as opposed to ``trim``, which knows blanks only."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def without_markers(x: Column) -> Column:
    """A name without the list markers before it, however many there are."""
    return strip(F.regexp_replace(x, rf"(?U)^(?:\s*{MARKER})+\s*", ""))


def squeeze(x: Column) -> Column:
    """Without white space and middle dots."""
    return F.regexp_replace(x, r"(?U)[\s·․ㆍ∙・]", "")


def class_key(x: Column) -> Column:
    """As :func:`squeeze`, and without brackets, hyphens and underscores."""
    return F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)[\s·・ㆍ\-_()]", "")


def card_key(x: Column) -> Column:
    """Without a bracket at the end, and without white space, dots, hyphens, underscores and tildes."""
    return F.regexp_replace(strip(F.regexp_replace(strip(F.coalesce(x, F.lit(""))), r"(?U)\([^()]*\)\s*$", "")), r"(?U)[\s·․ㆍ∙・_\-~]", "")


def match_key(x: Column) -> Column:
    """Squeezed, and without the parts of brackets that tell a status; a bracket without parts goes."""
    def bracket(b: Column) -> Column:
        parts = F.transform(F.split(F.regexp_replace(b, r"^\(|\)$", ""), ","), strip)
        keep = F.filter(parts, lambda p: (p != "") & ~p.rlike("|".join(STATUS_WORDS)))
        return F.when(F.size(keep) > 0, F.concat(F.lit("("), F.array_join(keep, ","), F.lit(")"))).otherwise("")

    pattern = r"\([^()]*\)"
    between, brackets = F.split(x, pattern, -1), F.concat(F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), bracket), F.array(F.lit("")))
    return squeeze(F.array_join(F.zip_with(between, brackets, lambda a, b: F.concat(a, b)), ""))


def header_key(x: Column) -> Column:
    """A column's name as it is compared: letters, digits and Hangul alone, in lower case."""
    return F.lower(F.regexp_replace(F.coalesce(x, F.lit("")), r"[^0-9A-Za-z가-힣]", ""))


def override_key(code5: Column, parent: Column, name: Column) -> Column:
    """``code5|name``; without a code ``|parent > name``."""
    bare = F.when(F.coalesce(parent, F.lit("")) != "", F.concat_ws(" > ", parent, name)).otherwise(name)
    return F.concat(F.coalesce(code5, F.lit("")), F.lit("|"), F.when(F.coalesce(code5, F.lit("")) != "", name).otherwise(bare))
