"""Discovery on cell tables ``cells(doc_id, sheet, row_no, col_no, value_str, value_num, value_ts, is_formula, cached_null)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import header_key, strip
from ..functions.numbers import coerced

SHEET = ["doc_id", "sheet"]
# Words of headers whose columns hold identifiers, and names that mean one column.
IDENTIFIER_WORDS = ("번호", "코드", "전화", "휴대폰", "계좌", "주민", "우편")
ALIASES = {
    "이름": ("성명", "성함", "담당자", "직원명", "교사명", "고객명", "유아명", "학부모명"),
    "금액": ("합계", "비용", "가격", "매출액", "예산액", "지출액", "지급액", "지급금액", "강의비", "강의료", "수당"),
    "날짜": ("일자", "등록일", "처리일", "지급일", "시작일", "종료일"),
    "부서": ("소속", "팀", "부서명", "소속부서", "소속기관"),
    "상태": ("진행상태", "처리상태", "결과", "완료여부"),
    "코드": ("번호", "id", "식별자", "일련번호", "연번", "순번"),
    "수량": ("개수", "건수", "인원", "인원수", "유아수"),
}


def filled() -> Column:
    return F.coalesce(F.col("value_str") != "", F.lit(False)) | F.col("value_num").isNotNull() | F.col("value_ts").isNotNull()


def as_text() -> Column:
    return F.coalesce(F.col("value_str"), F.col("value_num").cast("string"), F.col("value_ts").cast("string"))


def numeric_text(value: Column, header: Column) -> Column:
    """Text that is a number, unless its header says that it is an identifier."""
    text = strip(value)
    return F.coalesce(text.rlike(r"^\(?[-+]?[0-9][0-9,]*(?:\.[0-9]+)?\)?(?:원|%|명|건|개)?$") & coerced(text).isNotNull() & ~header.rlike("|".join(IDENTIFIER_WORDS)), F.lit(False))


def column_profile(cells: DataFrame, headers: DataFrame, sample: int | None = None, cap: int | None = None) -> DataFrame:
    """``doc_id, sheet, header, kind, nonempty, unique`` of each column below its header: date or number from 80 % on, else text.
    ``headers(doc_id, sheet, header_row, col_no, header)``; all rows count, or the first ``sample``, and all distinct values, or up to ``cap`` of them."""
    rows = cells.join(headers, [*SHEET, "col_no"]).where((F.col("row_no") > F.col("header_row")) & filled())
    rows = rows if sample is None else rows.where(F.col("row_no") <= F.col("header_row") + sample)
    n = F.count(F.lit(1))
    numbers = F.count_if(F.col("value_num").isNotNull() | numeric_text(F.col("value_str"), F.col("header")))
    kind = F.when(F.count_if(F.col("value_ts").isNotNull()) / n >= 0.8, "date").when(numbers / n >= 0.8, "number").otherwise("text")
    return rows.groupBy(*SHEET, "header").agg(kind.alias("kind"), n.alias("nonempty"), (F.count_distinct(as_text()) if cap is None else F.least(F.count_distinct(as_text()), F.lit(cap))).alias("unique"))


def formula_status(cells: DataFrame, limit: int | None = None) -> DataFrame:
    """``doc_id, sheet, formulas, uncached`` of all cells of a sheet, or of its first ``limit``, row by row."""
    if limit is not None:
        w = Window.partitionBy(*SHEET).orderBy("row_no", "col_no")
        cells = cells.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit)
    return cells.groupBy(*SHEET).agg(F.count_if("is_formula").alias("formulas"), F.count_if(F.col("is_formula") & F.col("cached_null")).alias("uncached"))


def row_scores(cells: DataFrame, rows: int | None = 20) -> DataFrame:
    """``doc_id, sheet, row_no, filled, score``, and ``score_plain`` without the penalty of long texts, of the first rows (a header is among them), or of all."""
    text = F.coalesce(F.col("value_str") != "", F.lit(False))
    one = (cells if rows is None else cells.where(F.col("row_no") <= rows)).groupBy(*SHEET, "row_no").agg(F.count_if(filled()).alias("filled"), F.count_distinct(F.when(filled(), strip(as_text()))).alias("_u"), F.count_if(text).alias("_t"), F.count_if(text & (F.length("value_str") > 40)).alias("_long"))
    w = Window.partitionBy(*SHEET).orderBy("row_no")
    following = F.when(F.lead("row_no").over(w) == F.col("row_no") + 1, F.lead("filled").over(w)).otherwise(0)
    plain = F.col("filled") + 0.25 * F.col("_u") + 0.25 * F.col("_t") + 0.2 * F.least(following, F.col("filled"))
    return one.withColumn("score_plain", F.when(F.col("filled") >= 2, plain).otherwise(-1.0)).withColumn("score", F.when(F.col("filled") >= 2, plain - 1.5 * F.col("_long"))).select(*SHEET, "row_no", "filled", "score", "score_plain")


def header_row(cells: DataFrame) -> DataFrame:
    """``doc_id, sheet, header_row``: the row among the first 20 that looks most like a header; 1 if none has two cells."""
    best = row_scores(cells).groupBy(*SHEET).agg(F.max(F.when(F.col("score") > -1, F.struct("score", (-F.col("row_no")).alias("r"))))["r"].alias("_r"))
    return best.select(*SHEET, F.coalesce(-F.col("_r"), F.lit(1)).alias("header_row"))


def table_regions(cells: DataFrame, rows: int | None = None) -> DataFrame:
    """``doc_id, sheet, header_row, end_row`` of each table of a sheet: a likely header after a blank row begins one, in the whole sheet or its first ``rows``."""
    scored, w = row_scores(cells, rows), Window.partitionBy(*SHEET).orderBy("row_no")
    after_blank = (F.coalesce(F.lag("row_no").over(w), F.lit(0)) < F.col("row_no") - 1) | (F.lag("filled").over(w) == 0) | F.lag("row_no").over(w).isNull()
    likely = scored.withColumn("_after", after_blank).withColumn("_ok", F.col("score_plain") >= 3)
    first = F.sum(F.col("_ok").cast("int")).over(w) == 1
    starts = likely.withColumn("_first", first).where(F.col("_ok") & (F.col("_after") | F.col("_first"))).select(*SHEET, "row_no")
    starts = starts.union(header_row(cells).select(*SHEET, F.col("header_row").alias("row_no"))).distinct()
    last = cells.groupBy(*SHEET).agg(F.max("row_no").alias("_last"))
    kept = starts.withColumn("_prev", F.lag("row_no").over(w)).where("_prev is null or row_no - _prev > 2")
    return kept.withColumn("_next", F.lead("row_no").over(w)).join(last, SHEET).select(*SHEET, F.col("row_no").alias("header_row"), F.coalesce(F.col("_next") - 1, "_last").alias("end_row"))


def unique_headers(headers: DataFrame) -> DataFrame:
    """Header names with ``_2``, ``_3`` after those that an earlier column has."""
    w = Window.partitionBy(*SHEET, strip(F.col("header"))).orderBy("col_no")
    n = F.row_number().over(w)
    return headers.withColumn("_n", n).withColumn("header", F.when(F.col("_n") == 1, strip(F.col("header"))).otherwise(F.concat(strip(F.col("header")), F.lit("_"), F.col("_n").cast("string")))).drop("_n")


def family(key: Column) -> Column:
    """The family of names that a cleaned header belongs to; null for none."""
    out = F.lit(None).cast("string")
    for name, others in ALIASES.items():
        out = F.when(key.isin(name, *others), name).otherwise(out)
    return out


def match_columns(wanted: DataFrame, columns: DataFrame, threshold: float = 0.55, margin: float = 0.08) -> DataFrame:
    """``wanted(name)`` with the best of ``columns(column)`` by ``score``, and whether the runner-up is as near.

    The score is one less the edit distance over the longer name, .92 or more if one name holds the other, .88 or more if both are of
    one family of names, 1 if they are alike once cleaned. Where both tables say a ``kind``, it counts .05 more for the same one and
    .12 less for another, 1 at most; a null kind is not asked for. Nothing is broadcast but what Spark finds small; both are made
    distinct first. Null names and names without a letter or digit match nothing.
    """
    kinds = "kind" in wanted.columns and "kind" in columns.columns
    bonus, penalty = (0.05, 0.12) if kinds else (0.0, 0.0)
    told = lambda df: df.select("*", F.col("kind").alias("_kind")) if kinds else df.withColumn("_kind", F.lit(None).cast("string"))
    a = told(wanted).select("name", header_key(F.col("name")).alias("_a"), F.col("_kind").alias("_ka")).where("_a <> ''").distinct()
    b = told(columns).select("column", header_key(F.col("column")).alias("_b"), F.col("_kind").alias("_kb")).where("_b <> ''").distinct()
    least = threshold - bonus
    # An edit breaks two letter pairs at most, so a pair is left unless, of an odd number of letters, every second one is edited; then
    # the names begin and end alike, and above a threshold of a half they are short. Below it they share a letter. A name of one
    # letter meets all that hold it.
    letters = lambda x: F.array_distinct(F.filter(F.split(x, ""), lambda c: c != ""))
    tagged = lambda tag, xs: F.transform(xs, lambda c: F.concat(F.lit(tag), c))
    none = F.array().cast("array<string>")

    def keys(x: Column, one: str, held: str) -> Column:
        pairs = F.when(F.length(x) > 1, F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substring(x, i, F.lit(2)))).otherwise(F.array(x))
        ends = F.when(F.length(x) * (2 * least - 1) <= 1 + 1e-6, F.array(F.concat(F.substring(x, 1, 1), F.substring(x, -1, 1)))).otherwise(none) if least > 0.5 else letters(x)
        return F.explode(F.array_distinct(F.concat(tagged("pair", pairs), tagged("ends", ends), tagged(held, letters(x)), F.when(F.length(x) == 1, tagged(one, F.array(x))).otherwise(none))))

    # ``a`` looks up its one letter among those that ``b`` holds, and the other way round.
    with_family = lambda df, x, one, held: df.withColumn("_g", keys(F.col(x), one, held)).unionByName(df.withColumn("_g", F.concat(F.lit("family "), family(F.col(x)))).where("_g is not null"))
    left, right = with_family(a, "_a", "in b", "in a"), with_family(b, "_b", "in a", "in b")
    met = left.join(right, "_g").select("name", "_a", "_ka", "column", "_b", "_kb").distinct()
    near = 1 - F.levenshtein("_a", "_b") / F.greatest(F.length("_a"), F.length("_b"))
    score = F.when(F.col("_a") == F.col("_b"), 1.0).when(F.col("_a").contains(F.col("_b")) | F.col("_b").contains(F.col("_a")), F.greatest(F.lit(0.92), near)).otherwise(near)
    alike = F.coalesce(family(F.col("_a")) == family(F.col("_b")), F.lit(False))
    score = F.when(alike, F.greatest(score, F.lit(0.88))).otherwise(score)
    if kinds:
        score = F.least(F.lit(1.0), F.when(F.col("_ka").isNull(), score).when(F.col("_ka").eqNullSafe(F.col("_kb")), score + bonus).otherwise(score - penalty))
    scored = met.withColumn("score", score).where(F.col("score") >= threshold)
    w = Window.partitionBy("name").orderBy(F.desc("score"), "column")
    ranked = scored.withColumn("_n", F.row_number().over(w)).withColumn("_next", F.lead("score").over(w)).where("_n = 1")
    return ranked.select("name", "column", "score", (F.col("score") - F.coalesce("_next", F.lit(0.0)) < margin).alias("ambiguous"))
