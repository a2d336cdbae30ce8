"""Personal data in texts and cells: detected by rules and check digits, scored, masked, and verified to be gone.

Rules are rows of a table ``(kind, pattern, grp, confidence, validator)``; users add their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .tree import numbered

# Patterns by kind with the group that holds the value, and the confidence of a match.
RULES = [
    ("resident_id", r"(?<![0-9])[0-9]{6}[- ]?[1-8][0-9]{6}(?![0-9])", 0, 0.99, "resident_id"),
    ("birth_date", r"(?:생\s*년\s*월\s*일|출\s*생\s*일)\s*[:：]?\s*((?:19|20)?[0-9]{2}[.\-/ ]?[0-9]{2}[.\-/ ]?[0-9]{2}\.?)", 1, 0.92, ""),
    ("email", r"(?i)(?<![\w.])[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}(?![\w.])", 0, 0.98, ""),
    ("phone", r"(?<![0-9])(?:01[016789]|0(?:2|3[1-3]|4[1-4]|5[1-5]|6[1-4]|50[0-9]|70|80))[- .)]?[0-9]{3,4}[- .]?[0-9]{4}(?![0-9])", 0, 0.95, ""),
    ("phone", r"(?<![0-9])(?:15|16|18)[0-9]{2}[- .]?[0-9]{4}(?![0-9])", 0, 0.8, ""),
    ("card", r"(?<![0-9])(?:[0-9][ -]?){15,16}(?![0-9])", 0, 0.75, "card"),
    ("account", r"(?:계\s*좌\s*번\s*호|통\s*장\s*번\s*호|계\s*좌)\s*[:：]?\s*((?:[0-9]{2,6}[- ]?){2,4}[0-9]{2,6})", 1, 0.9, ""),
    ("ip", r"(?<![0-9])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9])", 0, 0.9, ""),
    ("passport", r"(?i)(?:여\s*권\s*번\s*호|passport\s*(?:no\.?|number)?)\s*[:：]?\s*([A-Z]{1,2}[0-9]{7,8})", 1, 0.9, ""),
    ("licence", r"(?<![\w-])(?:[0-9]{2}|[가-힣]{2})[- ][0-9]{2}[- ][0-9]{6}[- ][0-9]{2}(?![\w-])", 0, 0.9, ""),
    ("business_id", r"(?<![0-9])[0-9]{3}[- ][0-9]{2}[- ][0-9]{5}(?![0-9])", 0, 0.9, "business_id"),
    ("address", r"(?:[가-힣]+(?:특별시|광역시|특별자치시|도)\s*)?[가-힣]+(?:시|군|구)\s+[가-힣0-9·.-]+(?:로|길|동|읍|면|리)\s*[0-9]+(?:-[0-9]+)?", 0, 0.72, ""),
    ("name", r"(?:성\s*명|이\s*름|신\s*청\s*인|담\s*당\s*자|대\s*표\s*자|예\s*금\s*주)\s*[:：]?\s*([가-힣]{2,6})", 1, 0.78, "name"),
]
# Surnames, words of column headers, and weights of check digits.
SURNAMES = "김이박최정강조윤장임한오서신권황안송전홍유고문양손배백허남심노하곽성차주우구민진지엄채원천방공현함변염여추도소석선설마길연위표명기반왕금옥육인맹제모탁국어은편용"
COMPOUND_SURNAMES = ("남궁", "황보", "제갈", "사공", "선우", "서문", "독고", "동방", "망절", "소봉", "어금", "장곡", "즙문", "강전")
HEADER_WORDS = {
    "name": ("성명", "성함", "이름", "예금주", "신청인", "담당자", "대표자", "참가자", "참석자", "교육생", "수강생", "직원명", "교직원명", "name"), "resident_id": ("주민등록번호", "주민번호", "외국인등록번호"), "birth_date": ("생년월일", "출생일"),
    "account": ("계좌번호", "통장번호", "입금계좌", "지급계좌"), "phone": ("전화번호", "연락처", "휴대전화", "휴대폰", "핸드폰", "모바일", "내선번호", "phone"), "email": ("이메일", "전자우편", "메일주소", "email"), "card": ("카드번호",), "ip": ("IP주소", "아이피주소"),
    "address": ("주소", "거주지", "소재지"), "passport": ("여권번호",), "licence": ("운전면허번호", "면허번호"), "business_id": ("사업자등록번호", "사업자번호"),
}
RESIDENT_WEIGHTS, BUSINESS_WEIGHTS = (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5), (1, 3, 7, 1, 3, 7, 1, 3, 5)


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def value_key(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, r"(?U)\s+", ""))


def _digit(x: Column, i: int) -> Column:
    return F.substring(x, i + 1, 1).try_cast("int")


def luhn_ok(x: Column) -> Column:
    d = digits(x)
    return F.length(d).isin(15, 16) & F.call_function("luhn_check", d)


def resident_id_ok(x: Column) -> Column:
    d = digits(x)
    total = reduce(lambda a, b: a + b, [_digit(d, i) * w for i, w in enumerate(RESIDENT_WEIGHTS)])
    return F.coalesce((F.length(d) == 13) & ((11 - total % 11) % 10 == _digit(d, 12)), F.lit(False))


def business_id_ok(x: Column) -> Column:
    d = digits(x)
    total = reduce(lambda a, b: a + b, [_digit(d, i) * w for i, w in enumerate(BUSINESS_WEIGHTS)]) + F.floor(_digit(d, 8) * 5 / 10)
    return F.coalesce((F.length(d) == 10) & ((10 - total % 10) % 10 == _digit(d, 9)), F.lit(False))


def name_like(x: Column, known_surname: bool = True) -> Column:
    compact = F.regexp_replace(x, r"(?U)\s+", "")
    ok = compact.rlike("^[가-힣]{2,6}$")
    return ok & compact.rlike(f"^(?:[{SURNAMES}]|{'|'.join(COMPOUND_SURNAMES)})") if known_surname else ok


def confidence(kind: Column, validator: Column, value: Column, text: Column, base: Column) -> Column:
    """The confidence of a match by its validator; null rejects it. Card-like numbers without a right check digit count where the text
    names a card; resident ids need a possible date."""
    d = digits(value)
    date_ok = _digit(F.substring(d, 3, 2), 0).isNotNull() & F.substring(d, 3, 2).try_cast("int").between(1, 12) & F.substring(d, 5, 2).try_cast("int").between(1, 31)
    return (F.when(validator == "resident_id", F.when((F.length(d) == 13) & date_ok, F.when(resident_id_ok(value), 0.99).otherwise(0.9)))
            .when(validator == "card", F.when(luhn_ok(value), 0.95).when(text.rlike(r"(?i)카\s*드|card"), 0.6))
            .when(validator == "business_id", F.when(business_id_ok(value), 0.9)).when(validator == "name", F.when(name_like(value), base)).otherwise(base))


def _hit(kind: str, base: float, validator: str, rule: int):
    def row(v: Column) -> Column:
        score = confidence(F.lit(kind), F.lit(validator), v, F.col("text"), F.lit(base)).cast("double")
        return F.struct(F.lit(kind).alias("kind"), v.alias("value"), score.alias("confidence"), F.lit(rule).alias("rule"))

    return row


def find(texts: DataFrame, kinds: list[str] | None = None, literals: list[str] | None = None, rules: list[tuple] | None = None) -> DataFrame:
    """``doc_id, location, kind, value, value_key, confidence``: each value of a kind once a location, by the first rule that finds it.

    ``kinds`` limits the rules; ``literals`` are values of one's own, found whatever their case and spacing. All rules are evaluated in
    one pass over the texts: a row's matches are one array, exploded once.
    """
    per_rule = []
    for k, (kind, pattern, group, base, validator) in enumerate(rules or RULES):
        if kinds and kind not in kinds:
            continue
        per_rule.append(F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(group)), _hit(kind, base, validator, k)))
    for word in literals or []:
        pattern = "(?i)" + r"\s*".join(rf"\x{{{ord(c):x}}}" for c in "".join(word.split()))
        per_rule.append(F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda v: F.struct(F.lit("custom").alias("kind"), v.alias("value"), F.lit(1.0).alias("confidence"), F.lit(1000).alias("rule"))))
    hits = texts.where("text is not null").select("doc_id", "location", F.explode(F.flatten(F.array(*per_rule))).alias("h")).select("doc_id", "location", "h.*").where("confidence is not null and value <> ''")
    hits = hits.withColumn("value_key", value_key(F.col("value")))
    return hits.groupBy("doc_id", "location", "kind", "value_key").agg(F.min(F.struct("rule", "value", "confidence")).alias("b")).select("doc_id", "location", "kind", "b.value", "value_key", "b.confidence")


def select_confident(hits: DataFrame, least: float = 0.75) -> DataFrame:
    """``hits`` with ``selected``: sure enough to be masked without a look; and ``low`` for the count of doubtful ones."""
    return hits.withColumn("selected", F.col("confidence") >= least).withColumn("low", F.col("confidence") < 0.7)


#: Documents that borders of ranges are taken from, and ranges of the coarse and of each fine level.
SAMPLED, COARSE = 4096, 16


def aliases(hits: DataFrame) -> DataFrame:
    """``kind, value_key, alias``: numbers of a kind's values by first appearance, over all documents at once.

    Values are numbered within a range of documents that they appear in first, after those of all ranges before it, so no task holds all
    values of a kind. Ranges of whole ids are given by their size; those of other ids lie between borders out of a sample of ``SAMPLED`` ids,
    whatever they begin with. Null documents come first; the ranges change no number.
    """
    first = hits.groupBy("kind", "value_key").agg(F.min(F.struct("doc_id", "location")).alias("_at"))
    doc = F.col("_at.doc_id")
    whole = hits.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    cells = [F.floor(doc / (1 << k)) for k in (24, 12)] if whole else ranges(first.select(doc.alias("x")), doc)
    return numbered(first, ["kind"], ["_at", "value_key"], cells, "_number").select("kind", "value_key", F.format_string("[%s_%04d]", "kind", "_number").alias("alias"))


def ranges(values: DataFrame, x: Column) -> list[Column]:
    """Two numbers that never fall as ``x`` rises, the coarser first, so that about as many of ``values(x)`` have each."""
    kind = values.schema["x"].dataType
    some = sorted(r.x for r in values.where("x is not null").distinct().orderBy(F.xxhash64("x")).limit(SAMPLED).collect())
    step = max(1, len(some) // (COARSE * COARSE))
    borders = some[step::step]
    parts = [borders[k:k + COARSE] for k in range(0, len(borders), COARSE)]
    listed = lambda xs: F.array(*[F.lit(v).cast(kind) for v in xs]) if xs else F.array().cast(ArrayType(kind))
    passed = lambda xs, v: F.size(F.filter(xs, lambda b: b <= v))
    coarse = passed(listed([p[0] for p in parts]), x)
    fine = F.coalesce(passed(F.get(F.array(listed([]), *map(listed, parts)), coarse), x), F.lit(0))
    return [coarse, fine]


def mask(texts: DataFrame, hits: DataFrame, mode: str = "alias") -> DataFrame:
    """``texts`` with their selected values replaced, the longest first, whatever their case and spacing.

    ``delete`` puts blocks, ``label`` the kind, ``alias`` the kind and a number that is the same in every document.
    """
    if mode not in ("delete", "label", "alias"):
        raise ValueError(f"unknown mode {mode}")
    h = hits.where("selected") if "selected" in hits.columns else hits
    h = h.join(aliases(h), ["kind", "value_key"]) if mode == "alias" else h.withColumn("alias", F.concat(F.lit("["), "kind", F.lit("]")) if mode == "label" else F.repeat(F.lit("■"), F.length("value")))
    each = h.groupBy("doc_id", "location").agg(F.array_sort(F.collect_list(F.struct((-F.length("value")).alias("n"), "value_key", "alias"))).alias("_h"))
    chars = lambda v: F.transform(F.sequence(F.lit(1), F.length(v)), lambda i: F.substring(v, i, F.lit(1)))
    quoted = lambda v: F.concat(F.lit("(?i)"), F.array_join(F.transform(chars(v), lambda c: F.regexp_replace(c, r"([^\p{L}\p{N}])", r"\\$1")), r"\s*"))
    done = F.aggregate("_h", F.col("text"), lambda t, x: F.regexp_replace(t, quoted(x["value_key"]), x["alias"]))
    return texts.join(each, ["doc_id", "location"], "left").withColumn("text", F.when(F.col("_h").isNull(), F.col("text")).otherwise(done)).drop("_h")


def residual(masked: DataFrame, hits: DataFrame) -> DataFrame:
    """Values that a masked text still holds; anything here means that the output must not be used."""
    m = masked.select("doc_id", "location", value_key(F.col("text")).alias("_t"))
    return hits.join(m, ["doc_id", "location"]).where(F.col("_t").contains(F.col("value_key"))).drop("_t")


def header_kinds(value: Column) -> Column:
    """The kinds that a header's words name."""
    compact = F.regexp_replace(value, r"(?U)[\s:：()\[\]·._-]+", "")
    named = [F.when(reduce(lambda a, b: a | b, [F.contains(compact, F.lit(w)) for w in ws]), F.lit(k)) for k, ws in HEADER_WORDS.items()]
    return F.filter(F.array(*named), lambda k: k.isNotNull())


def under_headers(cells: DataFrame) -> DataFrame:
    """``cells`` with ``kinds`` of the nearest header above each cell in its column."""
    kinds = header_kinds(F.col("value"))
    w = Window.partitionBy("doc_id", "sheet", "col_no").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    named = cells.withColumn("_own", F.when(F.size(kinds) > 0, kinds))
    return named.withColumn("kinds", F.last("_own", ignorenulls=True).over(w)).where("_own is null and kinds is not null").drop("_own")


def name_columns(cells: DataFrame, least: int = 5, share: float = 0.65, distinct: int = 4) -> DataFrame:
    """``doc_id, sheet, col_no`` of columns whose values are mostly names."""
    like = name_like(F.col("value"))
    return cells.where("value is not null and value <> ''").groupBy("doc_id", "sheet", "col_no").agg(F.count(F.lit(1)).alias("n"), F.avg(like.cast("double")).alias("share"), F.count_distinct(F.when(like, F.col("value"))).alias("distinct_names")).where((F.col("n") >= least) & (F.col("share") >= share) & (F.col("distinct_names") >= distinct))


def best_evidence(hits: DataFrame, source: str = "source") -> DataFrame:
    """Of values found in a text layer and by recognition one row each: the surer, and of equally sure ones the text layer's."""
    w = Window.partitionBy("doc_id", "location", "kind", "value_key").orderBy(F.desc("confidence"), F.col(source) == "ocr")
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def report(hits: DataFrame) -> DataFrame:
    """``doc_id, found, selected, low`` of each document."""
    return hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("found"), F.count_if("selected").alias("selected"), F.count_if("low").alias("low"))
