import pytest
from pyspark.sql import functions as F

from recon.functions import formula, keys, numbers


def values(spark, texts, f):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in rows.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def test_main_formula(spark):
    texts = ["4,000,000원×2명×50%", "4,000천원×3회=9원", "3명×4,000원", "12원", "50%×4", "", None, "말씀", "1,000원 X 2 * 3"]
    assert values(spark, texts, formula.main_value) == pytest.approx([4000, 12000, None, 0.012, 0.002, None, None, None, 6])


def test_delta_formula(spark):
    texts = ["△740천원×7명×6/12개월", "14천원×3매×1시간×2명×3회-2천원", "(184,000,000원×3개원)-(9,926,670원×3개원)=", "5,000,000원×20개원×1회+4,000,000원×19개원×1회=", "100천원×1/0", None]
    assert values(spark, texts, formula.delta_value) == pytest.approx([-2590, 250, 522219.99, 176000, None, None])
    assert values(spark, ["0=", "00", "1,200", "2천원×3명=", "x"], formula.basis_value) == pytest.approx([0, 0, 1200, 6, None])


def test_terms_begin_only_where_one_is_complete(spark):
    texts = ["2천원×3 - 1천원", "2천원×-3", "-2천원×3", "(5천원×2)+(1천원×3)", "1천원-1천원-1천원", "3천원 + 2천원 × 2", "2천원-△1천원", "1천원-", "5천원×2개월-", "2천원 / 2", "1,000원\t×3"]
    assert values(spark, texts, formula.delta_value) == pytest.approx([5, -6, -6, 13, -1, 7, 3, 1, 10, 2, 3])


def test_names_and_their_formulas(spark):
    texts = ["여비 (5천원×2명)", "여비(5천원 x 2)  ", "(5×2)", "여비 (5천원)", "a (b) (3X2)", "a (b (3×2))", "a (3×2) b", "a (2)×3)", " 여비 ", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    name, tail = formula.name_and_formula(F.col("t"))
    assert [(r.n, r.f) for r in rows.select("i", name.alias("n"), tail.alias("f")).orderBy("i").collect()] == [
        ("여비", "5천원×2명"), ("여비", "5천원 x 2"), ("(5×2)", ""), ("여비 (5천원)", ""), ("a (b)", "3X2"), ("a (b (3×2))", ""), ("a (3×2) b", ""), ("a (2)×3)", ""), ("여비", ""), (None, "")]


def slow_delta(text):
    """Terms by a walk over characters, factors by a search in each."""
    import re

    body = re.sub(r"\s+", "", text.split("=")[0])
    terms, sign, at = [], 1, 0
    for i, c in enumerate(body):
        if c in "+-" and i and body[i - 1] not in "×xX*/(" and i + 1 < len(body) and (body[i + 1].isdigit() or body[i + 1] in "(△▲") and i > at - 1 and not (i == at and at):
            terms.append((sign, body[at:i]))
            sign, at = (1 if c == "+" else -1), i + 1
    total = 0.0
    for sign, term in [*terms, (sign, body[at:])]:
        product, n = 1.0, 0
        for factor in [f for f in re.split("[×xX*]", term) if f]:
            m = re.search(r"([△▲-]?)([0-9,]+(?:\.[0-9]+)?)(?:/([0-9,]+(?:\.[0-9]+)?))?(천원|원|%)?", factor)
            try:
                x = float(m[2].replace(",", "")) / float((m[3] or "1").replace(",", ""))
            except (TypeError, ValueError, ZeroDivisionError):
                return None
            if m[4] != "%" and n == 0 and m[4] is None:
                return None
            x *= 0.01 if m[4] == "%" else {"천원": 1000, "원": 1}[m[4]] if n == 0 else 1
            product, n = product * x * (-1 if m[1] else 1), n + 1
        if not n:
            return None
        total += sign * product / 1000
    return total


def test_the_fold_against_a_walk_over_random_texts(spark):
    import random

    rng = random.Random(4)
    parts = ["1", "25", "3.5", "1,000", "천원", "천원", "원", "%", "×", "×", "x", "+", "-", "△", "/", "(", ")", "명", " ", "회"]
    texts = ["2천원" + "".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(1500)]
    for text, got in zip(texts, values(spark, texts, formula.delta_value)):
        want = slow_delta(text)
        assert (got is None) == (want is None) and (got is None or got == pytest.approx(want)), text


def test_basis_texts(spark):
    rows = spark.createDataFrame([("", 0.0), ("50,000원×2회", 100.0), ("5×2=", 1.0), (None, None), (None, 3.0)], "f string, a double")
    assert [r.b for r in rows.select(formula.basis_text(F.col("f"), F.col("a")).alias("b")).collect()] == ["0=", "50,000원×2회=", "5×2=", "0=", ""]


def test_number_texts(spark):
    assert values(spark, ["△1,000", "2,376,941", " -5 ", "1.5", "12-3", "", None], numbers.signed_number) == [-1000, 2376941, -5, 1.5, None, None, None]
    assert values(spark, ["△2,590천원", "2,590", None], numbers.unit_number) == [-2590, None, None]
    assert [r and (r.now, r.previous) for r in values(spark, ["2,376,941(0)", "5(△3)", "5"], numbers.with_previous)] == [(2376941, 0), (5, -3), None]
    assert values(spark, ["1,000 원", "(500)", "abc12", "12-3", "-", "", None], numbers.coerced) == [1000, -500, 12, None, None, None, None]
    assert values(spark, ["2026년 본예산", "2025.12", "자료_2027", "x"], numbers.fiscal_year) == [2026, None, 2027, None]
    assert values(spark, ["제2회 추경", "본예산", "없음"], numbers.budget_round) == [2, 0, None]


def test_money(spark):
    rows = spark.createDataFrame([(2.5,), (-1234.5,), (0.0,), (None,)], "x double").select(numbers.money(F.col("x")).alias("m"), numbers.signed(F.col("x")).alias("s")).collect()
    assert [tuple(r) for r in rows] == [("2", "+2"), ("-1,234", "△1,234"), ("0", "0"), ("-", "-")]


def test_name_keys(spark):
    texts = ["(1) 가) 운영용품", " 2. 기본 ", "1)2)3) x", "가나", "（"]
    once = values(spark, texts, keys.without_markers)
    assert once[:4] == ["운영용품", "기본", "x", "가나"] and values(spark, once, keys.without_markers) == once
    assert values(spark, ["제지출금 등(신규)", "사업(성립전 포함, 재원배분)", "a (b)(계속) c"], keys.match_key) == ["제지출금등", "사업(재원배분)", "a(b)c"]
    assert values(spark, ["유-보-초 이음교육 운영(특교)", None], keys.card_key) == ["유보초이음교육운영", ""]
    assert values(spark, ["a·b (c)_d", None], keys.class_key) == ["abcd", ""]


def test_tolerances(spark):
    rows = spark.createDataFrame([(10.0, 10.4), (10.0, 10.6), (10.25, 11.2), (None, 1.0)], "a double, b double")
    assert [r.v for r in rows.select(numbers.formula_ok(F.col("a"), F.col("b")).alias("v")).collect()] == [True, False, True, True]
    assert [r.v for r in rows.select(numbers.same(F.col("a"), F.col("b")).alias("v")).collect()] == [True, False, False, False]
