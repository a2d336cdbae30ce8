import hashlib
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from recon.llm.pii import FIRST_DAY, LAST_DAY, SECRET, feistel_text, op7_pii_pseudonyms, pseudonymise, secret

KEY = "the key of these tests"
SCHEMA = "doc_id bigint, text string, found string, kind string"


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(d))) % 10 == 0


def slow_feistel(x, kind, key=KEY, rounds=8):
    left, right = x[:len(x) // 2], x[len(x) // 2:]

    def shifted(half, step, seen):
        h = hashlib.sha256("|".join([key, kind, str(len(x)), str(step), seen.lower()]).encode()).hexdigest()
        out = ""
        for i, c in enumerate(half):
            v = int(h[i % 31 * 2:i % 31 * 2 + 4], 16)
            for first, size in (("0", 10), ("a", 26), ("A", 26)):
                if first <= c <= chr(ord(first) + size - 1):
                    c = chr((ord(c) - ord(first) + v) % size + ord(first))
                    break
            out += c
        return out

    for step in range(1, rounds + 1):
        left, right = (shifted(left, step, right), right) if step % 2 else (left, shifted(right, step, left))
    return left + right


def run(spark, texts, **options):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA)
    rows = sorted(pseudonymise(docs, **({"key": KEY} | options)).collect(), key=lambda r: r.doc_id)
    return [r.text for r in rows], [[(f.kind, f.pseudonym) for f in r.found] for r in rows]


def test_text_permutation_against_slow_one(spark):
    rng = random.Random(1)
    values = ["", "7", "42", "ab", "A1.b-Z", *["".join(rng.choices("0123456789", k=n)) for n in range(3, 20)], "Long.Name_With-Many.Parts12345" * 3]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", feistel_text(F.col("v"), F.lit(KEY), "k").alias("p")).collect()
    assert {r.v: r.p for r in rows} == {v: slow_feistel(v, "k") for v in values}
    every = spark.range(10000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("v"))
    assert every.select(feistel_text(F.col("v"), F.lit(KEY), "k").alias("p")).distinct().count() == 10000


def test_numbers_keep_their_format(spark):
    texts, found = run(spark, ["pay 4111-1111-1111-1111, 4111 1111 1111 1111; 4111111111111111$$$", "call +1 (743) 555-3824 or (743) 555-3824!", "ip 10.0.0.255.", "ssn 123-45-6789", "me: Jo.Do7@mail5.example.com"])
    cards = [p for _, p in found[0]]
    assert [len(c) for c in cards] == [19, 19, 16] and len({c.replace("-", "").replace(" ", "") for c in cards}) == 1
    number = cards[2]
    assert luhn(number) and number[0] == "4" and number[1:15] == slow_feistel("11111111111111", "card")
    assert texts[0] == f"pay {cards[0]}, {cards[1]}; {cards[2]}$$$"
    assert found[1] == [("phone", f"+1 {found[1][1][1]}"), ("phone", found[1][1][1])] and found[1][1][1] != "(743) 555-3824"
    parts = found[2][0][1].split(".")
    assert texts[2] == f"ip {'.'.join(parts)}." and len(parts) == 4 and all(0 <= int(p) <= 255 for p in parts)
    assert found[3][0][0] == "ssn" and texts[3].startswith("ssn 123-") and texts[3] != "ssn 123-45-6789"
    assert texts[4] == f"me: {slow_feistel('Jo.Do7', 'email')}@mail5.example.com"


def test_dates_are_permuted_days(spark):
    a, z = date.fromisoformat(FIRST_DAY), date.fromisoformat(LAST_DAY)
    days = [a + timedelta(k) for k in range(0, (z - a).days + 1, 61)] + [z]
    texts, _ = run(spark, [d.isoformat() for d in days])
    new = [date.fromisoformat(t) for t in texts]
    assert len(set(new)) == len(days) and all(a <= d <= z for d in new)
    texts, _ = run(spark, ["1999-12-31 31.12.1999 12/31/1999 31/12/1999 1999/12/31"])
    iso, dots, us, eu, slash = texts[0].split(" ")
    d = date.fromisoformat(iso)
    assert (dots, us, eu, slash) == (d.strftime("%d.%m.%Y"), d.strftime("%m/%d/%Y"), d.strftime("%d/%m/%Y"), d.strftime("%Y/%m/%d"))


def test_what_is_not_valid_stays(spark):
    same = [None, "", "no numbers", "4111111111111112", "1980-02-30", "000-12-3456 900-12-3456", "256.1.1.1 1.2.3.4.5", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "order 2026082512345678", "v2.0 a@b 12 % 1-2-3", "9" * 3000, "x" * 100000 + "1"]
    texts, found = run(spark, same)
    assert texts == same and all(f == [] for f in found)


def test_links_keys_and_table_shape(spark):
    one = "a 4111111111111111 b"
    texts, _ = run(spark, [one, one, "4111111111111111", "word " * 20000 + one])
    other, _ = run(spark, [one], key="another")
    card = texts[2]
    assert texts[0] == texts[1] == f"a {card} b" and texts[3].endswith(texts[0]) and other[0] != texts[0]
    docs = spark.createDataFrame([(1, one, "x", "y")], SCHEMA)
    assert pseudonymise(docs, KEY).columns == docs.columns and pseudonymise(docs.limit(0), KEY).count() == 0


#: Country code, rest of a number.
PHONES = [("1", "7435553824"), ("7", "4951234567"), ("20", "1001234567"), ("27", "821234567"), ("31", "201234567"), ("33", "123456789"), ("39", "0612345678"), ("44", "2079460958"), ("49", "15112345678"), ("61", "412345678"),
          ("65", "61234567"), ("81", "312345678"), ("82", "1012345678"), ("86", "13812345678"), ("91", "9812345678"), ("212", "612345678"), ("351", "912345678"), ("358", "401234567"), ("380", "441234567"), ("420", "601123456"), ("852", "21234567"), ("971", "501234567"), ("998", "901234567")]


def test_all_spellings_of_a_phone_number_are_linked(spark):
    spelled = []
    for code, rest in PHONES:
        a, b, c = rest[:3], rest[3:6], rest[6:]
        spelled.append([f"+{code}{rest}", f"+{code} {a} {b} {c}", f"+{code}-{a}-{b}-{c}", f"+{code} {a}.{b}.{c}", f"+{code} ({a}) {b}-{c}"])
    texts, found = run(spark, [x for xs in spelled for x in xs])
    assert all([k for k, _ in f] == ["phone"] for f in found), [x for x, f in zip((x for xs in spelled for x in xs), found) if [k for k, _ in f] != ["phone"]]
    for i, (code, rest) in enumerate(PHONES):
        new = {"".join(c for c in t if c.isdigit()) for t in texts[5 * i:5 * i + 5]}
        assert len(new) == 1 and new.pop() == code + slow_feistel(rest, "phone")


def test_dates_before_a_time_and_of_all_centuries(spark):
    texts, found = run(spark, ["2024-01-02", "at 2024-01-02T10:00:05Z", "at 2024-01-02T1000", "2024-01-02Tuesday", "1800-01-01 2199-12-31 1850-06-07"])
    assert texts[1] == f"at {texts[0]}T10:00:05Z" and texts[2] == f"at {texts[0]}T1000" and texts[3] == "2024-01-02Tuesday"
    assert [k for k, _ in found[4]] == ["date"] * 3 and len({*texts[4].split(), "1800-01-01", "2199-12-31", "1850-06-07"}) == 6


def test_the_query_takes_the_session_s_key(spark):
    spark.conf.unset(SECRET)
    one = secret(spark)
    assert len(one) == 64 and secret(spark) == one
    spark.conf.set(SECRET, KEY)
    rows = {r.doc_id: r for r in op7_pii_pseudonyms(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: r.text for r in pseudonymise(docs.select("doc_id", "text"), KEY).collect()}
    assert {i: r.text for i, r in rows.items()} == want and any(r.n_found for r in rows.values())
    spark.conf.unset(SECRET)


@pytest.mark.parametrize("n", [13, 15, 19])
def test_cards_of_other_lengths(spark, n):
    rng = random.Random(n)
    numbers = []
    while len(numbers) < 20:
        d = "".join(rng.choices("0123456789", k=n))
        if luhn(d):
            numbers.append(d)
    _, found = run(spark, numbers)
    got = [f[0][1] for f in found]
    assert all(luhn(g) and len(g) == n and g[0] == d[0] for g, d in zip(got, numbers)) and len(set(got)) == 20


CARD = "4111111111111111"


@pytest.mark.parametrize("written", [CARD, "4111 1111 1111 1111", "4111-1111-1111-1111", "41111111 11111111"])
def test_neighbouring_numbers_hide_no_card(spark, written):
    around = ["{} 12/27", "77 {}", "2020 {} 123", "{} 2020-12-31", "7 {}-9", "{} {}"]
    # In two groups of eight it may be a phone number after a plus, and with 4 before and 5 behind the whole passes the check as well.
    around += ["+{}", "+1 {}", "12 {} 4 {} 5"] if len(written.split(" ")) != 2 else []
    texts, found = run(spark, [written, *(a.replace("{}", written) for a in around)])
    new = texts[0]
    assert new != written and luhn("".join(c for c in new if c.isdigit()))
    for a, t, f in zip(around, texts[1:], found[1:]):
        assert [k for k, p in f if p == new] == ["card"] * a.count("{}"), (a, t)
        if "2020-" not in a:
            assert t == a.replace("{}", new)


def test_neighbouring_numbers_do_not_change_phones(spark):
    phones = ["+1 (743) 555-3824", "(743) 555-3824", "743-555-3824", "+44 20 7946 0958"]
    alone, _ = run(spark, phones)
    for a in ("{} 2020", "2020 {}", "{}-12", "{} 15 1234"):
        texts, found = run(spark, [a.replace("{}", p) for p in phones])
        assert texts == [a.replace("{}", n) for n in alone] and [[k for k, _ in f] for f in found] == [["phone"]] * 4


def test_no_plan_holds_the_key(spark, capsys):
    secret = "a key that nobody may read 4711"
    docs = spark.createDataFrame([(1, "call +44 20 7946 0958 or 2001:db8::1, card 4111 1111 1111 1111", "x", "y")], "doc_id bigint, text string, found string, _n string")
    done = pseudonymise(docs, secret)
    done.collect()
    for mode in ("extended", "formatted", "codegen"):
        done.explain(mode)
    plans = done._jdf.queryExecution()
    shown = plans.toString() + plans.executedPlan().treeString() + capsys.readouterr().out
    assert len(shown) > 10_000 and secret not in shown and "Python" not in plans.executedPlan().toString()
