"""Pseudonyms of personal data that keep its format. DataFrame functions only.

Numbers, addresses and dates that are valid are replaced by a keyed permutation of their own format, a Feistel network of alternating
halves: a card number becomes a card number with a right check digit, a date a date. The same value gives the same pseudonym
wherever and however it is written, so documents stay linked, and no two values of a kind and length share one. The key is the
caller's: whoever has it can undo the permutation. It is the one row of a table, which a scalar subquery reads, so no plan shows it.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, read

ROUNDS = 8
#: The setting that holds the key of the query; its name makes Spark hide the value.
SECRET = "spark.recon.pseudonyms.secret"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: Digits after the country code where a country's numbers all have as many: such a number ends there, whatever follows it.
_NATIONAL = {8: "45|47|65|852", 9: "31|33|34|41|48|61|351|380|420|971|972", 10: "7|44|52|57|90|91", 11: "86"}
_EXACT = "|".join([r"\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}", *(rf"\+(?:{c})(?:[ .-]?\(?\d\)?){{{n - 1}}}[ .-]?\d" for n, c in _NATIONAL.items())])
#: Country codes, which no other number begins: two digits in these ranges, one for zones 1 and 7, three for all others.
_COUNTRY = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"
#: Patterns by kind, in the order in which they are tried. Letters and digits may not touch a match.
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "ip": rf"(?<!\d\.){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)",
    "phone": rf"(?:{_EXACT})(?![A-Za-z0-9])|\+\d{{1,3}}[ .-]?\(?\d{{2,4}}\)?(?:[ .-]?\d{{2,4}}){{2,3}}|\(\d{{3}}\) ?\d{{3}}-\d{{4}}|\d{{3}}-\d{{3}}-\d{{4}}",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "date": r"(?:18|19|20|21)\d\d([-/.])\d\d\1\d\d|\d\d[./]\d\d[./](?:18|19|20|21)\d\d",
    "card": r"\d(?:[ -]?\d){12,18}",
}
#: Dates of the years that the pattern can hold: 400 years are 189 times 773 days.
FIRST_DAY, LAST_DAY, DAY_HALVES = "1800-01-01", "2199-12-31", (189, 773)
#: What a match ends with: no letter or digit behind it, but for a date before a time of day.
_END = r"(?:(?![A-Za-z0-9])|(?<=\d{4}-\d\d-\d\d)(?=T\d\d:?\d\d))"
#: Written shapes of cards, which are tried before other groupings; other runs of digits as long as a card's, in few groups.
SHAPES = r"^(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?:\1\d{1,3})?|\d{4}([ -])\d{6}\2\d{4,5}|\d{4}([ -])\d{3}\3\d{3}\3\d{3})$"
FEW_GROUPS = r"^\d+(?:[ -]\d+){1,4}$"


def held_key(spark: SparkSession, key: str) -> Column:
    """The key as the value of a scalar subquery: plans, the UI and event logs name the subquery, not its value."""
    return spark.createDataFrame([(key,)], "pseudonym_key string").scalar()


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether the digits of ``x`` end in their check digit."""
    return F.call_function("luhn_check", x)


def _number(key: Column, kind: Column | str, step: Column, seen: Column) -> Column:
    """A keyed number below 2^52 of what a round sees of the other half."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.conv(F.substring(F.sha2(F.concat_ws("|", key, kind, step.cast("string"), seen.cast("string")), 256), 1, 13), 16, 10).cast("bigint")


def feistel_numbers(left: Column, right: Column, sizes: tuple[int, int], key: Column, kind: str) -> Column:
    """A keyed permutation of the pairs ``left`` below ``sizes[0]``, ``right`` below ``sizes[1]``."""
    a, b = sizes
    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))

    def step(s: Column, i: Column) -> Column:
        return F.when(i % 2 == 1, F.struct(((s["l"] + _number(key, kind, i, s["r"])) % a).alias("l"), s["r"].alias("r"))).otherwise(
            F.struct(s["l"].alias("l"), ((s["r"] + _number(key, kind, i, s["l"])) % b).alias("r")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def feistel_text(x: Column, key: Column, kind: Column | str) -> Column:
    """A keyed permutation of texts that moves digits among digits and letters among letters of their case; the two halves take
    turns, and a round sees the other half in lower case, so that spellings stay linked."""
    name = F.lit(kind) if isinstance(kind, str) else kind

    def shifted(half: Column, digest: Column) -> Column:
        def moved(c: Column, i: Column) -> Column:
            v, at = F.conv(F.substr(digest, i % 31 * 2 + 1, F.lit(4)), 16, 10).cast("int"), F.ascii(c)
            return (F.when(c.between("0", "9"), F.char((at - 48 + v) % 10 + 48)).when(c.between("a", "z"), F.char((at - 97 + v) % 26 + 97))
                    .when(c.between("A", "Z"), F.char((at - 65 + v) % 26 + 65)).otherwise(c))

        parts = F.transform(F.sequence(F.lit(1), F.length(half)), lambda i: F.substr(half, i, F.lit(1)))
        return F.when(F.length(half) == 0, half).otherwise(F.array_join(F.transform(parts, moved), ""))

    def digest(step: Column, seen: Column, size: Column) -> Column:
        return F.sha2(F.concat_ws("|", key, name, size.cast("string"), step.cast("string"), F.lower(seen)), 256)

    def step(s: Column, i: Column) -> Column:
        size = F.length(s["l"]) + F.length(s["r"])
        return F.when(i % 2 == 1, F.struct(let(digest(i, s["r"], size), lambda d: shifted(s["l"], d)).alias("l"), s["r"].alias("r"))).otherwise(
            F.struct(s["l"].alias("l"), let(digest(i, s["l"], size), lambda d: shifted(s["r"], d)).alias("r")))

    half = F.floor(F.length(x) / 2).cast("int")
    start = F.struct(F.substr(x, F.lit(1), half).alias("l"), F.substr(x, half + 1, F.length(x)).alias("r"))
    return let(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step), lambda s: F.concat(s["l"], s["r"]))


def refilled(shape: Column, new: Column) -> Column:
    """``shape`` with its digits replaced, in order, by those of ``new``."""
    def put(i: Column) -> Column:
        c = F.substr(shape, i, F.lit(1))
        return F.when(c.between("0", "9"), F.substr(new, F.length(digits(F.substr(shape, F.lit(1), i))), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), put), "")


def check_digit(x: Column) -> Column:
    """The digit that makes ``x`` and it pass the check of card numbers."""
    def value(i: Column) -> Column:
        d = F.substr(x, i, F.lit(1)).cast("int") * F.when((F.length(x) - i) % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(x)), value), F.lit(0), lambda a, v: a + v)
    return ((10 - total % 10) % 10).cast("string")


def kind_of(m: Column) -> Column:
    """The kind of a match if it is valid, else null: cards by their check digit, dates by the calendar, social security numbers by
    their ranges, phone numbers by 8 to 15 digits; the other patterns say all."""
    is_ = {k: m.rlike(f"^(?:{p})$") for k, p in PATTERNS.items()}
    phone = F.length(digits(m)).between(8, 15) & ~F.coalesce(_day(m).isNotNull(), F.lit(False))
    ssn = ~m.rlike("^(?:000|666|9)|-00-|-0000$")
    chain = F.when(is_["email"], "email").when(is_["ip"], "ip").when(is_["card"] & luhn(digits(m)), "card").when(is_["phone"] & phone, "phone")
    return chain.when(is_["ssn"] & ssn, "ssn").when(is_["date"] & _day(m).isNotNull(), "date")



def _ymd(m: Column) -> Column:
    """A written date as yyyy-mm-dd: year first; day first with points; with slashes month first, or day first if only that can be."""
    year_first, dots = m.rlike(r"^\d{4}"), m.rlike(r"^\d\d\.")
    a, b, c = (F.substring(m, *p) for p in ((1, 2), (4, 2), (7, 4)))
    month_first = m.rlike(r"^(?:0[1-9]|1[0-2])/")
    return (F.when(year_first, F.concat_ws("-", F.substring(m, 1, 4), F.substring(m, 6, 2), F.substring(m, 9, 2)))
            .when(dots | ~month_first, F.concat_ws("-", c, b, a)).otherwise(F.concat_ws("-", c, a, b)))


def _day(m: Column) -> Column:
    """Days from the first day to a written date; null if there is no such day."""
    day = F.try_to_timestamp(F.when(m.rlike(f"^(?:{PATTERNS['date']})$"), _ymd(m)), F.lit("yyyy-MM-dd")).cast("date")
    n = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
    return F.when(day.between(F.lit(FIRST_DAY).cast("date"), F.lit(LAST_DAY).cast("date")), n)


def pseudonym(m: Column, kind: Column, key: Column) -> Column:
    """The pseudonym of a valid match of a kind."""
    card = let(digits(m), lambda d: let(F.concat(F.substr(d, F.lit(1), F.lit(1)), feistel_text(F.substr(d, F.lit(2), F.length(d) - 2), key, "card")), lambda x: refilled(m, F.concat(x, check_digit(x)))))
    # The country code stays. It is read from the digits alone, so that all spellings of a number have one pseudonym.
    country = F.when(m.startswith("+"), F.regexp_extract(digits(m), f"^(?:{_COUNTRY})", 0)).otherwise(F.lit(""))
    phone = let(country, lambda c: refilled(m, F.concat(c, feistel_text(F.substr(digits(m), F.length(c) + 1, F.lit(20)), key, "phone"))))
    ssn = let(feistel_numbers(F.substring(m, 5, 2).cast("bigint") - 1, F.substring(m, 8, 4).cast("bigint") - 1, (99, 9999), key, "ssn"),
              lambda s: F.concat_ws("-", F.substring(m, 1, 3), F.lpad((s["l"] + 1).cast("string"), 2, "0"), F.lpad((s["r"] + 1).cast("string"), 4, "0")))
    octet = lambda k: F.element_at(F.split(m, r"\."), k).cast("bigint")
    ip = let(feistel_numbers(octet(1) * 256 + octet(2), octet(3) * 256 + octet(4), (65536, 65536), key, "ip"),
             lambda s: F.concat_ws(".", *[x.cast("string") for h in ("l", "r") for x in (F.floor(s[h] / 256), s[h] % 256)]))
    email = F.concat(feistel_text(F.substring_index(m, "@", 1), key, "email"), F.lit("@"), F.substring_index(m, "@", -1))
    a, b = DAY_HALVES
    # As many digits as there are, in the order that the date was written in.
    new = let(_day(m), lambda n: let(feistel_numbers(F.floor(n / b), n % b, (a, b), key, "date"), lambda s: F.date_add(F.lit(FIRST_DAY).cast("date"), (s["l"] * b + s["r"]).cast("int"))))
    day_first = m.rlike(r"^\d\d\.") | m.rlike(r"^(?:1[3-9]|[23]\d)/")
    date = let(new, lambda d: F.when(m.rlike(r"^\d{4}"), refilled(m, F.date_format(d, "yyyyMMdd"))).when(day_first, refilled(m, F.date_format(d, "ddMMyyyy"))).otherwise(refilled(m, F.date_format(d, "MMddyyyy"))))
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", phone).when(kind == "ssn", ssn).when(kind == "date", date)


def valid_cards(text: Column) -> Column:
    """Every run of 13 to 19 digits that begins and ends where a group of digits does and passes the check, the shorter first. Runs
    may overlap: a neighbouring number hides no card."""
    each = [F.regexp_extract_all(text, F.lit(rf"(?<![A-Za-z0-9])(?=(\d(?:[ -]?\d){{{n - 1}}})(?![A-Za-z0-9]))"), F.lit(1)) for n in range(13, 20)]
    return F.filter(F.array_distinct(F.flatten(F.array(*each))), lambda c: luhn(digits(c)))


def found_pattern(cards: Column | None = None) -> Column:
    """Pattern of all kinds for a text that holds these cards, as they are written there. No phone number begins with one of them that is
    longer than a phone number can be."""
    first, others = (PATTERNS["email"], PATTERNS["ip"]), (PATTERNS["phone"], PATTERNS["ssn"], PATTERNS["date"])
    if cards is None:
        return F.lit(r"(?<![A-Za-z0-9])(?:" + "|".join([*first, *others]) + ")" + _END)
    start = r"(?<![A-Za-z0-9])(?:" + "|".join(first) + r"|(?!\+(?:\d{1,3}[ .-]?)?(?:"
    # Phone numbers have 15 digits at most, so behind a plus only longer cards are cards.
    long_ = let(F.filter(cards, lambda c: F.length(digits(c)) > 15), lambda cs: F.when(F.size(cs) > 0, F.array_join(cs, "|")).otherwise("(?!)"))
    return F.concat(F.lit(start), long_, F.lit(r")(?![A-Za-z0-9]))(?:" + "|".join(others) + ")|"), F.array_join(cards, "|"), F.lit(")" + _END))


def text_pattern(text: Column) -> Column:
    """What to look for in a text: cards in their written shapes first, then, in what the other kinds leave, cards in other groups."""
    def pattern(cards: Column) -> Column:
        return F.when(F.size(cards) > 0, found_pattern(cards)).otherwise(found_pattern())

    def both(shaped: Column) -> Column:
        rest = F.regexp_replace(text, pattern(shaped), F.lit("#"))
        return let(rest, lambda r: let(F.regexp_extract_all(r, F.lit(r"(?<![A-Za-z0-9])" + PATTERNS["card"] + r"(?![A-Za-z0-9])"), F.lit(0)), lambda whole: pattern(
            F.concat(shaped, F.filter(whole, lambda c: luhn(digits(c))), F.reverse(F.filter(valid_cards(r), lambda c: c.rlike(FEW_GROUPS)))))))

    return F.when(text.rlike(r"\d(?:[ -]?\d){12}"), let(F.filter(valid_cards(text), lambda c: c.rlike(SHAPES)), both)).otherwise(found_pattern())


def pseudonymised(text: Column, key: Column) -> Column:
    """``struct(text, found array<struct(kind, pseudonym)>)`` of a text: the same but for its valid matches.

    The text is cut at its matches and put together again, so only what was matched changes. Texts without a digit or an at sign
    are passed on as they are.
    """
    def judged(m: Column) -> Column:
        return let(kind_of(m), lambda kind: F.struct(m.alias("old"), kind.alias("kind"), F.when(kind.isNotNull(), pseudonym(m, kind, key)).alias("new")))

    def build(ms: Column, pattern: Column) -> Column:
        # split() and regexp_extract_all() cut at the same places, so pieces and matches alternate.
        filled = F.concat(F.transform(ms, lambda m: F.coalesce(m["new"], m["old"])), F.array(F.lit("")))
        joined = F.array_join(F.flatten(F.transform(F.arrays_zip(F.split(text, pattern, -1).alias("p"), filled.alias("f")), lambda z: F.array(z["p"], z["f"]))), "")
        return F.struct(joined.alias("text"), F.transform(F.filter(ms, lambda m: m["kind"].isNotNull()), lambda m: F.struct(m["kind"].alias("kind"), m["new"].alias("pseudonym"))).alias("found"))

    none = F.struct(text.alias("text"), F.array().cast("array<struct<kind:string,pseudonym:string>>").alias("found"))
    done = let(text_pattern(text), lambda p: let(F.transform(F.regexp_extract_all(text, p, F.lit(0)), judged), lambda ms: F.when(F.size(ms) > 0, build(ms, p)).otherwise(none)))
    return F.when(text.rlike("[0-9@]"), done).otherwise(none)


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with its text pseudonymised and a column ``found`` of the kinds and pseudonyms in it, in order.

    Defined results: null and empty texts stay as they are; what looks like a number but isn't valid stays; repeated rows are
    treated alike; an empty table gives none; other columns pass, but for one named ``found``, which is replaced.
    """
    keyed = docs.withColumn("_key", held_key(docs.sparkSession, key))
    done = keyed.withColumn("_done", pseudonymised(F.col(text), F.col("_key"))).drop("_key")
    return done.withColumn(text, F.col("_done.text")).withColumn("found", F.col("_done.found")).drop("_done")


def secret(spark: SparkSession) -> str:
    """The key in the session's setting ``SECRET``. Where there is none the session gets a random one, which nobody else knows: its
    pseudonyms agree with each other, and not with those of other sessions."""
    if not spark.conf.get(SECRET, None):
        spark.conf.set(SECRET, secrets.token_hex(32))
    return spark.conf.get(SECRET)


def op7_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text, n_found`` and ``kinds`` over the whole table ``documents``, with the key of the session."""
    done = pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), secret(spark))
    return done.select("doc_id", "text", F.size("found").cast("bigint").alias("n_found"), F.array_join(F.transform("found", lambda f: f["kind"]), ",").alias("kinds"))
