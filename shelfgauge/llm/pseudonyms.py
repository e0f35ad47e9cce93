"""Format-preserving pseudonyms for personal numbers and dates.

Values are found by pattern, validated (check digits, ranges, the calendar) and
permuted within their format by a keyed Feistel network: two halves in turn get
a keyed hash of the other one added, modulo the number of values the half can
take.  Each network is a permutation, so different values stay different, equal
values stay equal in all documents, and a valid value becomes a valid one.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfgauge.llm.common import read_table, texts

ROUNDS = 8
KEY = "shelfgauge"

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
IP = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"
ISO_DATE = r"(?<![\d-])\d{4}-\d{2}-\d{2}(?!-?\d)"
DOT_DATE = r"(?<![\d.])\d{1,2}\.\d{1,2}\.\d{4}(?!\.?\d)"
SLASH_DATE = r"(?<![\d/])\d{1,2}/\d{1,2}/\d{4}(?!/?\d)"
YEAR_DATE = r"(?<![\d/])\d{4}/\d{1,2}/\d{1,2}(?!/?\d)"
# Twelve names each: English, German, French, Spanish, in full and short.
MONTHS = {kind: names.split() for kind, names in {
    "en": "january february march april may june july august september october november december",
    "en short": "jan feb mar apr may jun jul aug sep oct nov dec",
    "en sept": "jan feb mar apr may june july aug sept oct nov dec",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "de short": "jan feb mär apr mai jun jul aug sep okt nov dez",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "fr short": "janv févr mars avr mai juin juil août sept oct nov déc",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "es short": "ene feb mar abr may jun jul ago sep oct nov dic"}.items()}
MONTH = "(?iu:" + "|".join(sorted({name for names in MONTHS.values() for name in names}, key=lambda n: (-len(n), n))) + ")"
# A day, its ending, what parts it from the month, the month, what parts that from the year, the year.
DAY_FIRST = (r"(\d{1,2})((?i:st|nd|rd|th|er)|\.)?( ?-| *(?i:of|de)? +| (?=\p{L}))(" + MONTH + r")(\.?(?:,? +(?i:del?)? *|-|, *))(\d{4})")
MONTH_FIRST = "(" + MONTH + r")(\.? +|\.?-)(\d{1,2})((?i:st|nd|rd|th))?(,? +|, *|-)(\d{4})"


def ungrouped(pattern: str) -> str:
    return re.sub(r"(?<!\\)\((?!\?)", "(?:", pattern)


DAY_NAMED = r"(?<![\d./-])" + ungrouped(DAY_FIRST) + r"(?!\d)"
MONTH_NAMED = r"(?<![\p{L}\d])" + ungrouped(MONTH_FIRST) + r"(?!\d)"
# Country codes: of one digit, of two, and of three.
CODE = r"(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9]\d\d)"
DIGIT = r"(?:[ ./-]?\(?\d\)?)"
ABROAD = (r"(?<![\d+])\+(?=\d)(?:[17]{trunk}{digit}{{10}}|(?:3[134]|41|48|351){trunk}{digit}{{9}}|44{trunk}{digit}{{9,10}}"
          r"|(?![17]){code}{trunk}{digit}{{6,12}})(?!\d)").format(trunk=r"(?:[ .-]?\(0\))?", digit=DIGIT, code=CODE)
PHONE = (ABROAD + r"|(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
         r"|(?<![\d+])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])(?:1[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}(?![.-]?\d)")
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?!-?\d)"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"
# IBANs printed in groups of four, by the length that each country's have.
IBAN_LENGTHS = {15: "NO", 16: "BE", 18: "DK FO FI GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ XK LT LU MN",
                21: "HR LV LI CH", 22: "BH BG CR GE DE IE ME RS GB VA", 23: "GI IL AE IQ OM SO TL",
                24: "AD CZ MD PK RO SA SK ES SE TN VG", 25: "PT LY ST", 26: "IS TR", 27: "FR GR IT MR MC SM BI DJ",
                28: "AL AZ CY DO GT HU LB PL SV NI BY", 29: "BR PS QA EG UA", 30: "JO KW MU YE", 31: "MT SC",
                32: "LC", 33: "RU"}
SPACED_IBAN = r"(?<![A-Za-z0-9])(?:" + "|".join(
    "(?:" + countries.replace(" ", "|") + r")\d{2}" + f"(?: [A-Z0-9]{{4}}){{{length // 4 - 1}}}"
    + (f" [A-Z0-9]{{{length % 4}}}" if length % 4 else "")
    for length, countries in IBAN_LENGTHS.items()) + r")(?![A-Za-z0-9])"
CARD = (r"(?<!\d)(?:\d{13,19}|\d{4}(?: \d{4}){3}|\d{4}(?:-\d{4}){3}"
        r"|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5})(?!\d)")
# Nine patterns begin with one of a few characters, so elsewhere none of them is tried.
NUMBERS = "(?=[0-9(+])(?:" + "|".join((IP, ISO_DATE, DAY_NAMED, DOT_DATE, SLASH_DATE, YEAR_DATE, PHONE, SSN, CARD)) + ")"
VALUES = "|".join((EMAIL, NUMBERS, IBAN, MONTH_NAMED))

# Days in the 400 years after which the calendar repeats: 189 * 773.
FIRST_DAY, CYCLE_HIGH, CYCLE_LOW = "1700-01-01", 189, 773


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def keyed(key: str, kind: str, turn: Column, *parts: Column) -> Column:
    """A number below 2**60 that only the key's owner can tell."""
    text = F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), *[part.cast("string") for part in parts])
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("bigint")


def feistel(key: str, kind: str, left: Column, right: Column, n_left: Column, n_right: Column) -> Column:
    """Permute pairs of numbers below ``n_left`` and ``n_right``: a struct of a and b."""
    start = F.struct(left.cast("bigint").alias("a"), right.cast("bigint").alias("b"))

    def turn(state: Column, i: Column) -> Column:
        a = (state["a"] + keyed(key, kind, i, n_left, n_right, state["b"]) % n_left) % n_left
        b = (state["b"] + keyed(key, kind, i, n_left, n_right, state["a"]) % n_right) % n_right
        even = i % 2 == 0
        return F.struct(F.when(even, a).otherwise(state["a"]).alias("a"), F.when(even, state["b"]).otherwise(b).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def permuted_digits(key: str, kind: str, digits: Column) -> Column:
    """Permute the strings of 2 to 20 digits of one length."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    power = F.array(*[F.lit(10**k).cast("bigint") for k in range(11)])
    n_left, n_right = F.get(power, half), F.get(power, n - half)
    mixed = feistel(key, kind, F.left(digits, half), F.right(digits, n - half), n_left, n_right)
    return bound(mixed, lambda x: F.concat(
        F.lpad(x["a"].cast("string"), half, "0"), F.lpad(x["b"].cast("string"), n - half, "0")))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def characters(value: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: F.substring(value, i, F.lit(1)))


def refilled(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced, in order, by ``digits``."""

    def step(state: Column, char: Column) -> Column:
        digit = char.between("0", "9")
        return F.struct(
            F.concat(state["text"], F.when(digit, F.substring(digits, state["k"], F.lit(1))).otherwise(char)).alias("text"),
            (state["k"] + digit.cast("int")).alias("k"))

    return F.aggregate(characters(value), F.struct(F.lit("").alias("text"), F.lit(1).alias("k")), step)["text"]


def luhn_sum(digits: Column, doubled_from_right: int) -> Column:
    """Sum of digits, every other one doubled, beginning with the one so far from the right."""
    reverse = F.transform(characters(F.reverse(digits)), lambda c: c.cast("int"))

    def counted(digit: Column, i: Column) -> Column:
        double = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return F.when(i % 2 == doubled_from_right, double).otherwise(digit)

    return F.aggregate(F.transform(reverse, counted), F.lit(0), lambda a, b: a + b)


def card(key: str, value: Column) -> Column:
    """All digits but the check digit are permuted, and the check digit made anew; NULL if it is wrong."""

    def use(digits: Column) -> Column:
        body = permuted_digits(key, "card", F.left(digits, F.length(digits) - 1))
        new = bound(body, lambda b: F.concat(b, ((10 - luhn_sum(b, 0) % 10) % 10).cast("string")))
        return F.when(luhn_sum(digits, 1) % 10 == 0, refilled(value, new))

    return bound(digits_of(value), use)


def phone(key: str, value: Column) -> Column:
    """The national number is permuted; a country code, and the zero in (0), stay."""
    def use(digits: Column) -> Column:
        zero = F.when(value.contains("(0)"), F.lit("0")).otherwise(F.lit(""))
        listed = F.regexp_extract(digits, "^" + CODE, 0)
        code = F.when(value.startswith("+") & (listed != ""), listed).otherwise(F.left(digits, F.length(digits) - 10))
        number = F.right(digits, F.length(digits) - F.length(code) - F.length(zero))
        return refilled(value, F.concat(code, zero, permuted_digits(key, "phone", number)))

    return bound(digits_of(value), use)


def ip(key: str, value: Column) -> Column:
    """The four numbers are permuted as two of 16 bits; NULL if one exceeds 255."""
    def use(octets: Column) -> Column:
        at = [F.get(octets, i) for i in range(4)]
        size = F.lit(65_536).cast("bigint")
        mixed = feistel(key, "ip", at[0] * 256 + at[1], at[2] * 256 + at[3], size, size)
        new = bound(mixed, lambda x: F.concat_ws(".", *[
            part.cast("string") for half in ("a", "b")
            for part in (F.shiftright(x[half], 8), x[half].bitwiseAND(255))]))
        return F.when(F.array_max(octets) <= 255, new)

    return bound(F.transform(F.split(value, r"\."), lambda x: x.cast("int")), use)


def ssn(key: str, value: Column) -> Column:
    """Valid numbers (area neither 000, 666 nor 9xx; no part zero) are permuted among themselves."""
    def use(parts: Column) -> Column:
        area, group, serial = (F.get(parts, i) for i in range(3))
        valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
        place = area - 1 - (area > 666).cast("int")
        mixed = feistel(key, "ssn", place * 99 + group - 1, serial - 1,
                        F.lit(898 * 99).cast("bigint"), F.lit(9_999).cast("bigint"))

        def shown(x: Column) -> Column:
            place = F.floor(x["a"] / 99)
            area = place + 1 + (place >= 665).cast("int")
            return F.concat(F.lpad(area.cast("string"), 3, "0"), F.lit("-"),
                            F.lpad((x["a"] % 99 + 1).cast("string"), 2, "0"), F.lit("-"),
                            F.lpad((x["b"] + 1).cast("string"), 4, "0"))

        return F.when(valid, bound(mixed, shown))

    return bound(F.transform(F.split(value, "-"), lambda x: x.cast("int")), use)


def new_day(key: str, day: Column) -> Column:
    """Days from 1700 to 2099 are permuted among themselves; NULL for others."""
    number = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
    mixed = feistel(key, "date", F.floor(number / CYCLE_LOW), number % CYCLE_LOW,
                    F.lit(CYCLE_HIGH).cast("bigint"), F.lit(CYCLE_LOW).cast("bigint"))
    back = bound(mixed, lambda x: F.date_add(F.lit(FIRST_DAY).cast("date"), (x["a"] * CYCLE_LOW + x["b"]).cast("int")))
    return F.when((number >= 0) & (number < CYCLE_HIGH * CYCLE_LOW), back)


def date(key: str, value: Column) -> Column:
    """Dates of the calendar; NULL if there is no such day.

    With slashes the month comes first if that is a date, else the day.  Parts
    written with two digits, or of two, are written so again; a part written
    without its zero is again, unless it needs two digits.
    """
    def use(parts: Column) -> Column:
        one, two, three = (F.get(parts, i) for i in range(3))

        def day(year: Column, month: Column, of_month: Column) -> Column:
            return F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(of_month, 2, "0")).try_cast("date")

        def short(number: Column, old: Column) -> Column:
            return F.lpad(number.cast("string"), F.greatest(F.length(old), F.length(number.cast("string"))), F.lit("0"))

        iso = new_day(key, day(one, two, three))
        dotted = bound(new_day(key, day(three, two, one)), lambda d: F.concat_ws(
            ".", short(F.dayofmonth(d), one), short(F.month(d), two), F.lpad(F.year(d).cast("string"), 4, "0")))
        american = day(three, one, two).isNotNull()
        slashed = bound(new_day(key, F.coalesce(day(three, one, two), day(three, two, one))), lambda d: F.concat_ws(
            "/", short(F.when(american, F.month(d)).otherwise(F.dayofmonth(d)), one),
            short(F.when(american, F.dayofmonth(d)).otherwise(F.month(d)), two), F.lpad(F.year(d).cast("string"), 4, "0")))
        year_first = bound(iso, lambda d: F.concat_ws(
            "/", F.lpad(F.year(d).cast("string"), 4, "0"), short(F.month(d), two), short(F.dayofmonth(d), three)))
        return F.when(value.contains("-"), iso.cast("string")).when(
            F.length(one) == 4, F.when(year_first != "", F.when(iso.isNotNull(), year_first))).when(
            value.contains("."), F.when(dotted != "", dotted)).otherwise(F.when(slashed != "", slashed))

    return bound(F.split(value, "[-./]"), use)


def named_date(key: str, value: Column) -> Column:
    """Dates with a month's name: the new month's is of the same language, length and case."""
    first = value.rlike("^[0-9]")

    def part(day_first: int, month_first: int) -> Column:
        return F.when(first, F.regexp_extract(value, f"^{DAY_FIRST}$", day_first)).otherwise(
            F.regexp_extract(value, f"^{MONTH_FIRST}$", month_first) if month_first else F.lit(""))

    def ordered(*languages: str) -> list[str]:
        return [name for language in languages for kind, names in MONTHS.items() if kind.startswith(language) for name in names]

    def use(x: Column) -> Column:
        word = x["month"]
        small = word == F.lower(word)
        # Names that languages share are told by "de", by the dot after the day, and by their case.
        names = F.when(x["gap"].rlike("(?i)de"), F.lit(ordered("es", "fr", "en", "de"))).when(
            first & (x["ending"] == "."), F.lit(ordered("de", "en", "fr", "es"))).when(
            small, F.lit(ordered("fr", "es", "en", "de"))).otherwise(F.lit(ordered("en", "de", "fr", "es")))

        def found(y: Column) -> Column:
            place = y["place"]
            date = new_day(key, F.concat_ws("-", x["year"], F.lpad((place % 12 + 1).cast("string"), 2, "0"),
                                            F.lpad(x["day"], 2, "0")).try_cast("date"))

            def shown(d: Column) -> Column:
                name = F.get(y["names"], (place - place % 12 + F.month(d) - 1).cast("int"))
                name = F.when(small, name).when((word == F.upper(word)), F.upper(name)).otherwise(F.initcap(name))
                number = F.dayofmonth(d)
                day = F.lpad(number.cast("string"), F.greatest(F.length(x["day"]), F.length(number.cast("string"))), F.lit("0"))
                nth = F.when(number.isin(1, 21, 31), F.lit("st")).when(number.isin(2, 22), F.lit("nd")).when(
                    number.isin(3, 23), F.lit("rd")).otherwise(F.lit("th"))
                ending = F.when(x["ending"].isin("", "."), x["ending"]).when(
                    F.lower(x["ending"]) == "er", F.when(number == 1, x["ending"]).otherwise(F.lit(""))).otherwise(nth)
                year = F.lpad(F.year(d).cast("string"), 4, "0")
                return F.when(d.isNull(), F.lit(None).cast("string")).when(
                    first, F.concat(day, ending, x["gap"], name, x["gap2"], year)).otherwise(
                    F.concat(name, x["gap"], day, ending, x["gap2"], year))

            return bound(date, shown)

        return bound(bound(names, lambda n: F.struct(n.alias("names"), (F.array_position(n, F.lower(word)) - 1).alias("place"))), found)

    return bound(F.struct(part(1, 3).alias("day"), part(2, 4).alias("ending"), part(3, 2).alias("gap"),
                          part(4, 1).alias("month"), part(5, 5).alias("gap2"), part(6, 6).alias("year")), use)


def shifted(char: Column, by: Column) -> Column:
    """A letter or digit moved on within its kind; other characters stay."""
    code = F.ascii(char)
    moved = [(F.when(char.rlike(f"^[{low}-{high}]$"), F.chr(ord(low) + (code - ord(low) + by) % size)))
             for low, high, size in (("a", "z", 26), ("A", "Z", 26), ("0", "9", 10))]
    return F.coalesce(*moved, char)


def permuted_characters(key: str, kind: str, value: Column) -> Column:
    """Permute strings whose characters keep their kinds: lower case, upper case, digit, other."""
    half = F.floor(F.length(value) / 2).cast("int")

    def added(i: Column, text: Column, other: Column) -> Column:
        return F.array_join(F.transform(
            characters(text), lambda c, k: shifted(c, keyed(key, kind, i, k, other) % 1_000_003)), "")

    def turn(state: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even & (F.length(state["a"]) > 0), added(i, state["a"], state["b"])).otherwise(state["a"]).alias("a"),
            F.when(even, state["b"]).otherwise(added(i, state["b"], state["a"])).alias("b"))

    start = F.struct(F.left(value, half).alias("a"), F.right(value, F.length(value) - half).alias("b"))
    return bound(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn), lambda x: F.concat(x["a"], x["b"]))


def email(key: str, value: Column) -> Column:
    """The name is permuted within its letters and digits; the host stays."""
    name = F.substring_index(value, "@", 1)
    return F.concat(permuted_characters(key, "email", name), F.lit("@"), F.substring_index(value, "@", -1))


def mod97(value: Column) -> Column:
    """The remainder that IBAN check digits are made from: letters count from A = 10."""
    def step(rest: Column, char: Column) -> Column:
        digit = char.between("0", "9")
        return (rest * F.when(digit, 10).otherwise(100)
                + F.when(digit, F.ascii(char) - 48).otherwise(F.ascii(char) - 55)) % 97

    return F.aggregate(characters(value), F.lit(0), step)


def iban(key: str, value: Column) -> Column:
    """The account is permuted, the country stays, the check digits are made anew; NULL if they are wrong.

    Blanks between groups of four don't count, and are set again.
    """
    def use(bare: Column) -> Column:
        country, check = F.left(bare, F.lit(2)), F.substring(bare, 3, 2)
        account = F.right(bare, F.length(bare) - 4)
        new = bound(permuted_characters(key, "iban", account), lambda a: F.concat(
            country, F.lpad((98 - mod97(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0"), a))
        shown = F.when(value.contains(" "), F.trim(F.regexp_replace(new, "(.{4})", "$1 "))).otherwise(new)
        return F.when(mod97(F.concat(account, country, check)) == 1, shown)

    return bound(F.replace(value, F.lit(" "), F.lit("")), use)


def pseudonym(key: str, value: Column) -> Column:
    """The pseudonym of a found value, or NULL if it is no valid one."""
    def whole(pattern: str) -> Column:
        return value.rlike(f"^(?:{pattern})$")

    return (F.when(value.contains("@"), email(key, value))
            .when(whole(IP), ip(key, value))
            .when(whole(f"{ISO_DATE}|{DOT_DATE}|{SLASH_DATE}"), date(key, value))
            .when(whole(f"{YEAR_DATE}"), date(key, value))
            .when(whole(f"{DAY_NAMED}|{MONTH_NAMED}"), named_date(key, value))
            .when(whole(PHONE), phone(key, value))
            .when(whole(SSN), ssn(key, value))
            .when(whole(IBAN), iban(key, value))
            .when(whole(CARD), card(key, value)))


def pseudonymized(docs: DataFrame, key: str = KEY) -> DataFrame:
    """One row per document: doc_id, n_found, n_replaced, text.

    Emails, IPv4 addresses, dates, telephone numbers, social security numbers,
    IBANs and card numbers are found; the valid ones are replaced by their
    pseudonyms and everything else stays as it is.  Dates are yyyy-mm-dd,
    yyyy/mm/dd, d.m.yyyy, m/d/yyyy, d/m/yyyy, or have a month's name in English,
    German, French or Spanish.  Telephone numbers are +, a country code and 6 to
    12 digits in any groups, or 3-3-4 digits.  IBANs are written in one piece or
    in groups of four.  One value in two of these forms stays one value.

    Not found: telephone numbers without a country code in other groups than
    3-3-4, or with 00 for the +; IBANs in groups with other characters than
    blanks, or of countries not in IBAN_LENGTHS in groups; dates without a year,
    with a year of two digits, or months in other languages; cards in other
    groups; social security numbers without hyphens; IPv6 addresses; digits
    other than 0-9; and names and postal addresses.

    Spaced IBANs whose check digits are wrong are searched for other values, and
    don't count as found.  NULL texts are empty.  Rows that repeat a doc_id are
    documents of their own.  An empty table gives no rows; columns other than
    doc_id and text are not read.
    """
    def cut(row: Column) -> Column:
        """Texts around the valid spaced IBANs, and those IBANs' pseudonyms."""
        pieces = F.zip_with(row["ibans"], F.slice(row["parts"], 2, F.greatest(F.size(row["parts"]) - 1, F.lit(0))),
                            lambda old, after: F.struct(old.alias("old"), iban(key, old).alias("new"), after.alias("after")))

        def step(state: Column, x: Column) -> Column:
            last = F.element_at(state, -1)
            longer = F.concat(F.slice(state, 1, F.size(state) - 1), F.array(F.concat(last, x["old"], x["after"])))
            return F.when(x["new"].isNull(), longer).otherwise(F.concat(state, F.array(x["after"])))

        return bound(pieces, lambda p: F.struct(
            F.aggregate(p, F.array(F.get(row["parts"], 0)), step).alias("texts"),
            F.filter(F.transform(p, lambda x: x["new"]), lambda new: new.isNotNull()).alias("ibans")))

    def replaced(values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(v.alias("old"), pseudonym(key, v).alias("new")))

    def rebuilt(x: Column) -> Column:
        values = x["values"]
        between = F.slice(x["parts"], 2, F.greatest(F.size(x["parts"]) - 1, F.lit(0)))
        return F.struct(
            F.size(values).cast("bigint").alias("n_found"),
            F.size(F.filter(values, lambda v: v["new"].isNotNull())).cast("bigint").alias("n_replaced"),
            F.concat(F.get(x["parts"], 0), F.array_join(F.zip_with(
                values, between, lambda v, part: F.concat(F.coalesce(v["new"], v["old"]), part)), "")).alias("text"))

    def searched(text: Column) -> Column:
        # Texts without values, which are most, are searched once.
        return bound(F.struct(text.alias("text"), F.regexp_extract_all(text, F.lit(VALUES), F.lit(0)).alias("found")), lambda x: bound(
            F.struct(F.when(F.size(x["found"]) > 0, F.split(x["text"], VALUES, -1)).otherwise(F.array(x["text"])).alias("parts"),
                     replaced(x["found"]).alias("values")), rebuilt))

    def joined(x: Column) -> Column:
        def total(name: str) -> Column:
            return F.aggregate(x["rows"], F.lit(0).cast("bigint"), lambda n, row: n + row[name]) + F.size(x["ibans"])

        rest = F.slice(x["rows"], 2, F.greatest(F.size(x["rows"]) - 1, F.lit(0)))
        return F.struct(
            total("n_found").alias("n_found"), total("n_replaced").alias("n_replaced"),
            F.concat(F.get(x["rows"], 0)["text"], F.array_join(F.zip_with(
                x["ibans"], rest, lambda new, row: F.concat(new, row["text"])), "")).alias("text"))

    spaced = texts(docs).withColumn("ibans", F.regexp_extract_all("text", F.lit(SPACED_IBAN), F.lit(0)))
    parts = F.when(F.size("ibans") > 0, F.split("text", SPACED_IBAN, -1)).otherwise(F.array("text"))
    row = bound(bound(F.struct("ibans", parts.alias("parts")), cut), lambda x: bound(
        F.struct(F.transform(x["texts"], searched).alias("rows"), x["ibans"].alias("ibans")), joined))
    return spaced.select("doc_id", row.alias("row")).select("doc_id", "row.n_found", "row.n_replaced", "row.text")


def op9_pseudonyms(spark, sf_dir: str) -> DataFrame:
    return pseudonymized(read_table(spark, sf_dir, "documents"))
