"""Expressions that read a quantity out of a free-text package size.

All of them are built-in expressions with generated code, and all give NULL
for a text that is not understood.  The callers in ``operators.sizing`` store
the shared pieces (amount, unit, words) as columns first, so that one row
splits its size text once however many expressions look at it.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfgauge.functions.units import COUNT_WORDS, OUNCES_IN

# An unsigned decimal; keeps out "10d", "1_0", "NaN" and other texts which one
# engine or another would cast to a number.
NUMBER = "([0-9]+[.]?[0-9]*|[.][0-9]+)"

# White space other than the plain space, as the inside of a character class.
OTHER_SPACE = r"\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE, INK = f"[ {OTHER_SPACE}]", f"[^ {OTHER_SPACE}]"

# A number, two words, another number: "6 ct / 1.5 fl oz".
PACK = f"^{SPACE}*{NUMBER}{SPACE}+{INK}+{SPACE}+{INK}+{SPACE}+{NUMBER}(?:{SPACE}|$)"
LAST_WORD = f"({INK}+){SPACE}*$"


def plain_number(text: Column) -> Column:
    """The number a text is, or NULL.

    Casting a text that is no number costs an exception inside, so the pattern
    is asked first.  ``text`` is a stored column: it is looked at twice.
    """
    return F.when(text.rlike(f"^{NUMBER}$"), text.try_cast("double"))


def amount_text(size: Column) -> Column:
    """Text before the first space, or the whole text if there is none."""
    return F.substring_index(size, " ", 1)


def unit_text(size: Column) -> Column:
    """Text after the first space, or the whole text if there is none."""
    return F.substr(size, F.instr(size, " ") + 1)


def unit_part(size: Column) -> Column:
    """Text after the first space, NULL if there is none."""
    return F.get(F.split(size, " ", 2), F.lit(1))


def words_of(text: Column) -> Column:
    """White-space separated words, without empty ones.

    Splitting at single spaces is several times faster than at a pattern, so
    the rare other kinds of white space are turned into spaces first.
    """
    other = f"[{OTHER_SPACE}]"
    spaced = F.when(text.rlike(other), F.regexp_replace(text, other, " ")).otherwise(text)
    return F.array_remove(F.split(spaced, " "), "")


def last_of(words: Column) -> Column:
    return F.get(words, F.array_size(words) - 1)


def first_match(branches: list[tuple[Column, Column]]) -> Column:
    """CASE over (condition, value) pairs, NULL when none holds."""
    head, *rest = branches
    case = F.when(*head)
    for condition, value in rest:
        case = case.when(condition, value)
    return case


def _in_ounces(amount: Column, unit: str) -> Column:
    return amount if unit == "oz" else amount * F.lit(OUNCES_IN[unit])


def ounces_by_text(amount: Column, unit: Column, units: tuple[str, ...]) -> Column:
    """Ounces where the unit text mentions one of ``units``, tried in order.

    Litres must be the whole unit text: "rolls" and "ml" also contain an l.
    """
    return first_match([
        (unit.isin("l", "l.") if name == "l" else unit.contains(name), _in_ounces(amount, name))
        for name in units
    ])


def count_by_text(amount: Column, unit: Column) -> Column:
    """Pieces where the unit text mentions any count word."""
    return F.when(reduce(or_, [unit.contains(word) for word in COUNT_WORDS]), amount)


def ounces_by_last_word(
    amount: Column, words: Column, last: Column, units: tuple[str, ...]
) -> Column:
    """Ounces where the last word is exactly a unit, with or without a dot.

    Ounces allow one word in between ("59 fl oz"), other units none.
    """
    length = F.array_size(words)
    return first_match([
        (
            last.isin(name, name + ".") & (length.isin(2, 3) if name == "oz" else length == 2),
            _in_ounces(amount, name),
        )
        for name in units
    ])


def count_by_last_word(amount: Column, first: Column, words: Column, last: Column) -> Column:
    """Pieces from "6 ct" or from a ``first`` word such as "20ct"."""
    glued = first.endswith("ct") & first.rlike(f"^{NUMBER}ct$")
    return F.when((last == "ct") & (F.array_size(words) == 2), amount).when(
        glued, F.replace(first, F.lit("ct"), F.lit("")).try_cast("double")
    )


def upto_count(size: Column) -> Column:
    """Text up to and including the first "ct"."""
    return F.substring(size, 1, F.instr(size, "ct") + 1)


def is_count_and_ounces(size: Column) -> Column:
    return size.contains("ct") & size.contains("oz")


def number_text(number: Column) -> Column:
    """A number as plain digits, "0.0005" and "12345678.9" included.

    The cast of a double alone writes such numbers with an exponent.
    """
    digits = F.regexp_replace(number.try_cast("decimal(38,20)").cast("string"), "0+$", "")
    return F.regexp_replace(digits, "[.]$", ".0")


def multiplied_out(size: Column) -> Column:
    """"6 ct / 1.5 fl oz" to "9.0 oz"; NULL where a number is missing."""
    count, amount = [F.regexp_extract(size, PACK, group).try_cast("double") for group in (1, 2)]
    text = F.concat(number_text(count * amount), F.lit(" "), F.regexp_extract(size, LAST_WORD, 1))
    return F.when(size.rlike(PACK), text)


def pack_total(size: Column) -> Column:
    """"4 ct / 2.5 oz" to 10.0, by dropping unit letters and spaces."""
    bare = F.replace(F.replace(F.replace(size, F.lit("ct"), F.lit("")), F.lit("oz"), F.lit("")),
                     F.lit(" "), F.lit(""))
    parts = F.split(bare, "/")
    return plain_number(F.get(parts, F.lit(0))) * plain_number(F.get(parts, F.lit(1)))
