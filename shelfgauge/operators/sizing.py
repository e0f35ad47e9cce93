"""Package sizes to numbers, one dialect per kind of category."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfgauge.functions import sizes

AMOUNT, UNIT, WORDS, LAST = "_amount", "_unit", "_words", "_last"
FIRST, FIRST_AMOUNT = "_first", "_first_amount"


@dataclass(frozen=True)
class Dialect:
    """How one category states its sizes.

    ``by`` is "text" (a unit name anywhere after the first space counts) or
    "last_word" (the last word must be the unit, and nothing may surround it).
    ``ounce_units`` are tried in order; ``counts`` adds pieces.
    """

    by: str
    ounce_units: tuple[str, ...] = ()
    counts: bool = False

    @property
    def ounce_side(self) -> Dialect | None:
        return replace(self, counts=False) if self.ounce_units else None

    @property
    def count_side(self) -> Dialect | None:
        return replace(self, ounce_units=()) if self.counts else None

    def ounces(self) -> Column:
        if not self.ounce_units:
            return F.lit(None).cast("double")
        if self.by == "text":
            return sizes.ounces_by_text(F.col(AMOUNT), F.col(UNIT), self.ounce_units)
        return sizes.ounces_by_last_word(
            F.col(FIRST_AMOUNT), F.col(WORDS), F.col(LAST), self.ounce_units
        )

    def pieces(self) -> Column:
        if not self.counts:
            return F.lit(None).cast("double")
        if self.by == "text":
            return sizes.count_by_text(F.col(AMOUNT), F.col(UNIT))
        return sizes.count_by_last_word(
            F.col(FIRST_AMOUNT), F.col(FIRST), F.col(WORDS), F.col(LAST)
        )


WEIGHT_TEXT = Dialect("text", ("oz", "lb"))
COUNT_TEXT = Dialect("text", counts=True)
PRODUCE_TEXT = Dialect("text", ("oz", "lb"), counts=True)
ANY_OUNCES_TEXT = Dialect("text", ("oz", "lb", "qt", "gal", "l"))
LIQUID_WORDS = Dialect("last_word", ("oz", "qt", "l", "gal"))
TEA_WORDS = Dialect("last_word", ("oz", "gal"), counts=True)
DRESSING_WORDS = Dialect("last_word", ("oz",), counts=True)
OUNCE_WORDS = Dialect("last_word", ("oz",))
COUNT_WORDS_ONLY = Dialect("last_word", counts=True)


def with_size_pieces(df: DataFrame) -> DataFrame:
    """Split ``size`` once; Catalyst drops the pieces a dialect does not read."""
    size = F.col("size")
    return df.withColumns({
        "_amount_text": sizes.amount_text(size),
        UNIT: sizes.unit_text(size),
        WORDS: sizes.words_of(size),
    }).withColumns({
        AMOUNT: sizes.plain_number(F.col("_amount_text")),
        FIRST: F.get(F.col(WORDS), F.lit(0)),
        LAST: sizes.last_of(F.col(WORDS)),
    }).withColumn(FIRST_AMOUNT, sizes.plain_number(F.col(FIRST)))


def add_parsed(df: DataFrame, parsed: dict[str, Column]) -> DataFrame:
    """Add columns parsed from the size pieces, evaluated once per row.

    The values come out of a one-row ``inline``.  As plain columns, Catalyst
    would copy the whole parser into every later filter that mentions a size
    (and through it into join conditions); it does not move filters below a
    generator, so here a filter sees a plain attribute.
    """
    row = F.struct(*[value.alias(name) for name, value in parsed.items()])
    return with_size_pieces(df).select(*df.columns, F.inline(F.array(row)))


def add_sizes(df: DataFrame, dialect: Dialect, count_unit: str = "each") -> DataFrame:
    """Add ``size_oz`` and/or ``size_<count_unit>``, as the dialect states them."""
    parsed = {}
    if dialect.ounce_units:
        parsed["size_oz"] = dialect.ounces()
    if dialect.counts:
        parsed[f"size_{count_unit}"] = dialect.pieces()
    return add_parsed(df, parsed)
