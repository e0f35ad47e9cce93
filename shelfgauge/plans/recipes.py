"""The categories, as configurations of the same operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfgauge.operators import filters, repair, sizing
from shelfgauge.operators.sizing import Dialect
from shelfgauge.plans import fixed_repairs
from shelfgauge.sources.stores import MAIN_STORE, SECOND_STORE, StoreSearch


@dataclass(frozen=True)
class Recipe:
    """How one category gets from offers to its result tables.

    In this order: ``keep`` filters products, ``rewrite`` computes a size from
    description and size, the two lists of repairs replace sizes (for any
    product, and for single products), ``keep_repaired`` filters again, and
    ``dialect`` parses.  One result table per unit in ``results``.
    """

    name: str
    terms: tuple[str, ...]
    dialect: Dialect | None = None
    results: tuple[str, ...] = ()
    count_unit: str = "each"
    keep: Callable[[], Column] | None = None
    rewrite: Callable[[Column, Column], Column] | None = None
    repairs: tuple[tuple[str, str], ...] = ()
    product_repairs: tuple[tuple[str, str, str], ...] = ()
    keep_repaired: Callable[[], Column] | None = None
    drop_unsized: bool = False
    pack_brand: str | None = None
    ranked: bool = False
    stamped: bool = False
    store: StoreSearch = MAIN_STORE

    @property
    def size_columns(self) -> tuple[str, ...]:
        if self.dialect is None:
            return ()
        oz = ("size_oz",) if self.dialect.ounce_units else ()
        count = (f"size_{self.count_unit}",) if self.dialect.counts else ()
        return oz + count


TOILET_PAPER = Recipe(
    "toilet paper", ("toilet paper",),
    dialect=sizing.COUNT_TEXT, results=("each",), stamped=True,
)
VEGETABLES = Recipe(
    "vegetables", ("fresh vegetables",),
    repairs=fixed_repairs.VEGETABLE_REPAIRS,
    dialect=sizing.PRODUCE_TEXT, results=("oz", "each"), drop_unsized=True, stamped=True,
)
FRUIT = Recipe(
    "fruit", ("fruit",),
    repairs=fixed_repairs.FRUIT_REPAIRS,
    dialect=sizing.PRODUCE_TEXT, results=("oz", "each"), stamped=True,
)
MEAT = Recipe(
    "meat", ("meat",),
    product_repairs=fixed_repairs.MEAT_REPAIRS, pack_brand=fixed_repairs.PACK_BRAND,
)
COFFEE = Recipe(
    "coffee", ("whole bean coffee",),
    dialect=sizing.WEIGHT_TEXT, results=("oz",), stamped=True,
)
DECAF_COFFEE = Recipe(
    "decaf coffee", ("decaf coffee",),
    keep=lambda: filters.never_matches(F.col("description"), filters.COFFEE_PODS),
    dialect=sizing.WEIGHT_TEXT, results=("oz",), stamped=True,
)
LAUNDRY_DETERGENT = Recipe(
    "laundry detergent", ("laundry detergent",), dialect=sizing.WEIGHT_TEXT,
)
CREAMER = Recipe(
    "creamer", ("non dairy coffee creamer",),
    dialect=sizing.ANY_OUNCES_TEXT, results=("oz",), ranked=True, stamped=True,
)
MILK = Recipe(
    "milk", ("non dairy milk",),
    repairs=fixed_repairs.MILK_REPAIRS,
    dialect=sizing.LIQUID_WORDS, results=("oz",), ranked=True, stamped=True,
)
TEA = Recipe(
    "tea", ("decaf tea", "herbal tea"),
    rewrite=repair.tea_bag_size, repairs=fixed_repairs.TEA_REPAIRS,
    dialect=sizing.TEA_WORDS, results=("oz", "ct"), count_unit="ct", ranked=True,
)
SALAD_DRESSING = Recipe(
    "salad dressing", ("salad dressing",),
    rewrite=repair.multiplied_size,
    dialect=sizing.DRESSING_WORDS, results=("oz", "each"), ranked=True,
)
EGGS = Recipe(
    "eggs", ("eggs",),
    keep=lambda: filters.mentions_any_case(F.col("description"), "egg"),
    repairs=fixed_repairs.EGG_REPAIRS,
    keep_repaired=lambda: filters.sold_by_count(F.col("size")),
    dialect=sizing.COUNT_WORDS_ONLY, results=("each",), ranked=True,
    store=SECOND_STORE,
)
PEANUT_BUTTER = Recipe(
    "peanut butter", ("peanut butter",),
    keep=lambda: filters.mentions_none(F.col("description"), filters.NOT_PEANUT_BUTTER),
    repairs=fixed_repairs.PEANUT_BUTTER_REPAIRS,
    dialect=sizing.OUNCE_WORDS, results=("oz",), ranked=True,
)

RECIPES = (
    TOILET_PAPER, VEGETABLES, FRUIT, MEAT, COFFEE, DECAF_COFFEE, LAUNDRY_DETERGENT, CREAMER, MILK,
    TEA, SALAD_DRESSING, EGGS, PEANUT_BUTTER,
)

# Categories merged into one table, the earlier winning; and those put below
# each other with their own ranks.
MERGED = {"produce": (VEGETABLES, FRUIT), "all coffee": (COFFEE, DECAF_COFFEE)}
SIDE_BY_SIDE = {"creamer and milk": (CREAMER, MILK)}


def recipes_by_term() -> dict[str, Recipe]:
    return {term: recipe for recipe in RECIPES for term in recipe.terms}
