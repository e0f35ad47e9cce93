"""Unit prices, and the cheapest offer per product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# "unit" is a package of whatever the row's own ``unit`` column says.
UNITS = ("oz", "each", "ct", "unit")

# One result table of the engine covers one category in one store.
FRAME = ("category", "store_id")


def regular_per(unit: str) -> str:
    return f"regular_per_size_{unit}"


def promo_per(unit: str) -> str:
    return f"promo_per_size_{unit}"


def per_size(unit: str) -> str:
    return f"per_size_{unit}"


def pct_change(unit: str) -> str:
    return f"pct_change_regular_to_promo_size_{unit}"


def _percent_change(old: Column, new: Column) -> Column:
    return (new - old) / F.nullif(old, F.lit(0.0)) * 100


def add_unit_prices(df: DataFrame) -> DataFrame:
    """Add regular and promo price per unit and the change between them.

    Each size column that is present (size_oz, size_each, ...) gets its three
    columns.  A size or a regular price of zero gives NULL.
    """
    units = [unit for unit in UNITS if f"size_{unit}" in df.columns]
    prices, changes = {}, {}
    for unit in units:
        divisor = F.nullif(F.col(f"size_{unit}"), F.lit(0.0))
        prices[regular_per(unit)] = F.col("regular") / divisor
        prices[promo_per(unit)] = F.col("promo") / divisor
        changes[pct_change(unit)] = _percent_change(
            F.col(regular_per(unit)), F.col(promo_per(unit))
        )
    return df.withColumns(prices).withColumns(changes) if units else df


def drop_incomplete(df: DataFrame, unit: str) -> DataFrame:
    """Keep offers with every column of the result row known."""
    return df.dropna(
        subset=["description", "size", "regular", "promo", regular_per(unit), pct_change(unit)]
    )


def price_rows(df: DataFrame, unit: str) -> DataFrame:
    """One row per price of an offer: the regular one, and the promo one if above 0.

    Both rows come out of one pass over the offers.
    """
    base = [name for name in df.columns if name in (*FRAME, "description", "size", "regular", "promo")]
    priced = drop_incomplete(df, unit)
    return (
        priced.select(
            *base,
            F.explode(F.array(regular_per(unit), F.when(F.col(promo_per(unit)) > 0, F.col(promo_per(unit)))))
            .alias(per_size(unit)),
            pct_change(unit),
        )
        .filter(F.col(per_size(unit)).isNotNull())
    )


def lowest_unit_price(unit: str) -> Column:
    """The cheaper of an offer's regular price and its promo price above 0."""
    regular, promo = F.col(regular_per(unit)), F.col(promo_per(unit))
    return F.when(promo > 0, F.least(regular, promo)).otherwise(regular)


def best_price(df: DataFrame, unit: str, frame: tuple[str, ...] = FRAME) -> DataFrame:
    """The cheapest row per product description within ``frame``.

    Equal prices are decided by regular price, promo price and size text.  Both
    price rows of an offer agree in everything but the price, so the cheaper
    one is chosen per row, and the offers are combined before the shuffle: a
    product which holds a third of all rows still sends one row per task.
    """
    keys = [*frame, "description"]
    rest = ["regular", "promo", "size", pct_change(unit)]
    narrow = drop_incomplete(df, unit).select(
        *keys, lowest_unit_price(unit).alias(per_size(unit)), *rest
    )
    best = narrow.groupBy(*keys).agg(F.min(F.struct(per_size(unit), *rest)).alias("_best"))
    shown = ("size", "regular", "promo", per_size(unit), pct_change(unit))
    return best.select(*keys, *[F.col(f"_best.{name}").alias(name) for name in shown])


def cheapest_first(df: DataFrame, price: str, frame: tuple[str, ...] = ()) -> DataFrame:
    """Sort by unit price, ties in a fixed order."""
    return df.orderBy(*dict.fromkeys([*frame, price, "regular", "promo", "size", *df.columns]))


def by_description(df: DataFrame, descending: bool = False) -> DataFrame:
    """Sort by description, ties in a fixed order.

    All other columns break ties, so the rows of a frequent description can be
    sorted by several tasks.
    """
    description = F.desc("description") if descending else F.asc("description")
    return df.orderBy(description, *[name for name in df.columns if name != "description"])
