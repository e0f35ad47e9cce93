"""Merging the result tables of related categories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfgauge.operators.pricing import FRAME, cheapest_first


def union_all(tables: list[DataFrame]) -> DataFrame:
    """All rows of all tables; a column some table lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def first_source_wins(
    tables: list[DataFrame], price: str, frame: tuple[str, ...] = FRAME
) -> DataFrame:
    """Merge tables; of rows equal in description and size the earliest table's stays."""
    placed = union_all([
        table.withColumn("_source", F.lit(place)) for place, table in enumerate(tables)
    ])
    return least_source(placed, price, frame).select(*tables[0].columns)


def least_source(table: DataFrame, price: str, frame: tuple[str, ...] = FRAME) -> DataFrame:
    """Of rows equal in description and size, the one with the least ``_source``, which is then dropped.

    Rows are combined before the shuffle, so no group is gathered in one task.
    Within one source the cheapest row stays.
    """
    keys = [*frame, "description", "size"]
    rest = [c for c in table.columns if c not in keys and c not in (price, "_source")]
    first = table.groupBy(*keys).agg(F.min(F.struct("_source", price, *rest)).alias("_first"))
    return first.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in (price, *rest)]).select(
        *[c for c in table.columns if c != "_source"])


def keep_ranks(tables: list[DataFrame], price: str) -> DataFrame:
    """All rows of ranked tables by price; each row keeps the rank of its own table."""
    return cheapest_first(union_all(tables), price)
