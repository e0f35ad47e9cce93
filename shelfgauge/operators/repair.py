"""Repairs of size texts before they are parsed."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfgauge.functions import sizes

TEA_BAGS = "Tea Bags|Teabags"

# Fixed lists are written into the plan and broadcast, so they stay short.
LONGEST_FIXED_LIST = 5_000


def fixed_table(spark: SparkSession, schema: str, rows: Sequence[tuple]) -> DataFrame:
    """A short constant table, evaluated in the JVM and marked for broadcast."""
    if not 0 < len(rows) <= LONGEST_FIXED_LIST:
        raise ValueError(f"a fixed table holds 1 to {LONGEST_FIXED_LIST} rows, not {len(rows)}")
    names = [column.split()[0] for column in schema.split(",")]
    listed = json.dumps([dict(zip(names, row, strict=True)) for row in rows])
    table = F.inline(F.from_json(F.lit(listed), f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>"))
    return F.broadcast(spark.range(0, 1, 1, 1).select(table))


def fixed_rules(spark: SparkSession, keys: Sequence[str], rows: Sequence[tuple]) -> DataFrame:
    """Repair rules from a literal list of (*keys, old size, new size)."""
    if len({row[:-1] for row in rows}) != len(rows):
        raise ValueError("two rules have the same key")
    columns = [f"{name} string" for name in (*keys, "old_size", "new_size")]
    return fixed_table(spark, ", ".join(columns), rows)


def checked_rules(rules: DataFrame) -> DataFrame:
    """The rules themselves, after an aggregation has shown that no two have the same key."""
    keys = [name for name in rules.columns if name != "new_size"]
    twice = rules.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").first()
    if twice is not None:
        raise ValueError(f"{twice.n} rules for {twice.asDict()}")
    return rules


def repair_by_table(df: DataFrame, rules: DataFrame, key: str = "category") -> DataFrame:
    """Replace sizes by a table of rules (``key``, description, old_size, new_size) of any length.

    A rule without a description holds for any product of its category; one
    with a description is applied first.
    """
    by_product = rules.filter(F.col("description").isNotNull())
    by_size = rules.filter(F.col("description").isNull()).drop("description")
    return repair_sizes(repair_sizes(df, by_product.select(key, "description", "old_size", "new_size")), by_size)


def repair_sizes(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Replace ``size`` where a rule matches it.

    ``rules`` holds ``old_size``, ``new_size`` and any further key columns, for
    example ``description`` or ``category``; all must match, and the keys must
    be unique.  A ``fixed_rules`` table is broadcast; Spark picks the join for
    a table of any other size.
    """
    keys = [name for name in rules.columns if name not in ("old_size", "new_size")]
    renamed = rules.select(
        *[F.col(name).alias(f"_rule_{name}") for name in keys],
        F.col("old_size").alias("_rule_size"),
        F.col("new_size").alias("_rule_new"),
    )
    matches = F.col("size") == F.col("_rule_size")
    for name in keys:
        matches &= F.col(name) == F.col(f"_rule_{name}")
    joined = df.join(renamed, matches, "left")
    return joined.withColumn("size", F.coalesce("_rule_new", "size")).select(*df.columns)


def tea_bag_size(description: Column, size: Column) -> Column:
    """Tea bags sold by count and weight keep the count: "20 ct / 1.4 oz" to "20 ct"."""
    applies = description.rlike(TEA_BAGS) & sizes.is_count_and_ounces(size)
    return F.when(applies, sizes.upto_count(size)).otherwise(size)


def multiplied_size(description: Column, size: Column) -> Column:
    """Packs become one weight: "6 ct / 1.5 fl oz" to "9.0 oz".

    A text without the two numbers keeps its size.
    """
    total = F.when(sizes.is_count_and_ounces(size), sizes.multiplied_out(size))
    return F.coalesce(total, size)


def cut_tea_bag_sizes(df: DataFrame) -> DataFrame:
    return df.withColumn("size", tea_bag_size(F.col("description"), F.col("size")))


def multiply_pack_sizes(df: DataFrame) -> DataFrame:
    return df.withColumn("size", multiplied_size(F.col("description"), F.col("size")))


def pack_total_of(brand: str) -> Column:
    """Count times ounces of one brand's compound sizes, else NULL."""
    size = F.col("size")
    applies = (F.col("brand") == brand) & size.contains("/") & sizes.is_count_and_ounces(size)
    return F.when(applies, sizes.pack_total(size))


def add_pack_total(df: DataFrame, brand: str) -> DataFrame:
    """Add ``pack_total``: count times ounces for one brand's compound sizes."""
    return df.withColumn("pack_total", pack_total_of(brand))
