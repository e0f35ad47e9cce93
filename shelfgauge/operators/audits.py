"""Reports that show what a category's sizes look like."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfgauge.functions import sizes
from shelfgauge.operators.joins import add_by_key
from shelfgauge.operators.ranking import UP_TO_HERE, slice_totals, sliced


def compound_sizes(df: DataFrame) -> DataFrame:
    """Offers with a size such as "4 ct / 3 oz"."""
    return df.filter(F.col("size").contains("/"))


def bare_each(df: DataFrame) -> DataFrame:
    """Offers sold as "each" without a number."""
    return df.filter(F.col("size") == "each")


def frequency(df: DataFrame, value: Column | str, name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """How often each value occurs, most frequent first; NULL is not counted."""
    value = F.col(value) if isinstance(value, str) else value
    return (
        df.select(*keys, value.alias(name))
        .filter(F.col(name).isNotNull())
        .groupBy(*keys, name)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(*keys, F.desc("n"), name)
    )


def size_frequency(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return frequency(df, "size", "size", keys)


def unit_frequency(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """How often each text after the amount occurs."""
    return frequency(df, sizes.unit_part(F.col("size")), "unit", keys)


# Reports that ``report_counts`` makes, apart from the number of rows.
ROWS = "rows"
FREQUENCIES = ("sizes", "units", "compound sizes", "compound brands", "unparsed sizes")


def report_counts(parsed: DataFrame, keys: tuple[str, ...] = ("category",)) -> DataFrame:
    """Every frequency report over a parsed table, and its rows, in one scan: keys, report, value, n.

    Rows are combined before the one shuffle.  Unknown values are not counted;
    an offer without a size that was not understood counts under "unparsed
    sizes" with an empty value.
    """
    size, amounts = F.col("size"), [F.col(c).isNull() for c in parsed.columns if c.startswith("size_")]
    compound = size.contains("/")
    unparsed = reduce(and_, amounts) if amounts else F.lit(False)
    values = (
        size, sizes.unit_part(size), F.when(compound, size), F.when(compound, F.col("brand")),
        F.when(unparsed, F.coalesce(size, F.lit(""))),
    )
    named = [F.struct(F.lit(name).alias("report"), value.alias("value")) for name, value in zip(FREQUENCIES, values)]
    listed = F.filter(F.array(*named), lambda one: one["value"].isNotNull())
    every = F.concat(listed, F.array(F.struct(F.lit(ROWS).alias("report"), F.lit(ROWS).alias("value"))))
    return parsed.select(*keys, F.inline(every)).groupBy(*keys, "report", "value").agg(F.count(F.lit(1)).alias("n"))


def report_of(counts: DataFrame, report: str, name: str, keys: tuple[str, ...] = ("category",)) -> DataFrame:
    """One frequency report out of stored ``report_counts``, most frequent value first."""
    chosen = counts.filter(F.col("report") == report).select(*keys, F.col("value").alias(name), "n")
    return chosen.orderBy(*keys, F.desc("n"), name)


def shapes(counts: DataFrame, n_columns: int, keys: tuple[str, ...] = ("category",)) -> DataFrame:
    """Rows and columns of each table, out of stored ``report_counts``."""
    rows = counts.filter(F.col("report") == ROWS)
    return rows.select(*keys, F.col("n").alias("n_rows"), F.lit(n_columns).cast("bigint").alias("n_columns"))


def distinct_units(df: DataFrame) -> DataFrame:
    return df.select(sizes.unit_part(F.col("size")).alias("unit")).distinct()


def names_a_unit(units: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """Whether any whole unit text is one of ``known``."""
    return units.agg(
        F.coalesce(F.max(F.col("unit").isin(*known)), F.lit(False)).alias("names_a_unit")
    )


def shape(df: DataFrame) -> DataFrame:
    """Number of rows and columns, as one row."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_columns", F.lit(len(df.columns)).cast("bigint")
    )


def value_counts(df: DataFrame, value: str, frame: tuple[str, ...]) -> DataFrame:
    """Stored table of each known value, how often it occurs, and its slice, per frame."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*frame, F.col(value).alias("_value"))
    return sliced(counted.agg(F.count(F.lit(1)).alias("_n")), "_value", "value-counts")


def quartiles(counted: DataFrame, frame: tuple[str, ...]) -> DataFrame:
    """Count, least, greatest and exact quartiles per frame, from ``value_counts``.

    The totals of the slices tell which slice holds a rank.  Only the values of
    these slices are put in order, at most four slices of a frame; a quartile
    between two ranks is interpolated.
    """
    shares = {"q1": 0.25, "q3": 0.75}
    totals = counted.groupBy(*frame).agg(
        F.sum("_n").alias("n"), F.min("_value").alias("least"), F.max("_value").alias("greatest")
    )

    def position(name: str) -> Column:
        return F.lit(shares[name]) * (F.col("n") - 1)

    def ranks(name: str) -> list[Column]:
        below = F.floor(position(name))
        return [F.struct(F.lit(f"{name}_below").alias("_name"), below.alias("_rank")),
                F.struct(F.lit(f"{name}_above").alias("_name"), F.least(below + 1, F.col("n") - 1).alias("_rank"))]

    sums = add_by_key(slice_totals(counted, frame, "_n"), totals, frame)
    lies_here = lambda rank: (F.col("_before") <= rank["_rank"]) & (rank["_rank"] < F.col("_before") + F.col("_sum"))
    wanted = sums.withColumn("_wanted", F.filter(F.array(*[r for name in shares for r in ranks(name)]), lies_here))
    wanted = wanted.filter(F.array_size("_wanted") > 0)
    place = (*frame, "_slice")
    within = Window.partitionBy(*place).orderBy("_value").rowsBetween(*UP_TO_HERE)
    held = add_by_key(counted, wanted, place).withColumn("_upto", F.col("_before") + F.sum("_n").over(within))
    named = held.select(*frame, "n", "least", "greatest", "_value", "_n", "_upto", F.inline("_wanted"))
    named = named.filter((F.col("_upto") - F.col("_n") <= F.col("_rank")) & (F.col("_rank") < F.col("_upto")))
    found = named.groupBy(*frame, "n", "least", "greatest").agg(*[
        F.max(F.when(F.col("_name") == f"{name}_{side}", F.col("_value"))).alias(f"{name}_{side}")
        for name in shares for side in ("below", "above")])

    def between(name: str) -> Column:
        low, high = F.col(f"{name}_below"), F.col(f"{name}_above")
        part = position(name) - F.floor(position(name))
        step = high - low
        return F.when(part >= 0.5, high - step * (1 - part)).otherwise(low + step * part)

    return found.select(
        *frame, "n", "least", "greatest", *[between(name).alias(name) for name in shares]
    )


def price_histogram(
    df: DataFrame, price: str, frame: tuple[str, ...] = ("category",),
) -> DataFrame:
    """Rows per equal-width price bin of each frame, of at least one column; bins without rows are left out.

    The bin width is the smaller of the Sturges and the Freedman-Diaconis
    width, or the former alone where the quartiles coincide.  A bin holds its
    lower edge, the last bin both edges.  ``n_bins`` counts all bins.
    """
    counted = value_counts(df, price, frame)
    n, value, n_bins = F.col("n"), F.col("_value"), F.col("n_bins")
    span = F.col("greatest") - F.col("least")
    sturges = span / (F.log2(n) + 1.0)
    freedman_diaconis = 2.0 * (F.col("q3") - F.col("q1")) / F.pow(n, F.lit(1.0 / 3.0))
    width = F.when(freedman_diaconis > 0, F.least(freedman_diaconis, sturges)).otherwise(sturges)
    one_value = span == 0
    limits = quartiles(counted, frame).select(
        *frame,
        F.when(one_value, F.lit(1)).otherwise(F.ceil(span / F.nullif(width, F.lit(0.0))))
        .cast("bigint").alias("n_bins"),
        F.when(one_value, F.col("least") - 0.5).otherwise(F.col("least")).alias("low"),
        F.when(one_value, F.col("greatest") + 0.5).otherwise(F.col("greatest")).alias("high"),
    )

    def edge(index: Column) -> Column:
        step = (F.col("high") - F.col("low")) / n_bins
        return F.when(index == n_bins, F.col("high")).otherwise(index * step + F.col("low"))

    # The quotient may be off by one at an edge; the edges themselves decide.
    quotient = F.floor((value - F.col("low")) / ((F.col("high") - F.col("low")) / n_bins))
    near = add_by_key(counted, limits, frame).withColumn("_near", F.least(quotient, n_bins - 1))
    guess = F.col("_near")
    placed = near.withColumn(
        "bin",
        F.when(value < edge(guess), guess - 1)
        .when((guess < n_bins - 1) & (value >= edge(guess + 1)), guess + 1)
        .otherwise(guess),
    )
    counts = placed.groupBy(*frame, "n_bins", "low", "high", "bin").agg(F.sum("_n").alias("n"))
    return counts.select(
        *frame, "n_bins", "bin",
        edge(F.col("bin")).alias("bin_from"),
        edge(F.col("bin") + 1).alias("bin_to"),
        "n",
    )
