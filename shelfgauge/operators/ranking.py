"""Dense ranks and running totals over frames of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from shelfgauge.operators.joins import add_by_key
from shelfgauge.operators.pricing import FRAME
from shelfgauge.sources.tables import written

UP_TO_HERE = (Window.unboundedPreceding, Window.currentRow)

# A slice holds about so many rows, as long as the greatest number of slices allows.
SLICE_ROWS, MOST_SLICES = 100_000, 1_000


def sliced(df: DataFrame, value: str, name: str) -> DataFrame:
    """Store ``df`` and add ``_slice``, the slice of ``value`` that a row lies in; slices ascend, NULL is in the first.

    The limits are quantiles of the stored rows, found in the same pass that
    stores them, so that between two limits lie few rows and fewer values.
    """
    seen = Observation()
    shares = [i / MOST_SLICES for i in range(1, MOST_SLICES)]
    table = written(df.observe(
        seen, F.count(value).alias("n"), F.percentile_approx(value, shares, 4 * MOST_SLICES).alias("limits")), name)
    n, every = seen.get["n"], seen.get["limits"] or []
    n_slices = min(MOST_SLICES, max(2, -(-n // SLICE_ROWS)))
    limits = sorted({every[i * MOST_SLICES // n_slices - 1] for i in range(1, n_slices)}) if every else [0.0]
    below = F.filter(F.lit(limits), lambda limit: limit < F.col(value))
    return table.withColumn("_slice", F.array_size(below))


def slice_totals(rows: DataFrame, frame: tuple[str, ...], measure: str) -> DataFrame:
    """Per frame and slice: the sum of ``measure`` in the slice, and in the slices before it."""
    before = Window.partitionBy(*frame).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return rows.groupBy(*frame, "_slice").agg(F.sum(measure).alias("_sum")).withColumn(
        "_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))


def running_total(
    table: DataFrame, frame: tuple[str, ...], order: str, measure: str, name: str
) -> DataFrame:
    """Add the running sum of ``measure`` along ``order`` within ``frame``.

    (frame, order) values are unique.  The rows are range-partitioned into
    slices of even size, whatever the sizes of the frames, and stored once with
    their slice's number; each slice is summed on its own, and the sums of the
    slices before it are added.  A window holds one slice, or one row per slice.
    """
    # Stored before its two uses, so that both see the same slice limits.
    sliced = written(
        table.repartitionByRange(*frame, order).withColumn("_slice", F.spark_partition_id()),
        "slices",
    )
    place = (*frame, "_slice")
    within = Window.partitionBy(*place).orderBy(order).rowsBetween(*UP_TO_HERE)
    before = (
        Window.partitionBy(*frame).orderBy("_slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = sliced.withColumn("_inside", F.sum(measure).over(within))
    offsets = (
        sliced.groupBy(*place).agg(F.sum(measure).alias("_sum"))
        .select(*place, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    )
    return add_by_key(inside, offsets, place).select(
        *table.columns, (F.col("_inside") + F.col("_before")).alias(name)
    )


def dense_price_rank(
    df: DataFrame, price: str, frame: tuple[str, ...] = FRAME, name: str = "per_size_rank"
) -> DataFrame:
    """Add the dense rank by ``price`` within ``frame``, as a double.

    ``frame=()`` ranks the whole table.  The rank is a running count of the
    distinct prices, joined back to the rows: prices are counted along each
    slice, and the counts of the slices before are added.  A window holds the
    prices of one slice, or one row per slice, whatever the size of the table
    or of a frame.
    """
    table = sliced(df, price, "ranked")
    place = (*frame, "_slice")
    prices = table.select(*place, price).distinct().withColumn("_one", F.lit(1))
    within = Window.partitionBy(*place).orderBy(price).rowsBetween(*UP_TO_HERE)
    inside = prices.withColumn("_inside", F.sum("_one").over(within))
    totals = slice_totals(prices, frame, "_one")
    ranks = add_by_key(inside, totals, place).select(
        *frame, price, (F.col("_inside") + F.col("_before")).cast("double").alias(name))
    return add_by_key(table.drop("_slice"), ranks, (*frame, price))


def rank_frequency(ranked: DataFrame, keys: tuple[str, ...] = (), rank: str = "per_size_rank") -> DataFrame:
    """Rows per rank, in rank order."""
    counts = ranked.groupBy(*keys, rank).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(*keys, rank)


def group_mean(df: DataFrame, keys: tuple[str, ...], value: str, name: str) -> DataFrame:
    """Add the mean of ``value`` over rows of equal ``keys`` to each row.

    The means are combined before the shuffle and joined back, so a hot key
    never lies in one window; ``df`` is read twice.  A decimal ``value`` is
    summed exactly, in any order.
    """
    means = df.groupBy(*keys).agg((F.sum(value).cast("double") / F.count(value)).alias(name))
    return add_by_key(df, means, keys)
