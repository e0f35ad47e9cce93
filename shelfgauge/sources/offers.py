"""Offers kept as a table between runs, so that a page's JSON is parsed once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OFFERS = (
    "run string, category string, store_id string, description string, brand string, size string, "
    "regular double, promo double"
)


def store_offers(offers: DataFrame, table: str, run: str) -> None:
    """Store the offers of one run, by run and search term.

    Storing a run again replaces what it had of the same terms and nothing
    else.  The rebalance hint gathers a term's offers into few files and
    splits a term too large for one task.
    """
    kept = offers.withColumn("run", F.lit(run)).select(*[column.split()[0] for column in OFFERS.split(", ")])
    (
        kept.hint("rebalance", "category")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run", "category")
        .parquet(table)
    )


def stored_offers(
    spark: SparkSession, table: str, run: str | None = None, terms: Sequence[str] = (), store: str | None = None
) -> DataFrame:
    """Offers of a run, or of all runs; only the folders of the run and terms are read."""
    offers = spark.read.schema(OFFERS).parquet(table)
    if run is not None:
        offers = offers.filter(F.col("run") == run)
    if terms:
        offers = offers.filter(F.col("category").isin(*terms))
    return offers if store is None else offers.filter(F.col("store_id") == store)
