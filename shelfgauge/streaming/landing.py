"""Pages that keep landing, appended to a table of offers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfgauge.operators.stamp import stamp_run
from shelfgauge.sources.pages import FULFILLMENT, PAGE_FOLDERS, flatten_pages
from shelfgauge.sources.schemas import PAGE, partitioned

FILES_PER_BATCH = 10_000


def stream_offers(
    spark: SparkSession, path: str, fulfillment: str = FULFILLMENT, files: int = FILES_PER_BATCH
) -> DataFrame:
    """Offers of pages as they land, with their run and the time they were read at.

    Every run's pages are taken; ``run`` tells them apart, and is NULL where
    pages land without a folder of their run.  Flattening a page needs no
    state, so the stream has none.
    """
    pages = (
        spark.readStream.schema(partitioned(PAGE, "run", *PAGE_FOLDERS))
        .option("maxFilesPerTrigger", files)
        .json(path)
        .filter(F.col("fulfillment") == fulfillment)
    )
    return stamp_run(flatten_pages(pages, keep=("run",)))


def append_offers(offers: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Take in what has landed since the last run, each page once, and stop."""
    return (
        offers.writeStream.format("parquet")
        .partitionBy("category")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
