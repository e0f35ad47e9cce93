"""Store lists, and the lookup of one store's id."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfgauge.sources.schemas import STORE_PAGE, parse_json, partitioned


def read_store_pages(
    spark: SparkSession, path: str, zipcode: str | None = None, whole_files: bool = False
) -> DataFrame:
    """Landed store searches, under ``zip=<zip code>/``; ``whole_files`` reads one page per file."""
    pages = spark.read.schema(partitioned(STORE_PAGE, "zip")).option("multiLine", whole_files).json(path)
    return pages if zipcode is None else pages.filter(F.col("zip") == zipcode)


def parse_store_pages(texts: DataFrame, value: str = "value") -> DataFrame:
    return parse_json(texts, STORE_PAGE, value)


def flatten_stores(pages: DataFrame) -> DataFrame:
    """One row per store with its address fields; ``place`` is the rank in its page."""
    others = [name for name in pages.columns if name != "data"]
    return pages.select(*others, F.posexplode("data").alias("place", "store")).select(
        *others,
        "place",
        F.col("store.locationId").alias("location_id"),
        F.col("store.chain").alias("chain"),
        F.col("store.address.addressLine1").alias("address_line1"),
        F.col("store.address.city").alias("city"),
    )


def first_store(stores: DataFrame, address: str, city: str, order: tuple[str, ...] = ("place",)) -> DataFrame:
    """Id of the first store, in ``order``, whose address matches a pattern in ``city``."""
    return (
        stores.filter(F.col("address_line1").rlike(address) & (F.col("city") == city))
        .orderBy(*order, "location_id")
        .limit(1)
        .select("location_id")
    )


@dataclass(frozen=True)
class StoreSearch:
    """What is known of a store whose id is looked up."""

    zipcode: str
    address: str
    city: str


# The two stores of the category searches.
MAIN_STORE = StoreSearch("80218", "1155 E 9Th Ave", "Denver")
SECOND_STORE = StoreSearch("80204", "1725 Sheridan", "Edgewater")


def find_store(spark: SparkSession, path: str, search: StoreSearch, whole_files: bool = False) -> DataFrame:
    """The store a search is for, from the landed pages of its zip code."""
    stores = flatten_stores(read_store_pages(spark, path, search.zipcode, whole_files))
    return first_store(stores, search.address, search.city)


def find_store_id(spark: SparkSession, path: str, search: StoreSearch, whole_files: bool = False) -> str:
    found = find_store(spark, path, search, whole_files).first()
    if found is None:
        raise LookupError(f"no store matches {search}")
    return found.location_id
