"""Landed search result pages to offers.

Pages land as JSON lines under ``run=<run>/fulfillment=<mode>/term=<term>/store=<store>/``;
where there are too many stores for folders, ``store`` is a field of the page, and
without runs to tell apart the first folder may be left out.  All pages of all
searches are read as one table: only the folders of the wanted run and terms are
listed, and the pages of a search need no appending.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfgauge.sources.schemas import PAGE, UNREADABLE, parse_json, partitioned
from shelfgauge.sources.tables import hadoop_folder

# Fixed value: the fulfilment mode searched for, pick-up at the store.
FULFILLMENT = "csp"

PAGE_FOLDERS = ("fulfillment", "term", "store")

# Fixed value: products that a full page lists.
PAGE_SIZE = 50
# A file may say where its page begins, for example "start=50.json".
START_IN_FILE = r"start[=_-]?(\d+)[^/]*$"

# How runs are named: a number, or a day with or without a time.
RUN_FORMATS = (r"\d+", r"\d{4}-\d{2}-\d{2}", r"\d{4}-?\d{2}-?\d{2}T\d{2}[:-]?\d{2}[:-]?\d{2}Z?")

# Kinds of what lands as a page.
GOOD, ERROR, NOT_JSON = "page", "error page", "unreadable"


def read_pages(
    spark: SparkSession,
    path: str,
    terms: Sequence[str] = (),
    store: str | None = None,
    fulfillment: str = FULFILLMENT,
    whole_files: bool = False,
    run: str | None = None,
) -> DataFrame:
    """Pages of the given searches, with their ``page_file``.

    A line that is not JSON becomes a page without data, and stands in ``unreadable``.
    ``whole_files`` reads one page per file, for pages printed over several lines.
    ``run`` is the run that landed the pages, the latest one by default.  Spark
    raises an error if nothing has landed for any of the terms.
    """
    run = run or latest_run(spark, path)
    root = f"{path}/run={run}" if run else path
    pages = (
        spark.read.schema(partitioned(PAGE, *PAGE_FOLDERS))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", UNREADABLE)
        .option("multiLine", whole_files)
        .option("basePath", root)
        .json(f"{root}/fulfillment={fulfillment}{term_folders(terms)}")
        .select("*", F.col("_metadata.file_path").alias("page_file"))
        .filter(F.col("fulfillment") == fulfillment)
    )
    if terms:
        pages = pages.filter(F.col("term").isin(*terms))
    if store is not None:
        pages = pages.filter(F.col("store") == store)
    return pages


def latest_run(spark: SparkSession, path: str) -> str | None:
    """The newest run, or None where pages land without a folder of their run.

    Numbers are compared as numbers, days and times as text.  Names of more
    than one format, or of none, have no order, and pages beside the folders of
    runs belong to none: both raise an error, and the run has to be stated.
    """
    names = folder_names(spark, path)
    runs = [name.removeprefix("run=") for name in names if name.startswith("run=")]
    if not runs:
        return None
    beside = [name for name in names if name.startswith("fulfillment=")]
    formats = {next((i for i, one in enumerate(RUN_FORMATS) if re.fullmatch(one, run)), None) for run in runs}
    if beside or None in formats or len(formats) > 1:
        raise ValueError(f"state the run to read: {path} holds {', '.join(sorted(names)[:10])}")
    return max(runs, key=int) if formats == {0} else max(runs)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder of any file system that Spark reads."""
    file_system, folder = hadoop_folder(spark, path)
    return [status.getPath().getName() for status in file_system.listStatus(folder)]


def term_folders(terms: Sequence[str]) -> str:
    """The folders of the terms as a path pattern; nothing if a term has characters that folders escape."""
    if not terms or not all(re.fullmatch(r"[\w -]+", term) for term in terms):
        return ""
    return f"/term={{{','.join(terms)}}}"


def parse_pages(texts: DataFrame, value: str = "value") -> DataFrame:
    """Pages held as JSON text in a column; a text that is not JSON gives no data."""
    return parse_json(texts, PAGE, value)


def flatten_pages(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per listed product, with the first of its items and the columns of its page in ``keep``.

    Pages without data give no rows.  A product without items or without a
    price keeps its row, with NULL for what is missing.
    """
    item = F.get(F.col("product.items"), F.lit(0))
    return pages.select(*keep, "term", "store", F.explode("data").alias("product")).select(
        *keep,
        F.col("term").alias("category"),
        F.col("store").alias("store_id"),
        "product.description",
        "product.brand",
        item["size"].alias("size"),
        item["price"]["regular"].alias("regular"),
        item["price"]["promo"].alias("promo"),
    )


def product_search(
    spark: SparkSession, path: str, terms: Sequence[str], store: str,
    whole_files: bool = False, run: str | None = None,
) -> DataFrame:
    """Offers found for one or more search terms in one store."""
    return flatten_pages(read_pages(spark, path, terms, store, whole_files=whole_files, run=run))


def search_completeness(pages: DataFrame) -> DataFrame:
    """Products announced and received per search, to find pages that are missing."""
    return pages.groupBy("term", "store").agg(
        F.max("meta.pagination.total").alias("announced"),
        F.sum(F.coalesce(F.array_size("data"), F.lit(0))).alias("received"),
    )


def page_report(pages: DataFrame) -> DataFrame:
    """What was lost per search: products announced and received, pages without data, products without a price.

    A page printed over several lines, but read line by line, counts as so many without data.
    """
    product_price = F.filter("data", lambda product: F.get(product["items"], F.lit(0))["price"]["regular"].isNull())
    return pages.groupBy("term", "store").agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.count_if(F.col("data").isNull()).alias("n_without_data"),
        F.max("meta.pagination.total").alias("announced"),
        F.sum(F.coalesce(F.array_size("data"), F.lit(0))).alias("received"),
        F.sum(F.coalesce(F.array_size(product_price), F.lit(0))).alias("n_without_price"),
    )


def page_kind(pages: DataFrame) -> Column:
    """What landed: a page with data, JSON without data such as an error message, or text that is not JSON."""
    unreadable = F.col(UNREADABLE).isNotNull()
    return F.when(F.col("data").isNotNull(), GOOD).when(unreadable, NOT_JSON).otherwise(ERROR)


def page_kinds(pages: DataFrame) -> DataFrame:
    """How many landed texts of each kind a search has."""
    kinds = pages.select("term", "store", page_kind(pages).alias("kind"))
    return kinds.groupBy("term", "store").agg(
        F.count_if(F.col("kind") == GOOD).alias("n_pages"),
        F.count_if(F.col("kind") == ERROR).alias("n_error_pages"),
        F.count_if(F.col("kind") == NOT_JSON).alias("n_unreadable"),
    )


def quarantine(pages: DataFrame) -> DataFrame:
    """What landed without data: search, kind, file, and the text where it is not JSON."""
    file = F.col("page_file") if "page_file" in pages.columns else F.lit(None).cast("string")
    found = pages.select("term", "store", page_kind(pages).alias("kind"), file.alias("page_file"),
                         F.col(UNREADABLE).alias("page_text"))
    return found.filter(F.col("kind") != GOOD)


def page_start(pages: DataFrame) -> Column:
    """Where a page begins among the products of its search: its own field, or else its file's name; NULL if neither says."""
    told = F.col("meta.pagination.start")
    if "page_file" not in pages.columns:
        return told
    named = F.regexp_extract("page_file", START_IN_FILE, 1)
    return F.coalesce(told, F.when(named != "", named.cast("bigint")))


def page_gaps(pages: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """Pages that are missing or short: term, store, start, expected and received products.

    A search that announces n products has pages at 0, 50, ... below n, and each
    must have landed with data; a page that came twice fills one place only.
    The first page must be there in any case; ``expected`` is NULL if no page
    told how many products there are.  A search with pages that tell no start
    gets one row without a start if it received fewer products than announced.
    """
    starts = pages.select(
        "term", "store", page_start(pages).alias("start"), F.col("meta.pagination.total").alias("total"),
        F.array_size("data").cast("bigint").alias("n"))
    # Both uses read one aggregation: first by page, then from that by search.
    landed = starts.groupBy("term", "store", "start").agg(
        F.max("n").alias("received"), F.sum("n").alias("n_all"), F.max("total").alias("total"))
    searches = landed.groupBy("term", "store").agg(
        F.max("total").alias("announced"), F.sum("n_all").alias("n_all"),
        F.count_if(F.col("start").isNull() & F.col("received").isNotNull()).alias("n_unplaced"))
    last = F.greatest(F.coalesce(F.col("announced"), F.lit(1)) - 1, F.lit(0))
    places = searches.filter("n_unplaced = 0").select(
        "term", "store", "announced", F.explode(F.sequence(F.lit(0).cast("bigint"), last, F.lit(page_size).cast("bigint")))
        .alias("start"))
    found = landed.filter("received is not null and start is not null").select("term", "store", "start", "received")
    expected = F.least(F.col("announced") - F.col("start"), F.lit(page_size).cast("bigint"))
    gaps = places.join(found, ["term", "store", "start"], "left").select(
        "term", "store", "start", F.when(F.col("announced").isNotNull(), expected).alias("expected"),
        F.col("received").alias("_held"))
    gaps = gaps.filter(F.col("_held").isNull() | (F.col("_held") < F.col("expected")))
    unplaced = searches.filter((F.col("n_unplaced") > 0) & (F.col("n_all") < F.col("announced"))).select(
        "term", "store", F.lit(None).cast("bigint").alias("start"), F.col("announced").alias("expected"),
        F.col("n_all").alias("_held"))
    return gaps.union(unplaced).select(
        "term", "store", "start", "expected", F.coalesce("_held", F.lit(0).cast("bigint")).alias("received"))
