"""Every registered query, over the whole of the driver's tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shelfgauge.functions import sizes
from shelfgauge.functions.clock import wall_time
from shelfgauge.functions.units import OUNCES_IN
from shelfgauge.operators import audits, combine, filters, pricing, ranking, repair, sizing
from shelfgauge.operators.stamp import stamp_run
from shelfgauge.plans import fixed_repairs, jobs, recipes
from shelfgauge.sources import offers as stored
from shelfgauge.sources import pages, stores, tables
from verification import surrogate

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

RUN_AT = dt.datetime(2026, 1, 2, 3, 4, 5, tzinfo=dt.timezone.utc)


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# How the part types are priced where all categories run in one job.
CATALOGUE = {
    "ECONOMY": recipes.VEGETABLES,
    "LARGE": recipes.SALAD_DRESSING,
    "MEDIUM": recipes.TEA,
    "PROMO": recipes.TEA,
    "SMALL": recipes.EGGS,
    "STANDARD": recipes.MILK,
}

# A search for a part type's products, here standing for a search term.
SEARCHED_TERMS = ("ECONOMY", "SMALL")


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogate.offers(spark, sf_dir).drop("l_linenumber")


def sized(spark: SparkSession, sf_dir: str, dialect: sizing.Dialect, count: str = "each") -> DataFrame:
    return sizing.add_sizes(offers(spark, sf_dir), dialect, count)


def priced(spark: SparkSession, sf_dir: str, dialect: sizing.Dialect, count: str = "each") -> DataFrame:
    return pricing.add_unit_prices(sized(spark, sf_dir, dialect, count))


# Ingest

def page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.parse_pages(surrogate.landed_page_texts(spark, sf_dir))


@query
def ingest_pages_flatten(spark, sf_dir):
    return pages.flatten_pages(page_table(spark, sf_dir))


@query
def ingest_skip_error_pages(spark, sf_dir):
    """Pages, pages with products, and products per search."""
    return page_table(spark, sf_dir).groupBy("term", "store").agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.count("data").alias("n_good_pages"),
        F.sum(F.coalesce(F.array_size("data"), F.lit(0))).alias("n_products"),
    )


@query
def ingest_completeness(spark, sf_dir):
    return pages.search_completeness(page_table(spark, sf_dir))


@query
def ingest_multi_term_union(spark, sf_dir):
    found = page_table(spark, sf_dir).filter(F.col("term").isin(*SEARCHED_TERMS))
    return pages.flatten_pages(found).withColumn("category", F.lit("both"))


@query
def ingest_partition_filter(spark, sf_dir):
    """Land all pages as files in their folders, then search two terms."""
    landing = f"{tables.shared_folder(spark)}/shelfgauge/landing-{tables.unique()}"
    texts = surrogate.landed_page_texts(spark, sf_dir)
    landed = texts.select(F.lit(pages.FULFILLMENT).alias("fulfillment"), "term", "value")
    landed.hint("rebalance", "term").write.partitionBy("fulfillment", "term").text(landing)
    return pages.flatten_pages(pages.read_pages(spark, landing, SEARCHED_TERMS))


@query
def ingest_latest_run(spark, sf_dir):
    """Land all pages twice, by two runs; only those of the later one are read."""
    landing = f"{tables.shared_folder(spark)}/shelfgauge/landing-{tables.unique()}"
    texts = surrogate.landed_page_texts(spark, sf_dir)
    runs = F.explode(F.array(F.lit("2026-01-01"), F.lit("2026-01-02"))).alias("run")
    landed = texts.select(runs, F.lit(pages.FULFILLMENT).alias("fulfillment"), "term", "value")
    files = landed.hint("rebalance", "run", "term").write.partitionBy("run", "fulfillment", "term")
    # Pages are much alike, and Spark reads compressed files as it does others.
    files.option("compression", "gzip").text(landing)
    return pages.flatten_pages(pages.read_pages(spark, landing))


@query
def ingest_page_report(spark, sf_dir):
    return pages.page_report(page_table(spark, sf_dir))


def landed_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of whole searches, landed as files and read back."""
    landing = f"{tables.shared_folder(spark)}/shelfgauge/landing-{tables.unique()}"
    texts = surrogate.paged_search_texts(spark, sf_dir)
    # There are too many stores for folders; that of an error message is not known then.
    landed = texts.select(F.lit(pages.FULFILLMENT).alias("fulfillment"), "term", "value")
    landed.hint("rebalance", "term").write.partitionBy("fulfillment", "term").text(landing)
    return pages.read_pages(spark, landing)


@query
def ingest_page_gaps(spark, sf_dir):
    """Missing pages, also where another page came twice."""
    return pages.page_gaps(pages.parse_pages(surrogate.paged_search_texts(spark, sf_dir)))


@query
def ingest_page_kinds(spark, sf_dir):
    return pages.page_kinds(pages.parse_pages(surrogate.paged_search_texts(spark, sf_dir)))


@query
def ingest_quarantine(spark, sf_dir):
    """What landed in files without data, by search term and kind, and the characters of what is no JSON."""
    found = pages.quarantine(landed_searches(spark, sf_dir))
    return found.groupBy("term", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("page_file").isNull()).alias("n_without_file"),
        F.sum(F.length("page_text")).alias("n_chars"))


@query
def ingest_stored_offers(spark, sf_dir):
    """Store one run twice and another once, then read two terms of the first."""
    table = f"{tables.shared_folder(spark)}/shelfgauge/offers-{tables.unique()}"
    found = tables.written(pages.flatten_pages(page_table(spark, sf_dir)), "found")
    for run in ("2026-01-01", "2026-01-02", "2026-01-01"):
        stored.store_offers(found if run == "2026-01-01" else found.filter("regular > 0"), table, run)
    return stored.stored_offers(spark, table, "2026-01-01", SEARCHED_TERMS)


# Stores

def store_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.flatten_stores(stores.parse_store_pages(surrogate.store_documents(spark, sf_dir)))


@query
def store_flatten(spark, sf_dir):
    return store_table(spark, sf_dir).select(
        "location_id", "chain", "address_line1", "city"
    )


@query
def store_match_first(spark, sf_dir):
    return stores.first_store(
        store_table(spark, sf_dir), "#0+[1-9][0-9]*$", "ASIA", ("position", "place")
    )


@query
def store_lookup(spark, sf_dir):
    """Land all store searches under a zip code each, then look a store up in one of them."""
    landing = f"{tables.shared_folder(spark)}/shelfgauge/stores-{tables.unique()}"
    texts = surrogate.store_documents(spark, sf_dir)
    landed = texts.select((F.col("position") % 3).cast("string").alias("zip"), "value")
    landed.hint("rebalance", "zip").write.partitionBy("zip").text(landing)
    return stores.find_store(spark, landing, stores.StoreSearch("1", "#0+[1-9][0-9]*$", "ASIA"))


# Sizes

@query
def size_oz_substring(spark, sf_dir):
    return sized(spark, sf_dir, sizing.WEIGHT_TEXT)


@query
def size_each_substring(spark, sf_dir):
    return sized(spark, sf_dir, sizing.COUNT_TEXT)


@query
def size_oz_units(spark, sf_dir):
    return sized(spark, sf_dir, sizing.ANY_OUNCES_TEXT)


@query
def size_oz_exact(spark, sf_dir):
    return sized(spark, sf_dir, sizing.LIQUID_WORDS)


@query
def size_ct_exact(spark, sf_dir):
    return sized(spark, sf_dir, sizing.TEA_WORDS, "ct")


# Repairs

@query
def repair_literal(spark, sf_dir):
    rules = [
        *fixed_repairs.VEGETABLE_REPAIRS, *fixed_repairs.MILK_REPAIRS, *fixed_repairs.TEA_REPAIRS,
        *fixed_repairs.EGG_REPAIRS, *fixed_repairs.PEANUT_BUTTER_REPAIRS,
    ]
    table = repair.fixed_rules(spark, (), rules)
    return repair.repair_sizes(offers(spark, sf_dir), table)


@query
def repair_keyed(spark, sf_dir):
    table = repair.fixed_rules(spark, ("description",), fixed_repairs.MEAT_REPAIRS)
    return repair.repair_sizes(offers(spark, sf_dir), table)


@query
def repair_by_table(spark, sf_dir):
    """More rules than a fixed list holds: some products' own, some of a category's size, and many that match nothing."""
    parts = surrogate.products(spark, sf_dir)
    own = parts.filter("p_partkey % 3 = 0 and description is not null and size is not null").groupBy(
        "category", "description", F.col("size").alias("old_size")).agg(
        F.concat(F.max("p_partkey").cast("string"), F.lit(" oz")).alias("new_size"))
    orders = spark.read.schema("o_orderkey bigint").parquet(f"{sf_dir}/orders.parquet")
    idle = orders.selectExpr(
        "'ECONOMY' as category", "concat('order ', o_orderkey) as description", "'each' as old_size", "'1 ct' as new_size")
    shared = parts.filter("size like '% ct'").select(
        "category", F.lit(None).cast("string").alias("description"), F.col("size").alias("old_size"),
        F.concat(F.lit("about "), "size").alias("new_size")).distinct()
    rules = tables.written(own.union(idle).union(shared), "rules")
    return repair.repair_by_table(offers(spark, sf_dir), repair.checked_rules(rules))


@query
def repair_truncate_ct(spark, sf_dir):
    return repair.cut_tea_bag_sizes(offers(spark, sf_dir))


@query
def repair_compound(spark, sf_dir):
    return repair.multiply_pack_sizes(offers(spark, sf_dir))


@query
def repair_brand_compound(spark, sf_dir):
    return repair.add_pack_total(offers(spark, sf_dir), fixed_repairs.PACK_BRAND)


# Unit prices

@query
def unit_price_columns(spark, sf_dir):
    return priced(spark, sf_dir, sizing.PRODUCE_TEXT)


@query
def drop_incomplete(spark, sf_dir):
    return pricing.drop_incomplete(priced(spark, sf_dir, sizing.WEIGHT_TEXT), "oz")


@query
def price_rows_oz(spark, sf_dir):
    return pricing.price_rows(priced(spark, sf_dir, sizing.WEIGHT_TEXT), "oz")


@query
def best_price_oz(spark, sf_dir):
    """Flagship: cheapest price per ounce of each product of a category, ranked and sorted."""
    best = pricing.best_price(priced(spark, sf_dir, sizing.ANY_OUNCES_TEXT), "oz", ("category",))
    ranked = ranking.dense_price_rank(best, "per_size_oz", ("category",))
    return pricing.cheapest_first(ranked, "per_size_oz", ("category",))


@query
def best_price_each(spark, sf_dir):
    return pricing.best_price(priced(spark, sf_dir, sizing.COUNT_TEXT), "each")


@query
def best_price_ct(spark, sf_dir):
    return pricing.best_price(priced(spark, sf_dir, sizing.TEA_WORDS, "ct"), "ct")


# Ranks and merges

def best_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.best_price(priced(spark, sf_dir, sizing.WEIGHT_TEXT), "oz")


@query
def dense_price_rank(spark, sf_dir):
    return ranking.dense_price_rank(best_weights(spark, sf_dir), "per_size_oz")


@query
def dense_price_rank_sliced(spark, sf_dir):
    """The ranks per category alone."""
    best = best_weights(spark, sf_dir)
    return ranking.dense_price_rank(best, "per_size_oz", ("category",))


@query
def dense_price_rank_global(spark, sf_dir):
    """One rank over the whole table."""
    return ranking.dense_price_rank(best_weights(spark, sf_dir), "per_size_oz", ())


@query
def rank_frequency(spark, sf_dir):
    ranked = ranking.dense_price_rank(best_weights(spark, sf_dir), "per_size_oz", ("category",))
    return ranking.rank_frequency(ranked, ("category",))


@query
def group_mean(spark, sf_dir):
    cents = offers(spark, sf_dir).withColumn("regular", F.col("regular").cast("decimal(18,2)"))
    means = ranking.group_mean(cents, ("category", "description"), "regular", "mean_regular")
    return means.select("category", "store_id", "description", "size", "mean_regular")


@query
def combine_first_source_wins(spark, sf_dir):
    sources = [
        pricing.best_price(priced(spark, sf_dir, dialect), "oz")
        for dialect in (sizing.LIQUID_WORDS, sizing.ANY_OUNCES_TEXT)
    ]
    return combine.first_source_wins(sources, "per_size_oz")


@query
def combine_keep_ranks(spark, sf_dir):
    sources = [
        ranking.dense_price_rank(
            pricing.best_price(priced(spark, sf_dir, dialect), "oz", ("category",)),
            "per_size_oz", ("category",),
        )
        for dialect in (sizing.ANY_OUNCES_TEXT, sizing.LIQUID_WORDS)
    ]
    return combine.keep_ranks(sources, "per_size_oz")


# Reports

@query
def size_frequency(spark, sf_dir):
    return audits.size_frequency(offers(spark, sf_dir), ("category",))


@query
def unit_frequency(spark, sf_dir):
    return audits.unit_frequency(offers(spark, sf_dir), ("category",))


@query
def compound_brand_frequency(spark, sf_dir):
    return audits.frequency(audits.compound_sizes(offers(spark, sf_dir)), "brand", "brand")


@query
def compound_size_frequency(spark, sf_dir):
    return audits.size_frequency(audits.compound_sizes(offers(spark, sf_dir)))


@query
def distinct_units(spark, sf_dir):
    return audits.distinct_units(offers(spark, sf_dir))


@query
def names_a_unit(spark, sf_dir):
    return audits.names_a_unit(audits.distinct_units(offers(spark, sf_dir)), tuple(OUNCES_IN))


@query
def price_histogram(spark, sf_dir):
    return audits.price_histogram(best_weights(spark, sf_dir), "per_size_oz")


@query
def price_histogram_sliced(spark, sf_dir):
    """One histogram of the whole table."""
    whole = best_weights(spark, sf_dir).withColumn("category", F.lit("all"))
    return audits.price_histogram(whole, "per_size_oz")


@query
def frame_shape(spark, sf_dir):
    return audits.shape(offers(spark, sf_dir))


@query
def audit_unparsed(spark, sf_dir):
    table = filters.unparsed(sized(spark, sf_dir, sizing.PRODUCE_TEXT), "size_oz", "size_each")
    return table.select("category", "store_id", "description", "size")


@query
def audit_compound(spark, sf_dir):
    table = audits.compound_sizes(offers(spark, sf_dir))
    return table.select("category", "store_id", "description", "size")


@query
def audit_bare_each(spark, sf_dir):
    return audits.bare_each(offers(spark, sf_dir)).select("category", "store_id", "description", "size")


@query
def keep_any_size(spark, sf_dir):
    return filters.keep_any_size(sized(spark, sf_dir, sizing.PRODUCE_TEXT), "size_oz", "size_each")


@query
def sort_description(spark, sf_dir):
    return pricing.by_description(audits.compound_sizes(offers(spark, sf_dir)), descending=True)


@query
def report_frequencies(spark, sf_dir):
    """All frequency reports of a parsed table, and its rows, in one scan."""
    return audits.report_counts(sized(spark, sf_dir, sizing.PRODUCE_TEXT))


@query
def price_reports(spark, sf_dir):
    """How many products hold each rank of each result table of the catalogue."""
    catalogue = tables.written(jobs.price_catalogue(offers(spark, sf_dir), CATALOGUE), "catalogue")
    return jobs.price_reports(catalogue)["rank frequency"]


# Product filters

@query
def exclude_regex(spark, sf_dir):
    return offers(spark, sf_dir).filter(
        filters.mentions_none(F.col("description"), filters.NOT_PEANUT_BUTTER)
    )


@query
def exclude_findall(spark, sf_dir):
    return offers(spark, sf_dir).filter(
        filters.never_matches(F.col("description"), filters.COFFEE_PODS)
    )


@query
def contains_ci(spark, sf_dir):
    return offers(spark, sf_dir).filter(filters.mentions_any_case(F.col("description"), "egg"))


@query
def suffix_filter(spark, sf_dir):
    return offers(spark, sf_dir).filter(filters.sold_by_count(F.col("size")))


@query
def unit_part(spark, sf_dir):
    """Amount, unit and words of every distinct size text."""
    table = offers(spark, sf_dir).select("size").distinct()
    words = sizes.words_of(F.col("size"))
    return table.select(
        "size",
        sizes.amount_text(F.col("size")).alias("amount"),
        sizes.unit_part(F.col("size")).alias("unit"),
        F.array_size(words).cast("bigint").alias("n_words"),
        F.get(words, F.lit(0)).alias("first_word"),
        sizes.last_of(words).alias("last_word"),
    )


# Sink and clock

@query
def sink_roundtrip(spark, sf_dir):
    path = f"{tables.shared_folder(spark)}/shelfgauge/result-{tables.unique()}"
    best = best_weights(spark, sf_dir)
    tables.write_result(best, path)
    return tables.read_result(spark, path, best.schema)


@query
def stamp_run_rows(spark, sf_dir):
    """The stamp of a run at a stated instant, as the clock in the display zone shows it."""
    stamped = stamp_run(best_weights(spark, sf_dir), RUN_AT)
    return stamped.withColumn("runtime_mst", wall_time(F.col("runtime_mst")))


@query
def run_time_in_zone(spark, sf_dir):
    """What the clock in the display zone shows at each event."""
    events = surrogate.table(spark, sf_dir, "events")
    return events.select("event_id", wall_time(F.col("ts").cast("timestamp")).alias("wall_time"))


# Category jobs, each over all offers; a part type in a store is one frame.

def _register_category(recipe: recipes.Recipe, unit: str) -> None:
    name = recipe.name.replace(" ", "_")
    name = f"job_{name}_{unit}" if len(recipe.results) > 1 else f"job_{name}"

    def run(spark, sf_dir):
        return jobs.result(offers(spark, sf_dir), recipe, unit).drop("runtime_mst")

    QUERIES[name] = run


for _recipe in recipes.RECIPES:
    for _unit in _recipe.results:
        _register_category(_recipe, _unit)


def searched(spark: SparkSession, sf_dir: str, *members: recipes.Recipe) -> DataFrame:
    """Every offer as found by the first search of each category; part types stay the frames."""
    terms = F.array(*[F.lit(recipe.terms[0]) for recipe in members])
    return offers(spark, sf_dir).withColumn("term", F.explode(terms))


def merged(spark: SparkSession, sf_dir: str, unit: str, *members: recipes.Recipe) -> DataFrame:
    return jobs.merged(searched(spark, sf_dir, *members), members, unit, "term")


@query
def job_produce_oz(spark, sf_dir):
    return merged(spark, sf_dir, "oz", recipes.VEGETABLES, recipes.FRUIT)


@query
def job_produce_each(spark, sf_dir):
    return merged(spark, sf_dir, "each", recipes.VEGETABLES, recipes.FRUIT)


@query
def job_all_coffee(spark, sf_dir):
    return merged(spark, sf_dir, "oz", recipes.COFFEE, recipes.DECAF_COFFEE)


@query
def job_all_coffee_ranks(spark, sf_dir):
    return ranking.rank_frequency(merged(spark, sf_dir, "oz", recipes.COFFEE, recipes.DECAF_COFFEE))


@query
def job_creamer_and_milk(spark, sf_dir):
    members = (recipes.CREAMER, recipes.MILK)
    table = jobs.side_by_side(searched(spark, sf_dir, *members), members, "oz", "term")
    return table.drop("runtime_mst")


@query
def job_meat(spark, sf_dir):
    return jobs.parsed(offers(spark, sf_dir), recipes.MEAT)


@query
def job_laundry_detergent(spark, sf_dir):
    return jobs.parsed(offers(spark, sf_dir), recipes.LAUNDRY_DETERGENT)


@query
def job_all_categories(spark, sf_dir):
    return jobs.price_catalogue(offers(spark, sf_dir), CATALOGUE)


@query
def job_merge_priced(spark, sf_dir):
    """Two categories of the priced catalogue merged without reading the offers again."""
    catalogue = tables.written(jobs.price_catalogue(offers(spark, sf_dir), CATALOGUE), "catalogue")
    return jobs.merge_priced(catalogue, ("vegetables", "milk"))


@query
def catalogue_parsed(spark, sf_dir):
    return jobs.parsed_catalogue(offers(spark, sf_dir), CATALOGUE)


@query
def job_losses(spark, sf_dir):
    """What the pass over all categories read and lost, counted while it runs."""
    losses = Observation()
    jobs.price_catalogue(offers(spark, sf_dir), CATALOGUE, losses)
    return jobs.losses_table(spark, losses)


@query
def catalogue_all_recipes(spark, sf_dir):
    """All recipes in one pass: each store's offers stand for those of a search term."""
    terms = F.array(*[F.lit(term) for term in recipes.recipes_by_term()])
    found = offers(spark, sf_dir).withColumn("term", F.get(terms, (F.col("store_id") % F.array_size(terms)).cast("int")))
    return jobs.parsed_catalogue(found, recipes.recipes_by_term(), "term")


@query
def catalogue_unparsed(spark, sf_dir):
    """How many offers of each category have no size that was understood."""
    parsed = jobs.parsed_catalogue(offers(spark, sf_dir), CATALOGUE)
    unparsed = jobs.catalogue_reports(parsed)["unparsed"]
    return audits.size_frequency(unparsed, ("category",))
