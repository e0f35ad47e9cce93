"""Jobs: one category, merged categories, and all categories in one pass."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shelfgauge.functions.sizes import first_match
from shelfgauge.operators import audits, combine, filters, pricing, ranking, repair, sizing
from shelfgauge.operators.pricing import FRAME
from shelfgauge.operators.stamp import stamp_run
from shelfgauge.plans.recipes import Recipe, recipes_by_term
from shelfgauge.sources.pages import flatten_pages, product_search, read_pages
from shelfgauge.sources.stores import StoreSearch, find_store_id
from shelfgauge.sources.tables import written


def search(
    spark: SparkSession, pages: str, stores: str, recipe: Recipe,
    whole_files: bool = False, run: str | None = None,
) -> DataFrame:
    """A category's offers in its store, from landed pages; all its terms become one table."""
    store = find_store_id(spark, stores, recipe.store, whole_files)
    found = product_search(spark, pages, recipe.terms, store, whole_files, run)
    return found.withColumn("category", F.lit(recipe.name))


def searched_pages(
    spark: SparkSession, pages: str, stores: str, whole_files: bool = False, run: str | None = None
) -> DataFrame:
    """The landed pages of all categories, each from its own store, in one scan."""
    terms_of: dict[StoreSearch, list[str]] = {}
    for term, recipe in recipes_by_term().items():
        terms_of.setdefault(recipe.store, []).append(term)
    wanted = reduce(or_, [
        F.col("term").isin(*terms) & (F.col("store") == find_store_id(spark, stores, store, whole_files))
        for store, terms in terms_of.items()
    ])
    return read_pages(spark, pages, list(recipes_by_term()), whole_files=whole_files, run=run).filter(wanted)


def search_all(
    spark: SparkSession, pages: str, stores: str, whole_files: bool = False, run: str | None = None
) -> DataFrame:
    """The offers of all categories; ``category`` holds the search term."""
    return flatten_pages(searched_pages(spark, pages, stores, whole_files, run))


def repaired(offers: DataFrame, recipe: Recipe) -> DataFrame:
    """The category's products with their size texts put right."""
    spark = offers.sparkSession
    df = offers.filter(recipe.keep()) if recipe.keep else offers
    if recipe.rewrite:
        df = df.withColumn("size", recipe.rewrite(F.col("description"), F.col("size")))
    if recipe.product_repairs:
        rules = repair.fixed_rules(spark, ("description",), recipe.product_repairs)
        df = repair.repair_sizes(df, rules)
    if recipe.repairs:
        df = repair.repair_sizes(df, repair.fixed_rules(spark, (), recipe.repairs))
    if recipe.keep_repaired:
        df = df.filter(recipe.keep_repaired())
    return repair.add_pack_total(df, recipe.pack_brand) if recipe.pack_brand else df


def parsed(offers: DataFrame, recipe: Recipe) -> DataFrame:
    """The repaired products with their sizes as numbers."""
    df = repaired(offers, recipe)
    if recipe.dialect is None:
        return df
    df = sizing.add_sizes(df, recipe.dialect, recipe.count_unit)
    return filters.keep_any_size(df, *recipe.size_columns) if recipe.drop_unsized else df


def result(
    offers: DataFrame, recipe: Recipe, unit: str, frame: tuple[str, ...] = FRAME
) -> DataFrame:
    """A category's result table for one unit."""
    best = pricing.best_price(pricing.add_unit_prices(parsed(offers, recipe)), unit, frame)
    if recipe.ranked:
        best = ranking.dense_price_rank(best, pricing.per_size(unit), frame)
    return stamp_run(best) if recipe.stamped else best


def best_of_members(
    offers: DataFrame, members: tuple[Recipe, ...], unit: str, term: str, frame: tuple[str, ...]
) -> DataFrame:
    """Result rows of related categories from one scan and one shuffle; ``_source`` is the category's place in ``members``."""
    by_term = {name: recipe for recipe in members for name in recipe.terms}
    parsed = parsed_catalogue(offers, by_term, term)
    if unit != "oz":
        counted = F.when(F.col("count_unit") == unit, F.col("size_count"))
        parsed = parsed.withColumn(f"size_{unit}", counted).drop("size_oz")
    names = [recipe.name for recipe in members]
    source = F.array_position(F.lit(names), F.col(term)).alias("_source")
    shown = [name for name in frame if name != term]
    sized = parsed.select(source, term, *shown, "description", "size", "regular", "promo", f"size_{unit}")
    best = pricing.best_price(pricing.add_unit_prices(sized), unit, ("_source", *frame) if term in frame else ("_source", term, *frame))
    return best if term in frame else best.drop(term)


def merged(
    offers: DataFrame, members: tuple[Recipe, ...], unit: str, term: str = "category", frame: tuple[str, ...] = FRAME
) -> DataFrame:
    """Result tables of related categories as one, ranked anew; earlier categories win.

    ``term`` is the column of the offers that holds the search term.
    """
    price = pricing.per_size(unit)
    merged_frame = tuple(name for name in frame if name != term)
    best = best_of_members(offers, members, unit, term, frame)
    return ranking.dense_price_rank(combine.least_source(best, price, merged_frame), price, merged_frame)


def side_by_side(
    offers: DataFrame, members: tuple[Recipe, ...], unit: str, term: str = "category", frame: tuple[str, ...] = FRAME
) -> DataFrame:
    """Result tables of related categories below each other, each row with its own category's rank."""
    price = pricing.per_size(unit)
    best = best_of_members(offers, members, unit, term, frame)
    ranked = ranking.dense_price_rank(best, price, ("_source", *frame)).drop("_source")
    if all(recipe.stamped for recipe in members):
        ranked = stamp_run(ranked)
    return pricing.cheapest_first(ranked, price)


def parsed_catalogue(
    offers: DataFrame, recipes: dict[str, Recipe], term: str = "category", rules: DataFrame | None = None
) -> DataFrame:
    """Every category's products, repaired and parsed, in one pass without a shuffle.

    ``recipes`` maps each value of the column ``term`` (a search term) to its recipe;
    it holds the recipe's name afterwards.  ``size_count`` counts in ``count_unit``.
    ``rules`` (``term``, description, old_size, new_size), if given, takes the
    place of the recipes' own repairs; there may be any number of them.

    A short table gives each row the number of its recipe.  Recipes that agree
    in a step share its branch, so the generated code stays small enough for
    the JVM to compile, however many categories there are.
    """
    spark = offers.sparkSession
    members = list({recipe.name: recipe for recipe in recipes.values()}.values())
    number = {recipe.name: i for i, recipe in enumerate(members)}
    plan = repair.fixed_table(
        spark,
        f"{term} string, _recipe int, _name string, count_unit string",
        [(searched, number[r.name], r.name, r.count_unit) for searched, r in recipes.items()],
    )

    def belongs(group: list[Recipe]) -> Column:
        return F.col("_recipe").isin([number[recipe.name] for recipe in group])

    def kept(df: DataFrame, rule: Callable[[Recipe], Callable[[], Column] | None]) -> DataFrame:
        for condition, group in _grouped(members, rule):
            df = df.filter(~belongs(group) | condition())
        return df

    def chosen(value: Callable[[Recipe], object], column: Callable[[object], Column]) -> Column:
        cases = [(belongs(group), column(key)) for key, group in _grouped(members, value)]
        return first_match(cases) if cases else F.lit(None).cast("double")

    df = kept(offers.join(plan, term), lambda recipe: recipe.keep)
    rewrites = [
        (belongs(group), rewrite(F.col("description"), F.col("size")))
        for rewrite, group in _grouped(members, lambda recipe: recipe.rewrite)
    ]
    if rewrites:
        df = df.withColumn("size", first_match(rewrites).otherwise(F.col("size")))
    by_product = [
        (searched, *rule) for searched, recipe in recipes.items() for rule in recipe.product_repairs
    ]
    if rules is not None:
        df = repair.repair_by_table(df, repair.checked_rules(rules), term)
        by_product = []
    if by_product:
        df = repair.repair_sizes(df, repair.fixed_rules(spark, (term, "description"), by_product))
    by_size = [(searched, *rule) for searched, recipe in recipes.items() for rule in recipe.repairs]
    if by_size and rules is None:
        df = repair.repair_sizes(df, repair.fixed_rules(spark, (term,), by_size))
    df = kept(df, lambda recipe: recipe.keep_repaired)

    packs = [(belongs(group), repair.pack_total_of(brand))
             for brand, group in _grouped(members, lambda recipe: recipe.pack_brand)]
    if packs:
        df = df.withColumn("pack_total", first_match(packs))

    sized = sizing.add_parsed(df, {
        "size_oz": chosen(lambda r: r.dialect and r.dialect.ounce_side, lambda d: d.ounces()),
        "size_count": chosen(lambda r: r.dialect and r.dialect.count_side, lambda d: d.pieces()),
    })
    others = [name for name in offers.columns if name != term]
    others += ["pack_total"] if packs else []
    return sized.select(
        F.col("_name").alias(term), *others, "size_oz", "size_count", "count_unit"
    )


def _grouped(members: list[Recipe], key: Callable[[Recipe], object]) -> list[tuple[object, list[Recipe]]]:
    """Recipes by what ``key`` gives for them, without those it gives nothing for."""
    groups: dict[object, list[Recipe]] = {}
    for recipe in members:
        if key(recipe):
            groups.setdefault(key(recipe), []).append(recipe)
    return list(groups.items())


def price_parsed(parsed: DataFrame) -> DataFrame:
    """Result rows of a parsed catalogue, in one shuffle.

    Rows carry the unit of their price; all are ranked within category, store
    and unit.
    """
    packages = F.array(
        F.struct(F.lit("oz").alias("unit"), F.col("size_oz").alias("size_unit")),
        F.struct(F.col("count_unit").alias("unit"), F.col("size_count").alias("size_unit")),
    )
    sized = parsed.select(*FRAME, "description", "size", "regular", "promo", F.inline(packages))
    frame = (*FRAME, "unit")
    best = pricing.best_price(pricing.add_unit_prices(sized), "unit", frame)
    return ranking.dense_price_rank(best, pricing.per_size("unit"), frame)


def unknown_categories(offers: DataFrame, recipes: dict[str, Recipe]) -> DataFrame:
    """Offers per category that has no recipe, and that ``parsed_catalogue`` therefore leaves out."""
    known = F.coalesce(F.col("category").isin(*recipes), F.lit(False))
    return offers.where(~known).groupBy("category").agg(F.count(F.lit(1)).alias("n_offers"))


def priced_names(recipes: dict[str, Recipe]) -> list[str]:
    """Names of the categories that have result tables."""
    return sorted({recipe.name for recipe in recipes.values() if recipe.results})


def price_catalogue(
    offers: DataFrame, recipes: dict[str, Recipe], losses: Observation | None = None
) -> DataFrame:
    """Every category's result rows in one pass over the offers and one shuffle.

    ``losses`` is told what the pass loses, when the result is first computed.
    """
    priced = {term: recipe for term, recipe in recipes.items() if recipe.results}
    parsed = parsed_catalogue(offers, priced)
    return price_parsed(counting_losses(parsed, losses) if losses else parsed)


def counting_losses(parsed: DataFrame, losses: Observation) -> DataFrame:
    """Count, in whatever job computes ``parsed`` first, its offers and those that get no unit price, by reason.

    Offers are read once: the metrics come with the job's own pass.
    """
    amount = F.coalesce(F.nullif(F.col("size_oz"), F.lit(0.0)), F.nullif(F.col("size_count"), F.lit(0.0)))
    known = F.col("description").isNotNull() & F.col("promo").isNotNull() & (F.col("regular") != 0)
    return parsed.observe(
        losses,
        F.count(F.lit(1)).alias("n_offers"),
        F.count_if(F.col("size_oz").isNull() & F.col("size_count").isNull()).alias("n_unparsed"),
        F.count_if(F.col("regular").isNull() | F.col("promo").isNull()).alias("n_without_price"),
        F.count_if(~F.coalesce(known & amount.isNotNull(), F.lit(False))).alias("n_dropped"),
    )


def losses_table(spark: SparkSession, losses: Observation) -> DataFrame:
    """The counts of a finished pass, as one row."""
    counts = losses.get
    return spark.range(1).select(*[F.lit(n).cast("bigint").alias(name) for name, n in counts.items()])


def catalogue_reports(parsed: DataFrame) -> dict[str, DataFrame]:
    """What the sizes of a stored parsed catalogue look like, per category.

    All frequencies come out of one scan, whose counts are stored.
    """
    by = ("category",)
    counts = written(audits.report_counts(parsed, by), "report-counts")
    compound = audits.compound_sizes(parsed)
    return {
        "sizes": audits.report_of(counts, "sizes", "size", by),
        "units": audits.report_of(counts, "units", "unit", by),
        "compound": pricing.by_description(compound, descending=True),
        "compound sizes": audits.report_of(counts, "compound sizes", "size", by),
        "compound brands": audits.report_of(counts, "compound brands", "brand", by),
        "unparsed sizes": audits.report_of(counts, "unparsed sizes", "size", by),
        "shapes": audits.shapes(counts, len(parsed.columns), by),
        "bare each": audits.bare_each(parsed),
        "unparsed": filters.unparsed(parsed, "size_oz", "size_count"),
    }


def price_reports(catalogue: DataFrame) -> dict[str, DataFrame]:
    """How the unit prices and ranks of a stored priced catalogue are spread, per result table."""
    frame = (*FRAME, "unit")
    return {
        "histogram": audits.price_histogram(catalogue, pricing.per_size("unit"), frame),
        "rank frequency": ranking.rank_frequency(catalogue, frame),
    }


def merge_priced(catalogue: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Related categories of a priced catalogue as one, ranked anew; earlier names win.

    Starts from the result rows, so the offers are not read again.
    """
    price, frame = pricing.per_size("unit"), ("store_id", "unit")
    tables = [catalogue.filter(F.col("category") == name).drop("per_size_rank") for name in names]
    return ranking.dense_price_rank(combine.first_source_wins(tables, price, frame), price, frame)
