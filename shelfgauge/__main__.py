"""Price all categories: ``spark-submit`` this, or ``python -m shelfgauge <pages> <stores> <out>``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shelfgauge.operators import combine
from shelfgauge.operators.stamp import stamp_run
from shelfgauge.plans import jobs, recipes
from shelfgauge.session import build_session
from shelfgauge.sources import tables
from shelfgauge.sources.offers import store_offers, stored_offers
from shelfgauge.sources.pages import flatten_pages, latest_run, page_gaps, page_report, quarantine


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="shelfgauge", description=__doc__)
    parser.add_argument("pages", help="folder of landed search result pages")
    parser.add_argument("stores", help="folder of landed store searches")
    parser.add_argument("out", help="folder for the result tables")
    parser.add_argument("--reports", action="store_true", help="also store the parsed offers and reports on them")
    parser.add_argument("--show", action="store_true", help="also print the tables")
    parser.add_argument("--run", help="the run that landed the pages (default: the latest)")
    parser.add_argument("--whole-files", action="store_true", help="a file holds one page, printed over several lines")
    parser.add_argument("--complete", action="store_true", help="fail if a page of a search is missing or short")
    parser.add_argument("--offers", help="keep the run's offers in this table, and price from it")
    parser.add_argument("--master", help="Spark master, if not set by spark-submit")
    options = parser.parse_args(arguments)

    spark = build_session(options.master)
    with tables.own_folder(spark):
        price_all(spark, options)


def price_all(spark: SparkSession, options: argparse.Namespace) -> None:
    run = options.run or latest_run(spark, options.pages)
    found = jobs.searched_pages(spark, options.pages, options.stores, options.whole_files, run)
    if options.complete:
        gaps = page_gaps(found)
        if not gaps.isEmpty():
            tables.show_result(gaps)
            raise SystemExit("pages are missing")
    offers = flatten_pages(found)
    if options.offers:
        if run is None:
            raise SystemExit("offers are stored by run: let pages land under run=<run>, or state --run")
        store_offers(offers, options.offers, run)
        offers = stored_offers(spark, options.offers, run).drop("run")
    by_term = recipes.recipes_by_term()
    losses = Observation("losses")

    def report(name: str, table: DataFrame, by: str = "category") -> None:
        tables.write_result(table, f"{options.out}/reports/{name.replace(' ', '_')}", by)

    if options.reports:
        parsed = jobs.counting_losses(jobs.parsed_catalogue(offers, by_term), losses)
        tables.write_result(parsed, f"{options.out}/offers")
        parsed = tables.read_result(spark, f"{options.out}/offers", parsed.schema)
        for name, table in jobs.catalogue_reports(parsed).items():
            report(name, table)
        report("searches", page_report(found), by="term")
        report("quarantine", quarantine(found), by="term")
        report("unknown categories", jobs.unknown_categories(offers, by_term))
        priced = jobs.price_parsed(parsed.filter(F.col("category").isin(*jobs.priced_names(by_term))))
    else:
        priced = jobs.price_catalogue(offers, by_term, losses)
    priced = stamp_run(priced)
    tables.write_result(priced, f"{options.out}/prices")
    catalogue = tables.read_result(spark, f"{options.out}/prices", priced.schema)
    counts = losses.get
    print("offers: " + ", ".join(f"{name.removeprefix('n_').replace('_', ' ')} {n:,}" for name, n in counts.items()))
    if options.reports:
        jobs.losses_table(spark, losses).write.mode("overwrite").parquet(f"{options.out}/reports/losses")
        for name, table in jobs.price_reports(catalogue).items():
            report(name, table)

    results = {"prices": catalogue}
    for name, members in recipes.MERGED.items():
        results[name] = jobs.merge_priced(catalogue, tuple(member.name for member in members))
    for name, members in recipes.SIDE_BY_SIDE.items():
        listed = [catalogue.filter(F.col("category") == member.name) for member in members]
        results[name] = combine.union_all(listed)
    for name, result in results.items():
        if name != "prices":
            tables.write_result(result, f"{options.out}/{name.replace(' ', '_')}", by="unit")
        if options.show:
            tables.show_result(result.orderBy("unit", "per_size_unit", "description"))


if __name__ == "__main__":
    main()
