"""What the plans must not contain, and how large they may get."""

import pytest

from shelfgauge.plans import jobs, recipes
from shelfgauge.operators.pricing import FRAME
from verification.queries import QUERIES, offers, searched

SMALLEST = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_no_cross_join_no_single_partition(spark, name):
    plan = physical(QUERIES[name](spark, SMALLEST))
    for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan
    if "dense_rank" in plan or "row_number" in plan:
        assert "SinglePartition" not in plan


def test_size_texts_are_parsed_once(spark):
    parsed = QUERIES["catalogue_parsed"](spark, SMALLEST).filter("size_oz > 0 or size_count > 0")
    plan = optimized(parsed)
    assert plan.count("try_cast") <= 10 and len(plan) < 16_000
    for name in ("best_price_each", "drop_incomplete", "price_rows_oz", "keep_any_size"):
        plan = optimized(QUERIES[name](spark, SMALLEST))
        assert plan.count("try_cast") <= 3, name
        assert len(plan) < 16_000, name


@pytest.mark.parametrize("name", ["report_frequencies", "size_frequency"])
def test_reports_scan_the_offers_once(spark, name):
    plan = physical(QUERIES[name](spark, SMALLEST))
    assert plan.count("Scan parquet") == 2  # lineitem and part


def test_merged_categories_come_from_one_scan(spark):
    members = (recipes.VEGETABLES, recipes.FRUIT)
    best = jobs.best_of_members(searched(spark, SMALLEST, *members), members, "oz", "term", FRAME)
    plan = physical(best)
    assert plan.count("Scan parquet") == 2 and plan.count("Exchange hashpartitioning(_source") == 1


def test_only_used_columns_are_read(spark):
    plan = physical(QUERIES["size_frequency"](spark, SMALLEST))
    assert "l_extendedprice" not in plan and "p_brand" not in plan and "l_discount" not in plan


def test_term_filter_prunes_landing_folders(spark):
    plan = physical(QUERIES["ingest_partition_filter"](spark, SMALLEST))
    assert "PartitionFilters: [isnotnull(fulfillment" in plan and "term#" in plan


def test_best_price_shuffles_offers_once_after_their_join(spark):
    plan = physical(QUERIES["best_price_each"](spark, SMALLEST))
    assert plan.count("Exchange hashpartitioning(category") == 1
    assert "partial_min" in plan


def test_generated_code_of_all_categories_is_compiled(spark):
    """The JVM leaves methods above 8,000 bytes of code uncompiled, which is many times slower."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parsed = jobs.parsed_catalogue(offers(spark, SMALLEST), recipes.recipes_by_term())
        stages = parsed._jdf.queryExecution().debug().codegenToSeq()
        sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert sizes and max(sizes) < 8_000
