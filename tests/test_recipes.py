"""Categories from landed pages to result tables, and all of them in one pass."""

import datetime as dt
import json

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from shelfgauge.functions.clock import wall_time
from shelfgauge.operators import pricing
from shelfgauge.operators.stamp import stamp_run
from shelfgauge.plans import fixed_repairs, jobs, recipes

OFFER = "category string, store_id string, description string, brand string, size string, regular double, promo double"


def offer(description, size, regular=10.0, promo=0.0, category="c", brand="B"):
    return (category, "1", description, brand, size, regular, promo)


def prices(df, unit):
    return {r.description: r[f"per_size_{unit}"] for r in df.collect()}


@pytest.mark.parametrize(("recipe", "unit", "rows", "expected"), [
    (recipes.TOILET_PAPER, "each", [("a", "20 rolls"), ("b", "10 oz")], {"a": 0.5}),
    (recipes.VEGETABLES, "oz", [("a", "4 ct / 3 oz"), ("b", "1 pt / 10 oz"), ("c", "1 lb")],
     {"a": 10 / 12, "b": 1.0, "c": 0.625}),
    (recipes.VEGETABLES, "each", [("a", "each"), ("b", "4 ct / 3 oz"), ("c", "2 bunch")], {"a": 10.0, "c": 5.0}),
    (recipes.FRUIT, "each", [("a", "each"), ("b", "4 ct / 3 oz")], {"b": 2.5}),
    (recipes.COFFEE, "oz", [("a", "20 oz"), ("b", "1 qt")], {"a": 0.5}),
    (recipes.DECAF_COFFEE, "oz", [("Coffee K Pods", "20 oz"), ("Beans", "20 oz")], {"Beans": 0.5}),
    (recipes.CREAMER, "oz", [("a", "1 gal"), ("b", "1 l"), ("c", "1/2 gal")], {"a": 10 / 128, "b": 10 / 33.81}),
    (recipes.MILK, "oz", [("a", "1/2 gal"), ("b", "6 ct / 8 fl oz"), ("c", "1 lb")], {"a": 10 / 64, "b": 10 / 48}),
    (recipes.TEA, "ct", [("Tea Bags", "20 ct / 1.4 oz"), ("x", "12 ct / 1.16 oz"), ("y", "16ct"), ("z", "4 ct / 12 oz")],
     {"Tea Bags": 0.5, "x": 10 / 12, "y": 0.625}),
    (recipes.TEA, "oz", [("z", "4 ct / 12 oz"), ("w", "12 bottles / 16 fl oz")], {"z": 10 / 48, "w": 10 / 192}),
    (recipes.SALAD_DRESSING, "oz", [("a", "6 ct / 1.5 fl oz"), ("b", "16 fl oz")], {"a": 10 / 9.0, "b": 0.625}),
    (recipes.EGGS, "each", [("Large Eggs", "large dozen"), ("Egg Whites", "16 oz"), ("Rolls", "12 ct")],
     {"Large Eggs": 10 / 12}),
    (recipes.PEANUT_BUTTER, "oz", [("Creamy", "8 ct / 1.15 oz"), ("PB Cookie", "10 oz"), ("c", "1 lb")],
     {"Creamy": 10 / 9.2}),
])
def test_category(table, recipe, unit, rows, expected):
    df = table(OFFER, [offer(*row) for row in rows])
    result = jobs.result(df, recipe, unit)
    assert prices(result, unit) == expected
    assert ("per_size_rank" in result.columns) == recipe.ranked
    assert ("runtime_mst" in result.columns) == recipe.stamped


def test_every_meat_rule_applies(table):
    df = table(OFFER, [offer(name, old) for name, old, _ in fixed_repairs.MEAT_REPAIRS] + [
        offer("other", "2 ct / 7 oz"), offer("pack", "4 ct / 2.5 oz", brand=fixed_repairs.PACK_BRAND),
    ])
    got = {r.description: (r["size"], r.pack_total) for r in jobs.parsed(df, recipes.MEAT).collect()}
    assert got == {
        **{name: (new, None) for name, _, new in fixed_repairs.MEAT_REPAIRS},
        "other": ("2 ct / 7 oz", None), "pack": ("4 ct / 2.5 oz", 10.0),
    }


def test_laundry_detergent_is_only_parsed(table):
    df = jobs.parsed(table(OFFER, [offer("a", "2 lb")]), recipes.LAUNDRY_DETERGENT)
    assert df.first()["size_oz"] == 32.0


def test_unsized_vegetables_are_dropped(table):
    df = table(OFFER, [offer("a", "1 lb"), offer("b", "big"), offer("c", None)])
    assert [r.description for r in jobs.parsed(df, recipes.VEGETABLES).collect()] == ["a"]
    assert jobs.parsed(df, recipes.FRUIT).count() == 3


@pytest.mark.parametrize("term", ["category", "term"])
def test_merged_categories_prefer_the_earlier(table, term):
    first, second = recipes.VEGETABLES.terms[0], recipes.FRUIT.terms[0]
    rows = [
        (first, offer("a", "10 oz", 20.0)), (first, offer("b", "5 oz")), (second, offer("a", "10 oz", 10.0)),
        (second, offer("c", "20 oz")), ("other", offer("d", "1 oz")), (first, offer("e", "3 ct")), (second, offer("e", "3 ct", 6.0)),
    ]
    offers = table(f"search string, {OFFER}", [(searched, *row) for searched, row in rows])
    offers = offers.drop("category").withColumnRenamed("search", "category") if term == "category" else (
        offers.withColumnRenamed("search", "term"))
    members = (recipes.VEGETABLES, recipes.FRUIT)
    got = jobs.merged(offers, members, "oz", term).collect()
    assert {(r.description, r.per_size_oz, r.per_size_rank) for r in got} == {("c", 0.5, 1.0), ("a", 2.0, 2.0), ("b", 2.0, 2.0)}
    by_piece = jobs.merged(offers, members, "each", term).collect()
    assert [(r.description, r.regular) for r in by_piece] == [("e", 10.0)]
    if term == "category":
        assert {(r.description, r.category) for r in got} == {("a", "vegetables"), ("b", "vegetables"), ("c", "fruit")}


@pytest.mark.parametrize("term", ["category", "term"])
def test_side_by_side_keeps_ranks(table, term):
    first, second = recipes.CREAMER.terms[0], recipes.MILK.terms[0]
    rows = [(first, offer("a", "10 oz")), (second, offer("b", "20 oz")), (second, offer("c", "5 oz"))]
    offers = table(f"search string, {OFFER}", [(searched, *row) for searched, row in rows])
    offers = offers.drop("category").withColumnRenamed("search", "category") if term == "category" else (
        offers.withColumnRenamed("search", "term"))
    both = jobs.side_by_side(offers, (recipes.CREAMER, recipes.MILK), "oz", term)
    assert [(r.description, r.per_size_rank) for r in both.collect()] == [("b", 1.0), ("a", 1.0), ("c", 2.0)]


def test_rules_from_a_table(spark, table):
    offers = table(OFFER, [offer("a", "x"), offer("b", "x"), offer("c", None), offer("b", "1/2 gal")])
    offers = offers.withColumn("category", F.lit(recipes.MILK.terms[0]))
    term = recipes.MILK.terms[0]
    idle = [(term, f"p{i}", "x", "9 oz") for i in range(6_000)]
    rules = table("category string, description string, old_size string, new_size string",
                  [*idle, (term, "a", "x", "4 oz"), (term, None, "x", "8 oz"), ("other", None, "x", "2 oz")])
    parsed = jobs.parsed_catalogue(offers, {term: recipes.MILK}, rules=rules)
    got = sorted((r.description, r["size"] or "", r.size_oz) for r in parsed.collect())
    # The recipe's own repair of half gallons gives way to the table.
    assert got == [("a", "4 oz", 4.0), ("b", "1/2 gal", None), ("b", "8 oz", 8.0), ("c", "", None)]
    with pytest.raises(ValueError, match="2 rules"):
        jobs.parsed_catalogue(offers, {term: recipes.MILK}, rules=rules.union(rules.filter("description is null")))


def test_losses_are_counted_in_the_jobs_own_pass(spark, table, tmp_path):
    term = recipes.MILK.terms[0]
    rows = [offer("a", "8 oz"), offer("b", "big"), offer("c", None), offer("d", "4 oz", 0.0), offer("e", "0 oz")]
    rows.append((*offer("f", "4 oz")[:-1], None))
    table(OFFER, rows).withColumn("category", F.lit(term)).write.parquet(str(tmp_path / "offers"))
    offers = spark.read.parquet(str(tmp_path / "offers"))
    seen = Observation()
    counted = Observation()
    priced = jobs.price_catalogue(offers.observe(counted, F.count(F.lit(1)).alias("read")), {term: recipes.MILK}, seen)
    assert seen.get == {"n_offers": 6, "n_unparsed": 2, "n_without_price": 1, "n_dropped": 5}
    # The pass that counted them is done: what is left reads the stored rows, not the offers.
    plan = priced._jdf.queryExecution().optimizedPlan().toString()
    assert "CollectMetrics" not in plan and counted.get == {"read": 6}
    assert [r.description for r in priced.collect()] == ["a"]
    assert [tuple(r) for r in jobs.losses_table(spark, seen).collect()] == [(6, 2, 1, 5)]


def test_catalogue_equals_the_single_jobs(table):
    names = ["Tea Bags", "Large Eggs", "Candy", "Coffee Pods", "x", "y", fixed_repairs.MEAT_REPAIRS[0][0]]
    sizes = [
        "4 ct / 3 oz", "1/2 gal", "20ct", "6 ct", "large dozen", "16 fl oz", "1 lb", "each", "12 ct / 1.16 oz",
        "8 ct / 1.15 oz", "2 l", "3 ct / 1 lb", "6 ct / 8 fl oz", "5 pk", None,
    ]
    by_term = recipes.recipes_by_term()
    rows = [
        (term, "1", name, "B", size, 1.0 + (i * 7 + j * 3 + k) % 11, [0.0, 0.75, 2.0, None][(i + j + k) % 4])
        for i, term in enumerate(by_term) for j, name in enumerate(names) for k, size in enumerate(sizes)
    ]
    offers = table(OFFER, rows)
    got = {
        (r.category, r.unit, r.description, r["size"], r.regular, r.promo, r.per_size_unit)
        for r in jobs.price_catalogue(offers, by_term).collect()
    }
    expected = set()
    for recipe in recipes.RECIPES:
        mine = offers.filter(F.col("category").isin(*recipe.terms)).withColumn("category", F.lit(recipe.name))
        for unit in recipe.results:
            best = pricing.best_price(pricing.add_unit_prices(jobs.parsed(mine, recipe)), unit)
            expected |= {
                (r.category, unit, r.description, r["size"], r.regular, r.promo, r[f"per_size_{unit}"])
                for r in best.collect()
            }
    assert got == expected and {row[0] for row in got} == {r.name for r in recipes.RECIPES if r.results}


def test_parsed_catalogue_equals_the_single_jobs(table):
    by_term = recipes.recipes_by_term()
    names = ["Tea Bags", "Large Eggs", "Candy", "Coffee Pods", fixed_repairs.MEAT_REPAIRS[0][0]]
    sizes = ["4 ct / 3 oz", "1/2 gal", "20ct", "large dozen", "16 fl oz", "1 lb", "3 ct / 1 lb", "5 pk", None]
    offers = table(OFFER, [offer(n, s, category=term) for term in by_term for n in names for s in sizes])
    parsed = jobs.parsed_catalogue(offers, by_term)
    got = sorted(str((r.category, r.description, r["size"], r.size_oz, r.size_count)) for r in parsed.collect())
    expected = []
    for recipe in recipes.RECIPES:
        mine = jobs.parsed(offers.filter(F.col("category").isin(*recipe.terms)), recipe)
        columns = {
            "oz": "size_oz" if "size_oz" in mine.columns else None,
            "count": next((c for c in mine.columns if c in ("size_each", "size_ct")), None),
        }
        for r in mine.collect():
            row = r.asDict()
            expected.append((recipe.name, r.description, r["size"], row.get(columns["oz"]), row.get(columns["count"])))
        if recipe.drop_unsized:  # the catalogue keeps them for its report
            unsized = jobs.repaired(offers.filter(F.col("category").isin(*recipe.terms)), recipe)
            known = {(r.description, r["size"]) for r in mine.collect()}
            expected += [
                (recipe.name, r.description, r["size"], None, None)
                for r in unsized.collect() if (r.description, r["size"]) not in known
            ]
    assert got == sorted(map(str, expected))


def test_reports(table):
    df = table(OFFER, [
        offer("a", "4 ct / 3 lb", brand="X"), offer("b", "4 ct / 3 lb", brand="Y"), offer("c", "each"),
        offer("d", "2 oz"), offer("e", None),
    ])
    parsed = jobs.parsed_catalogue(df, {"c": recipes.MILK})
    reports = {name: report.collect() for name, report in jobs.catalogue_reports(parsed).items()}
    assert [(r["size"], r.n) for r in reports["sizes"]] == [("4 ct / 3 lb", 2), ("2 oz", 1), ("each", 1)]
    assert [(r.unit, r.n) for r in reports["units"]] == [("ct / 3 lb", 2), ("oz", 1)]
    assert [r.description for r in reports["compound"]] == ["b", "a"]
    assert [(r["size"], r.n) for r in reports["compound sizes"]] == [("4 ct / 3 lb", 2)]
    assert [(r.brand, r.n) for r in reports["compound brands"]] == [("X", 1), ("Y", 1)]
    assert [r.description for r in reports["bare each"]] == ["c"]
    assert sorted(r.description for r in reports["unparsed"]) == ["a", "b", "c", "e"]


def test_from_landed_pages_to_result(spark, tmp_path):
    for term, size in (("decaf tea", "10 ct"), ("herbal tea", "20 ct")):
        folder = tmp_path / "pages" / "fulfillment=csp" / f"term={term}" / "store=77"
        folder.mkdir(parents=True)
        listed = {"description": "Mint", "items": [{"size": size, "price": {"regular": 5, "promo": 0}}]}
        (folder / "p.json").write_text(json.dumps({"data": [listed]}))
    folder = tmp_path / "stores" / "zip=80218"
    folder.mkdir(parents=True)
    address = {"addressLine1": "1155 E 9Th Ave", "city": "Denver"}
    (folder / "s.json").write_text(json.dumps({"data": [{"locationId": "77", "address": address}]}))
    offers = jobs.search(spark, str(tmp_path / "pages"), str(tmp_path / "stores"), recipes.TEA)
    (row,) = jobs.result(offers, recipes.TEA, "ct").collect()
    assert (row.category, row.description, row["size"], row.per_size_ct) == ("tea", "Mint", "20 ct", 0.25)


def test_stamp(table):
    at = dt.datetime(2023, 7, 1, 12, 0)
    stamped = stamp_run(table("a int", [(1,), (2,)]), at)
    shown = stamped.select(wall_time(F.col("runtime_mst"))).collect()
    assert {r[0] for r in shown} == {dt.datetime(2023, 7, 1, 6, 0)}
    now = stamp_run(table("a int", [(1,), (2,)]))
    assert now.select("runtime_mst").distinct().count() == 1
