"""The whole run, from landed pages to stored tables."""

import json

import pytest

from shelfgauge import __main__ as program
from shelfgauge.plans import recipes
from shelfgauge.sources.pages import folder_names
from shelfgauge.sources.stores import MAIN_STORE, SECOND_STORE
from shelfgauge.sources.tables import shared_folder


@pytest.mark.parametrize("options", [[], ["--reports", "--show", "--whole-files"], ["--offers"]])
def test_whole_run(spark, tmp_path, options, capsys):
    stores = {MAIN_STORE: "11", SECOND_STORE: "22"}
    for search, location in stores.items():
        folder = tmp_path / "stores" / f"zip={search.zipcode}"
        folder.mkdir(parents=True)
        address = {"addressLine1": search.address, "city": search.city}
        (folder / "s.json").write_text(json.dumps({"data": [{"locationId": location, "address": address}]}))
    for term, recipe in recipes.recipes_by_term().items():
        for store in stores.values():
            root = tmp_path / "pages" / "run=7" if "--offers" in options else tmp_path / "pages"
            folder = root / "fulfillment=csp" / f"term={term}" / f"store={store}"
            folder.mkdir(parents=True)
            dearer = 1 if store == stores[recipe.store] else 100
            listed = [
                {"description": name, "items": [{"size": size, "price": {"regular": 4 * dearer, "promo": 2}}]}
                for name, size in (("Egg Mix", "8 oz"), ("Eggs", "8 ct"), ("Shared", "16 oz"))
            ]
            lines = 2 if "--whole-files" in options else None
            meta = {"pagination": {"total": 4}}
            (folder / "p.json").write_text(json.dumps({"data": listed, "meta": meta}, indent=lines))
    out = tmp_path / "out"
    if "--offers" in options:
        options = ["--offers", str(tmp_path / "kept")]
    before = set(folder_names(spark, shared_folder(spark) + "/shelfgauge"))
    arguments = [str(tmp_path / "pages"), str(tmp_path / "stores"), str(out), "--master", "local[4]", *options]
    with pytest.raises(SystemExit, match="pages are missing"):
        program.main([*arguments, "--complete"])
    assert not out.exists()
    program.main(arguments)
    # No table of the run is left in the shared folder.
    assert set(folder_names(spark, shared_folder(spark) + "/shelfgauge")) == before
    # Three products for each of the terms; those of the tables without prices count with the reports.
    n_terms = len(recipes.recipes_by_term())
    # Eggs leave one product, and peanut butter is no mix.
    n_read = 3 * (n_terms if "--reports" in options else n_terms - 2) - 3
    assert f"offers: offers {n_read}" in capsys.readouterr().out
    if "--offers" in options:
        program.main(arguments)  # the stored run is replaced, not added to
        assert spark.read.parquet(str(tmp_path / "kept")).filter("run = 7").count() == 3 * n_terms

    prices = spark.read.parquet(str(out / "prices"))
    assert {r.category for r in prices.select("category").distinct().collect()} == {
        recipe.name for recipe in recipes.RECIPES if recipe.results
    }
    assert prices.filter("regular <> 4").count() == 0 and prices.filter("runtime_mst is null").count() == 0
    eggs = prices.filter("category = 'eggs'").collect()
    assert [(r.store_id, r.description, r.unit, r.per_size_unit) for r in eggs] == [("22", "Eggs", "each", 0.25)]
    produce = spark.read.parquet(str(out / "produce")).collect()
    assert {(r.description, r.category, r.unit) for r in produce} == {
        ("Egg Mix", "vegetables", "oz"), ("Shared", "vegetables", "oz"), ("Eggs", "vegetables", "each"),
    }
    both = spark.read.parquet(str(out / "creamer_and_milk")).collect()
    assert sorted((r.category, r.description, r.per_size_rank) for r in both) == [
        ("creamer", "Egg Mix", 2.0), ("creamer", "Shared", 1.0), ("milk", "Egg Mix", 2.0), ("milk", "Shared", 1.0),
    ]
    if "--reports" in options:
        sizes = spark.read.parquet(str(out / "reports" / "sizes"))
        assert {r.category for r in sizes.collect()} == {recipe.name for recipe in recipes.RECIPES}
        searches = spark.read.parquet(str(out / "reports" / "searches")).collect()
        assert {r.term for r in searches} == set(recipes.recipes_by_term())
        assert {(r.announced, r.received, r.n_without_data, r.n_without_price) for r in searches} == {(4, 3, 0, 0)}
        shapes = spark.read.parquet(str(out / "reports" / "shapes")).collect()
        assert {(r.category, r.n_rows) for r in shapes} >= {("tea", 6), ("milk", 3)}
        histogram = spark.read.parquet(str(out / "reports" / "histogram"))
        assert histogram.agg({"n": "sum"}).first()[0] == prices.count()
        ranks = spark.read.parquet(str(out / "reports" / "rank_frequency"))
        assert ranks.agg({"n": "sum"}).first()[0] == prices.count()
        assert spark.read.parquet(str(out / "reports" / "losses")).first().n_offers == n_read
        assert not list((out / "reports" / "quarantine").glob("term=*"))
        unparsed = spark.read.parquet(str(out / "reports" / "unparsed"))
        assert {r["size"] for r in unparsed.filter("category = 'toilet paper'").collect()} == {"8 oz", "16 oz"}
