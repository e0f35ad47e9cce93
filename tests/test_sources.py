"""Landed pages and stores, result tables, and the stream of pages."""

import json

import pytest

from pyspark.sql import functions as F

from shelfgauge.sources import offers, pages, stores, tables
from shelfgauge.streaming import landing


def product(description, *items, **more):
    return {"description": description, "brand": "B", "items": list(items), "upc": "1", "images": [], **more}


def item(size, regular=None, promo=None, priced=True):
    price = {"price": {"regular": regular, "promo": promo}} if priced else {}
    return {"size": size, "itemId": "7", **price}


def page(*products, total=None):
    return {"data": list(products), "meta": {"pagination": {"start": 0, "total": total or len(products)}}}


def land(root, term, store, *lines, name="p.json", mode="csp"):
    folder = root / f"fulfillment={mode}" / f"term={term}" / f"store={store}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))


@pytest.fixture
def landed(tmp_path):
    tmp_path = tmp_path / "landing"
    land(
        tmp_path, "fruit", "01",
        page(product("apple", item("3 lb", 4.5, 0), item("9 lb", 1, 1)), product("pear", item("each", 1, 0.5)), total=6),
        page(product("no items"), product("no price", item("1 ct", priced=False))),
    )
    land(
        tmp_path, "fruit", "01",
        {"errors": {"reason": "timed out"}}, "{\"data\": [{\"descr", page(product("plum", item("2 lb", 3, None))),
        name="next.json",
    )
    land(tmp_path, "meat", "01", page(product("ham", item("1 lb", 9, 8))))
    land(tmp_path, "fruit", "02", page(product("kiwi", item("4 ct", 2, 0))))
    land(tmp_path, "fruit", "01", page(product("by mail", item("4 ct", 2, 0))), mode="dth")
    return tmp_path


def test_product_search(spark, landed):
    found = pages.product_search(spark, str(landed), ["fruit"], "01")
    assert found.columns == ["category", "store_id", "description", "brand", "size", "regular", "promo"]
    assert sorted(tuple(r)[2:] for r in found.collect()) == [
        ("apple", "B", "3 lb", 4.5, 0.0),
        ("no items", "B", None, None, None),
        ("no price", "B", "1 ct", None, None),
        ("pear", "B", "each", 1.0, 0.5),
        ("plum", "B", "2 lb", 3.0, None),
    ]
    assert {tuple(r)[:2] for r in found.collect()} == {("fruit", "01")}


def test_several_terms_are_one_scan(spark, landed):
    found = pages.product_search(spark, str(landed), ["fruit", "meat"], "01")
    assert "ham" in {r.description for r in found.collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert "term#" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "images" not in plan and "upc" not in plan


def test_search_completeness(spark, landed):
    report = pages.search_completeness(pages.read_pages(spark, str(landed), ["fruit"], "01"))
    assert [tuple(r) for r in report.collect()] == [("fruit", "01", 6, 5)]


def test_pages_printed_over_several_lines(spark, tmp_path):
    land(tmp_path, "fruit", "01", json.dumps(page(product("fig", item("1 lb", 2, 0))), indent=2))
    found = pages.read_pages(spark, str(tmp_path), whole_files=True)
    assert [r.description for r in pages.flatten_pages(found).collect()] == ["fig"]


def test_the_latest_run_is_read_by_default(spark, tmp_path):
    for run, price in (("2026-01-01", 1), ("2026-01-02", 2)):
        land(tmp_path / f"run={run}", "fruit", "01", page(product("fig", item("1 lb", price, 0))))
    assert pages.latest_run(spark, str(tmp_path)) == "2026-01-02"
    search = (spark, str(tmp_path), ["fruit"], "01")
    assert [r.regular for r in pages.product_search(*search).collect()] == [2.0]
    assert [r.regular for r in pages.product_search(*search, run="2026-01-01").collect()] == [1.0]


def test_only_the_folders_of_the_terms_are_listed(spark, landed):
    files = pages.read_pages(spark, str(landed), ["meat"]).inputFiles()
    assert len(files) == 1 and "term=meat" in files[0]
    assert pages.term_folders(["egg bites", "half-and-half"]) == "/term={egg bites,half-and-half}"
    assert pages.term_folders(["salt & pepper", "eggs"]) == ""


def test_runs_are_ordered_by_a_stated_format(spark, tmp_path):
    def newest(*names):
        root = tmp_path / "-".join(names).replace("=", "")
        for name in names:
            (root / name).mkdir(parents=True)
        return pages.latest_run(spark, str(root))

    assert newest("run=9", "run=10") == "10"
    assert newest("run=20260102T030405Z", "run=20260102T030406Z") == "20260102T030406Z"
    assert newest("fulfillment=csp") is None
    for names in (("run=a", "run=b"), ("run=9", "run=2026-01-02"), ("run=9", "fulfillment=csp")):
        with pytest.raises(ValueError, match="state the run"):
            newest(*names)


def full(n, total, start=None):
    meta = {"pagination": {"total": total} if start is None else {"total": total, "start": start}}
    return {"data": [product(f"p{i}", item("1 lb", 2, 0)) for i in range(n)], "meta": meta}


def gaps(spark, root):
    return sorted((r.term, -1 if r.start is None else r.start, r.expected, r.received)
                  for r in pages.page_gaps(pages.read_pages(spark, str(root))).collect())


def test_page_gaps(spark, tmp_path):
    error, cut = {"errors": {}}, "{\"data\": [{\"descr"
    land(tmp_path, "whole", "01", full(50, 120, 0), full(50, 120, 50), full(20, 120, 100))
    land(tmp_path, "hidden", "01", full(50, 120, 0), full(50, 120, 0), full(20, 120, 100))  # as many products as announced
    land(tmp_path, "short", "01", full(50, 120, 0), full(50, 120, 50), full(19, 120, 100))
    land(tmp_path, "first", "01", error, full(20, 70, 50))
    land(tmp_path, "nothing", "01", error, cut)
    land(tmp_path, "empty", "01", full(0, 0, 0))
    land(tmp_path, "unplaced", "01", full(50, 120), full(50, 120))
    land(tmp_path, "unplaced whole", "01", full(50, 60), full(10, 60))
    for start in (0, 100):
        land(tmp_path, "named", "01", full(50, 150), name=f"start={start}.json")
    assert gaps(spark, tmp_path) == [
        ("first", 0, 50, 0), ("hidden", 50, 50, 0), ("named", 50, 50, 0), ("nothing", 0, None, 0),
        ("short", 100, 20, 19), ("unplaced", -1, 120, 100),
    ]


def test_page_kinds_and_quarantine(spark, landed):
    found = pages.read_pages(spark, str(landed), ["fruit"], "01")
    assert [tuple(r) for r in pages.page_kinds(found).collect()] == [("fruit", "01", 3, 1, 1)]
    kept = {r.kind: r for r in pages.quarantine(found).collect()}
    assert set(kept) == {"error page", "unreadable"}
    assert kept["unreadable"].page_text == "{\"data\": [{\"descr" and kept["error page"].page_text is None
    assert all(r.page_file.endswith("next.json") for r in kept.values())


def test_storing_a_run_again_changes_nothing(spark, landed, tmp_path):
    table = str(tmp_path / "offers")
    found = pages.flatten_pages(pages.read_pages(spark, str(landed)))

    def held(**chosen):
        return sorted(map(str, offers.stored_offers(spark, table, **chosen).collect()))

    offers.store_offers(found, table, "1")
    first = held()
    offers.store_offers(found, table, "2")
    offers.store_offers(found, table, "1")
    assert held(run="1") == first and len(held()) == 2 * len(first)
    # A term that the run has landed anew is replaced; the others stay.
    offers.store_offers(found.filter("category = 'meat'").withColumn("regular", F.lit(1.0)), table, "1")
    assert [r.regular for r in offers.stored_offers(spark, table, "1", ["meat"]).collect()] == [1.0]
    assert len(held(run="1")) == len(first) and len(held(run="2")) == len(first)
    plan = offers.stored_offers(spark, table, "1", ["meat"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run" in plan and "category#" in plan.split("PartitionFilters")[1].split("]")[0]


def test_page_report(spark, landed):
    report = pages.page_report(pages.read_pages(spark, str(landed), ["fruit"], "01"))
    assert [r.asDict() for r in report.collect()] == [{
        "term": "fruit", "store": "01", "n_pages": 5, "n_without_data": 2,
        "announced": 6, "received": 5, "n_without_price": 2,
    }]


def test_pages_held_as_text_equal_landed_files(spark, landed, table):
    texts = [json.dumps(page(product("apple", item("3 lb", 4.5, 0)))), "{\"data\": [{", "{}", None]
    df = table("term string, store string, value string", [("fruit", "01", t) for t in texts])
    assert [tuple(r) for r in pages.flatten_pages(pages.parse_pages(df)).collect()] == [
        ("fruit", "01", "apple", "B", "3 lb", 4.5, 0.0)
    ]


def store(location, address, city):
    return {
        "locationId": location, "chain": "C", "phone": "1",
        "address": {"addressLine1": address, "city": city, "zipCode": "8"},
    }


@pytest.fixture
def store_pages(tmp_path):
    root = tmp_path / "stores"
    for search, listed in (
        (stores.MAIN_STORE, [
            store("1", "9 Other St", "Denver"), store("2", "1155 E 9Th Ave", "Aurora"),
            store("4", "1155 E 9Th Ave", "Denver"), store("3", "1155 E 9Th Ave Unit 2", "Denver"),
        ]),
        (stores.SECOND_STORE, [store("5", "1725 Sheridan Blvd", "Edgewater")]),
    ):
        folder = root / f"zip={search.zipcode}"
        folder.mkdir(parents=True)
        (folder / "s.json").write_text(json.dumps({"data": listed}))
    return str(root)


def test_flatten_stores(spark, store_pages):
    table = stores.flatten_stores(stores.read_store_pages(spark, store_pages, "80204"))
    assert [r.asDict() for r in table.collect()] == [{
        "zip": "80204", "place": 0, "location_id": "5", "chain": "C",
        "address_line1": "1725 Sheridan Blvd", "city": "Edgewater",
    }]


def test_first_matching_store_in_listed_order(spark, store_pages):
    assert stores.find_store_id(spark, store_pages, stores.MAIN_STORE) == "4"
    assert stores.find_store_id(spark, store_pages, stores.SECOND_STORE) == "5"
    with pytest.raises(LookupError):
        stores.find_store_id(spark, store_pages, stores.StoreSearch("80204", "nowhere", "Denver"))


def test_write_result_by_category(spark, table, tmp_path):
    df = table("category string, n int", [("a", 1), ("b b", 2), ("a", 3)])
    path = str(tmp_path / "out")
    tables.write_result(df, path)
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["category=a", "category=b b"]
    assert sorted(map(tuple, tables.read_result(spark, path, df.schema).select("category", "n").collect())) == [
        ("a", 1), ("a", 3), ("b b", 2)
    ]


def test_written_tables_lie_in_the_shared_folder(spark, table):
    kept = tables.written(table("a int", [(1,), (2,)]), "numbers")
    assert all(tables.shared_folder(spark) + "/shelfgauge/numbers-" in f for f in kept.inputFiles())
    assert "FileScan" in kept._jdf.queryExecution().executedPlan().toString()


def test_tables_of_a_run_go_with_it(spark, table):
    def held():
        return {x for x in pages.folder_names(spark, f"{tables.shared_folder(spark)}/shelfgauge") if x.startswith("run-")}

    tables.written(table("a int", [(1,)]), "kept")
    before = held()
    with pytest.raises(KeyError), tables.own_folder(spark):
        inner = tables.written(table("a int", [(1,)]), "numbers")
        assert inner.count() == 1 and len(held()) == len(before) + 1
        raise KeyError
    assert held() == before


class Settings(dict):
    """The part of a session that names its master and folder."""

    def __init__(self, **settings):
        super().__init__({name.replace("_", "."): value for name, value in settings.items()})
        self.conf = self
        self.set = self.__setitem__


def test_a_cluster_must_name_its_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        tables.shared_folder(Settings(spark_master="yarn"))
    assert tables.shared_folder(Settings(spark_master="yarn", spark_checkpoint_dir="s3://b/c/")) == "s3://b/c"


def test_a_local_session_gets_one_folder():
    local = Settings(spark_master="local[2]")
    assert tables.shared_folder(local) == tables.shared_folder(local) == local["spark.checkpoint.dir"]


def test_show_result_cuts_nothing(table, capsys):
    long = "x" * 100
    tables.show_result(table("a string", [(long,)] * 30))
    assert capsys.readouterr().out.count(long) == 30


def test_stream_takes_each_page_once(spark, landed, tmp_path):
    out, checkpoint = str(tmp_path / "offers"), str(tmp_path / "checkpoint")
    pages_path = str(landed)

    def run():
        query = landing.append_offers(landing.stream_offers(spark, pages_path, files=2), out, checkpoint)
        query.awaitTermination()
        return spark.read.parquet(out)

    first = run()
    batch = pages.flatten_pages(pages.read_pages(spark, pages_path))
    columns = batch.columns
    assert sorted(map(str, first.select(columns).collect())) == sorted(map(str, batch.collect()))
    assert first.filter("runtime_mst is null").count() == 0
    land(landed, "meat", "01", page(product("beef", item("1 lb", 9, 8))), name="later.json")
    assert run().count() == batch.count() + 1


def test_stream_tells_runs_apart(spark, tmp_path):
    for run, price in (("1", 1), ("2", 2)):
        land(tmp_path / "landing" / f"run={run}", "fruit", "01", page(product("fig", item("1 lb", price, 0))))
    out = str(tmp_path / "offers")
    landing.append_offers(landing.stream_offers(spark, str(tmp_path / "landing")), out, str(tmp_path / "c")).awaitTermination()
    assert {(r.run, r.regular) for r in spark.read.parquet(out).collect()} == {("1", 1.0), ("2", 2.0)}
