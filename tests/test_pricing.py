"""Unit prices and best prices, against a plain Python reckoning."""

import random

from shelfgauge.operators import pricing, sizing

OFFER = "category string, store_id string, description string, size string, regular double, promo double"


def priced(table, rows, dialect=sizing.PRODUCE_TEXT):
    return pricing.add_unit_prices(sizing.add_sizes(table(OFFER, rows), dialect))


def offer(description="d", size="10 oz", regular=5.0, promo=0.0, category="c", store="s"):
    return (category, store, description, size, regular, promo)


def best(table, *rows, unit="oz"):
    return [row.asDict() for row in pricing.best_price(priced(table, rows), unit).collect()]


def test_promo_counts_only_above_zero(table):
    (row,) = best(table, offer(promo=0.0))
    assert (row["per_size_oz"], row["pct_change_regular_to_promo_size_oz"]) == (0.5, -100.0)
    (row,) = best(table, offer(promo=4.0))
    assert row["per_size_oz"] == 0.4


def test_promo_dearer_than_regular_does_not_win(table):
    (row,) = best(table, offer(promo=6.0))
    assert row["per_size_oz"] == 0.5


def test_unknown_promo_drops_the_product(table):
    assert best(table, offer(promo=None)) == []


def test_zero_size_and_zero_regular_price_drop_the_product(table):
    assert best(table, offer(size="0 oz"), offer(regular=0.0)) == []


def test_sizes_of_one_description_collapse_to_the_cheapest(table):
    (row,) = best(table, offer(size="10 oz"), offer(size="20 oz"), offer(size="2 lb", regular=100.0))
    assert (row["size"], row["per_size_oz"]) == ("20 oz", 0.25)


def test_ties_go_to_regular_then_promo_then_size(table):
    rows = [
        offer(size="10 oz", regular=5.0), offer(size="20 oz", regular=10.0),
        offer(size="10 fl oz", regular=5.0), offer(size="10 oz", regular=6.0, promo=5.0),
    ]
    (row,) = best(table, *rows)
    assert (row["regular"], row["promo"], row["size"]) == (5.0, 0.0, "10 fl oz")


def test_stores_are_separate_frames(table):
    rows = best(table, offer(store="1"), offer(store="2", regular=1.0))
    assert {(row["store_id"], row["per_size_oz"]) for row in rows} == {("1", 0.5), ("2", 0.1)}


def test_only_present_sizes_are_priced(table):
    df = pricing.add_unit_prices(table(OFFER + ", size_oz double", [(*offer(), 10.0)]))
    assert "regular_per_size_oz" in df.columns
    assert not any("each" in name for name in df.columns)


def reckon(rows):
    """Best rows per product from all price rows, in Python."""
    found = {}
    for category, store, description, size, regular, promo in rows:
        ounces = float(size.split()[0]) if size and size.endswith("oz") else None
        if None in (description, ounces, regular, promo) or not ounces or not regular:
            continue
        change = (promo / ounces - regular / ounces) / (regular / ounces) * 100
        for price, known in ((regular, True), (promo, promo > 0)):
            row = (price / ounces, regular, promo, size, change)
            key = (category, store, description)
            if known and (key not in found or row < found[key]):
                found[key] = row
    return {(*key, size, regular, promo, per, change) for key, (per, regular, promo, size, change) in found.items()}


def random_offers(n, seed):
    """Offers of which a third are one product in one store."""
    pick = random.Random(seed)
    rows = []
    for _ in range(n):
        hot = pick.random() < 1 / 3
        rows.append((
            "hot" if hot else pick.choice("abc"),
            "1" if hot else pick.choice("123"),
            "hot" if hot else pick.choice(["x", "y", "z", None]),
            pick.choice(["1 oz", "2 oz", "4 oz", "0 oz", "3 ct", None]),
            pick.choice([0.0, 1.0, 2.0, 2.5, None]),
            pick.choice([0.0, 0.5, 1.0, 3.0, None]),
        ))
    return rows


def test_best_price_equals_reckoning(table):
    for seed in range(3):
        rows = random_offers(400, seed)
        got = {tuple(row) for row in pricing.best_price(priced(table, rows), "oz").collect()}
        assert got == reckon(rows)


def test_best_price_ignores_partitioning(table):
    df = priced(table, random_offers(300, 9))
    results = [
        sorted(pricing.best_price(df.repartition(n), "oz").collect()) for n in (1, 7)
    ]
    assert results[0] == results[1]


def test_price_rows_hold_both_prices_and_their_least_is_the_best(table):
    df = priced(table, random_offers(300, 4))
    rows = pricing.price_rows(df, "oz").collect()
    least = {}
    for row in rows:
        key = (row.category, row.store_id, row.description)
        least[key] = min(row.per_size_oz, least.get(key, row.per_size_oz))
    best_rows = pricing.best_price(df, "oz").collect()
    assert least == {(r.category, r.store_id, r.description): r.per_size_oz for r in best_rows}
    complete = pricing.drop_incomplete(df, "oz")
    assert len(rows) == complete.count() + complete.filter("promo_per_size_oz > 0").count()


def test_cheapest_first_is_sorted(table):
    df = pricing.best_price(priced(table, random_offers(300, 5)), "oz")
    prices = [row.per_size_oz for row in pricing.cheapest_first(df, "per_size_oz").collect()]
    assert prices == sorted(prices)
