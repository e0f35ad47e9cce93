"""Reports, the histogram against numpy, and product filters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfgauge.operators import audits, combine, filters, ranking

SAMPLES = {
    "many": lambda rng: rng.gamma(2.0, 3.0, 800).round(3),
    "ties": lambda rng: rng.integers(1, 9, 300) / 4,
    "one value": lambda rng: np.full(20, 2.5),
    "quartiles coincide": lambda rng: np.array([1.0] * 90 + [2.0, 3.0, 9.0]),
    "single": lambda rng: np.array([7.25]),
    "two": lambda rng: np.array([1.0, 4.0]),
}


def test_histogram_equals_numpy(table):
    rng = np.random.default_rng(7)
    samples = {name: make(rng) for name, make in SAMPLES.items()}
    rows = [(name, float(v)) for name, values in samples.items() for v in values]
    df = table("category string, price double", [*rows, ("many", None)])
    got = audits.price_histogram(df, "price").collect()
    for name, values in samples.items():
        # The narrower bins of the two rules; without a spread there is one Freedman-Diaconis bin.
        edges = max((np.histogram_bin_edges(values, rule) for rule in ("fd", "sturges")), key=len)
        counts, _ = np.histogram(values, edges)
        mine = {r["bin"]: r for r in got if r["category"] == name}
        assert {r["n_bins"] for r in mine.values()} == {len(counts)}, name
        assert {b: r["n"] for b, r in mine.items()} == {
            i: c for i, c in enumerate(counts.tolist()) if c
        }, name
        for i, r in mine.items():
            assert (r["bin_from"], r["bin_to"]) == pytest.approx((edges[i], edges[i + 1]), rel=1e-12)


def test_quartiles_equal_numpy(table):
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=101), "b": rng.integers(0, 5, 50).astype(float), "c": np.array([1.0])}
    df = table("g string, v double", [(g, float(v)) for g, vs in groups.items() for v in vs])
    counted = audits.value_counts(df, "v", ("g",))
    for r in audits.quartiles(counted, ("g",)).collect():
        values = groups[r["g"]]
        assert (r["n"], r["least"], r["greatest"]) == (len(values), values.min(), values.max())
        assert (r["q1"], r["q3"]) == tuple(np.percentile(values, [25, 75]))


def test_quartiles_over_many_slices(table, monkeypatch):
    monkeypatch.setattr(ranking, "SLICE_ROWS", 10)
    test_quartiles_equal_numpy(table)
    test_histogram_equals_numpy(table)


def test_only_slices_that_hold_a_quartile_are_ordered(table, monkeypatch):
    monkeypatch.setattr(ranking, "SLICE_ROWS", 10)
    df = table("g string, v double", [("a", float(i)) for i in range(1_000)])
    counted = audits.value_counts(df, "v", ("g",))
    assert counted.select("_slice").distinct().count() > 50
    plan = audits.quartiles(counted, ("g",))._jdf.queryExecution().optimizedPlan().toString()
    # The window over values lies above the join that leaves only the wanted slices.
    assert plan.index("_upto") < plan.index("Join")


def test_report_counts(table):
    df = table("category string, brand string, size string, size_oz double", [
        ("a", "B", "2 oz", 2.0), ("a", "B", "2 oz", 2.0), ("a", "C", "4 ct / 3 oz", 4.0), ("a", None, "each", None),
        ("b", "B", None, None)])
    counts = audits.report_counts(df)
    assert {tuple(r) for r in counts.collect()} == {
        ("a", "sizes", "2 oz", 2), ("a", "sizes", "4 ct / 3 oz", 1), ("a", "sizes", "each", 1), ("a", "units", "oz", 2),
        ("a", "units", "ct / 3 oz", 1), ("a", "compound sizes", "4 ct / 3 oz", 1), ("a", "compound brands", "C", 1),
        ("a", "unparsed sizes", "each", 1), ("b", "unparsed sizes", "", 1), ("a", "rows", "rows", 4), ("b", "rows", "rows", 1)}
    assert [tuple(r) for r in audits.report_of(counts, "sizes", "size").collect()] == [
        ("a", "2 oz", 2), ("a", "4 ct / 3 oz", 1), ("a", "each", 1)]
    assert {tuple(r) for r in audits.shapes(counts, 4).collect()} == {("a", 4, 4), ("b", 1, 4)}


def test_frequencies(table):
    df = table("size string", [("2 oz",), ("1 fl oz",), ("2 oz",), ("each",), (None,), ("3 oz",)])
    assert [tuple(r) for r in audits.size_frequency(df).collect()] == [
        ("2 oz", 2), ("1 fl oz", 1), ("3 oz", 1), ("each", 1)
    ]
    assert [tuple(r) for r in audits.unit_frequency(df).collect()] == [("oz", 3), ("fl oz", 1)]
    assert {r[0] for r in audits.distinct_units(df).collect()} == {"oz", "fl oz", None}


def test_names_a_unit(table):
    def names(*units):
        return audits.names_a_unit(table("unit string", [(u,) for u in units]), ("oz", "lb")).first()[0]

    assert names("fl oz", "oz") and not names("fl oz") and not names(None) and not names()


def test_shape(table):
    df = table("a int, b int", [(1, 2), (3, None)])
    assert tuple(audits.shape(df).first()) == (2, 2)


def test_compound_and_bare_each(table):
    df = table("size string", [("4 ct / 3 oz",), ("each",), ("1 each",), (None,)])
    assert [r[0] for r in audits.compound_sizes(df).collect()] == ["4 ct / 3 oz"]
    assert [r[0] for r in audits.bare_each(df).collect()] == ["each"]


def test_product_filters(table):
    names = [
        "Peanut Butter", "PB Candy", "PB candy", "Coffee Pods", "Coffe K Pods", "Coff Pods",
        "Coffeee Pods", "Large EGGS", "Ice Cream", "ice cream",
    ]
    df = table("d string", [(n,) for n in names])

    def kept(condition):
        return [r.d for r in df.filter(condition).collect()]

    d = F.col("d")
    assert kept(filters.mentions_none(d, filters.NOT_PEANUT_BUTTER)) == [
        n for n in names if n not in ("PB Candy", "Ice Cream")
    ]
    assert kept(filters.never_matches(d, filters.COFFEE_PODS)) == [
        n for n in names if n not in ("Coffee Pods", "Coffe K Pods", "Coffeee Pods")
    ]
    assert kept(filters.mentions_any_case(d, "egg")) == ["Large EGGS"]


def test_unparsed_and_any_size_split_the_table(table):
    df = table("size_oz double, size_each double", [(1.0, None), (None, 2.0), (None, None), (1.0, 1.0)])
    assert filters.keep_any_size(df, "size_oz", "size_each").count() == 3
    assert filters.unparsed(df, "size_oz", "size_each").count() == 1


def test_first_source_wins_even_when_dearer(table):
    schema = "category string, store_id string, description string, size string, regular double, promo double, per_size_oz double"
    first = table(schema, [("c", "s", "d", "1 oz", 9.0, 0.0, 9.0)])
    second = table(schema, [("c", "s", "d", "1 oz", 1.0, 0.0, 1.0), ("c", "s", "d", "2 oz", 1.0, 0.0, 0.5)])
    got = combine.first_source_wins([first, second], "per_size_oz").collect()
    assert {(r["size"], r.per_size_oz) for r in got} == {("1 oz", 9.0), ("2 oz", 0.5)}
    assert combine.first_source_wins([first, second], "per_size_oz").columns == first.columns


def test_union_fills_missing_columns(table):
    both = combine.union_all([table("a int, b int", [(1, 2)]), table("a int", [(3,)])])
    assert {tuple(r) for r in both.collect()} == {(1, 2), (3, None)}
