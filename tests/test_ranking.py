"""Ranks and running totals: equal to brute force, also with hot frames."""

import random

import pytest

from shelfgauge.operators import ranking


def rows(n, seed):
    """A third of all rows in one frame, and a third of those at one price."""
    pick = random.Random(seed)
    out = []
    for i in range(n):
        frame = "hot" if pick.random() < 1 / 3 else pick.choice("abcde")
        price = 1.0 if frame == "hot" and pick.random() < 1 / 3 else pick.randint(1, 200) / 8
        out.append((frame, f"d{i}", price))
    return out


def reckon(rows, by_frame=True):
    prices = {}
    for frame, _, price in rows:
        prices.setdefault(frame if by_frame else "", set()).add(price)
    order = {frame: sorted(values) for frame, values in prices.items()}
    return {
        (frame, name, price, float(order[frame if by_frame else ""].index(price) + 1))
        for frame, name, price in rows
    }


@pytest.mark.parametrize("frame", [("frame",), ()])
def test_dense_rank(table, frame):
    data = rows(600, 1)
    df = table("frame string, name string, price double", data)
    ranked = ranking.dense_price_rank(df, "price", frame, "rank")
    assert {tuple(r) for r in ranked.collect()} == reckon(data, bool(frame))


@pytest.mark.parametrize("frame", [("frame",), ()])
def test_dense_rank_over_many_slices(table, frame, monkeypatch):
    monkeypatch.setattr(ranking, "SLICE_ROWS", 20)
    data = rows(900, 5)
    df = table("frame string, name string, price double", data)
    assert ranking.sliced(df, "price", "x").select("_slice").distinct().count() > 10
    ranked = ranking.dense_price_rank(df, "price", frame, "rank")
    assert {tuple(r) for r in ranked.collect()} == reckon(data, bool(frame))


def test_slices_ascend_and_hold_few_values(table, monkeypatch):
    monkeypatch.setattr(ranking, "SLICE_ROWS", 50)
    df = table("price double", [(float(i % 700),) for i in range(2_000)] + [(5.0,)] * 1_000 + [(None,)])
    held = {}
    for r in ranking.sliced(df, "price", "x").collect():
        held.setdefault(r["_slice"], set()).add(r["price"])
    assert None in held[0] and max(len(values) for values in held.values()) <= 60
    ends = [(min(v - {None}), max(v - {None})) for _, v in sorted(held.items())]
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))


def test_ranks_of_an_empty_table(table):
    df = table("frame string, name string, price double", [])
    assert ranking.dense_price_rank(df, "price", ("frame",)).collect() == []


def test_ranks_start_at_one_without_gaps(table):
    df = table("frame string, name string, price double", rows(500, 2))
    ranked = ranking.dense_price_rank(df, "price", ("frame",), "rank")
    by_frame = {}
    for row in ranked.collect():
        by_frame.setdefault(row["frame"], set()).add(row["rank"])
    for ranks in by_frame.values():
        assert ranks == {float(i) for i in range(1, len(ranks) + 1)}


def test_running_total(spark, table):
    pick = random.Random(3)
    data = [(f, v, pick.randint(1, 9)) for f in ("a", "b", None) for v in range(100)]
    df = table("frame string, value int, n int", data)
    got = {
        (r["frame"], r["value"]): r["upto"]
        for r in ranking.running_total(df, ("frame",), "value", "n", "upto").collect()
    }
    for frame, value, _ in data:
        assert got[frame, value] == sum(n for f, v, n in data if f == frame and v <= value)


def test_slices_are_even_however_skewed_the_frames(table):
    """A window never holds more than a slice."""
    df = table("frame string, name string, price double", [("hot", f"d{i}", float(i)) for i in range(4000)])
    prices = df.select("frame", "price").distinct()
    from pyspark.sql import functions as F

    sizes = [
        r["count"] for r in
        prices.repartitionByRange(8, "frame", "price").groupBy(F.spark_partition_id()).count().collect()
    ]
    assert len(sizes) == 8 and max(sizes) < 2 * 4000 / 8


def test_rank_frequency_in_rank_order(table):
    df = table("per_size_rank double", [(2.0,), (1.0,), (2.0,)])
    assert [tuple(r) for r in ranking.rank_frequency(df).collect()] == [(1.0, 1), (2.0, 2)]


def test_group_mean(table):
    df = table("k string, v double", [("a", 1.0), ("a", 2.0), (None, 5.0), ("b", None)])
    got = sorted((str(r.k), r.m) for r in ranking.group_mean(df, ("k",), "v", "m").collect() if r.k != "b")
    assert got == [("None", 5.0), ("a", 1.5), ("a", 1.5)]
