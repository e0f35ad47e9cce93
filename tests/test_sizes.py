"""Golden size texts through every dialect, and the computed repairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from shelfgauge.functions import sizes
from shelfgauge.operators import repair, sizing

# size text: ounces by text (oz, lb), pieces by text, ounces of any unit by
# text, ounces by last word, pieces by last word
GOLDEN = {
    "16 oz": (16, None, 16, 16, None),
    "16 oz.": (16, None, 16, 16, None),
    "59 fl oz": (59, None, 59, 59, None),
    "16  fl oz": (16, None, 16, 16, None),
    ".99 oz": (0.99, None, 0.99, 0.99, None),
    "2 lb": (32, None, 32, None, None),
    "3 lbs": (48, None, 48, None, None),
    "1 qt": (None, None, 32, 32, None),
    "10 qt": (None, None, 320, 320, None),
    "2 l": (None, None, 67.62, 67.62, None),
    "0.5 gal": (None, None, 64, 64, None),
    "1/2 gal": (None, None, None, None, None),
    "750 ml": (None, None, None, None, None),
    "6 ct": (None, 6, None, None, 6),
    "20ct": (None, None, None, None, 20),
    "1 each": (None, 1, None, None, None),
    "each": (None, None, None, None, None),
    "1 bunch": (None, 1, None, None, None),
    "4 pk": (None, 4, None, None, None),
    "12 rolls": (None, 12, None, None, None),
    "4 ct / 3 oz": (4, 4, 4, None, None),
    "10d oz": (None, None, None, None, None),
    "": (None, None, None, None, None),
    None: (None, None, None, None, None),
}


def parse(table, dialect, texts, count="each"):
    column = "size_oz" if dialect.ounce_units else f"size_{count}"
    parsed = sizing.add_sizes(table("size string", [(t,) for t in texts]), dialect, count)
    return {row["size"]: row[column] for row in parsed.collect()}


@pytest.mark.parametrize(
    ("place", "dialect"),
    [
        (0, sizing.WEIGHT_TEXT), (1, sizing.COUNT_TEXT), (2, sizing.ANY_OUNCES_TEXT),
        (3, sizing.LIQUID_WORDS), (4, sizing.COUNT_WORDS_ONLY),
    ],
)
def test_golden_sizes(table, place, dialect):
    got = parse(table, dialect, GOLDEN)
    assert got == {text: values[place] for text, values in GOLDEN.items()}


def test_last_word_dialects_know_only_their_units(table):
    liquids = ["10 qt", "2 l", "0.5 gal", "8 oz"]
    tea = sizing.Dialect("last_word", ("oz", "gal"))
    assert parse(table, tea, liquids) == {"10 qt": None, "2 l": None, "0.5 gal": 64, "8 oz": 8}
    assert parse(table, sizing.OUNCE_WORDS, liquids) == {
        "10 qt": None, "2 l": None, "0.5 gal": None, "8 oz": 8
    }


def test_ounces_and_pieces_side_by_side(table):
    df = sizing.add_sizes(table("size string", [("4 ct / 3 oz",)]), sizing.PRODUCE_TEXT)
    assert df.columns == ["size", "size_oz", "size_each"]
    assert tuple(df.first())[1:] == (4, 4)


def test_words_split_at_any_white_space(table):
    texts = [" 16 fl\toz ", "a b", "\x1cx", "  ", ""]
    df = table("size string", [(t,) for t in texts]).select("size", sizes.words_of(F.col("size")).alias("w"))
    assert {row["size"]: row["w"] for row in df.collect()} == {t: t.split() for t in texts}


@pytest.mark.parametrize("text", ["NaN", "Infinity", "1e3", "1_0", "10d", "10f", "-1", "+1", ".", "1.2.3", ""])
def test_only_plain_decimals_are_numbers(table, text):
    assert table("t string", [(text,)]).select(sizes.plain_number(F.col("t"))).first()[0] is None


@pytest.mark.parametrize(("text", "value"), [("5", 5.0), ("5.", 5.0), (".5", 0.5), ("07.25", 7.25)])
def test_plain_decimals(table, text, value):
    assert table("t string", [(text,)]).select(sizes.plain_number(F.col("t"))).first()[0] == value


def test_cut_tea_bag_sizes(table):
    rows = [
        ("Herbal Tea Bags", "20 ct / 1.4 oz"), ("Mint Teabags", "16 ct / 1.13 oz"),
        ("Loose Tea", "20 ct / 1.4 oz"), ("Mint Teabags", "20 ct"), ("Mint Teabags", None),
    ]
    cut = repair.cut_tea_bag_sizes(table("description string, size string", rows))
    assert [row["size"] for row in cut.collect()] == ["20 ct", "16 ct", "20 ct / 1.4 oz", "20 ct", None]


def test_multiply_pack_sizes(table):
    sizes_before = ["6 ct / 1.5 fl oz", "6 ct / 1.3 oz", "16 oz", "ct oz", "x ct / 2 oz", None]
    df = table("description string, size string", [("d", s) for s in sizes_before])
    assert [row["size"] for row in repair.multiply_pack_sizes(df).collect()] == [
        "9.0 oz", "7.800000000000001 oz", "16 oz", "ct oz", "x ct / 2 oz", None
    ]


def test_pack_total(table):
    rows = [("Own", "4 ct / 2.5 oz"), ("Other", "4 ct / 2.5 oz"), ("Own", "10 oz"), ("Own", "4 ct / 3 lb")]
    df = repair.add_pack_total(table("brand string, size string", rows), "Own")
    assert [row["pack_total"] for row in df.collect()] == [10.0, None, None, None]


def test_rules_match_on_all_their_keys(spark, table):
    df = table("description string, size string", [("a", "1 ct"), ("b", "1 ct"), ("a", None), ("a", "2 ct")])
    rules = repair.fixed_rules(spark, ("description",), [("a", "1 ct", "9 ct")])
    got = [tuple(row) for row in repair.repair_sizes(df, rules).collect()]
    assert sorted(got, key=str) == sorted([("a", "9 ct"), ("b", "1 ct"), ("a", None), ("a", "2 ct")], key=str)


def test_repair_is_idempotent(spark, table):
    from shelfgauge.plans import fixed_repairs

    for rules in (fixed_repairs.VEGETABLE_REPAIRS, fixed_repairs.TEA_REPAIRS, fixed_repairs.MILK_REPAIRS):
        df = table("size string", [(old,) for old, _ in rules])
        rule_table = repair.fixed_rules(spark, (), rules)
        once = repair.repair_sizes(df, rule_table)
        assert [r[0] for r in once.collect()] == [new for _, new in rules]
        assert repair.repair_sizes(once, rule_table).collect() == once.collect()


def test_fixed_tables_stay_short_and_unambiguous(spark):
    with pytest.raises(ValueError, match="same key"):
        repair.fixed_rules(spark, (), [("a", "b"), ("a", "c")])
    with pytest.raises(ValueError, match="1 to"):
        repair.fixed_table(spark, "old_size string", [])


@pytest.mark.parametrize("number", [9.0, 7.800000000000001, 0.001, 0.0005, 0.00012345, 9999999.5, 1e7, 12345678.9, 1.5e15])
def test_numbers_are_written_in_plain_digits(table, number):
    assert table("n double", [(number,)]).select(sizes.number_text(F.col("n"))).first()[0] == str(number)


OUNCES = {"oz": 1, "lb": 16, "qt": 32, "l": 33.81, "gal": 128}


def amount(text):
    return float(text) if re.fullmatch(r"[0-9]+\.?[0-9]*|\.[0-9]+", text) else None


def times(number, factor):
    return None if number is None else number * factor


def by_text(text, units):
    first, _, rest = text.partition(" ")
    unit = rest if " " in text else text
    for name in units:
        if unit in ("l", "l.") if name == "l" else name in unit:
            return times(amount(first), OUNCES[name])
    return None


def pieces_by_text(text):
    first, _, rest = text.partition(" ")
    unit = rest if " " in text else text
    return amount(first) if any(w in unit for w in ("bunch", "ct", "each", "pk", "roll")) else None


def by_last_word(text, units):
    words = text.split()
    for name in units:
        lengths = (2, 3) if name == "oz" else (2,)
        if words and words[-1] in (name, name + ".") and len(words) in lengths:
            return times(amount(words[0]), OUNCES[name])
    return None


def pieces_by_last_word(text):
    words = text.split()
    if len(words) == 2 and words[-1] == "ct":
        return amount(words[0])
    return amount(words[0][:-2]) if words and words[0].endswith("ct") else None


def test_random_sizes_equal_plain_python(table):
    pick = random.Random(11)
    parts = [
        "1", "12", ".5", "3.", "2.25", "x", "1/2", "10d", "oz", "oz.", "fl", "lb", "lbs", "qt", "qt.", "l", "l.",
        "ml", "gal", "ct", "20ct", "xct", "each", "pk", "rolls", "bunch", "/", "pt", "",
    ]
    texts = sorted({
        pick.choice(["", " "]) * (pick.random() < 0.1)
        + pick.choice([" ", " ", " ", "  ", "\t", "\u00a0"]).join(pick.choices(parts, k=pick.randint(1, 5)))
        for _ in range(4000)
    })
    checks = [
        (sizing.WEIGHT_TEXT, lambda t: by_text(t, ("oz", "lb"))),
        (sizing.ANY_OUNCES_TEXT, lambda t: by_text(t, ("oz", "lb", "qt", "gal", "l"))),
        (sizing.COUNT_TEXT, pieces_by_text),
        (sizing.LIQUID_WORDS, lambda t: by_last_word(t, ("oz", "qt", "l", "gal"))),
        (sizing.COUNT_WORDS_ONLY, pieces_by_last_word),
    ]
    for dialect, reckon in checks:
        assert parse(table, dialect, texts) == {t: reckon(t) for t in texts}
