"""Benchmark decontamination by spaced seeds.

A seed is the hash of the words at the marked places of a mask; the places
between are ignored, so a passage with some words replaced still shares seeds
with its original.  Seeds of all positions of documents meet those of the
benchmark in one join.  A hit fixes how a document and an item lie against each
other; the words of the whole overlap are then compared.  Items of up to seven
words have masks of their own, as long as the item.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfgauge.llm.common import read_table, texts, without_ids, written

# Masks of five words; all of one span, so their seeds interleave.
MASKS = ("1101011", "1110011", "1011101")
SPAN = len(MASKS[0])
# Two replaced words of 10, or three of 15, can lie so that each seed of these masks has one; never so with this one more.
EXTRA, EXTRA_WORDS = "111011", (10, 15)
# Items of fewer words must be met word for word; they stand in clean texts by chance, too.
TELLING = 5
# A window of so many words, or the whole item if that is shorter, must agree in this share of its words.
WINDOW, SIMILARITY = 16, 0.8
# Benchmark seeds are broadcast up to this many rows (8 + 8 + 4 bytes each); beyond, the join shuffles.
BROADCAST_SEEDS = 2_000_000


def word_hashes(text: Column) -> Column:
    """Hashes of the runs of letters and digits, in lower case."""
    found = F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+", -1), lambda word: word != "")
    return F.transform(found, lambda word: F.xxhash64(word))


def masks_of(length: int) -> tuple[str, ...]:
    """Masks for an item of so many words: any words that may be replaced in it leave one seed at least."""
    if length < TELLING:
        return ("1" * length,)
    if length <= SPAN:
        # One word may be replaced: each mask leaves out a place and its counterpart from the end.
        return tuple("".join("0" if k in (out, length - 1 - out) else "1" for k in range(length))
                     for out in range((length + 1) // 2))
    return (*MASKS, EXTRA) if length in EXTRA_WORDS else MASKS


def seeds(hashes: Column, masks: list[str]) -> Column:
    """Seeds of all positions: the element at ``position * len(masks) + mask``, NULL where a mask does not fit."""
    shortest = min(map(len, masks))

    def at(array: Column, start: Column) -> Column:
        def seed(mask: str) -> Column:
            value = F.xxhash64(F.lit(mask), *[F.get(array, start + k) for k, mark in enumerate(mask) if mark == "1"])
            return value if len(mask) == shortest else F.when(start + len(mask) <= F.size(array), value)

        return F.array(*map(seed, masks))

    def of(array: Column) -> Column:
        last = F.size(array) - shortest
        return F.when(last >= 0, F.flatten(F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda start: at(array, start))))

    # The outer transform binds the array, which is then computed once, not once per position.
    return F.element_at(F.transform(F.array(hashes), of), 1)


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, item): hashes of each item's words, stored; items without a word are left out."""
    items = benchmark.select(
        F.col("item_id").cast("bigint").alias("item_id"),
        word_hashes(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("item"))
    return written(items.where(F.size("item") > 0).distinct(), "items")


def seed_table(items: DataFrame) -> tuple[DataFrame, list[str]]:
    """(item_id, item_at, seed, short) of all items, stored, and the masks in use: those for the lengths that occur."""
    length = F.least(F.size("item"), F.lit(WINDOW))
    lengths = sorted(row.length for row in items.select(length.alias("length")).distinct().collect())
    masks = list(dict.fromkeys(mask for n in lengths for mask in masks_of(n))) or list(MASKS)
    exploded = items.select(
        "item_id", length.alias("length"), F.posexplode(seeds(F.col("item"), masks)).alias("k", "seed"))
    number = F.col("k") % len(masks)
    own = reduce(lambda a, b: a | b, [
        (F.col("length") == n) & number.isin([masks.index(mask) for mask in masks_of(n)]) for n in lengths], F.lit(False))
    place = F.floor(F.col("k") / len(masks)).cast("int")
    table = exploded.where(F.col("seed").isNotNull() & own).select(
        "item_id", place.alias("item_at"), "seed", (F.col("length") < TELLING).alias("short"))
    return written(table.distinct(), "seeds"), masks


def alignments(docs: DataFrame, table: DataFrame, masks: list[str]) -> DataFrame:
    """(doc_id, item_id, shift), stored: item word i lies against document word i + shift.

    Seeds of items below TELLING words are the whole item: the first one of a document is enough.
    """
    rows = texts(docs).select("doc_id", F.posexplode(seeds(word_hashes(F.col("text")), masks)).alias("k", "seed"))
    small = table.count() <= BROADCAST_SEEDS
    hits = rows.join(F.broadcast(table) if small else table, "seed")
    shift = F.floor(F.col("k") / len(masks)).cast("int") - F.col("item_at")
    hits = hits.select("doc_id", "item_id", shift.alias("shift"), F.when(~F.col("short"), shift).alias("apart"))
    found = hits.groupBy("doc_id", "item_id", "apart").agg(F.min("shift").alias("shift"))
    return written(found.drop("apart"), "alignments")


def overlaps(docs: DataFrame, found: DataFrame, items: DataFrame) -> DataFrame:
    """Compare the words of each alignment: adds ``width`` and ``matched``, the best window's words that agree."""
    ids = found.select(F.col("doc_id").alias("hit_id")).distinct()
    all_texts = texts(docs)
    hit = all_texts.join(ids, all_texts["doc_id"].eqNullSafe(ids["hit_id"]), "left_semi")
    hit = written(hit.select(F.col("doc_id").alias("hit_id"), word_hashes(F.col("text")).alias("words")), "hit-words")
    sized = found.join(items, "item_id")
    aligned = sized.join(hit, sized["doc_id"].eqNullSafe(hit["hit_id"]))
    skipped = F.greatest(F.lit(0), -F.col("shift"))
    start = F.greatest(F.lit(0), F.col("shift"))
    length = F.least(F.size("item") - skipped, F.size("words") - start)
    width = F.least(F.size("item"), F.lit(WINDOW))
    pairs = aligned.where(length >= width).select(
        "doc_id", "item_id", "shift", width.alias("width"),
        F.slice("item", skipped + 1, length).alias("left"), F.slice("words", start + 1, length).alias("right"))
    pairs = pairs.select(
        "doc_id", "item_id", "shift", "width",
        F.zip_with("left", "right", lambda a, b: (a == b).cast("int")).alias("same"))

    def best(same: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(1), F.size(same) - F.col("width") + 1),
            lambda at: F.size(F.filter(F.slice(same, at, F.col("width")), lambda x: x == 1)))
        return F.array_max(windows)

    matched = F.element_at(F.transform(F.array("same"), best), 1)
    return pairs.select("doc_id", "item_id", "shift", "width", matched.alias("matched"))


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, least_words: int = 1) -> DataFrame:
    """One row per document and benchmark item it holds: doc_id, item_id, width, matched, shift.

    Of ``width`` words in a row (the whole item, 16 at most), ``matched`` agree,
    a share of ``similarity`` at least; ``shift`` is the word of the document
    at which the item begins, or would begin.  Words are runs of letters and
    digits in lower case.  With a similarity of 0.8 or more no such window is
    missed.  Items of fewer than ``least_words`` words are not searched for;
    NULL and empty texts hold nothing, and NULL and empty items are held by
    nothing.  Rows that repeat a doc_id are one document.  Empty tables give no
    rows; columns other than ids and texts are not read.
    """
    items = benchmark_items(benchmark).where(F.size("item") >= least_words)
    found = alignments(docs, *seed_table(items))
    good = overlaps(docs, found, items).where(F.col("matched") >= F.col("width") * similarity)
    best = good.groupBy("doc_id", "item_id").agg(
        F.max(F.struct("matched", (-F.col("shift")).alias("back"), "width")).alias("x"))
    return best.select("doc_id", "item_id", "x.width", "x.matched", (-F.col("x.back")).alias("shift"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents, with all their columns, that hold no benchmark item of TELLING words or more."""
    return without_ids(docs, contaminated(docs, benchmark, least_words=TELLING))


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
