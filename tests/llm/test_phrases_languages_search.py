"""Phrase collocations, language ID and ranked search against plain Python, on awkward and empty tables too."""

import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfgauge.llm import collocations, language_id, ranked_search
from shelfgauge.llm.common import read_table

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LANGS = "doc_id long, text string, lang string, phrase string, place int, n long"


def in_lang(spark, rows):
    """Rows of (doc_id, text, lang), with columns whose names operators use, too."""
    return spark.createDataFrame([(i, t, lang, "x", 1, None) for i, t, lang in rows], LANGS)


# Phrases

def phrases_by_hand(rows, top):
    one, two, three, total = Counter(), Counter(), Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(UPPER)):
            w = re.findall(r"[^ \t]+", piece)
            total[lang] += len(w)
            one.update((lang, x) for x in w)
            two.update((lang, *x) for x in zip(w, w[1:]))
            three.update((lang, *x) for x in zip(w, w[1:], w[2:]))
    found = defaultdict(list)
    for (lang, x, y), a in two.items():
        longer = [f for (lg, p, q, r), f in three.items() if lg == lang and f >= 10 and (x, y) in ((p, q), (q, r))] if a >= 10 else []
        if a >= 10 and not any(100 * f >= 50 * a for f in longer):
            left, right = one[lang, x], one[lang, y]
            found[lang].append((-(10**6 * a * a // (left * right)), -a, f"{x} {y}".encode(), left, right))
    for (lang, x, y, z), a in three.items():
        if a >= 10:
            cuts = [(10**6 * a * a // (left * right), k, left, right) for k, left, right in (
                (1, one[lang, x], two[lang, y, z]), (2, two[lang, x, y], one[lang, z]))]
            score, _, left, right = min(cuts)
            found[lang].append((-score, -a, f"{x} {y} {z}".encode(), left, right))
    return {(lang, i + 1, phrase.decode(), -a, left, right, total[lang], -score)
            for lang, rows in found.items() for i, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top])}


def got_phrases(df, **options):
    rows = collocations.collocations(df, **options).collect()
    found = {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r["n"], r.score) for r in rows}
    assert len(found) == len(rows)
    return found


def random_corpus(pick, n, words):
    fixed = ["new york city", "Sausages É fried", "of the", "é ü", "a a a a"]
    rows = []
    for i in range(n):
        parts = [pick.choice(fixed) if pick.random() < 0.3 else " ".join(pick.choices(words, k=3)) for _ in range(30)]
        text = "".join(part + pick.choice([" ", " ", "\t", ". ", ",", "\n"]) for part in parts)
        rows.append((i, text, pick.choice(["en", "en", "fr", None, "und"])))
    return rows + [(None, None, "en"), (n, "", None), (n, "one", "xx"), (n, " \t.;\n ", "en")]


@pytest.mark.parametrize("partitions, top", [(1, 2000), (7, 15)])
def test_collocations(spark, partitions, top):
    rows = random_corpus(random.Random(partitions), 60, ["w", "the", "Big", "cat", "naïve", "x1", " ", "\x00", "q"])
    assert got_phrases(in_lang(spark, rows).repartition(partitions), top=top) == phrases_by_hand(rows, top)


def test_collocations_of_words_beyond_the_tiles(spark):
    pick = random.Random(3)
    rare = [f"r{i}" for i in range(5_000)]  # each follows frequent words, so its id is beyond DENSE
    rows = []
    for i in range(10):
        pairs = [f"{w} z{w}" for w in rare]
        pick.shuffle(pairs)
        rows.append((i, ", ".join(pairs) + " the cat sat," * 30 + ", of the cat" * 20, "en"))
    rows += [(99, " r1 zr1 r2." * 11, "en")]
    assert got_phrases(in_lang(spark, rows).repartition(4)) == phrases_by_hand(rows, 2_000)


def test_large_counts_do_not_overflow(spark):
    big = 3_000_000_000
    row = spark.createDataFrame([(big, big + 1, big + 2)], "a long, l long, r long")
    got = row.select(collocations.ratio("a", "l", "r").alias("score")).first().score
    assert got == 10**6 * big * big // ((big + 1) * (big + 2))


def test_entries_of_tiles_and_lists():
    rng = np.random.default_rng(4)
    rank = np.minimum(rng.geometric(0.003, 60_000), 6_000)
    right = np.minimum(rng.geometric(0.004, 60_000), 6_000)
    left = rank.astype(np.int64) << 35  # like the code of a pair
    found = collocations.entries("en", 1, left, rank, right, 3)
    got = Counter()
    tiles, lists = found[found["part"] < 0], found[found["part"] >= 0]
    for part, group in tiles.groupby("part"):
        row = collocations.add_tiles(("en", part, 0), group.assign(slot=0)).iloc[0]
        for cell, n in zip(collocations.unpack(row["rights"]), collocations.unpack(row["counts"])):
            r, c = divmod(-1 - part, collocations.ACROSS)
            got[r * collocations.TILE + cell // collocations.TILE, c * collocations.TILE + cell % collocations.TILE] += n
    want = Counter(zip(rank.tolist(), right.tolist()))
    near = {k: v for k, v in want.items() if max(k) < collocations.DENSE}
    assert dict(got) == near and len(tiles) > 1
    far = Counter()
    for part, group in lists.groupby("part"):
        frame = collocations.add_lists(("en", part), group)
        far.update({(a >> 35, b): n for a, b, n in zip(frame["left"], frame["right"], frame["a"])})
    assert far == {k: v for k, v in want.items() if k not in near and v >= collocations.LEAST}


def test_pack():
    for values in ([], [0], [0, 0], [1, 256, 70_000, 0], [2**40, 3], [65_536]):
        assert collocations.unpack(collocations.pack(np.array(values, np.int64))).tolist() == values


def test_narrowing_in_rounds_keeps_the_first(spark, monkeypatch):
    monkeypatch.setattr(collocations, "WINDOW_ROWS", 10)
    rows = [("en", f"p {i}", i % 7, 1, 1, i % 11) for i in range(300)]
    table = spark.createDataFrame(rows, "lang string, phrase string, a long, l long, r long, score long")
    got = collocations.top_phrases(table, 5).collect()
    want = sorted(rows, key=lambda r: (-r[5], -r[2], r[1]))[:5]
    assert sorted((r["rank"], r.phrase) for r in got) == [(i + 1, r[1]) for i, r in enumerate(want)]


def test_collocations_of_awkward_and_empty_documents(awkward, empty):
    rows = [(i, text, None) for i, text, *_ in awkward.select("doc_id", "text").collect()]
    assert got_phrases(awkward) == phrases_by_hand(rows, 2_000) != set()
    assert collocations.collocations(empty).collect() == []


# Languages

def test_grams_by_hand():
    def hashed(points):
        mixed = 0x9E3779B9 * len(points) % 2**32
        for point in points:
            mixed = (mixed ^ point) * 0x85EBCA6B % 2**32
            mixed ^= mixed >> 13
        return mixed * 0xC2B2AE35 % 2**32 >> 16

    pick = random.Random(7)
    for _ in range(50):
        text = "".join(pick.choices("abÉñ  .1\n—\U0001f600", k=pick.randint(0, 30)))
        plain = re.sub(r"[^a-zÀ-῿Ⰰ-\U0010ffff]+", " ", f" {text.lower()} ")
        want = Counter(hashed([ord(c) for c in plain[i:i + n]]) for n in (1, 2, 3) for i in range(len(plain) - n + 1))
        assert Counter(language_id.grams(text).tolist()) == want


def test_ftrl_by_hand():
    pick, rng = random.Random(1), np.random.default_rng(1)
    rows = [(np.array(sorted(pick.sample(range(40), 6))), rng.random(6)) for _ in range(60)]
    labels = np.array([int(at[0] % 3) for at, _ in rows])
    got = language_id.ftrl(rows, labels, 3)
    z, n = defaultdict(float), defaultdict(float)

    def weight(i, k):
        penalty = 0.0 if i == language_id.BUCKETS else language_id.L1
        if abs(z[i, k]) <= penalty:
            return 0.0
        return -(z[i, k] - math.copysign(penalty, z[i, k])) / (
            (language_id.BETA + math.sqrt(n[i, k])) / language_id.ALPHA + language_id.L2)

    for _ in range(language_id.EPOCHS):
        for (at, x), label in zip(rows, labels):
            inputs = [*zip(at.tolist(), x.tolist()), (language_id.BUCKETS, 1.0)]
            w = {(i, k): weight(i, k) for i, _ in inputs for k in range(3)}
            logits = [sum(v * w[i, k] for i, v in inputs) for k in range(3)]
            total = sum(map(math.exp, logits))
            for i, v in inputs:
                for k in range(3):
                    g = v * (math.exp(logits[k]) / total - (k == label))
                    sigma = (math.sqrt(n[i, k] + g * g) - math.sqrt(n[i, k])) / language_id.ALPHA
                    z[i, k] += g - sigma * w[i, k]
                    n[i, k] += g * g
    for i in [*range(40), language_id.BUCKETS]:
        assert got[i] == pytest.approx([weight(i, k) for k in range(3)], abs=1e-9)


def test_temperature_makes_chances_right():
    rng = np.random.default_rng(2)
    logits = rng.normal(0, 2, (4_000, 3))
    labels = np.array([rng.choice(3, p=p) for p in language_id.softmax(logits)])
    assert language_id.best_temperature(logits * 4, labels) == pytest.approx(4, rel=0.15)
    assert language_id.best_temperature(logits[:0], labels[:0]) == 1.0


def test_languages_of_held_out_documents(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    got = language_id.identify(docs, docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 200 and sum(r.lang == r.lang_pred for r in got) >= 0.99 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_only_learnable_rows_are_learned_from(spark):
    rows = [(i, f"aa bb {i}", "x") for i in range(40)] + [(i, f"cc dd {i}", "y") for i in range(40, 80)]
    docs = in_lang(spark, rows + [(None, None, "z"), (81, "ee", None)])
    out = docs.where(language_id.held_out(F.col("doc_id"))).withColumn("lang", F.lit("never"))
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))).union(out))
    assert model.langs == ("x", "y")
    learned = [text for i, text, _ in rows if crc32(str(i).encode()) % 4 != 2]
    df, n = Counter(g for text in learned for g in set(language_id.grams(text).tolist())), len(learned)
    for bucket, count in df.items():
        assert model.idf[bucket] == pytest.approx(math.log((1 + n) / (1 + count)) + 1)
    got = {r.doc_id: r.lang_pred for r in language_id.predict(docs, model).collect()}
    assert all(got[i] == lang for i, _, lang in rows) and got[None] == "und"


def test_sample_takes_the_smallest_hashes_of_each_language(spark):
    rows = [(i, f"t{i}", "big") for i in range(1_500)] + [(i, f"t{i}", "small") for i in range(2_000, 2_010)] + [(5, "t5", "big")] * 3
    known = language_id.learnable(in_lang(spark, rows))
    got = Counter((r.lang, r.place) for r in language_id.sampled(known).collect())
    by_lang = defaultdict(set)
    for r in known.collect():
        by_lang[r.lang].add(r.place)
    assert set(got) == {(lang, p) for lang, places in by_lang.items() for p in sorted(places)[:language_id.PER_LANG]}


def test_languages_of_awkward_and_empty_documents(awkward, empty):
    got = language_id.identify(awkward, awkward).collect()  # no row has a lang
    assert len(got) == awkward.count()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0), ("und", 1.0)}
    learned = awkward.withColumn("lang", F.when(F.col("doc_id") < 5, "a").otherwise("b"))
    got = language_id.identify(awkward, learned).collect()
    assert all(r.lang_pred in ("a", "b", "und") and 0 <= r.score <= 1 for r in got)
    assert sorted(r.doc_id for r in got if r.lang_pred == "und") == [3, 4, 5]
    assert language_id.identify(empty, empty).collect() == []
    assert language_id.identify(empty, learned).collect() == []


# Ranked search

def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def search_by_hand(docs, items):
    found = [(i, Counter(terms(text))) for i, text in docs]
    n = sum(bool(c) for _, c in found)
    total = sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
    want = Counter()
    for item, text in items:
        scores = []
        for i, counts in found:
            m = 25 + 75 * sum(counts.values()) * n // total if total else 0
            score = sum(weight[t] * (10**9 * counts[t] // (1000 * counts[t] + 8 * m)) for t in terms(text) if counts[t])
            if score:
                scores.append((-score, i is None, i or 0))
        for rank, (score, lost, i) in enumerate(sorted(scores)[:10], 1):
            want[item, rank, None if lost else i, -score] += 1
    return want


def searched(spark, docs, items, partitions):
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, terms string, item int")
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, score int")
    got = ranked_search.ranked_search(table.repartition(partitions), asked).collect()
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in got)


@pytest.mark.parametrize("seed", range(4))
def test_ranked_search(spark, seed):
    pick = random.Random(seed)
    lexicon = [f"w{i}" for i in range(60)] + ["é", "Ünï", "a-b", "x_y", "\U0001f600"]
    chances = [1 / (i + 1) for i in range(len(lexicon))]

    def text(most):
        return pick.choice([" ", ", "]).join(pick.choices(lexicon, chances, k=pick.randint(0, most)))

    docs = [(i, text(80)) for i in range(800)] + [(None, "w7 w8"), (3, "w7 w8"), (900, None), (901, "w3 " * 3_000)]
    docs += [(1_000 + i, "w5 w6 w7") for i in range(30)]
    items = [(i, text(12)) for i in range(25)] + [(None, "w7"), (2, "W7 w7 w8"), (30, None), (31, "absent")]
    assert searched(spark, docs, items, (1, 5)[seed % 2]) == search_by_hand(docs, items)


def test_blocks_are_rejected_undecoded():
    rng = np.random.default_rng(1)
    numbers = ranked_search.Numbers({b"rare": 0, b"common": 1})
    streams = [np.array([1] * rng.integers(1, 4) + ([0] * 30 if i % 997 == 0 else []), np.int32) for i in range(12_000)]
    row = ranked_search.build_shard(list(range(12_000)), numbers, streams)
    total = sum(map(len, streams))
    shard = ranked_search.Shard(type("Row", (), row), {b"rare": 0, b"common": 1}, 12_000, total)
    docs, scores = ranked_search.search_shard(shard, [(0, 5_000), (1, 1)], 0)
    assert len(docs) >= 10 and set(docs) <= set(range(0, 12_000, 997))
    # The common term's list was not essential: only blocks of documents with the rare one were decoded.
    opened = [key for key in shard.decoded if isinstance(key, tuple)]
    assert shard.term[1] not in shard.decoded and 0 < len(opened) <= 13 < shard.block_starts[-1]


def test_search_of_awkward_and_empty_tables(spark, awkward, empty):
    docs = [tuple(r) for r in awkward.select("doc_id", "text").collect()]
    items = [(1, "word with repeated one"), (2, None), (None, "")]
    assert searched(spark, docs, items, 3) == search_by_hand(docs, items)
    assert searched(spark, docs, [], 2) == searched(spark, [], items, 2) == Counter()


def test_scaled_lengths_beyond_64_bits():
    lengths = np.array([10**9, 7], np.int64)
    assert ranked_search.scaled_lengths(lengths, 10**10, 10**13).tolist() == [
        25 + 75 * length * 10**10 // 10**13 for length in (10**9, 7)]
