"""Every training-data operator against brute force, on awkward and empty tables too."""

import math
import random
import re
from collections import Counter
from hashlib import sha256
from itertools import combinations
from operator import eq
from zlib import crc32

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from shelfgauge.llm import (common, decontamination, exact_dedup, language_model, line_dedup, mixing, pseudonyms,
                            quality, range_coder, simhash, token_ids, toxicity)

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))


def rows_of(df):
    return [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]


# Exact dedup

def test_minimal_perfect_hash():
    rows = np.random.default_rng(1).integers(0, 2**63, (5_000, 4)).astype("<u8")
    slots, sizes, marks = exact_dedup.build_hash(rows)
    assert sorted(slots) == list(range(5_000))
    assert (exact_dedup.find_slots(rows, sizes, marks) == slots).all()


@pytest.mark.parametrize("split", [0, 1, 2])
def test_exact_dedup(awkward, split):
    old = F.coalesce(F.col("doc_id") % 2, F.lit(0)) < split
    got = exact_dedup.exact_dedup(awkward.where(old), awkward.where(~old)).collect()
    groups = {}
    for i, text, _ in rows_of(awkward):
        groups.setdefault((text or "").translate(UPPER), []).append(i)
    want = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, keep, len(ids), i == keep, sha256(text.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want


@pytest.mark.parametrize("turned", [False, True])
def test_buckets_of_a_batch_without_history(spark, make, tmp_path, turned):
    docs = make([(i, f"text {i % 30_000}", "a") for i in range(40_000)])
    nothing = docs.where("doc_id < 0")
    got = exact_dedup.exact_dedup(docs, nothing) if turned else exact_dedup.exact_dedup(nothing, docs)
    rows = got.groupBy("group_size", "kept").count().collect()
    assert {(r.group_size, r.kept, r["count"]) for r in rows} == {(1, True, 20_000), (2, True, 10_000), (2, False, 10_000)}
    digests = exact_dedup.distinct_digests(exact_dedup.digests(docs))
    bits = exact_dedup.bucket_bits(30_000)
    per_bucket = digests.groupBy(exact_dedup.bucket_of(F.col("digest"), bits)).count().agg(F.max("count")).first()[0]
    assert bits == 3 and per_bucket < 1.2 * exact_dedup.BUCKET_DIGESTS


# Mixing

def test_mix_meets_targets(make):
    pick = random.Random(5)
    docs = make([(i, "w " * pick.randint(0, 300), pick.choice(["a", "b", "c", "é", None])) for i in range(600)])
    got = mixing.mix(docs).collect()
    source = {i: s for i, _, s in rows_of(docs)}
    size = Counter()
    for r in got:
        size[source[r.doc_id]] += r.size
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(size.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] >= 2 * size[s]}
        if not full:
            target.update(share)
            break
        for s in full:
            target[s] = 2 * size[s]
            left -= target[s]
        free -= full
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.target == pytest.approx(target[source[r.doc_id]])
        taken[source[r.doc_id]] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= 0.01 * target[s] + 5


def test_mixed_documents_keep_columns(awkward):
    got = mixing.mixed_documents(awkward)
    assert got.schema.names == awkward.schema.names
    assert {r["doc_id"] for r in got.collect()} <= {r["doc_id"] for r in awkward.collect()}


# Token ids

@pytest.mark.parametrize("ids", [
    [], [5], list(range(300)) * 40, [65_535, 0] * 5_000, [7] * 9_000,
])
def test_range_coder_round_trip(ids):
    ids = np.array(ids, np.int64)
    assert (range_coder.decode(range_coder.encode(ids)) == ids).all()


def test_damaged_block_is_noticed():
    blocks = range_coder.encode(np.arange(100))
    broken = blocks[0][:-1] + bytes([blocks[0][-1] ^ 1])
    with pytest.raises(ValueError):
        range_coder.decode([broken])


def test_pieces_give_the_ids_of_whole_texts():
    import random

    deal = random.Random(1)
    parts = ["a", "B", "é", "ß", "7", "²", "ª", "'s", "'ll", "'", ".", ",", ":", "...", "!", " ", " ", "  ", "\n",
             "\n\n", "\n\n\n", "\t", "\r\n", "\u00a0", "\u3000", "漢字", "한", "😀", "\0", "<|endoftext|>", "\x85"]
    texts = ["".join(deal.choice(parts[:deal.choice((20, len(parts)))]) for _ in range(deal.randrange(14)))
             for _ in range(20_000)]
    encoder = token_ids.Encoder(token_ids.default_tokenizer())
    whole = encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    assert encoder.encode(texts) == [np.array(c.ids, "<u4").tobytes() for c in whole]


def test_token_ids(awkward):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_ids.default_tokenizer())
    got = token_ids.token_ids(awkward).orderBy("start").collect()
    texts = {i: t for i, t, _ in rows_of(awkward)}
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 4, 5, 7, 7, 8, 9, 10]
    start = 0
    for r in got:
        ids = tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


# SimHash

def fingerprint(text):
    found = words(text)
    grams = [" ".join(found[i:i + 3]) for i in range(max(1, len(found) - 2))] if found else []
    hashes = [xxhash.xxh64_intdigest(gram, 42) for gram in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(fps, radius):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_simhash_groups(awkward):
    got = simhash.simhash_groups(awkward).collect()
    assert len(got) == awkward.count()
    texts = {i: t for i, t, _ in rows_of(awkward)}
    for r in got:
        assert r.fingerprint == f"{fingerprint(texts[r.doc_id]):016x}"
    by_id = {r.doc_id: r.component_id for r in got}
    assert by_id[2] == 1 and by_id[4] == by_id[5] == 3 and by_id[7] == 7


@pytest.mark.parametrize("tile", [8_192, 16])
def test_near_edges_connect_what_links_connect(spark, tile):
    pick = random.Random(3)
    fps = set()
    for _ in range(12):
        fp = pick.getrandbits(64)
        for _ in range(25):
            fps.add(fp)
            for _ in range(pick.randint(1, 3)):
                fp ^= 1 << pick.randrange(64)
    fps = sorted(fps)
    signed = [fp - 2**64 if fp >= 2**63 else fp for fp in fps]
    edges = simhash.near_edges(spark.createDataFrame([(fp,) for fp in signed], "fp long"), 2, tile).collect()
    place = {fp: i for i, fp in enumerate(signed)}
    pairs = [(place[r.a], place[r.b]) for r in edges]
    assert all((fps[a] ^ fps[b]).bit_count() <= 64 for a, b in pairs)
    left, right = (np.array([p[k] for p in pairs], int) for k in (0, 1))
    assert list(common.smallest_labels(len(fps), left, right)) == reach(fps, 2)


def test_sliced_links_are_exact():
    pick = np.random.default_rng(2)
    base = pick.integers(0, 2**63, 3).astype(np.uint64)
    fps = np.repeat(base, 100) ^ (np.uint64(1) << pick.integers(0, 64, 300).astype(np.uint64))
    run = np.repeat([0, 1, 2], 100)
    for radius in (0, 1, 2, 3, 5):
        a, b = simhash.sliced_links(fps, run, radius)
        want = {(i, j) for i in range(300) for j in range(i)
                if run[i] == run[j] and int(fps[i] ^ fps[j]).bit_count() <= radius}
        assert set(zip(a.tolist(), b.tolist())) == want


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90)], "a long, b long")
    got = {r.node: r.root for r in common.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 100: 90}


# Line dedup

def test_line_classes(make, awkward):
    pick = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    lines = [pick.sample(vocabulary, pick.randint(3, 14)) for _ in range(40)]
    texts = []
    for _ in range(60):
        text = []
        for _ in range(4):
            line = list(pick.choice(lines))
            if pick.random() < 0.5:
                line[pick.randrange(len(line))] = pick.choice(vocabulary)
            text.append(" ".join(line))
        texts.append("\n".join(text))
    got = {(r.doc_id, r.line): r for r in line_dedup.line_classes(
        make([(i, t, None) for i, t in enumerate(texts)]), least_words=5).collect()}
    every = [((i, n), frozenset(line.split())) for i, t in enumerate(texts) for n, line in enumerate(t.split("\n"))]
    every = [x for x in every if len(x[1]) >= 5]
    assert set(got) == {at for at, _ in every}
    for at, own in every:
        near = {s for _, s in every if 5 * len(s & own) >= 4 * len(s | own)}
        assert got[at].n_links == len(near) - 1
        assert got[at].kept == (not any(s in near and other < at for other, s in every))
    assert line_dedup.line_classes(awkward).where("doc_id in (1, 2) and kept").count() == 1
    cleaned = {r.doc_id: r.text for r in line_dedup.deduplicated(awkward).collect()}
    assert cleaned[2] == "" and cleaned[1] == "One two three four five six seven."


def test_long_lines(make):
    pick = random.Random(9)
    first = [pick.sample([f"w{i}" for i in range(900)], pick.randint(40, 300)) for _ in range(12)]
    lines = []
    for _ in range(60):
        line = list(pick.choice(first))
        for at in pick.sample(range(len(line)), int(len(line) * pick.choice([0, 0.03, 0.09, 0.11, 0.13, 0.3]))):
            line[at] = f"n{pick.randrange(10_000)}"
        lines.append(frozenset(line))
    got = line_dedup.line_classes(make([(i, " ".join(line), None) for i, line in enumerate(lines)])).collect()
    for r in got:
        near = {s for s in lines if 5 * len(s & lines[r.doc_id]) >= 4 * len(s | lines[r.doc_id])}
        assert r.n_links == len(near) - 1
        assert r.kept == (not any(s in near for s in lines[:r.doc_id]))


def test_short_lines(make, spark, tmp_path):
    pick = random.Random(8)
    texts = ["\n".join(" ".join(pick.choices("abcdefg", k=pick.randint(0, 7))) for _ in range(5)) for _ in range(40)]
    make([(i, t, None) for i, t in enumerate(texts)]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.line): r for r in line_dedup.op4_line_dedup(spark, str(tmp_path)).collect()}
    every = [((i, n), frozenset(line.split())) for i, t in enumerate(texts) for n, line in enumerate(t.split("\n"))]
    every = [x for x in every if x[1]]
    assert set(got) == {at for at, _ in every}
    for at, own in every:
        near = {s for _, s in every if 5 * len(s & own) >= 4 * len(s | own)}
        assert got[at].n_links == len(near) - 1
        assert got[at].kept == (not any(s in near and other < at for other, s in every))
    docs = make([(1, "All rights reserved.\n\nx", None), (2, "y\nall rights reserved.\n\nx", None)])
    assert {r.doc_id: r.text for r in line_dedup.deduplicated(docs).collect()} == {
        1: "All rights reserved.\n\nx", 2: "y\n"}


# Classifiers

def labelled(make, spark, n=400):
    pick = random.Random(6)
    plain = [f"t{i}" for i in range(50)]
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = pick.choices(["".join(pick.choices("abcdefgh", k=5)) for _ in plain], k=60)
        for _ in range(4 * bad):
            text[pick.randrange(60)] = pick.choice(["vile", "nasty"])
        body = " ".join(text) + ".\n" + " ".join(text[:20]) + "."
        rows.append((i, body, None))
        labels.append((i, int(bad)))
    return make(rows), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity(make, spark, awkward):
    docs, labels = labelled(make, spark)
    got = toxicity.toxicity(docs, docs, labels).collect()
    assert {r.doc_id for r in got if r.held_out} == {i for i in range(400) if crc32(str(i).encode()) % 3 == 1}
    right = [r.predicted == (r.doc_id % 4 == 0) for r in got if r.held_out]
    assert sum(right) >= 0.95 * len(right)
    assert toxicity.clean_documents(docs, labels).schema == docs.schema
    unknown = toxicity.toxicity(awkward, awkward, labels.limit(0)).collect()
    assert len(unknown) == 11 and {r.score for r in unknown} == {0.5}


def test_quality(make, spark, awkward):
    docs, _ = labelled(make, spark)
    bad = F.col("doc_id") % 5 == 0
    docs = docs.withColumn("text", F.when(bad, F.upper("text")).otherwise(F.col("text")))
    labels = docs.select("doc_id", (~bad).cast("int").alias("quality"))
    got = quality.quality(docs, docs, labels).collect()
    right = [r.predicted == (r.doc_id % 5 != 0) for r in got if r.held_out]
    assert sum(right) >= 0.98 * len(right)
    assert len(quality.quality(awkward, docs, labels).where("score between 0 and 1").collect()) == 11
    assert {r.score for r in quality.quality(awkward, awkward, labels.limit(0)).collect()} == {0.5}


def test_marginals_equal_enumeration():
    gain, move, counts = np.array([0.3, -1.0, 2.0, 0.5]), np.array([[0.7, -0.2], [0.1, 0.4]]), np.array([3, 1])
    good, _ = quality.marginals(gain, move, counts)
    weight = {}
    for path in np.ndindex(2, 2, 2):
        weight[path] = math.exp(sum(gain[t] * y for t, y in enumerate(path)) + move[path[0], path[1]] + move[path[1], path[2]])
    for t in range(3):
        assert good[t] == pytest.approx(sum(w for p, w in weight.items() if p[t]) / sum(weight.values()))
    assert good[3] == pytest.approx(1 / (1 + math.exp(-0.5)))


# Language model

def test_forward_equals_enumeration():
    pick = np.random.default_rng(1)
    states, symbols = language_model.STATES, 5
    move = pick.dirichlet(np.ones(states), states)
    emit = pick.dirichlet(np.ones(symbols), states).T
    start = pick.dirichlet(np.ones(states))
    model = language_model.Model(start, move, emit)
    text = np.array([0, 3, 1, 2], np.uint16)
    lanes = language_model.in_lanes(np.array([1, 3]))
    got = np.empty(2)
    got[lanes.order] = language_model.forward(text, lanes, model)
    assert got[0] == pytest.approx(math.log10(start @ emit[0]))
    total = sum(start[a] * emit[3, a] * move[a, b] * emit[1, b] * move[b, c] * emit[2, c]
                for a, b, c in np.ndindex(states, states, states))
    assert got[1] == pytest.approx(math.log10(total))


@pytest.mark.parametrize("frequent", [100_000, 3])
def test_language_model_counts(awkward, monkeypatch, frequent):
    monkeypatch.setattr(language_model, "FREQUENT", frequent)
    train = common.remainder(F.col("doc_id"), 7) != 2
    got = language_model.score(awkward, train, rounds=1).collect()
    texts = [(i, words(t) + [None]) for i, t, _ in rows_of(awkward)]
    learned = Counter(w for i, t in texts if crc32(b"" if i is None else str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(learned.values()), len(learned)
    want = sorted((len(t), sum(learned[w] > 0 for w in t), n,
                   round(sum(math.log10((learned[w] + 1) / (n + v + 1)) for w in t), 5)) for _, t in texts)
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_every_word_has_emissions_of_its_own(make, monkeypatch):
    pick = random.Random(2)
    topics = [[f"{name}{i}abc" for i in range(30)] for name in "pq"]
    docs = make([(i, " ".join(pick.choices(topics[i % 2], k=40)), None) for i in range(80)])
    train = F.col("doc_id") < 60

    def scores(frequent):
        monkeypatch.setattr(language_model, "FREQUENT", frequent)
        return {r.doc_id: r for r in language_model.score(docs, train, rounds=6).collect()}

    # Words that are not broadcast learn their topic, too, though all have one ending.
    for got in (scores(3),):
        held = [r for i, r in got.items() if i >= 60]
        assert sum(r.score for r in held) > sum(r.base_score for r in held) + 2 * len(held)
    # All words' probabilities after a step, and the unknown one's, add up to 1 in each state.
    rows = common.texts(docs).withColumn("train", F.lit(True))
    counts = language_model.count_words(rows.select("doc_id", "text"))
    known = language_model.vocabulary(counts)
    model, others = language_model.first_model(known, counts)
    table = language_model.encoded(rows, known)
    last = -math.inf
    for _ in range(3):
        model, others, likelihood = language_model.improved(table, model, others, known)
        assert likelihood > last and others.table.count() + len(known.frequent) == 60
        assert model.emit.sum(0) + language_model.sums(others.table, "e") + others.unknown == pytest.approx(np.ones(8))
        last = likelihood

def test_expected_counts_equal_enumeration():
    pick = np.random.default_rng(3)
    states = language_model.STATES
    model = language_model.Model(pick.dirichlet(np.ones(states)), pick.dirichlet(np.ones(states), states),
                                 pick.dirichlet(np.ones(6), states).T)
    texts = [[4], [0, 3, 1, 3], [2, 0]]
    lengths = np.array([len(x) for x in texts])
    start, moved, emitted, total = language_model.expected_counts(np.concatenate(texts), lengths, model)
    want = [np.zeros(states), np.zeros((states, states)), np.zeros((6, states)), 0.0]
    for text in texts:
        paths = {}
        for path in np.ndindex(*[states] * len(text)):
            p = model.start[path[0]]
            for t, symbol in enumerate(text):
                p *= model.emit[symbol, path[t]] * (model.move[path[t - 1], path[t]] if t else 1)
            paths[path] = p
        whole = sum(paths.values())
        want[3] += math.log10(whole)
        for path, p in paths.items():
            want[0][path[0]] += p / whole
            for t, symbol in enumerate(text):
                want[2][symbol, path[t]] += p / whole
                if t:
                    want[1][path[t - 1], path[t]] += p / whole
    for got, right in zip((start, moved, emitted, total), want):
        assert got == pytest.approx(right, rel=1e-4, abs=1e-5)


def test_shares_and_symbols_are_unpacked_as_packed(spark):
    states = language_model.STATES
    shares = np.exp(np.random.default_rng(4).normal(0, 3, (20, states)))
    rows = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(shares)],
                                 ["c", *[f"s{s}" for s in range(states)]])
    packed = rows.select("c", *language_model.packed_shares([F.col(f"s{s}") for s in range(states)]))
    stored = packed.select("c", "p0", "p1", *language_model.weighted_shares()).orderBy("c").toPandas()
    read = language_model.unpacked_shares(stored["p0"].to_numpy(), stored["p1"].to_numpy())
    assert read == pytest.approx(shares, rel=1e-3)
    assert stored.iloc[:, 3:].to_numpy() == pytest.approx((np.arange(20)[:, None] + 1) * read)
    equal = np.array([language_model.EQUAL_SHARES])
    assert (language_model.unpacked_shares(equal, equal) == 1).all()
    symbols = np.array([0, 1, 255, 256, 70_000, 2**31], np.uint32)
    assert list(language_model.unpacked_symbols(language_model.packed_symbols(symbols))) == list(symbols)


def test_language_model_beats_the_word_frequencies_on_held_out_texts(make, monkeypatch):
    monkeypatch.setattr(language_model, "FREQUENT", 20)
    pick = random.Random(5)
    topics = [[f"{name}{i}" for i in range(40)] for name in "pq"]
    docs = make([(i, " ".join(pick.choices(topics[i % 2], k=60)), None) for i in range(200)])
    got = [r for r in language_model.score(docs, F.col("doc_id") < 160).collect() if r.doc_id >= 160]
    assert len(got) == 40 and sum(r.score for r in got) > sum(r.base_score for r in got) + 2 * len(got)


# Decontamination

def test_contaminated(make, spark, awkward):
    item = [f"k{i}" for i in range(30)]
    changed = list(item)
    for k in (4, 9, 14, 19, 24):
        changed[k] = "other"
    noise = [f"n{i}" for i in range(200)]
    texts = [" ".join(noise[:50] + item + noise[50:]), " ".join(noise[:9] + changed), " ".join(noise),
             " ".join(item[:10] + noise), " ".join(x + "***" for x in item).upper()]
    benchmark = spark.createDataFrame([(1, " ".join(item)), (2, "too short"), (3, None)], "item_id long, text string")
    docs = make([(i, t, None) for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in decontamination.contaminated(docs, benchmark).collect()}
    assert set(got) == {0, 1, 4} and got[0].shift == 50 and got[0].matched == 16 and got[1].matched == 13
    kept = decontamination.clean_documents(docs, benchmark)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {2, 3}
    assert decontamination.contaminated(awkward, benchmark).collect() == []
    assert decontamination.clean_documents(awkward, benchmark).count() == 11


def may_differ(width):
    return width - next(m for m in range(width + 1) if m >= width * decontamination.SIMILARITY)


def test_masks_leave_a_seed_wherever_words_are_replaced():
    for length in range(1, decontamination.WINDOW + 1):
        placed = [{at + k for k, mark in enumerate(mask) if mark == "1"}
                  for mask in decontamination.masks_of(length) for at in range(length - len(mask) + 1)]
        for n in range(may_differ(length) + 1):
            for replaced in combinations(range(length), n):
                assert any(not marked & set(replaced) for marked in placed), (length, replaced)


@pytest.mark.parametrize("broadcast", [decontamination.BROADCAST_SEEDS, 0])
def test_contaminated_equals_brute_force(make, spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontamination, "BROADCAST_SEEDS", broadcast)
    pick = random.Random(broadcast)
    names = [f"w{i}" for i in range(12)]
    items = {n: pick.choices(names, k=n) for n in [*range(1, 18), 23]}
    docs = {i: pick.choices(names, k=pick.randrange(60)) for i in range(60)}
    for i in range(60, 160):
        # An item, or a part of it, with some words replaced, at the start, the end or inside of a text.
        part = list(items[list(items)[i % len(items)]])
        for k in pick.sample(range(len(part)), min(len(part), pick.randrange(5))):
            part[k] = "other"
        docs[i] = pick.choices(names, k=pick.choice((0, 3))) + part + pick.choices(names, k=pick.choice((0, 3)))
    want = {}
    for i, words_of in docs.items():
        for n, item in items.items():
            width = min(n, decontamination.WINDOW)
            fits = [(sum(map(eq, item[at:at + width], words_of[b:b + width])), at - b)
                    for at in range(n - width + 1) for b in range(len(words_of) - width + 1)]
            if fits and max(fits)[0] >= width * decontamination.SIMILARITY:
                want[i, n] = (width, max(fits)[0], -max(fits)[1])
    benchmark = spark.createDataFrame([(n, " ".join(item)) for n, item in items.items()], "item_id long, text string")
    table = make([(i, ", ".join(words_of), None) for i, words_of in docs.items()])
    got = decontamination.contaminated(table, benchmark).collect()
    assert {(r.doc_id, r.item_id): (r.width, r.matched, r.shift) for r in got} == want and len(got) == len(want)
    assert {n for _, n in want} == set(items)
    kept = {r.doc_id for r in decontamination.clean_documents(table, benchmark).collect()}
    assert kept == set(docs) - {i for i, n in want if n >= decontamination.TELLING}


# Pseudonyms

def luhn(digits):
    pairs = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in pairs) % 10 == 0


def test_pseudonyms(make, awkward):
    text = ("4111 1111 1111 1111, 4111111111111111 4111111111111112 1.2.3.4. 999.1.1.1 1984-02-29 1983-02-29 "
            "123-45-6789 000-12-3456 (017) 555-7713 a.b7@x.example.com GB82WEST12345698765432 GB83WEST12345698765432")
    row = pseudonyms.pseudonymized(make([(1, text, None), (2, "so 1.2.3.4", None)])).orderBy("doc_id").collect()
    got = re.split(r", | (?!\d{4} |555|\d{4},)", row[0].text)
    assert (row[0].n_found, row[0].n_replaced) == (13, 8)
    for same in ("4111111111111112", "999.1.1.1", "1983-02-29", "000-12-3456", "GB83WEST12345698765432"):
        assert same in row[0].text
    card = got[0].replace(" ", "")
    assert luhn(card) and card != "4" + "1" * 15 and row[0].text.count(card) == 1
    address = re.search(r"(\S+)\. 999", row[0].text)[1]
    assert row[1].text == f"so {address}"
    assert row[0].text.endswith(" GB83WEST12345698765432") and "@x.example.com" in row[0].text
    other = pseudonyms.pseudonymized(make([(2, "so 1.2.3.4", None)]), key="another").collect()[0].text
    assert other != row[1].text
    assert {r.text for r in pseudonyms.pseudonymized(awkward).collect()} == {t or "" for _, t, _ in rows_of(awkward)}


def test_other_written_forms(make):
    def made(text):
        row = pseudonyms.pseudonymized(make([(1, text, None)])).collect()[0]
        return row.text, row.n_found, row.n_replaced

    forms = ["+44 20 7946 0958", "+44 (0)20 7946 0958", "+442079460958", "+33 1 23 45 67 89", "+33123456789",
             "+34 912 345 678", "+49 30 123456", "+49 (30) 123456", "555 123 4567", "+1 555-123-4567", "1-555-123-4567",
             "DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947",
             "2021/03/04", "2021-03-04", "4 March 2021", "March 4th, 2021", "4. März 2021", "4 mars 2021",
             "4 de marzo de 2021", "04-Mar-2021", "MAR 4 2021"]
    text, found, replaced = made("; ".join(forms) + "; BE12 4111 1111 1111 1111; 2021/13/45; 31 April 2021.")
    got = text.split("; ")
    assert (found, replaced) == (len(forms) + 3, len(forms) + 1)
    assert got[-2:] == ["2021/13/45", "31 April 2021."] and got[-3].startswith("BE12 ") and luhn(re.sub(r"\D", "", got[-3])[2:])
    assert all(new != old for new, old in zip(got, forms))
    at = dict(zip(forms, got))

    def bare(form):
        return re.sub(r"\(0\)|[^0-9A-Za-z]", "", at[form])

    assert bare(forms[0]) == bare(forms[1]) == bare(forms[2]) and bare(forms[3]) == bare(forms[4])
    assert bare(forms[6]) == bare(forms[7]) and bare(forms[8]) == bare(forms[9])[1:] == bare(forms[10])[1:]
    assert bare(forms[11]) == bare(forms[12]) and at[forms[11]].startswith("DE") and at[forms[11]].count(" ") == 5
    assert [k for k, c in enumerate(at[forms[3]]) if c == " "] == [3, 5, 8, 11, 14] and at[forms[3]].startswith("+33")
    year, month, day = at["2021-03-04"].split("-")
    names = {kind: [name.capitalize() for name in pseudonyms.MONTHS[kind]] for kind in pseudonyms.MONTHS}
    m, d = int(month) - 1, int(day)
    assert at["2021/03/04"] == f"{year}/{month}/{day}" and at["4 March 2021"] == f"{d} {names['en'][m]} {year}"
    assert at["March 4th, 2021"].startswith(f"{names['en'][m]} {d}") and at["March 4th, 2021"].endswith(f", {year}")
    assert at["4. März 2021"] == f"{d}. {names['de'][m]} {year}"
    assert at["4 mars 2021"] == f"{d} {names['fr'][m].lower()} {year}"
    assert at["4 de marzo de 2021"] == f"{d} de {names['es'][m].lower()} de {year}"
    assert at["04-Mar-2021"] == f"{day}-{names['en short'][m]}-{year}"
    assert at["MAR 4 2021"] == f"{names['en short'][m].upper()} {d} {year}"


def test_feistel_is_a_permutation(spark):
    df = spark.range(1000).select(pseudonyms.permuted_digits("k", "t", F.lpad(F.col("id").cast("string"), 3, "0")).alias("x"))
    assert {r.x for r in df.collect()} == {f"{i:03d}" for i in range(1000)}


# Empty tables

def test_empty_tables(empty, spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    benchmark = spark.createDataFrame([], "item_id long, text string")
    results = [
        exact_dedup.exact_dedup(empty, empty), mixing.mix(empty), token_ids.token_ids(empty),
        simhash.simhash_groups(empty), line_dedup.line_classes(empty), toxicity.toxicity(empty, empty, labels),
        quality.quality(empty, empty, labels), language_model.score(empty, F.lit(True), 1),
        decontamination.contaminated(empty, benchmark), pseudonyms.pseudonymized(empty),
    ]
    for result in results:
        assert result.collect() == []
