"""The pipeline's stages: what goes, what stays, and the columns."""

import random
import re

import public_tokenizers
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from shelfgauge.llm import mixing, toxicity


def test_stages_over_the_smallest_tables(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = corpus_pipeline.read_table(spark, sf_dir, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        assert docs.join(before, "doc_id", "left_anti").isEmpty()
        if name != "mixing":
            assert docs.count() <= before.count()
    got = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    rows = got.orderBy("start").collect()
    assert len(rows) == docs.count()
    assert [r.start for r in rows[1:]] == [r.start + r.n_tokens for r in rows[:-1]]
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)


def test_awkward_documents_pass_all_stages(spark, awkward, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    awkward.write.parquet(f"{tmp_path}/documents.parquet")
    docs = awkward
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), name)
    # 2 copies 1; the three texts without words are one group, and so are the two rows of document 7.
    assert sorted(r.doc_id or 0 for r in docs.select("doc_id").collect()) == [0, 1, 3, 7, 8, 9, 10]
    assert corpus_pipeline.run(spark, str(tmp_path)).where(F.col("n_tokens") < 1).isEmpty()


def test_rows_go_by_their_own_texts(spark, make, tmp_path):
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    same = "three rows have this text of nine words exactly"
    rows = [(1, same, "a"), (None, same, "a"), (None, "a text of its own without an id here", "b"), (5, same, "a"),
            (5, "another text of its own that shares an id", "b"), (None, f"so it says {ITEM}", "a"), (None, "clean words only", "a")]
    near = corpus_pipeline.drop_near_copies(spark, make(rows), str(tmp_path))
    assert near.columns == make([]).columns
    assert sorted((r.doc_id or 0, r.text) for r in near.collect()) == sorted(
        (rows[i][0] or 0, rows[i][1]) for i in (0, 2, 4, 5, 6))
    clean = corpus_pipeline.drop_contaminated(spark, near, str(tmp_path))
    assert sorted((r.doc_id or 0, r.text) for r in clean.collect()) == sorted((rows[i][0] or 0, rows[i][1]) for i in (0, 2, 4, 6))


ITEM = "which of the seven rivers of the old land runs longest before it meets the cold northern sea"


def fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [words[i:i + 3] for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(b" ".join(gram), 42) for gram in grams]
    return sum((2 * sum(h >> bit & 1 for h in hashes) > len(hashes)) << bit for bit in range(64))


def without_near_copies(rows):
    prints = [fingerprint(text) for _, text in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    first = {g: min((i for i in range(len(rows)) if group[i] == g), key=lambda i: rows[i][0]) for g in set(group)}
    return [rows[i] for i in sorted(first.values())]


def holds(text, item):
    have, want = (re.findall(r"[^\W_]+", x.lower()) for x in (text or "", item))
    for shift in range(-len(want), len(have)):
        same = [have[i + shift] == word if 0 <= i + shift < len(have) else None for i, word in enumerate(want)]
        windows = [same[i:i + 16] for i in range(len(want) - 15)]
        if any(None not in window and sum(window) >= 0.8 * 16 for window in windows):
            return True
    return False


def test_stages_equal_plain_python(spark, make, tmp_path):
    pick = random.Random(11)
    lexicon = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(160):
        toxic = i % 4 == 0
        said = pick.choices(lexicon, k=pick.randint(30, 90)) + (pick.choices(["vile", "scum", "filth"], k=12) if toxic else [])
        pick.shuffle(said)
        rows.append((i, " ".join(said), pick.choice("ab"), int(toxic)))
    for i in range(160, 190):
        _, text, source, toxic = rows[pick.randrange(150)]
        rows.append((i, text.upper() if i % 2 else text.replace(" ", "  ", 3), source, toxic))
    for i in range(190, 200):
        item = ITEM.split()
        if i % 2:
            item[pick.randrange(3, 13)] = "replaced"
        rows.append((i, f"{rows[i - 190 + 1][1]} {' '.join(item)} tail", "a", 0))
    docs = make([row[:3] for row in rows])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, toxic) for i, _, _, toxic in rows], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def held(df):
        return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())

    got = docs = corpus_pipeline.read_table(spark, str(tmp_path), "documents")
    weights = toxicity.dense_weights(toxicity.fit(docs, labels))
    want = [(i, text) for i, text, _, _ in rows if toxicity.probability(text, weights) < 0.7]
    assert 0 < len(want) < len(rows) and not any(toxic for i, _, _, toxic in rows if i in {x for x, _ in want})
    for (_, stage), plain in zip(corpus_pipeline.STAGES, (
            None, without_near_copies, lambda rows: [row for row in rows if not holds(row[1], ITEM)])):
        want = plain(want) if plain else want
        got = corpus_pipeline.written(stage(spark, got, str(tmp_path)), "stage")
        assert held(got) == sorted(want)
    assert not any(i >= 160 for i, _ in want)

    copies = {r.doc_id: r.copies for r in mixing.mix(got).collect()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    counts = [(i, len(tokenizer.encode(text, add_special_tokens=False).ids) + 1) for i, text in sorted(want) for _ in range(copies[i])]
    final = corpus_pipeline.run(spark, str(tmp_path)).orderBy("start").collect()
    assert [(r.doc_id, r.n_tokens) for r in final] == counts


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
