"""Groups of near copies in line dedup: whole counts, but no row per pair."""

import itertools
import math
import random
import string

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from shelfgauge.llm import common, language_model, line_dedup


@pytest.mark.parametrize("tile", [4_096, 7])
def test_a_group_of_near_copies_gives_no_row_per_pair(make, monkeypatch, tile):
    monkeypatch.setattr(line_dedup, "TILE", tile)
    seen = {}

    def noted(frame, name):
        seen[name] = made = written(frame, name)
        return made

    written = line_dedup.written
    monkeypatch.setattr(line_dedup, "written", noted)
    pick = random.Random(5)
    base = [f"w{i}" for i in range(20)]
    lines = [" ".join(base[:19] + [f"x{i}"]) for i in range(60)]
    lines += [" ".join(pick.sample(base, 18)) for _ in range(30)] + lines[:5]
    ids = [None if i == 40 else i for i in range(len(lines))]
    rows = line_dedup.line_classes(make([(i, line, None) for i, line in zip(ids, lines)])).collect()
    words = [frozenset(line.split()) for line in lines]
    order = sorted(range(len(lines)), key=lambda n: (ids[n] is not None, ids[n]))
    place = {n: k for k, n in enumerate(order)}
    got = {r.doc_id: r for r in rows}
    for n, own in enumerate(words):
        near = [m for m, x in enumerate(words) if 5 * len(own & x) >= 4 * len(own | x)]
        assert got[ids[n]].n_links == len({words[m] for m in near}) - 1
        assert got[ids[n]].kept == (min(place[m] for m in near) == place[n])
    # A row per set and tile of its group; the 60 lines alone have 1,770 pairs.
    assert got[0].n_links >= 59
    tiles = -(-len(set(words)) // tile)
    assert seen["line-links"].count() <= len(set(words)) * tiles and seen["line-candidates"].count() <= len(set(words))


def test_words_of_a_chunk_are_hashed_once_each(monkeypatch):
    pick = random.Random(3)
    texts = ["".join(pick.choices(list(" \t\n\x0b\r\x1c\x85AbB\xe9\xc9\U0001f600"), k=pick.randint(0, 40))) for _ in range(300)] + ["", "\n"]
    lines = [line for text in texts for line in text.split("\n")]
    sets = [set(line.encode().lower().split()) for line in lines]
    want = [sorted(line_dedup.word_hashes(line).tolist()) for line in lines]
    hashed, digest = [], line_dedup.xxhash.xxh3_64_intdigest

    def counted(word):
        hashed.append(word)
        return digest(word)

    monkeypatch.setattr(line_dedup.xxhash, "xxh3_64_intdigest", counted)
    found = line_dedup.LineWords(pa.array(texts))
    line, word = found.sets(np.argsort(found.hashes))
    assert found.lines.tolist() == [text.count("\n") + 1 for text in texts]
    assert sorted(hashed) == sorted(set().union(*sets))
    hashes = np.sort(found.hashes)
    assert [hashes[word[line == n]].tolist() for n in range(len(lines))] == want


def test_postings_meet_in_every_tile_and_are_packed(monkeypatch):
    monkeypatch.setattr(line_dedup, "POSTINGS", 50)
    n, tile = 40, 4
    prefix = np.full(n, 7, "<u4")
    counts = np.zeros(1 << line_dedup.COUNT_BITS, np.int64)
    counts[7 >> 32 - line_dedup.COUNT_BITS] = n
    batch = pa.RecordBatch.from_pydict({
        "id": np.arange(n), "size": np.full(n, 5, np.int32), "parity1": np.zeros(n, np.int64), "parity2": np.zeros(n, np.int64),
        "prefix": [x.tobytes() for x in prefix]})
    held = list(line_dedup.postings(batch, counts, tile))
    assert sum(map(len, held)) == n * (n // tile) and max(map(len, held)) < 2 * 50
    packed = line_dedup.dealt(held, 3).to_pandas()
    assert len(packed) <= 3
    together = set()
    for rows in packed["rows"]:
        for _, cell in line_dedup.met_postings(pd.Series([rows])).groupby("cell"):
            together |= {(a, b) for a in cell["id"] for b in cell["id"] if a < b}
    assert len(together) == n * (n - 1) // 2


def test_pieces_of_a_batch_keep_their_words(monkeypatch):
    monkeypatch.setattr(common, "CHUNK_BYTES", 60)
    texts = [f"Wörd{i} ÀB{i}\nsame é{i}" for i in range(40)] + [""]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(41)), "text": texts}).slice(3)
    pieces = list(common.column_chunks(batch))
    assert len(pieces) > 5 and [i for piece in pieces for i in piece["doc_id"].to_pylist()] == list(range(3, 41))
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    found = [word for piece in pieces for word in language_model.words_of(piece["text"])[0].to_pylist()]
    assert found == [word for text in texts[3:] for word in text.translate(lower).split()]
    want = {int(h) for text in texts[3:] for line in text.split("\n") for h in line_dedup.word_hashes(line)}
    assert {int(h) for piece in pieces for h in line_dedup.LineWords(piece["text"]).hashes} == want


@pytest.mark.parametrize("with_place", [True, False])
def test_pairs_pass_the_filters_as_one_by_one(with_place):
    random_ = np.random.default_rng(2)
    frame = pd.DataFrame({"cell": random_.integers(0, 5, 150), "id": random_.integers(0, 80, 150), "size": random_.integers(4, 16, 150)})
    frame["parity1"], frame["parity2"] = (random_.integers(-1, 1, 150) ^ (np.int64(1) << random_.integers(0, 64, 150)) for _ in range(2))
    if with_place:
        frame["place"] = random_.integers(0, 4, 150)
    frame = frame.sort_values(["cell", "size"]).reset_index(drop=True)
    want = set()
    for a, b in itertools.combinations(frame.assign(row=range(150)).to_dict("records"), 2):
        total = a["size"] + b["size"]
        overlap = math.ceil(0.8 / 1.8 * total - 1e-9)
        apart = sum(((a[x] ^ b[x]) & (1 << 64) - 1).bit_count() for x in ("parity1", "parity2"))
        places = a.get("place", 0), b.get("place", 0)
        rest = min(a["size"] - places[0], b["size"] - places[1])
        if (a["cell"] == b["cell"] and a["id"] != b["id"] and a["size"] >= 0.8 * b["size"] - 1e-9
                and apart <= total - 2 * overlap and min(places) + rest >= overlap):
            want.add((a["row"], b["row"]))
    got = [pair for low, high in line_dedup.near_pairs(frame, 0.8) for pair in zip(low.tolist(), high.tolist())]
    assert want and len(got) == len(set(got)) and set(got) == want
    assert list(line_dedup.near_pairs(frame.iloc[:0], 0.8)) == []
