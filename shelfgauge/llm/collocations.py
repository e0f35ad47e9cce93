"""Phrase collocations: n-grams counted by direct-address tiles over frequency-ranked ids.

Texts are cut into chunks of token numbers once.  Words that are frequent
enough get ids by falling frequency, so the pairs that occur most lie in the
low corner of the square of all id pairs.  That corner is cut into tiles of
TILE x TILE cells which are addressed directly and counted by ``bincount``;
the cells of other pairs are sorted and counted as coordinate lists, dealt by a
hash of the pair.  Frequent pairs are then ranked in turn, and a phrase of three
words is counted as the pair of a pair's rank and a word's.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfgauge.llm.common import UPPER, in_chunks, read_table, written
from shelfgauge.operators.ranking import running_total

LEAST = 10
TOP = 2_000
# A longer phrase takes the place of a shorter one within it from this share of its occurrences.
SHARE = 50
UNKNOWN = "und"
# Tokens of a chunk; one text may go beyond.
CHUNK_TOKENS = 4_000_000
# Ids below DENSE are counted in tiles of TILE x TILE cells.
TILE, DENSE = 512, 4_096
AREA, ACROSS = TILE * TILE, DENSE // TILE
# A chunk's tile with an occurrence for so many cells is counted by bincount, another by sorting.
CELLS_PER_PAIR = 16
# Coordinate lists are dealt to parts of about so many occurrences; tiles are added up so many at a time.
PART_PAIRS, FAN_IN = 4_000_000, 16
# Pairs ranked for the tiles of three words, over all languages.
RANKED_PAIRS = 1 << 16
# Marks of frequent pairs: a pair whose mark is not set is not frequent.
MARK_BITS, SEGMENT_BITS = 26, 15
# Rows of one top-k window.
WINDOW_ROWS = 200_000

BREAK, EMPTY = 0, 1
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
TABLE = bytes.maketrans(UPPER.encode() + SEPARATORS + b"\t", UPPER.lower().encode() + b"\n" * len(SEPARATORS) + b" ")

CHUNK_SCHEMA = "chunk long, lang string, n_tokens long, words binary, counts binary, stream binary"
WORD_SCHEMA = "chunk long, lang string, place int, word binary, n long"
ENTRY_SCHEMA = "lang string, part int, flush long, lefts binary, rights binary, counts binary"
TILE_SCHEMA = "lang string, part int, slot long, rights binary, counts binary"
COUNT_SCHEMA = "lang string, left long, right long, a long"


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers as compressed byte planes, as many as the greatest one fills."""
    n_planes = (int(values.max(initial=0)).bit_length() + 7) // 8 or int(len(values) > 0)
    planes = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8).T[:n_planes]
    return zstandard.compress(bytes([n_planes]) + planes.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    raw = zstandard.decompress(bytes(data))
    n_planes = raw[0]
    if not n_planes:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(n_planes, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, :n_planes] = planes.T
    return wide.view("<i8").ravel()


class Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, key):
        number = self[key] = len(self)
        return number


class Chunk:
    """The tokens of one language within a task: 0 parts pieces, other numbers are words."""

    def __init__(self):
        self.numbers = Numbers({b"\n": BREAK, b"": EMPTY})
        self.streams: list[np.ndarray] = []

    def add(self, texts: list[bytes]) -> int:
        blob = b"\n".join([*texts, b""]).translate(TABLE)
        parts = blob.replace(b"\n", b" \n ").split(b" ")
        stream = np.fromiter(map(self.numbers.__getitem__, parts), np.int32, len(parts))
        stream = stream[stream != EMPTY]
        stream = stream[np.append(True, (stream[1:] != BREAK) | (stream[:-1] != BREAK))] if len(stream) else stream
        self.streams.append(stream)
        return len(stream)

    def row(self, chunk: int, lang: str) -> dict:
        stream = np.concatenate(self.streams)
        counts = np.bincount(stream, minlength=len(self.numbers))[2:]
        return {"chunk": chunk, "lang": lang, "n_tokens": int(counts.sum()), "words": b" ".join(list(self.numbers)[2:]),
                "counts": pack(counts), "stream": pack(np.maximum(stream - 1, 0))}


def chunk_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    chunks: dict[str, Chunk] = {}
    held, number = 0, TaskContext.get().partitionId() << 32
    for frame in in_chunks(frames):
        for lang, group in frame.groupby("lang", sort=True):
            held += chunks.setdefault(lang, Chunk()).add([text.encode("utf-8", "replace") for text in group["text"]])
        if held >= CHUNK_TOKENS:
            yield pd.DataFrame([chunk.row(number + i, lang) for i, (lang, chunk) in enumerate(chunks.items())])
            number, chunks, held = number + len(chunks), {}, 0
    if chunks:
        yield pd.DataFrame([chunk.row(number + i, lang) for i, (lang, chunk) in enumerate(chunks.items())])


def chunked(docs: DataFrame) -> DataFrame:
    """The corpus as token numbers, one row per chunk and language, each with its own vocabulary."""
    rows = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return written(rows.mapInPandas(chunk_rows, CHUNK_SCHEMA), "phrase-chunks")


def word_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The distinct words of each chunk with their place in it, in frames of a bounded size."""
    for frame in frames:
        for row in frame.itertuples(index=False):
            counts = unpack(row.counts)
            words = bytes(row.words).split(b" ")[:len(counts)]
            for start in range(0, len(words), 100_000):
                part = slice(start, start + 100_000)
                yield pd.DataFrame({
                    "chunk": row.chunk, "lang": row.lang, "place": np.arange(start, start + len(words[part])),
                    "word": words[part], "n": counts[part]})


def ranked_words(chunk_words: DataFrame) -> DataFrame:
    """(lang, word, f, id) of words that occur LEAST times: ids of a language from 0, by falling frequency."""
    counted = chunk_words.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= LEAST)
    placed = counted.select("lang", "word", "f", F.struct((-F.col("f")).alias("f"), "word").alias("_order"), F.lit(1).alias("_one"))
    ranked = running_total(written(placed, "phrase-words"), ("lang",), "_order", "_one", "_upto")
    return written(ranked.select("lang", "word", "f", (F.col("_upto") - 1).alias("id")), "phrase-words")


def number_stream(key: tuple, chunks: pd.DataFrame, ids: pd.DataFrame) -> pd.DataFrame:
    """A chunk's stream in ids of the whole corpus, plus 1; 0 where there is no frequent word."""
    rows = []
    for row in chunks.itertuples(index=False):
        stream = unpack(row.stream)
        known = np.zeros(int(stream.max(initial=0)) + 1, np.int64)
        known[ids["place"].to_numpy() + 1] = ids["id"].to_numpy() + 1
        stream = known[stream]
        if len(stream):
            stream = stream[np.append(True, (stream[1:] != 0) | (stream[:-1] != 0))]
        rows.append({"flush": row.chunk, "lang": row.lang, "ids": pack(stream)})
    return pd.DataFrame(rows, columns=["flush", "lang", "ids"])


def numbered(chunks: DataFrame, chunk_words: DataFrame, words: DataFrame) -> DataFrame:
    """(flush, lang, ids): every chunk's stream of word ids; each chunk is sent its own words' ids only."""
    ids = chunk_words.join(words, ["lang", "word"]).select("chunk", "place", "id")
    both = chunks.select("chunk", "lang", "stream").groupBy("chunk").cogroup(ids.groupBy("chunk"))
    return written(both.applyInPandas(number_stream, "flush long, lang string, ids binary"), "phrase-streams")


# Counting pairs of (left, right)

def part_of(left: np.ndarray, right: np.ndarray, parts: int) -> np.ndarray:
    mixed = (left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (right.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def coordinate_list(left: np.ndarray, right: np.ndarray, n: np.ndarray | None = None) -> tuple:
    """Distinct (left, right) in order, and the sum of ``n`` (1 by default) of each."""
    lefts, at = np.unique(left, return_inverse=True)
    code = (at.astype(np.int64) << 32) | right
    order = np.argsort(code, kind="stable")
    code = code[order]
    starts = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
    sums = np.diff(np.append(starts, len(code))) if n is None else (
        np.add.reduceat(n[order], starts) if len(starts) else np.zeros(0, np.int64))
    code = code[starts]
    return lefts[code >> 32], code & 0xFFFFFFFF, sums


def entries(lang: str, flush: int, left: np.ndarray, rank: np.ndarray, right: np.ndarray, parts: int) -> pd.DataFrame:
    """What a chunk counts: its cells of tiles (``part`` below 0) and its coordinate lists, by part.

    ``rank`` is the place of ``left`` among the ids that tiles address, or DENSE and above.
    """
    rows = []
    near = (rank < DENSE) & (right < DENSE)
    tile = rank[near] // TILE * ACROSS + right[near] // TILE
    cell = rank[near] % TILE * TILE + right[near] % TILE
    order = np.argsort(tile.astype(np.uint8), kind="stable")
    cell, ends = cell[order], np.cumsum(np.bincount(tile, minlength=ACROSS * ACROSS))
    for number, (start, end) in enumerate(zip([0, *ends], ends)):
        if start == end:
            continue
        if (end - start) * CELLS_PER_PAIR >= AREA:
            counts = np.bincount(cell[start:end], minlength=AREA)
            cells = np.flatnonzero(counts)
            counts = counts[cells]
        else:
            cells, counts = np.unique(cell[start:end], return_counts=True)
        rows.append((lang, -1 - number, flush, b"", pack(cells), pack(counts)))
    lefts, rights, counts = coordinate_list(left[~near], right[~near])
    part = part_of(lefts, rights, parts)
    order = np.argsort(part, kind="stable")
    ends = np.cumsum(np.bincount(part, minlength=parts))
    for number, (start, end) in enumerate(zip([0, *ends], ends)):
        if start < end:
            at = order[start:end]
            rows.append((lang, number, flush, pack(np.diff(lefts[at], prepend=0)), pack(rights[at]), pack(counts[at])))
    return pd.DataFrame(rows, columns=["lang", "part", "flush", "lefts", "rights", "counts"])


def add_tiles(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(AREA, np.int64)
    for cells, counts in zip(group["rights"], group["counts"]):
        total[unpack(cells)] += unpack(counts)
    cells = np.flatnonzero(total)
    return pd.DataFrame([{"lang": key[0], "part": key[1], "slot": key[2], "rights": pack(cells), "counts": pack(total[cells])}])


def add_lists(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    columns = [[np.cumsum(unpack(data)) for data in group["lefts"]],
               [unpack(data) for data in group["rights"]], [unpack(data) for data in group["counts"]]]
    left, right, a = coordinate_list(*map(np.concatenate, columns))
    enough = a >= LEAST
    return pd.DataFrame({"lang": key[0], "left": left[enough], "right": right[enough], "a": a[enough]})


def counted_pairs(found: DataFrame, n_flushes: int, ranked: dict[str, np.ndarray] | None, name: str) -> DataFrame:
    """(lang, left, right, a) of pairs that occur LEAST times, stored, from the ``entries`` of all chunks.

    A tile is added up FAN_IN chunks at a time, so no task holds more than
    about FAN_IN tiles.  A part of the coordinate lists holds few occurrences.
    ``ranked`` gives the left values of tile rows; None where they are ids.
    """
    found = written(found, name)
    slots = max(n_flushes, 1)
    tiles = found.where("part < 0").select(
        "lang", "part", F.pmod(F.xxhash64("flush"), F.lit(slots)).alias("slot"), "rights", "counts")
    while True:
        slots = -(-slots // FAN_IN)
        tiles = tiles.withColumn("slot", F.floor(F.col("slot") / FAN_IN).cast("bigint"))
        tiles = tiles.groupBy("lang", "part", "slot").applyInPandas(add_tiles, TILE_SCHEMA)
        if slots == 1:
            break
        tiles = written(tiles, f"{name}-tiles")
    shared = found.sparkSession.sparkContext.broadcast(ranked)

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranked = shared.value
        for frame in frames:
            for row in frame.itertuples(index=False):
                cells, counts = unpack(row.rights), unpack(row.counts)
                enough = counts >= LEAST
                cells, tile = cells[enough], -1 - row.part
                left = tile // ACROSS * TILE + cells // TILE
                yield pd.DataFrame({
                    "lang": row.lang, "left": left if ranked is None else ranked[row.lang][left],
                    "right": tile % ACROSS * TILE + cells % TILE, "a": counts[enough]})

    rest = found.where("part >= 0").select("lang", "part", "lefts", "rights", "counts")
    rest = rest.groupBy("lang", "part").applyInPandas(add_lists, COUNT_SCHEMA)
    return written(tiles.mapInPandas(cells, COUNT_SCHEMA).union(rest), f"{name}-counted")


def pair_entries(streams: DataFrame, parts: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                ids = unpack(row.ids) - 1
                both = (ids[:-1] >= 0) & (ids[1:] >= 0)
                left = ids[:-1][both]
                yield entries(row.lang, row.flush, left, left, ids[1:][both], parts)

    return streams.mapInPandas(run, ENTRY_SCHEMA)


# Three words: a frequent pair and a word

def first_pairs(pairs: DataFrame) -> dict[str, np.ndarray]:
    """The most frequent pairs (left id * 2^32 + right id) of each language by rank: RANKED_PAIRS at most in all.

    Those of a frequency are taken all or not at all, in steps of a sixteenth of a doubling.
    """
    step = F.floor(F.log2("a") * 16).cast("int")
    limit, taken = None, 0
    for at, n in sorted(pairs.groupBy(step.alias("step")).count().collect(), reverse=True):
        taken += n
        if taken > RANKED_PAIRS:
            break
        limit = at
    found: dict[str, list] = {}
    if limit is not None:
        for lang, left, right, a in pairs.where(step >= limit).collect():
            found.setdefault(lang, []).append((-a, left << 32 | right))
    return {lang: np.array([code for _, code in sorted(rows)[:DENSE]], np.int64) for lang, rows in found.items()}


def mark_of(lang: str, pair: np.ndarray) -> np.ndarray:
    mixed = (pair.astype(np.uint64) ^ np.uint64(crc32(lang.encode()) << 31)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - MARK_BITS)).astype(np.int64)


def pair_marks(pairs: DataFrame) -> bytes:
    """A bit map of 2**MARK_BITS marks of all frequent pairs, whatever their number.

    Where two pairs share a mark, some pairs that are not frequent go on to be
    counted; what comes of them never reaches LEAST, so the result is the same.
    """
    def positions(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lang, group in frame.groupby("lang"):
                at = np.unique(mark_of(lang, (group["left"].to_numpy() << 32) | group["right"].to_numpy()))
                yield pd.DataFrame({"segment": at >> SEGMENT_BITS, "bit": at & (1 << SEGMENT_BITS) - 1})

    def maps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for segment, bits in zip(frame["segment"], frame["bits"]):
                marks = np.zeros(1 << SEGMENT_BITS, bool)
                marks[bits] = True
                rows.append((segment, np.packbits(marks).tobytes()))
            yield pd.DataFrame(rows, columns=["segment", "marks"])

    set_bits = pairs.select("lang", "left", "right").mapInPandas(positions, "segment int, bit int")
    found = set_bits.groupBy("segment").agg(F.collect_set("bit").alias("bits")).mapInPandas(maps, "segment int, marks binary")
    marks = bytearray(1 << MARK_BITS - 3)
    size = 1 << SEGMENT_BITS - 3
    for segment, held in found.collect():
        marks[segment * size:(segment + 1) * size] = held
    return bytes(marks)


def triple_entries(streams: DataFrame, parts: int, marks: bytes, ranked: dict[str, np.ndarray]) -> DataFrame:
    """Entries of (pair, word) wherever both pairs of three words bear a mark."""
    shared = streams.sparkSession.sparkContext.broadcast((marks, ranked))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks, ranked = shared.value
        marks = np.frombuffer(marks, np.uint8)
        for frame in frames:
            for row in frame.itertuples(index=False):
                ids = unpack(row.ids) - 1
                pair = ids[:-1] << 32 | np.maximum(ids[1:], 0)
                at = mark_of(row.lang, pair)
                frequent = (ids[:-1] >= 0) & (ids[1:] >= 0) & (marks[at >> 3] >> (7 - (at & 7)) & 1 > 0)
                both = np.flatnonzero(frequent[:-1] & frequent[1:])
                left, right = pair[both], ids[both + 2]
                yield entries(row.lang, row.flush, left, ranks_of(left, ranked.get(row.lang)), right, parts)

    return streams.mapInPandas(run, ENTRY_SCHEMA)


def ranks_of(pairs: np.ndarray, ranked: np.ndarray | None) -> np.ndarray:
    """Places of pairs in ``ranked``, or DENSE."""
    if ranked is None:
        return np.full(len(pairs), DENSE)
    order = np.argsort(ranked)
    held = ranked[order]
    at = np.minimum(np.searchsorted(held, pairs), len(held) - 1)
    return np.where(held[at] == pairs, order[at], DENSE)


# Scores

def ratio(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)) without rounding, also beyond 64 bits."""
    wide = "cast({} as decimal(38, 0))"
    return F.expr(f"cast(({wide.format('1000000')} * {a} * {a}) div ({wide.format(left)} * {right}) as bigint)")


def scored(words: DataFrame, pairs: DataFrame, triples: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of all candidates that no longer one stands for."""
    def word(name: str) -> DataFrame:
        return words.select("lang", F.col("id").alias(f"id_{name}"), F.col("f").alias(f"f_{name}"),
                            F.col("word").cast("string").alias(f"word_{name}"))

    two = pairs.select("lang", F.col("left").alias("id_x"), F.col("right").alias("id_y"), "a")
    three = triples.select("lang", F.shiftright("left", 32).alias("id_x"),
                           F.col("left").bitwiseAND(F.lit(0xFFFFFFFF)).alias("id_y"), F.col("right").alias("id_z"), "a")
    longest = three.select("lang", "id_x", "id_y", "a").union(three.select("lang", "id_y", "id_z", "a"))
    longest = longest.groupBy("lang", "id_x", "id_y").agg(F.max("a").alias("longest"))
    alone = two.join(longest, ["lang", "id_x", "id_y"], "left").where(
        F.col("longest").isNull() | (100 * F.col("longest") < SHARE * F.col("a")))
    alone = alone.join(word("x"), ["lang", "id_x"]).join(word("y"), ["lang", "id_y"]).select(
        "lang", F.concat_ws(" ", "word_x", "word_y").alias("phrase"), "a", F.col("f_x").alias("l"), F.col("f_y").alias("r"),
        ratio("a", "f_x", "f_y").alias("score"))

    head = two.select("lang", "id_x", "id_y", F.col("a").alias("f_xy"))
    tail = two.select("lang", F.col("id_x").alias("id_y"), F.col("id_y").alias("id_z"), F.col("a").alias("f_yz"))
    both = three.join(head, ["lang", "id_x", "id_y"]).join(tail, ["lang", "id_y", "id_z"])
    both = both.join(word("x"), ["lang", "id_x"]).join(word("y"), ["lang", "id_y"]).join(word("z"), ["lang", "id_z"])
    cut = F.least(
        F.struct(ratio("a", "f_x", "f_yz").alias("score"), F.lit(1).alias("k"), F.col("f_x").alias("l"), F.col("f_yz").alias("r")),
        F.struct(ratio("a", "f_xy", "f_z").alias("score"), F.lit(2).alias("k"), F.col("f_xy").alias("l"), F.col("f_z").alias("r")))
    both = both.withColumn("_cut", cut).select(
        "lang", F.concat_ws(" ", "word_x", "word_y", "word_z").alias("phrase"), "a", "_cut.l", "_cut.r", "_cut.score")
    return alone.union(both)


def top_phrases(phrases: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language with their rank; large languages are narrowed in rounds of bounded windows."""
    best = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    held = written(phrases, "phrase-scores")
    groups = -(-held.count() // max(WINDOW_ROWS, 2 * top))
    while groups > 1:
        salted = held.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(groups)))
        nth = F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*best))
        held = written(salted.withColumn("_nth", nth).where(F.col("_nth") <= top).drop("_salt", "_nth"), "phrase-scores")
        groups = -(-groups * top // max(WINDOW_ROWS, 2 * top))
    ranked = held.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("bigint"))
    return ranked.where(F.col("rank") <= top)


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """Each language's strongest phrases of two and three words: lang, rank, phrase, a, l, r, n, score.

    A-Z are lower-cased; a NULL lang is ``und`` and counts with rows that say
    so.  NULL, empty and one-word texts hold no phrase; their words count in n.
    Repeated rows count each.  Phrases of equal score come by falling a, then in
    byte order.  Empty tables give no rows; columns other than text and lang are
    not read.  A language has fewer than 2**31 words that occur LEAST times.
    """
    chunks = chunked(docs)
    totals = chunks.groupBy("lang").agg(F.sum("n_tokens").alias("n"))
    size = chunks.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    n_flushes, parts = size[0], max(1, -(-size[1] // PART_PAIRS))
    chunk_words = chunks.select("chunk", "lang", "words", "counts").mapInPandas(word_rows, WORD_SCHEMA)
    words = ranked_words(chunk_words)
    streams = numbered(chunks, chunk_words, words)
    pairs = counted_pairs(pair_entries(streams, parts), n_flushes, None, "phrase-pairs")
    ranked = first_pairs(pairs)
    found = triple_entries(streams, parts, pair_marks(pairs), ranked)
    triples = counted_pairs(found, n_flushes, ranked, "phrase-triples")
    return top_phrases(scored(words, pairs, triples), top).join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
split as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
one as (select lang, word as p, count(*) as f from (select lang, unnest(w) as word from split) group by all),
two as (
  select lang, x.a as a, x.b as b, count(*) as f
  from (select lang, unnest([{a: w[i], b: w[i + 1]} for i in range(1, len(w))]) as x from split) group by all),
three as (
  select lang, x.a as a, x.b as b, x.c as c, count(*) as f
  from (select lang, unnest([{a: w[i], b: w[i + 1], c: w[i + 2]} for i in range(1, len(w) - 1)]) as x from split)
  group by all),
totals as (select lang, sum(f)::bigint as n from one group by lang),
longer as (
  select lang, a, b, max(f) as f from (
    select lang, a, b, f from three where f >= 10 union all select lang, b, c, f from three where f >= 10)
  group by lang, a, b),
pairs as (
  select t.lang, t.a || ' ' || t.b as phrase, t.f as a, x.f as l, y.f as r,
         ((1000000::hugeint * t.f * t.f) // (x.f::hugeint * y.f))::bigint as score
  from two t join one x on x.lang = t.lang and x.p = t.a join one y on y.lang = t.lang and y.p = t.b
  left join longer m on m.lang = t.lang and m.a = t.a and m.b = t.b
  where t.f >= 10 and (m.f is null or 100 * m.f < 50 * t.f)),
cuts as (
  select t.lang, t.a || ' ' || t.b || ' ' || t.c as phrase, t.f as a, x.f as xf, yz.f as yzf, xy.f as xyf, z.f as zf,
         ((1000000::hugeint * t.f * t.f) // (x.f::hugeint * yz.f))::bigint as s1,
         ((1000000::hugeint * t.f * t.f) // (xy.f::hugeint * z.f))::bigint as s2
  from three t join one x on x.lang = t.lang and x.p = t.a join one z on z.lang = t.lang and z.p = t.c
  join two xy on xy.lang = t.lang and xy.a = t.a and xy.b = t.b
  join two yz on yz.lang = t.lang and yz.a = t.b and yz.b = t.c
  where t.f >= 10),
phrases as (
  select * from pairs union all
  select lang, phrase, a, case when s1 <= s2 then xf else xyf end, case when s1 <= s2 then yzf else zf end, least(s1, s2)
  from cuts),
ranked as (
  select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
  from phrases join totals using (lang))
select * from ranked where rank <= 2000
"""
