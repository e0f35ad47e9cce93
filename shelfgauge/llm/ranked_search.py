"""Ranked lexical search: Block-Max MaxScore over shards of an inverted index.

Documents are indexed in shards of a bounded number of terms.  A shard's lists
are compressed, and cut into blocks that carry the greatest term frequency and
the least document length within, so that a bound on a block's scores follows
from them whatever the size of the whole collection turns out to be.

A search decodes a shard's lists from the one that can add most.  As soon as
the lists left could not lift a new document to the tenth score together, they
are no longer essential: they are only looked up for documents found already,
and a document whose block bound shows that it stays too low is rejected before
the block is decompressed.  Each task keeps ten documents per item over all its
shards; these heaps are merged at the end.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfgauge.llm.common import read_table, written

TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
TOP = 10
BLOCK = 128
# Terms of a shard, and of the items searched for at once; one text may go beyond.
SHARD_TERMS = 4_000_000
ITEMS, ITEM_TERMS = 4_096, 1_000_000

INDEX_SCHEMA = (
    "doc_ids binary, known binary, lengths binary, terms binary, counts binary, places binary, widths binary, "
    "block_starts binary, block_first binary, block_last binary, block_tf binary, block_length binary, data binary"
)
HIT_SCHEMA = "item long, item_id long, doc_id long, score long"


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased."""
    return TERM.findall(text.lower())


class Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key):
        number = self[key] = len(self)
        return number


def narrowest(greatest: np.ndarray) -> np.ndarray:
    """Bytes that hold each value: 1, 2 or 4."""
    return np.where(greatest < 1 << 8, 1, np.where(greatest < 1 << 16, 2, 4))


def scatter(data: np.ndarray, at: np.ndarray, values: np.ndarray, widths: np.ndarray) -> None:
    """Put little-endian values of the given widths at byte positions of ``data``."""
    for byte in range(4):
        wide = widths > byte
        data[at[wide] + byte] = (values[wide] >> (8 * byte)) & 255


def build_shard(doc_ids: list, numbers: Numbers, streams: list[np.ndarray]) -> dict:
    """An index row of documents given as arrays of term numbers."""
    n_docs = len(streams)
    lengths = np.array([len(stream) for stream in streams], np.int64)
    code = np.concatenate([np.zeros(0, np.int64), *streams]).astype(np.int64) * n_docs
    code += np.repeat(np.arange(n_docs), lengths)
    code, tf = np.unique(code, return_counts=True)
    term, doc = code // max(n_docs, 1), code % max(n_docs, 1)
    # Every number of a shard was given to a term that occurs, so no list is empty.
    counts = np.bincount(term, minlength=len(numbers))
    starts = np.cumsum(counts) - counts
    gap = np.diff(doc, prepend=0)
    gap[starts] = 0
    if len(numbers):
        gap_width = narrowest(np.maximum.reduceat(gap, starts))
        tf_most = np.maximum.reduceat(tf, starts)
        tf_width = np.where(tf_most == 1, 0, narrowest(tf_most))
    else:
        gap_width = tf_width = np.zeros(0, np.int64)
    sizes = counts * (gap_width + tf_width)
    places = np.cumsum(sizes) - sizes
    data = np.zeros(int(sizes.sum()), np.uint8)
    within = np.arange(len(doc)) - starts[term]
    scatter(data, places[term] + within * gap_width[term], gap, gap_width[term])
    tf_at = places[term] + counts[term] * gap_width[term] + within * tf_width[term]
    scatter(data, tf_at, tf, tf_width[term])

    blocks = -(-counts // BLOCK)
    block_starts = np.concatenate([[0], np.cumsum(blocks)])
    inside = np.arange(block_starts[-1]) - np.repeat(block_starts[:-1], blocks)
    first = np.repeat(starts, blocks) + inside * BLOCK
    last = np.append(first[1:], len(doc))[:len(first)] - 1
    missing = [i is None or i != i for i in doc_ids]
    return {
        "doc_ids": np.array([0 if gone else int(i) for i, gone in zip(doc_ids, missing)], np.int64).tobytes(),
        "known": (~np.array(missing, bool)).tobytes(),
        "lengths": lengths.tobytes(),
        "terms": b" ".join(numbers),
        "counts": counts.astype(np.int32).tobytes(),
        "places": places.tobytes(),
        "widths": (gap_width * 8 + tf_width).astype(np.uint8).tobytes(),
        "block_starts": block_starts.astype(np.int32).tobytes(),
        "block_first": doc[first].astype(np.int32).tobytes(),
        "block_last": doc[last].astype(np.int32).tobytes(),
        "block_tf": (np.maximum.reduceat(tf, first) if len(first) else tf).astype(np.int32).tobytes(),
        "block_length": (np.minimum.reduceat(lengths[doc], first) if len(first) else tf).astype(np.int64).tobytes(),
        "data": data.tobytes(),
    }


def build_shards(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    doc_ids, numbers, streams, held = [], Numbers(), [], 0
    for frame in frames:
        for doc_id, text in zip(frame["doc_id"].astype(object), frame["text"]):
            found = terms_of(bytes(text))
            doc_ids.append(None if pd.isna(doc_id) else doc_id)
            streams.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
            held += len(found)
            if held >= SHARD_TERMS:
                yield pd.DataFrame([build_shard(doc_ids, numbers, streams)])
                doc_ids, numbers, streams, held = [], Numbers(), [], 0
    if doc_ids:
        yield pd.DataFrame([build_shard(doc_ids, numbers, streams)])


def build_index(docs: DataFrame) -> DataFrame:
    """One row per shard of the whole texts, stored; a NULL text has no terms."""
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    return written(rows.mapInPandas(build_shards, INDEX_SCHEMA), "search-index")


def collection_size(index: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = total = 0
        for frame in frames:
            for lengths in frame["lengths"]:
                lengths = np.frombuffer(lengths, np.int64)
                n, total = n + int((lengths > 0).sum()), total + int(lengths.sum())
        yield pd.DataFrame({"n": [n], "total": [total]})

    row = index.select("lengths").mapInPandas(run, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return row[0] or 0, row[1] or 0


def document_frequencies(index: DataFrame, terms: list[bytes]) -> np.ndarray:
    """Documents that hold each of ``terms``, over all shards."""
    shared = index.sparkSession.sparkContext.broadcast(terms)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = {term: i for i, term in enumerate(shared.value)}
        df = np.zeros(len(number), np.int64)
        for frame in frames:
            for held, counts in zip(frame["terms"], frame["counts"]):
                for term, count in zip(bytes(held).split(b" "), np.frombuffer(counts, np.int32).tolist()):
                    at = number.get(term)
                    if at is not None:
                        df[at] += count
        at = np.flatnonzero(df)
        yield pd.DataFrame({"number": at, "df": df[at]})

    found = np.zeros(len(terms), np.int64)
    partial = index.select("terms", "counts").mapInPandas(run, "number long, df long")
    for number, df in partial.groupBy("number").agg(F.sum("df")).collect():
        found[number] = df
    return found


def scaled_lengths(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """m of the score for document lengths; worked in Python's integers where 64 bits could be passed."""
    if len(lengths) and 75 * int(lengths.max()) * n >= 1 << 63:
        return np.array([25 + 75 * length * n // total for length in lengths.tolist()], np.int64)
    return 25 + 75 * lengths * n // max(total, 1)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What an occurrence count adds to a score per unit of term weight; grows with tf, falls with m."""
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1_000 * tf + 8 * m)


class Shard:
    """A row of the index, opened for the terms that a block of items asks for."""

    def __init__(self, row, wanted: dict[bytes, int], n: int, total: int):
        self.doc_ids = np.frombuffer(row.doc_ids, np.int64)
        self.known = np.frombuffer(row.known, bool)
        self.m = scaled_lengths(np.frombuffer(row.lengths, np.int64), n, total)
        self.counts = np.frombuffer(row.counts, np.int32)
        self.places = np.frombuffer(row.places, np.int64)
        self.widths = np.frombuffer(row.widths, np.uint8)
        self.block_starts = np.frombuffer(row.block_starts, np.int32)
        self.block_first = np.frombuffer(row.block_first, np.int32)
        self.block_last = np.frombuffer(row.block_last, np.int32)
        self.block_most = impact(
            np.frombuffer(row.block_tf, np.int32),
            scaled_lengths(np.frombuffer(row.block_length, np.int64), n, total))
        self.data = row.data
        self.term = {wanted[t]: i for i, t in enumerate(bytes(row.terms).split(b" ")) if t in wanted}
        self.most = {number: int(self.block_most[self.block_starts[i]:self.block_starts[i + 1]].max())
                     for number, i in self.term.items() if i < len(self.counts)}
        self.decoded: dict = {}

    def postings(self, term: int, start: int, end: int, first: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of the postings ``start`` to ``end`` of a list; ``first`` is their first document."""
        gap_width, tf_width = divmod(int(self.widths[term]), 8)
        place, count = int(self.places[term]), int(self.counts[term])
        gaps = np.frombuffer(self.data, f"<u{gap_width}", end - start, place + start * gap_width).astype(np.int64)
        gaps[0] = first
        docs = np.cumsum(gaps)
        if tf_width:
            at = place + count * gap_width + start * tf_width
            tf = np.frombuffer(self.data, f"<u{tf_width}", end - start, at)
        else:
            tf = np.ones(end - start, np.int64)
        return docs, impact(tf, self.m[docs])

    def whole_list(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        if term not in self.decoded:
            first = int(self.block_first[self.block_starts[term]])
            self.decoded[term] = self.postings(term, 0, int(self.counts[term]), first)
        return self.decoded[term]

    def block(self, term: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        if (term, block) not in self.decoded:
            start = (block - int(self.block_starts[term])) * BLOCK
            end = min(start + BLOCK, int(self.counts[term]))
            self.decoded[term, block] = self.postings(term, start, end, int(self.block_first[block]))
        return self.decoded[term, block]

    def look_up(self, term: int, docs: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Impacts of ``docs`` in the blocks that may hold them; only these blocks are decompressed."""
        if term in self.decoded:
            held, values = self.decoded[term]
        else:
            parts = [self.block(term, int(block)) for block in np.unique(blocks)]
            held, values = (np.concatenate(column) for column in zip(*parts))
        at = np.minimum(np.searchsorted(held, docs), len(held) - 1)
        return np.where(held[at] == docs, values[at], 0)


def tenth(scores: np.ndarray) -> int:
    return int(np.partition(scores, len(scores) - TOP)[-TOP]) if len(scores) >= TOP else 0


def search_shard(shard: Shard, asked: list[tuple[int, int]], least: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of a shard that may be among the best: every one that reaches ``least`` and the shard's tenth.

    ``asked`` holds (term number, weight times occurrences in the item).
    """
    lists = sorted(((weight * shard.most[number], shard.term[number], weight)
                    for number, weight in asked if number in shard.most and weight), reverse=True)
    left = sum(bound for bound, _, _ in lists)
    sums = np.zeros(len(shard.m), np.int64)
    place = 0
    # Essential lists: a document in none of them can't reach ``least``.
    while place < len(lists) and left >= max(least, 1):
        bound, term, weight = lists[place]
        docs, values = shard.whole_list(term)
        sums[docs] += weight * values
        left -= bound
        place += 1
        least = max(least, tenth(sums))  # sums so far are lower bounds
    docs = np.flatnonzero((sums > 0) & (sums + left >= least))
    scores = sums[docs]
    for bound, term, weight in lists[place:]:
        if not len(docs):
            break
        left -= bound
        low, high = shard.block_starts[term], shard.block_starts[term + 1]
        block = low + np.searchsorted(shard.block_last[low:high], docs)
        inside = block < high
        block = np.minimum(block, high - 1)
        inside &= shard.block_first[block] <= docs
        hopeful = scores + np.where(inside, weight * shard.block_most[block], 0) + left >= least
        docs, scores, block, inside = docs[hopeful], scores[hopeful], block[hopeful], inside[hopeful]
        if inside.any():
            scores[inside] += weight * shard.look_up(term, docs[inside], block[inside])
            least = max(least, tenth(scores))
            hopeful = scores + left >= least
            docs, scores = docs[hopeful], scores[hopeful]
    return docs, scores


def search_block(index: DataFrame, items: list[tuple], n: int, total: int) -> DataFrame:
    """(item, item_id, doc_id, score): the best documents of each item, from every task's heap."""
    asked = [(item_id, Counter(terms_of(text))) for item_id, text in items]
    terms = sorted({term for _, counts in asked for term in counts})
    df = document_frequencies(index, terms)
    number = {term: i for i, term in enumerate(terms)}
    weight = [math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df]
    queries = [(item_id, [(number[t], c * weight[number[t]]) for t, c in counts.items()]) for item_id, counts in asked]
    shared = index.sparkSession.sparkContext.broadcast((number, queries))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted, queries = shared.value
        heaps: list[list] = [[] for _ in queries]
        for frame in frames:
            for row in frame.itertuples(index=False):
                shard = Shard(row, wanted, n, total)
                for heap, (_, asked) in zip(heaps, queries):
                    least = -heap[-1][0] if len(heap) == TOP else 0
                    docs, scores = search_shard(shard, asked, least)
                    enough = scores >= max(least, tenth(scores), 1)
                    docs, scores = docs[enough], scores[enough]
                    found = np.lexsort((shard.doc_ids[docs], ~shard.known[docs], -scores))[:TOP]
                    heap.extend((-int(scores[i]), not shard.known[docs[i]], int(shard.doc_ids[docs[i]])) for i in found)
                    heap.sort()
                    del heap[TOP:]
        rows = [(item, queries[item][0], None if lost else doc_id, -score)
                for item, heap in enumerate(heaps) for score, lost, doc_id in heap]
        yield pd.DataFrame({
            "item": pd.array([r[0] for r in rows], "Int64"), "item_id": pd.array([r[1] for r in rows], "Int64"),
            "doc_id": pd.array([r[2] for r in rows], "Int64"), "score": pd.array([r[3] for r in rows], "Int64")})

    return index.mapInPandas(run, HIT_SCHEMA)


def item_blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """Items in blocks of a bounded number of items and terms, one partition at a time at the driver."""
    block, held = [], 0
    rows = items.select(
        F.col("item_id").cast("bigint").alias("item_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for item_id, text in rows.toLocalIterator():
        block.append((item_id, text.encode("utf-8", "replace")))
        held += len(text) // 2 + 1  # a term and what parts it from the next are two characters at least
        if len(block) >= ITEMS or held >= ITEM_TERMS:
            yield block
            block, held = [], 0
    if block:
        yield block


def ranked_search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The ten best documents of each item: item_id, rank, doc_id, score.

    Equal scores are ranked by ascending doc_id, NULL last; documents that score
    0 are left out.  NULL and empty texts have no terms, so such a document is
    never found and such an item finds nothing.  Rows that repeat a doc_id are
    documents of their own, and rows that repeat an item_id are searched for
    each.  Empty tables give no rows; other columns are not read.
    """
    index = build_index(docs)
    n, total = collection_size(index)
    best_first = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    found = []
    for block in item_blocks(items):
        hits = search_block(index, block, n, total).withColumn("rank", F.row_number().over(best_first))
        found.append(written(hits.where(F.col("rank") <= TOP).select("item_id", "rank", "doc_id", "score"), "search-hits"))
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    result = found[0]
    for hits in found[1:]:
        result = result.union(hits)
    return result


def op13_ranked_search(spark, sf_dir: str) -> DataFrame:
    return ranked_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
with found as (
  select doc_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from documents),
postings as (select doc_id, term, count(*) as tf from found group by all),
lengths as (select doc_id, sum(tf)::bigint as n from postings group by all),
collection as (select count(*) as n_docs, sum(n)::bigint as total from lengths),
weights as (
  select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from postings, collection group by term, n_docs),
asked as (
  select item_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark),
counted as (select item_id, term, count(*) as times from asked group by all),
scored as (
  select item_id, doc_id,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // total))))::bigint as score
  from counted join postings using (term) join weights using (term) join lengths using (doc_id), collection
  group by item_id, doc_id),
ranked as (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id)::integer as rank, doc_id, score
  from scored where score > 0)
select * from ranked where rank <= 10
"""
