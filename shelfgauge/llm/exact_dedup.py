"""Exact dedup against a minimal perfect hash of the digests seen before.

The distinct digests of the historical documents are dealt into buckets by
their leading bits.  Each bucket gets a minimal perfect hash, built level by
level: digests that are alone at their position of a level are placed there,
the others go on to the next level, and a digest's slot is the number of
placed digests before its position.  Slots hold the full digest, the winning
document and the number of copies.  A new digest is looked up in its bucket;
the perfect hash names one slot for any input, so the 32 bytes held there
decide whether it is a member.  Nonmembers form groups of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfgauge.llm.common import lower_ascii, read_table, texts, written

DIGEST = 32
# Digests per bucket, on average; a bucket is built in one task's memory.
BUCKET_DIGESTS = 4_096
MAX_BUCKET_BITS = 30
# Positions per digest and level: more placed per level against longer bit maps.
SPREAD = 1.5

INDEX_SCHEMA = (
    "bucket long, digests binary, winners binary, copies binary, level_sizes array<int>, levels binary"
)
CLASS_SCHEMA = "digest binary, keep_id long, group_size long, member boolean"


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest): the SHA-256 of the text with A-Z lower-cased, in UTF-8."""
    return texts(docs).select(
        "doc_id", F.unhex(F.sha2(lower_ascii(F.col("text")).cast("binary"), 256)).alias("digest"))


def distinct_digests(rows: DataFrame) -> DataFrame:
    """One row per digest: the greatest doc_id and the number of rows; combined before the shuffle."""
    return rows.groupBy("digest").agg(
        F.max("doc_id").alias("winner"), F.count(F.lit(1)).alias("copies"))


def bucket_of(digest: Column, bits: int) -> Column:
    leading = F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("bigint")
    return F.shiftright(leading, 32 - bits)


def bucket_bits(n: int) -> int:
    """So many bits that a bucket holds about BUCKET_DIGESTS of ``n`` digests."""
    return min(MAX_BUCKET_BITS, max(0, (n // BUCKET_DIGESTS).bit_length()))


def as_words(column: pd.Series) -> np.ndarray:
    """Digests as rows of four 64-bit words."""
    return np.frombuffer(b"".join(map(bytes, column)), dtype="<u8").reshape(-1, 4)


def positions(rows: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where the digests fall among ``size`` positions of a level; each level mixes anew."""
    x = rows[:, 1] + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)
    x ^= rows[:, 2 + level % 2]
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return (x % np.uint64(size)).astype(np.int64)


def build_hash(rows: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray]:
    """Slots of distinct digests (a permutation of 0..n-1), the levels' sizes, and all levels' marks."""
    slots = np.zeros(len(rows), dtype=np.int64)
    left, sizes, marks, before = np.arange(len(rows)), [], [], 0
    while len(left):
        size = int(len(left) * SPREAD) + 1
        at = positions(rows[left], len(sizes), size)
        placed = np.bincount(at, minlength=size) == 1
        alone = placed[at]
        slots[left[alone]] = before + np.cumsum(placed)[at[alone]] - 1
        before += int(placed.sum())
        left = left[~alone]
        sizes.append(size)
        marks.append(placed)
    return slots, sizes, np.concatenate([*marks, np.zeros(0, bool)])


def find_slots(rows: np.ndarray, sizes: list[int], marks: np.ndarray) -> np.ndarray:
    """The slot that the hash names for each digest; -1 where no level has a mark."""
    slots = np.full(len(rows), -1, dtype=np.int64)
    rank = np.cumsum(marks) - 1
    left, start = np.arange(len(rows)), 0
    for level, size in enumerate(sizes):
        at = start + positions(rows[left], level, size)
        hit = marks[at]
        slots[left[hit]] = rank[at[hit]]
        left = left[~hit]
        start += size
    return slots


def build_bucket(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    rows = as_words(group["digest"])
    slots, sizes, marks = build_hash(rows)
    order = np.argsort(slots)
    winners = group["winner"].astype("Int64").fillna(np.iinfo(np.int64).min).to_numpy(np.int64)
    return pd.DataFrame({
        "bucket": [key[0]],
        "digests": [rows[order].tobytes()],
        "winners": [winners[order].tobytes()],
        "copies": [group["copies"].to_numpy(np.int64)[order].tobytes()],
        "level_sizes": [sizes],
        "levels": [np.packbits(marks).tobytes()],
    })


def build_index(history: DataFrame, bits: int) -> DataFrame:
    """One row per bucket of the historical digests (digest, winner, copies), stored."""
    rows = history.withColumn("bucket", bucket_of(F.col("digest"), bits))
    return written(rows.groupBy("bucket").applyInPandas(build_bucket, INDEX_SCHEMA), "digest-index")


def look_up(key: tuple, index: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
    """A bucket's classes after ``batch``: slots updated by members, nonmembers on their own."""
    missing = np.iinfo(np.int64).min
    rows = as_words(batch["digest"])
    new_winner = batch["winner"].astype("Int64").fillna(missing).to_numpy(np.int64)
    new_copies = batch["copies"].to_numpy(np.int64)
    held = np.zeros((0, 4), dtype="<u8")
    winner = copies = np.zeros(0, dtype=np.int64)
    member = np.zeros(len(rows), dtype=bool)
    if len(index):
        entry = index.iloc[0]
        held = np.frombuffer(entry["digests"], dtype="<u8").reshape(-1, 4)
        winner = np.frombuffer(entry["winners"], dtype=np.int64).copy()
        copies = np.frombuffer(entry["copies"], dtype=np.int64).copy()
        sizes = [int(size) for size in entry["level_sizes"]]
        marks = np.unpackbits(np.frombuffer(entry["levels"], np.uint8), count=sum(sizes)).astype(bool)
        slots = find_slots(rows, sizes, marks)
        member = (slots >= 0) & (held[slots] == rows).all(axis=1)
        found = slots[member]  # batch digests are distinct, so no slot comes twice
        winner[found] = np.maximum(winner[found], new_winner[member])
        copies[found] += new_copies[member]
    every = np.concatenate([held, rows[~member]])
    keep = np.concatenate([winner, new_winner[~member]])
    return pd.DataFrame({
        "digest": [row.tobytes() for row in every],
        "keep_id": pd.array(keep, dtype="Int64").copy() if not (keep == missing).any()
        else pd.array([None if x == missing else int(x) for x in keep], dtype="Int64"),
        "group_size": np.concatenate([copies, new_copies[~member]]),
        "member": np.concatenate([np.ones(len(held), bool), np.zeros(int((~member).sum()), bool)]),
    })


def classes_after(index: DataFrame, batch: DataFrame, bits: int) -> DataFrame:
    """Classes of equal texts over history and batch: (digest, keep_id, group_size, member)."""
    rows = batch.withColumn("bucket", bucket_of(F.col("digest"), bits))
    return index.groupBy("bucket").cogroup(rows.groupBy("bucket")).applyInPandas(look_up, CLASS_SCHEMA)


def exact_dedup(history: DataFrame, batch: DataFrame) -> DataFrame:
    """One row per document of both: which row of its group of equal texts stays.

    Returns doc_id, keep_id, group_size, kept, text_sha256, member (whether the
    text is in the historical index).  The greatest doc_id of a group stays.
    NULL texts equal empty ones.  A NULL doc_id loses to any other; a group of
    none but NULL ids keeps NULL.  Rows that repeat a doc_id within a group are
    one document and are marked alike.  Empty tables give no rows; columns
    other than doc_id and text are not read.
    """
    old = written(digests(history).withColumn("old", F.lit(True)), "digests")
    new = written(digests(batch).withColumn("old", F.lit(False)), "digests")
    seen = written(distinct_digests(old), "history")
    coming = written(distinct_digests(new), "batch")
    # A bucket holds digests of both; either may be far the larger.
    bits = bucket_bits(max(seen.count(), coming.count()))
    classes = written(classes_after(build_index(seen, bits), coming, bits), "classes")
    # A plain join, in which adaptive execution splits the rows of a hot text.
    return old.union(new).join(classes, "digest").select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), "member")


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents; those with an even id stand for the history, the others for the new batch."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    even = F.coalesce(F.col("doc_id") % 2, F.lit(0)) == 0
    return exact_dedup(docs.where(even), docs.where(~even)).drop("member")


ORACLE_SQL = """
with digests as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                  'abcdefghijklmnopqrstuvwxyz')) as text_sha256
  from documents)
select doc_id, max(doc_id) over (partition by text_sha256) as keep_id,
       count(*) over (partition by text_sha256) as group_size,
       doc_id = max(doc_id) over (partition by text_sha256) as kept, text_sha256
from digests
"""
