"""SimHash near-dedup: fingerprints compared bit-sliced, 64 at a time.

Fingerprints within the radius agree in at least two of the four 16-bit bands
if they differ in two bits at most, so six keys of two bands each bring every
such pair together.  Fingerprints of one key stand in blocks of 64, held as
vertical bit planes: word b of a block has bit b of all its members.  One
fingerprint is compared with a block by 64 steps of XOR and a carry-save
counter that counts up to the radius for 64 lanes at once; blocks in which all
lanes exceed the radius are given up on the way.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfgauge.llm.common import components, read_table, smallest_labels, texts, tidied, written

SHINGLE = 3
RADIUS = 2
SEED = 42
# Rows of a key that one task compares; larger keys are dealt to pairs of such tiles.
TILE = 8_192
# Work items (a fingerprint against a block) held at once, and steps between give-ups.
ITEMS, STEPS = 200_000, 8
ONE = np.uint64(1)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Bit b is 1 if set in over half of the shingles' XXH64; 0 for a text without words."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest = xxhash.xxh64_intdigest
    grams = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    hashes = np.fromiter((digest(gram, SEED) for gram in grams), np.uint64, len(words) - shingle + 1)
    set_bits = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 4096):
        part = hashes[start:start + 4096].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fingerprints as signed 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One text at a time leaves Arrow's memory.
            fps = np.array([fingerprint(text.as_py(), shingle) for text in batch["text"]], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return texts(docs).mapInArrow(tidied(run), "doc_id long, fp long")


def band_masks(radius: int) -> list[int]:
    """Masks of which at least one covers only equal bits of any two fingerprints within ``radius``.

    radius + 2 bands, of which two at least are equal; a mask covers two bands.
    """
    edges = [64 * i // (radius + 2) for i in range(radius + 3)]
    bands = [((1 << high) - 1) ^ ((1 << low) - 1) for low, high in zip(edges, edges[1:])]
    return [a | b for a, b in combinations(bands, 2)]


def signed(mask: int) -> int:
    return mask - 2**64 if mask >= 2**63 else mask


def sliced_links(fps: np.ndarray, run_of: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), j < i, of equal ``run_of`` (sorted) whose fingerprints differ in at most ``radius`` bits."""
    n = len(fps)
    first = np.flatnonzero(np.r_[True, np.diff(run_of) != 0])
    length = np.diff(np.r_[first, n])
    run = np.repeat(np.arange(len(first)), length)
    place = np.arange(n) - first[run]
    blocks_before = np.r_[0, np.cumsum((length + 63) // 64)]
    block = blocks_before[run] + place // 64
    lane = (place % 64).astype(np.uint64)
    # Vertical planes: planes[b][k] holds bit b of the 64 members of block k.
    starts = np.flatnonzero(np.r_[True, np.diff(block) != 0])
    planes = np.stack([
        np.bitwise_or.reduceat(((fps >> np.uint64(b)) & ONE) << lane, starts) for b in range(64)])
    items = place // 64 + 1  # each fingerprint against the blocks up to its own
    left, right = [], []
    cuts = np.flatnonzero(np.diff(np.cumsum(items) // ITEMS)) + 1
    for low, high in zip([0, *cuts], [*cuts, n]):
        row = np.repeat(np.arange(low, high), items[low:high])
        ends = np.cumsum(items[low:high])
        at = blocks_before[run[row]] + np.arange(len(row)) - np.repeat(ends - items[low:high], items[low:high])
        own = at == block[row]
        live = np.full(len(row), ~np.uint64(0))
        live[own] = (ONE << lane[row[own]]) - ONE  # only members before itself
        # Lanes past a run's end, in its last block, are never before a member of it.
        counter = [np.zeros(len(row), np.uint64) for _ in range(max(1, radius.bit_length()))]
        over = np.zeros(len(row), np.uint64)
        for b in range(64):
            differs = planes[b][at] ^ (np.uint64(0) - ((fps[row] >> np.uint64(b)) & ONE))
            for k, digit in enumerate(counter):
                counter[k], differs = digit ^ differs, digit & differs
            over |= differs
            if b % STEPS == STEPS - 1:
                exceeded = over | exceeds(counter, radius)
                near = live & ~exceeded
                keep = near != 0
                if not keep.all():
                    row, at, live, over = row[keep], at[keep], live[keep], over[keep]
                    counter = [digit[keep] for digit in counter]
                if not len(row):
                    break
        if len(row):
            near = live & ~(over | exceeds(counter, radius))
            bits = np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            item, bit = np.nonzero(bits)
            left.append(row[item])
            right.append(starts[at[item]] + bit)
    return np.concatenate([*left, np.zeros(0, int)]), np.concatenate([*right, np.zeros(0, int)])


def exceeds(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count, in the digits held, is greater than ``radius``."""
    above, equal = np.zeros_like(counter[0]), ~np.zeros_like(counter[0])
    for k in reversed(range(len(counter))):
        if radius >> k & 1:
            equal = equal & counter[k]
        else:
            above = above | (equal & counter[k])
            equal = equal & ~counter[k]
    return above


def forest(frame: pd.DataFrame, radius: int) -> pd.DataFrame:
    """Edges that connect, per key, the fingerprints that links connect: fewer than there are rows."""
    fps = frame["fp"].to_numpy(np.int64).view(np.uint64)
    run_of = frame["cell"].to_numpy(np.int64)
    left, right = sliced_links(fps, run_of, radius)
    label = smallest_labels(len(fps), left, right)
    linked = np.flatnonzero(label != np.arange(len(fps)))
    return pd.DataFrame({"a": fps[linked].view(np.int64), "b": fps[label[linked]].view(np.int64)})


def compare_cells(frames: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Rows arrive sorted by cell; a cell cut by the end of a frame goes on in the next one."""
    rest = None
    for frame in frames:
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        whole = int(np.searchsorted(frame["cell"].to_numpy(), frame["cell"].iloc[-1])) if len(frame) else 0
        rest = frame.iloc[whole:]
        if whole:
            yield forest(frame.iloc[:whole], radius)
    if rest is not None and len(rest):
        yield forest(rest, radius)


def near_edges(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that connect what links connect."""
    masks = F.array(*[F.lit(signed(mask)) for mask in band_masks(radius)])
    keyed = distinct.select("fp", F.posexplode(masks).alias("band", "mask")).select(
        "fp", F.xxhash64("band", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))
    # Equal hashes of different keys only add comparisons.  A key of one row has no links.
    crowded = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / tile).cast("int")
    dealt = keyed.join(crowded, "key").select("fp", "key", tiles.alias("tiles")).withColumn(
        "own", F.pmod(F.xxhash64("fp"), F.col("tiles")))
    # A key of several tiles is compared tile by tile: each row meets every tile once.
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "fp", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"))
    sorted_cells = cells.repartition("cell").sortWithinPartitions("cell")
    return sorted_cells.mapInPandas(lambda frames: compare_cells(frames, radius), "a long, b long")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id.

    Texts whose fingerprints differ in at most ``radius`` bits are linked;
    ``component_id`` is the smallest doc_id reachable over links.  NULL and
    empty texts have fingerprint zero and are linked like any other.  A
    component of none but NULL doc_ids has a NULL id.  Rows that repeat a doc_id
    are returned as often as they come.  An empty table gives no rows; columns
    other than doc_id and text are not read.
    """
    rows = written(fingerprints(docs, shingle), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct-fingerprints")
    roots = components(near_edges(distinct.select("fp"), radius), "near-edges")
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_fp = written(rooted.join(ids, "root").select("fp", "component_id"), "components-by-fingerprint")
    # A plain join, in which adaptive execution splits a hot fingerprint.
    return rows.join(by_fp, "fp").select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_groups(read_table(spark, sf_dir, "documents"))
