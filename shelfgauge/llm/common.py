"""What several training-data operators share: inputs, words, links, stored tables."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfgauge.sources.tables import written

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Rows of this many text bytes are worked on at once inside a task.
CHUNK_BYTES = 4_000_000
# Rows of about this many bytes pass between Spark and a Python worker at once; by number alone they may be of any size.
BATCH_BYTES = 4_000_000
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` and ``text``; other columns, whatever their names, stay behind. NULL texts are empty."""
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """The runs of ``[^\\x20\\x09-\\x0D]`` in order."""
    spaced = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.filter(F.split(spaced, " ", -1), lambda word: word != "")


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id, written as text, modulo ``divisor``; NULL ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def in_chunks(frames: Iterator, column: str = "text", size: int = CHUNK_BYTES) -> Iterator:
    """Cut pandas frames so that one piece holds a bounded number of text bytes, or one row."""
    for frame in frames:
        if not len(frame):
            continue
        sizes = frame[column].str.len().to_numpy()
        ends = np.flatnonzero(np.diff(np.cumsum(sizes) // size)) + 1
        for start, end in zip([0, *ends], [*ends, len(frame)]):
            yield frame.iloc[start:end]


def column_chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that one piece holds a bounded number of bytes of its column ``text``, or one row."""
    if batch.num_rows:
        sizes = pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False)
        ends = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // CHUNK_BYTES)) + 1
        for start, end in zip([0, *ends.tolist()], [*ends.tolist(), batch.num_rows]):
            # Copied: pyarrow's text functions may read a slice from the wrong place.
            yield batch.take(pa.array(np.arange(start, end)))


def release_memory() -> None:
    """Hand what a Python worker has freed back to the system; workers live on, and allocators keep it for them."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # other C libraries than glibc have none
        if trim:
            trim(0)


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a task's work on its batches, with the memory released after its end."""

    def tidy(batches: Iterator) -> Iterator:
        yield from run(batches)
        release_memory()

    return tidy


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs within hands rows to Python in batches of about BATCH_BYTES."""
    before = spark.conf.get(BATCH_SETTING, None)
    spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_SETTING)
        else:
            spark.conf.set(BATCH_SETTING, before)


def smallest_labels(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For vertices 0..n-1 and edges between them, the smallest vertex each one reaches."""
    label = np.arange(n)
    while len(left):
        a, b = label[left], label[right]
        apart = a != b
        if not apart.any():
            break
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
    return label


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for all nodes of ``edges`` (a, b): the smallest node reachable.

    Large-star and small-star steps in turn, each one aggregation with partial
    minima and one join, until a round changes nothing.  Every round is stored,
    so a lost executor repeats one round at most.  The edges never leave Spark.
    """
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    links = written(edges.where("a <> b").select(low, high).distinct(), name)
    while True:
        # Large star: every larger neighbour of a node points to the smallest one around it.
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(least, both["a"] == least["k"]).where("b > a").select(
            F.col("m").alias("a"), "b").where("a <> b").distinct()
        large = written(large, name)
        # Small star: smaller neighbours and the node itself point to the smallest one.
        least = large.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("k"), "m")
        joined = large.join(least, large["b"] == least["k"])
        small = joined.select(F.col("m").alias("a"), F.col("a").alias("b")).union(
            least.select(F.col("m").alias("a"), F.col("k").alias("b")))
        small = written(small.where("a <> b").distinct(), name)
        if small.exceptAll(links).isEmpty() and links.exceptAll(small).isEmpty():
            break
        links = small
    roots = links.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.union(links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def free_name(base: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {name.lower() for frame in frames for name in frame.columns}
    while base.lower() in taken:
        base += "_"
    return base


def with_row_key(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``docs``, stored with a number that tells its rows apart, and the name of that column."""
    key = free_name("row_key", docs)
    return written(docs.withColumn(key, F.monotonically_increasing_id()), name), key


def without_rows(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """Rows whose ``key`` is not among those of ``gone`` (same column), without the key."""
    return rows.join(gone.select(key).distinct(), key, "left_anti").drop(key)


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is not among ``ids`` (doc_id); a NULL id is a value like any other."""
    name = free_name("dropped_id", docs)
    dropped = ids.select(F.col("doc_id").alias(name)).distinct()
    return docs.join(dropped, docs["doc_id"].cast("bigint").eqNullSafe(dropped[name]), "left_anti")
