"""Labelled rows for the classifiers: who may be learned from, and how many."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfgauge.llm.common import remainder, texts

FOLDS, HELD_OUT = 3, 1


def held_out(doc_id):
    """Rows never learned from: crc32 of the id, as text, leaves HELD_OUT modulo FOLDS."""
    return remainder(doc_id, FOLDS) == HELD_OUT


def training_rows(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(place, label, text): the ``bound`` labelled rows with the smallest hash of their id, not held out.

    The greatest of several labels of an id holds; rows without id or label are
    left out.  ``bound`` limits what a model is fitted on, nothing else; as it
    also limits the broadcast of ids, texts that are not learned from stay where they are.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id").limit(bound)
    return texts(docs).join(F.broadcast(chosen), "doc_id").select("place", "label", "text")
