"""From raw documents to token files: five stages, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfgauge.llm import decontamination, mixing, simhash, token_ids, toxicity
from shelfgauge.llm.common import read_table, small_batches, with_row_key, without_rows, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the model is learned from the labelled rows of ``docs``."""
    return toxicity.clean_documents(docs, read_table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the row with the smallest doc_id stays.

    Groups are of rows: rows without an id, or with an id that another row has,
    go or stay each by its own text.  A row without an id stays only in a group
    of none but such rows, and of equal ids one row stays.
    """
    rows, key = with_row_key(docs, "simhash-rows")
    groups = simhash.simhash_groups(rows.select(F.col(key).alias("doc_id"), "text"))
    groups = groups.select(F.col("doc_id").alias(key), F.col("component_id").alias("_group"))
    placed = written(groups.join(rows.select(key, F.col("doc_id").cast("bigint").alias("_id")), key), "simhash-groups")
    order = F.struct(F.col("_id").isNull(), "_id", key)
    first = placed.groupBy("_group").agg(F.min(order)[key].alias("_first"))
    return without_rows(rows, key, placed.join(first, "_group").where(F.col(key) != F.col("_first")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item go, whatever their ids; items of under five words stand in clean texts, too."""
    rows, key = with_row_key(docs, "decontamination-rows")
    found = decontamination.contaminated(
        rows.select(F.col(key).alias("doc_id"), "text"), read_table(spark, sf_dir, "benchmark"),
        least_words=decontamination.TELLING)
    return without_rows(rows, key, found.select(F.col("doc_id").alias(key)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix; one row per document and copy, read back from them."""
    return token_ids.token_ids(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_ids", write_tokens),
]

# The classifier, the fingerprints and the tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result stored and read back by the next."""
    docs = read_table(spark, sf_dir, "documents")
    with small_batches(spark):
        for name, stage in STAGES:
            docs = written(stage(spark, docs, sf_dir), name)
    return docs
