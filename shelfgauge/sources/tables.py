"""Result tables: intermediate, stored and shown."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SHOWN_ROWS = 250


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which all executors see.

    Only a local session, which is a single machine, may do without the
    setting; it then gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder shared by the executors")
    folder = tempfile.mkdtemp(prefix="shelfgauge-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def unique() -> str:
    return uuid.uuid4().hex


# Set while the tables of one run lie in a folder of their own.
RUN_FOLDER = "spark.shelfgauge.run"


def written(df: DataFrame, name: str) -> DataFrame:
    """Store ``df`` in the shared folder and read it back.

    For a table that several later steps read: it is computed once, its
    content stays fixed, and a lost executor does not bring it back to the
    sources.  Within ``own_folder`` it goes when that ends.
    """
    spark = df.sparkSession
    run = spark.conf.get(RUN_FOLDER, None)
    path = f"{shared_folder(spark)}/shelfgauge/{f'{run}/' if run else ''}{name}-{unique()}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def own_folder(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written within lie in one folder, which is deleted at the end, also after an error."""
    before, run = spark.conf.get(RUN_FOLDER, None), f"run-{unique()}"
    spark.conf.set(RUN_FOLDER, run)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(RUN_FOLDER)
        else:
            spark.conf.set(RUN_FOLDER, before)
        file_system, folder = hadoop_folder(spark, f"{shared_folder(spark)}/shelfgauge/{run}")
        file_system.delete(folder, True)


def hadoop_folder(spark: SparkSession, path: str) -> tuple:
    """The file system and path of a folder wherever Spark reads; not to be had through Spark Connect."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def write_result(df: DataFrame, path: str, by: str = "category", mode: str = "overwrite") -> None:
    """Store a result as parquet, one folder per value of ``by``.

    The rebalance hint gathers a category's rows into few files, and adaptive
    execution splits a category too large for one task.
    """
    df.hint("rebalance", by).write.mode(mode).partitionBy(by).parquet(path)


def read_result(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def show_result(df: DataFrame) -> None:
    """Print a result table without cutting its texts."""
    df.show(SHOWN_ROWS, truncate=False)
