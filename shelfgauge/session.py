"""A session with the settings the jobs are meant for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Shuffles start from many partitions; adaptive execution merges them to a
# useful size at run time, and splits those of hot join keys.
CLUSTER_SETTINGS = {"spark.sql.shuffle.partitions": "4000"}


def build_session(master: str | None = None, **settings: str) -> SparkSession:
    """A session; ``settings`` use _ for the dots.

    On a cluster, what spark-submit or the cluster's defaults set stays, and
    the rest is set to suit large tables.
    """
    builder = SparkSession.builder.appName("shelfgauge").config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    given = {name.replace("_", "."): value for name, value in settings.items()}
    for name, value in given.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    if not spark.conf.get("spark.master").startswith("local"):
        preset = spark.sparkContext.getConf()
        for name, value in CLUSTER_SETTINGS.items():
            if not preset.contains(name):
                spark.conf.set(name, value)
    return spark
