"""Joining a row per key back to the rows of that key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def add_by_key(rows: DataFrame, lookup: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Add the columns of ``lookup``, which has one row per ``keys``; NULL equals NULL.

    There is no hint: Spark broadcasts a small lookup, and otherwise splits the
    rows of a hot key over several tasks.
    """
    if not keys:
        raise ValueError("a lookup needs a key")
    renamed = lookup.withColumnsRenamed({key: f"_key_{key}" for key in keys})
    same = F.lit(True)
    for key in keys:
        same &= F.col(key).eqNullSafe(F.col(f"_key_{key}"))
    return rows.join(renamed, same).drop(*[f"_key_{key}" for key in keys])
