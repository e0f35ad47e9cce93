"""Run time of a result table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stamp_run(df: DataFrame, at: dt.datetime | None = None) -> DataFrame:
    """Add the instant of the run, the same in every row.

    ``at`` states it, for a run repeated for an earlier time.
    """
    instant = F.current_timestamp() if at is None else F.lit(at).cast("timestamp")
    return df.withColumn("runtime_mst", instant)
