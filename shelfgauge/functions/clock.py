"""Run time of a query."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfgauge.functions.units import DISPLAY_ZONE


def wall_time(instant: Column, zone: str = DISPLAY_ZONE) -> Column:
    """What a clock in ``zone`` shows at a TIMESTAMP, as TIMESTAMP_NTZ."""
    return F.convert_timezone(F.current_timezone(), F.lit(zone), instant.cast("timestamp_ntz"))
