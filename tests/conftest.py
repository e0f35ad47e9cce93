import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfgauge.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[4]",
        spark_sql_shuffle_partitions="8",
        spark_driver_memory="4g",
        spark_ui_showConsoleProgress="false",
        spark_sql_session_timeZone="UTC",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    """Rows as dicts, or a schema and tuples, to a DataFrame."""

    def make(schema, rows):
        return spark.createDataFrame(rows, schema)

    return make
