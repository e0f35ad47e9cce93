"""Compare every registered query with its oracle: ``python -m verification.check <sf> [name ...]``."""

from __future__ import annotations

import sys
import time

import duckdb

from shelfgauge.session import build_session
from verification.oracle import ORACLE_SQL
from verification.queries import QUERIES

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

DUCKDB_TYPE = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
               "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return connection


def sorted_rows(rows: list[tuple], names: list[str]) -> list[tuple]:
    """Rows with columns in name order, sorted; NULL and NaN told apart, doubles exact."""
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(repr(row[i]) for i in order) for row in rows)


def difference(spark, connection, sf_dir: str, name: str) -> str:
    """Empty if the query and its oracle agree; otherwise what differs."""
    table = QUERIES[name](spark, sf_dir)
    got = sorted_rows([tuple(row) for row in table.collect()], table.columns)
    if name not in ORACLE_SQL:
        return "" if got else "no rows"
    cursor = connection.execute(ORACLE_SQL[name])
    names = [column[0] for column in cursor.description]
    wanted = sorted_rows(cursor.fetchall(), names)
    if sorted(names) != sorted(table.columns):
        return f"columns {sorted(table.columns)} instead of {sorted(names)}"
    kinds = {column[0]: str(column[1]) for column in cursor.description}
    other = {c: (t, kinds[c]) for c, t in table.dtypes if DUCKDB_TYPE.get(t) != kinds[c]}
    if other:
        return f"types {other}"
    if got != wanted:
        odd = [pair for pair in zip(got, wanted) if pair[0] != pair[1]][:2]
        return f"{len(got)} rows instead of {len(wanted)}; first differences {odd}"
    return "" if got else "no rows"


def main() -> None:
    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session(
        "local[8]", spark_sql_shuffle_partitions="8", spark_sql_session_timeZone="UTC",
        spark_ui_showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    failed = 0
    for name in names:
        started = time.time()
        try:
            problem = difference(spark, connection, sf_dir, name)
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += bool(problem)
        mark = "ok  " if not problem else "FAIL"
        kind = "" if name in ORACLE_SQL else " (rows only)"
        print(f"{mark} {name}{kind} {time.time() - started:.1f}s {problem}", flush=True)
    missing = set(ORACLE_SQL) - set(QUERIES)
    print(f"{len(names) - failed} of {len(names)} agree; oracles without a query: {sorted(missing)}")


if __name__ == "__main__":
    main()
