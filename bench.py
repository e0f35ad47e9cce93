"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shelfgauge.session import build_session  # noqa: E402
from verification.queries import QUERIES  # noqa: E402

HEADLINE = (
    "ingest_pages_flatten",
    "size_oz_units",
    "size_ct_exact",
    "repair_literal",
    "repair_compound",
    "unit_price_columns",
    "price_rows_oz",
    "best_price_oz",
    "best_price_each",
    "dense_price_rank",
    "dense_price_rank_global",
    "combine_first_source_wins",
    "size_frequency",
    "price_histogram",
    "job_vegetables_oz",
    "job_tea_ct",
    "job_produce_oz",
    "job_all_categories",
)


def seconds(spark, sf_dir: str, name: str) -> float:
    """Best of three runs, from building the plan to the last row."""
    best = float("inf")
    for _ in range(3):
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        best = min(best, time.perf_counter() - started)
    return best


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        spark_sql_shuffle_partitions=cpus,
        spark_driver_memory="12g",
        spark_ui_showConsoleProgress="false",
        spark_sql_session_timeZone="UTC",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds(spark, sf_dir, "best_price_oz")  # warm up the JVM
    times = {name: round(seconds(spark, sf_dir, name), 3) for name in HEADLINE}
    print(json.dumps({
        "metric": "unit-price queries, total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
