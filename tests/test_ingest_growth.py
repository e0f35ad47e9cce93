"""What the ingest queries write, and how often they make their pages."""

from pathlib import Path

import pytest

from verification import queries


@pytest.fixture
def tables_of_offers(spark, tmp_path):
    """Two products and 400 offers of them, as part and lineitem."""
    folder = str(tmp_path / "tables")
    spark.sql("""select * from values (1L, 'red ring', 'Brand#1', 'ECONOMY', 4), (null, 'nothing', 'Brand#2', 'SMALL', 5),
        (2L, 'blue bolt', 'Brand#2', 'LARGE', 7) as t(p_partkey, p_name, p_brand, p_type, p_size)""").write.parquet(f"{folder}/part.parquet")
    spark.range(400).selectExpr(
        "id % 2 + 1 as l_partkey", "id % 5 as l_suppkey", "cast(3 as int) as l_linenumber",
        "cast(id as double) as l_extendedprice", "0.1D as l_discount").write.parquet(f"{folder}/lineitem.parquet")
    return folder


def test_landed_runs_are_compressed_files(spark, tables_of_offers, tmp_path, monkeypatch):
    monkeypatch.setattr(queries.tables, "shared_folder", lambda spark: str(tmp_path / "shared"))
    found = queries.ingest_latest_run(spark, tables_of_offers).collect()
    assert len(found) == 400
    files = list((tmp_path / "shared").rglob("part-*"))
    assert {file.suffix for file in files} == {".gz"}
    for run in ("2026-01-01", "2026-01-02"):
        assert {part for file in files if f"run={run}" in str(file) for part in file.parts if part.startswith("term=")} == {
            "term=ECONOMY", "term=LARGE"}
    text = 2 * sum(len(row.value) + 1 for row in queries.surrogate.landed_page_texts(spark, tables_of_offers).collect())
    assert sum(Path(file).stat().st_size for file in files) < text / 5


def test_offers_are_made_from_pages_once(spark, tables_of_offers, monkeypatch):
    stored = []
    store = queries.stored.store_offers

    def noted(offers, table, run):
        stored.append((run, offers._jdf.queryExecution().optimizedPlan().toString()))
        store(offers, table, run)

    monkeypatch.setattr(queries.stored, "store_offers", noted)
    assert queries.ingest_stored_offers(spark, tables_of_offers).count() == 200
    assert [run for run, _ in stored] == ["2026-01-01", "2026-01-02", "2026-01-01"]
    assert not any("from_json" in plan or "Join" in plan for _, plan in stored)
