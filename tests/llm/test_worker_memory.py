"""What Python workers hold at once, and what they keep after a task."""

import ctypes
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfgauge.llm import common, language_model, range_coder


def batch_rows(spark):
    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"n": [len(frame)]})

    docs = spark.range(0, 3_000, 1, 1).select("id", F.repeat(F.lit("0123456789"), 500).alias("text"))
    return [row.n for row in docs.mapInPandas(run, "n long").collect()]


def test_batches_are_bounded_by_bytes_within(spark):
    with common.small_batches(spark):
        inside = batch_rows(spark)
    assert sum(inside) == 3_000 and max(inside) * 5_000 < 1.1 * common.BATCH_BYTES
    assert spark.conf.get(common.BATCH_SETTING, None) is None
    assert batch_rows(spark) == [3_000]


def test_the_pipeline_runs_its_stages_in_small_batches(spark, monkeypatch):
    seen = []

    def stage(spark, docs, sf_dir):
        seen.append(spark.conf.get(common.BATCH_SETTING, None))
        return docs

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("noted", stage)])
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() == 200
    assert seen == [str(common.BATCH_BYTES)] and spark.conf.get(common.BATCH_SETTING, None) is None


def resident() -> int:
    with open("/proc/self/statm") as figures:
        return int(figures.read().split()[1]) * 4096


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="another C library than glibc")
def test_freed_memory_goes_back_after_a_task():
    def run(frames):
        held = [bytearray(20_000) for _ in range(10_000)]  # below the size that the system gives singly
        pins = held[::100]
        del held
        yield len(pins)

    before = resident()
    assert list(common.tidied(run)(iter([]))) == [100]
    assert resident() - before < 40_000_000


def test_batches_of_the_language_model_hold_like_lengths(monkeypatch):
    monkeypatch.setattr(language_model, "TOKENS", 1_000)
    monkeypatch.setattr(language_model, "HELD", 20_000)
    sizes = np.random.default_rng(1).integers(1, 300, 400)
    sizes[[7, 200]] = 2_500
    frames = [pd.DataFrame({"n_tokens": part, "key": range(start, start + len(part))})
              for start, part in zip(range(0, 400, 50), np.split(sizes, 8))]
    batches = list(language_model.in_batches(iter(frames)))
    assert sorted(key for batch in batches for key in batch["key"]) == list(range(400))
    assert all((batch["n_tokens"].to_numpy() == sizes[batch["key"]]).all() for batch in batches)
    assert all(len(batch) == 1 or batch["n_tokens"].sum() < 2 * 1_000 for batch in batches)
    # Steps that all batches take; in the order in which texts come they took about 300 each.
    assert sum(batch["n_tokens"].max() for batch in batches) < 0.8 * sum(min(300, batch["n_tokens"].sum()) for batch in batches) + 5_000
    few = list(language_model.in_batches(iter([frames[0].head(3)])))
    assert len(few) == 1 and few[0]["key"].tolist() == [0, 1, 2]


def test_a_group_of_token_ids_is_coded_in_bounded_memory():
    size = range_coder.BLOCK * range_coder.LANES
    ids = np.minimum(np.random.default_rng(1).zipf(1.2, size), 49_999).astype("<u4")
    tracemalloc.start()
    blocks = range_coder.encode(ids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100_000_000
    assert (range_coder.decode(blocks) == ids).all()
