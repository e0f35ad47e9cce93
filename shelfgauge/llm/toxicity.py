"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Each coordinate has its own learning rate, and L1 keeps at zero what never
earned its place, so the model is a short list of (feature, weight) that fits a
broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfgauge.llm.common import in_chunks, read_table, release_memory, texts, tidied
from shelfgauge.llm.training import held_out, training_rows

THRESHOLD = 0.7
# At most so many labelled rows are learned from.
SAMPLE = 16_000
EPOCHS = 5
BITS = 20
ALPHA, BETA, L1, L2 = 2.0, 1.0, 12.0, 0.1
# A feature of fewer labelled texts tells a text, not a kind of text, and isn't learned.
LEAST_TEXTS = 4
# Letters of any language: in UTF-8 every byte of a character beyond ASCII is 0x80 or more.
WORD = re.compile(rb"[a-z\x80-\xff]+")
# Gaps of the pairs: neighbours, and one or two words left out.
GAPS = (1, 2, 3)
BIAS = 0


def features(text: str) -> np.ndarray:
    """Hashes of words, neighbouring pairs and skip-grams, with repeats; BIAS first."""
    found = WORD.findall(text.encode("utf-8", "replace").lower())
    one = np.fromiter(map(crc32, found), np.uint64, len(found))
    parts = [np.zeros(1, np.uint64), scaled(one * np.uint64(0x9E3779B97F4A7C15))]
    for gap in GAPS:
        pair = one[:-gap] * np.uint64(0xC2B2AE3D27D4EB4F) + one[gap:] * np.uint64(0x165667B19E3779F9)
        parts.append(scaled((pair + np.uint64(gap)) * np.uint64(0x9E3779B97F4A7C15)))
    return np.concatenate(parts).astype(np.int32)


def scaled(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)) | np.uint64(1)  # never BIAS


def feature_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per chunk of texts: arrays of their places, labels and numbers of features, and all features in a row."""
    for frame in in_chunks(frames):
        found = [np.unique(features(text)) for text in frame["text"]]
        yield pd.DataFrame({
            "places": [frame["place"].to_numpy(np.int64).tobytes()],
            "labels": [frame["label"].to_numpy(np.int64).tobytes()],
            "lengths": [np.array([len(at) for at in found], np.int64).tobytes()],
            "features": [np.concatenate(found).tobytes()]})


def ftrl(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Weights after EPOCHS passes over the rows in their order."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(at: np.ndarray) -> np.ndarray:
        held = z[at]
        l1 = np.where(at == BIAS, 0.0, L1)
        shrunk = np.sign(held) * np.maximum(np.abs(held) - l1, 0.0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(EPOCHS):
        for at, label in zip(rows, labels):
            w = weights(at)
            gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
            squared = n[at]
            sigma = (np.sqrt(squared + gradient * gradient) - np.sqrt(squared)) / ALPHA
            z[at] += gradient - sigma * w
            n[at] += gradient * gradient
    return weights(np.arange(1 << BITS))


def fit_group(chunks: pa.Table) -> pa.Table:
    """Weights from all chunks, whose texts are learned from in the order of place and label; arrays are not copied."""

    def arrays(name: str, kind: type) -> list[np.ndarray]:
        return [np.frombuffer(data.as_buffer(), kind) for data in chunks[name]]

    packed = arrays("features", np.int32)
    frequent = np.zeros(1 << BITS, np.int32)
    for some in packed:
        np.add.at(frequent, some, 1)
    frequent = frequent >= LEAST_TEXTS
    frequent[BIAS] = True
    rows = []
    for some, lengths in zip(packed, arrays("lengths", np.int64)):
        keep = frequent[some]
        left = np.cumsum(keep, dtype=np.int32)[np.cumsum(lengths) - 1]  # a text has the bias at least
        rows += np.split(some[keep], left[:-1])
    places, labels = (np.concatenate(arrays(name, np.int64)) for name in ("places", "labels"))
    order = np.lexsort((labels, places))
    weights = ftrl([rows[i] for i in order], labels[order].astype(np.float64))
    kept = np.flatnonzero(weights)
    return pa.table({"features": [kept.astype(np.int32).tobytes()], "weights": [weights[kept].tobytes()]})


def fit_and_release(chunks: pa.Table) -> pa.Table:
    weights = fit_group(chunks)
    release_memory()
    return weights


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = SAMPLE) -> tuple[bytes, bytes]:
    """The model: features with a weight, and the weights; at most 2**BITS of them.

    Features are made where the texts are; one task then sees at most ``bound``
    rows of hashes.  Without labelled rows the model is empty.
    """
    rows = training_rows(docs, labels, label, bound).mapInPandas(
        tidied(feature_rows), "places binary, labels binary, lengths binary, features binary")
    model = rows.groupBy(F.lit(0).alias("all")).applyInArrow(fit_and_release, "features binary, weights binary").collect()
    return (bytes(model[0][0]), bytes(model[0][1])) if model else (b"", b"")


def dense_weights(model: tuple[bytes, bytes]) -> np.ndarray:
    dense = np.zeros(1 << BITS)
    dense[np.frombuffer(model[0], np.int32)] = np.frombuffer(model[1])
    return dense


def probability(text: str, dense: np.ndarray) -> float:
    """Each feature counts once, however often it comes."""
    at = features(text)
    at = at[dense[at] != 0]
    return 1 / (1 + np.exp(-np.clip(dense[np.unique(at)].sum(), -500, 500)))


def score(docs: DataFrame, model: tuple[bytes, bytes], threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    A text's score is the model's probability that it is toxic; each feature
    counts once, however often it comes.  NULL texts are empty; an empty text
    gets the score of the bias alone, and every text 0.5 from an empty model.
    Rows that repeat a doc_id are scored each; a NULL doc_id is not held out
    unless the empty text would be.  An empty table gives no rows; columns other
    than doc_id and text are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dense = dense_weights(shared.value)
        for frame in in_chunks(frames):
            yield pd.DataFrame({
                "doc_id": frame["doc_id"], "score": [probability(text, dense) for text in frame["text"]]})

    scored = texts(docs).mapInPandas(tidied(run), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labelled: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of ``docs`` by a model of the labelled rows of ``labelled``."""
    return score(docs, fit(labelled, labels))


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs``, with all their columns, of texts that score below ``threshold``; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator) -> Iterator:
        dense = dense_weights(shared.value)
        for batch in batches:
            texts_ = batch.column("text")
            yield batch.filter(pa.array([
                probability(text.as_py() or "", dense) < threshold for text in texts_], pa.bool_()))

    return docs.mapInArrow(tidied(run), docs.schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity(docs, docs, read_table(spark, sf_dir, "labels"))
