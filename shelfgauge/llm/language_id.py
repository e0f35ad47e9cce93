"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies of the hashed n-grams are counted over all texts that may
be learned from.  The weights are fitted on a bounded sample of them by
follow-the-regularised-leader with an L1 and an L2 penalty, and the
probabilities are then calibrated by a temperature on sampled rows that the
weights were not fitted on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfgauge.llm.common import read_table, remainder

FOLDS, HELD_OUT = 4, 2
ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
# The sample: so many texts of a language, and of all languages together.  500 is
# also below the limit up to which Spark cuts a window's rows before the shuffle.
PER_LANG, SAMPLE = 500, 8_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.01
# One sampled row in so many is kept for the temperature.
CALIBRATED = 5
TEMPERATURES = (0.05, 20.0)
UNKNOWN = "und"
MODEL_SCHEMA = "langs array<string>, buckets binary, weights binary, bias binary, temperature double"


def held_out(doc_id):
    return remainder(doc_id, FOLDS) == HELD_OUT


def grams(text: str) -> np.ndarray:
    """Hashes of the 1- to 3-grams of the lower-cased text, with repeats.

    What is no letter of ASCII and lies below U+00C0, and the symbols of U+2000
    to U+2BFF, parts words; a run of it is one blank.
    """
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    letter = ((points >= 97) & (points <= 122)) | ((points >= 0xC0) & ((points < 0x2000) | (points > 0x2BFF)))
    points = np.where(letter, points, np.uint32(32))
    points = points[np.append(True, letter[1:] | letter[:-1])]
    parts = []
    for order in ORDERS:
        if len(points) < order:
            break
        mixed = np.full(len(points) - order + 1, 0x9E3779B9 * order % 2**32, np.uint32)
        for i in range(order):
            mixed = (mixed ^ points[i:len(points) - order + 1 + i]) * np.uint32(0x85EBCA6B)
            mixed ^= mixed >> np.uint32(13)
        parts.append(((mixed * np.uint32(0xC2B2AE35)) >> np.uint32(16)).astype(np.uint16))
    return np.concatenate(parts)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that the text has n-grams in, ascending, and how many."""
    counts = np.bincount(grams(text), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Logarithmic frequencies times ``idf`` of the same buckets, of length 1."""
    weighted = np.log1p(counts) * idf
    return weighted / max(np.sqrt(weighted @ weighted), 1e-12)


def learnable(docs: DataFrame) -> DataFrame:
    """(place, lang, text) of what may be learned from; ``place`` hashes id and text."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id").cast("bigint")))
    text = F.col("text").cast("string")
    return known.select(
        F.xxhash64(F.col("doc_id").cast("bigint"), text).alias("place"),
        F.col("lang").cast("string").alias("lang"), text.alias("text"))


def inverse_frequencies(rows: DataFrame) -> np.ndarray:
    """idf of every bucket over all ``rows``; each task sends one count a bucket at most."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for frame in frames:
            for text in frame["text"]:
                df[np.unique(grams(text)) if len(text) < 256 else gram_counts(text)[0]] += 1
                n += 1
        at = np.flatnonzero(df)
        yield pd.DataFrame({"bucket": np.append(at, -1), "n": np.append(df[at], n)})

    counted = rows.select("text").mapInPandas(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n"))
    found = dict(counted.collect())
    total = found.pop(-1, 0)
    df = np.zeros(BUCKETS)
    for bucket, n in found.items():
        df[bucket] = n
    return np.log((1 + total) / (1 + df)) + 1


def sampled(rows: DataFrame) -> DataFrame:
    """(place, lang, text): of each language the texts with the smallest hashes, the same number for all.

    First the greatest hash taken is found per language, from hashes alone, so
    that only chosen texts are moved; hashes far above it stay where they are,
    so that a language's window holds a few times the sample, whatever its size.
    """
    held = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("held"))
    n_langs = held.count()
    if n_langs > SAMPLE:
        raise ValueError(f"{n_langs} languages are more than a sample of {SAMPLE} rows can hold")
    each = min(PER_LANG, SAMPLE // max(n_langs, 1))
    low = held.select("lang", (F.least(F.lit(1.0), F.lit(8.0 * each) / F.col("held")) * 2.0**64 - 2.0**63).alias("low"))
    # One row per language, SAMPLE at most.
    near = rows.select("lang", "place").join(F.broadcast(low), "lang").where(F.col("place").cast("double") <= F.col("low"))
    smallest = Window.partitionBy("lang").orderBy("place")
    first = near.select("lang", "place").distinct().withColumn("_nth", F.row_number().over(smallest))
    limits = first.where(F.col("_nth") <= each).groupBy("lang").agg(F.max("place").alias("limit"))
    return rows.join(F.broadcast(limits), "lang").where(F.col("place") <= F.col("limit")).select("place", "lang", "text")


def feature_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        found = [gram_counts(text) for text in frame["text"]]
        yield pd.DataFrame({
            "place": frame["place"], "lang": frame["lang"],
            "buckets": [at.astype(np.uint16).tobytes() for at, _ in found],
            "counts": [counts.astype(np.float32).tobytes() for _, counts in found]})


def softmax(logits: np.ndarray) -> np.ndarray:
    grown = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return grown / grown.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_langs: int) -> np.ndarray:
    """Weights, one row per bucket and a last one for the bias, after EPOCHS passes over the rows."""
    z, n = np.zeros((BUCKETS + 1, n_langs)), np.zeros((BUCKETS + 1, n_langs))
    penalty = np.full((BUCKETS + 1, 1), L1)
    penalty[BUCKETS] = 0.0

    def weights(at) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - penalty[at], 0.0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    rows = [(np.append(at, BUCKETS), np.append(x, 1.0)) for at, x in rows]
    for _ in range(EPOCHS):
        for (at, x), label in zip(rows, labels):
            w = weights(at)
            error = softmax(x @ w)
            error[label] -= 1.0
            gradient = x[:, None] * error
            before = n[at]
            after = before + gradient * gradient
            z[at] += gradient - (np.sqrt(after) - np.sqrt(before)) / ALPHA * w
            n[at] = after
    return weights(slice(None))


def log_loss(logits: np.ndarray, labels: np.ndarray, temperature: float) -> float:
    chance = softmax(logits / temperature)[np.arange(len(labels)), labels]
    return float(-np.log(np.maximum(chance, 1e-300)).mean())


def best_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm; 1 without rows."""
    if not len(labels):
        return 1.0
    low, high = np.log(TEMPERATURES[0]), np.log(TEMPERATURES[1])
    golden = (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - golden * (high - low), low + golden * (high - low)
        if log_loss(logits, labels, np.exp(a)) <= log_loss(logits, labels, np.exp(b)):
            high = b
        else:
            low = a
    return float(np.exp((low + high) / 2))


def fit_group(idf: np.ndarray, group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["place", "lang"], kind="stable")
    langs = sorted(set(group["lang"]))
    labels = group["lang"].map({lang: i for i, lang in enumerate(langs)}).to_numpy()
    rows = []
    for buckets, counts in zip(group["buckets"], group["counts"]):
        at = np.frombuffer(buckets, np.uint16).astype(np.int64)
        rows.append((at, tf_idf(np.frombuffer(counts, np.float32), idf[at])))
    kept_back = np.arange(len(rows)) % CALIBRATED == CALIBRATED - 1
    weights = ftrl([row for row, back in zip(rows, kept_back) if not back], labels[~kept_back], len(langs))
    logits = np.array([x @ weights[at] + weights[BUCKETS] for (at, x), back in zip(rows, kept_back) if back])
    kept = np.flatnonzero(np.abs(weights[:BUCKETS]).sum(axis=1))
    return pd.DataFrame({
        "langs": [langs], "buckets": [kept.astype(np.int32).tobytes()], "weights": [weights[kept].tobytes()],
        "bias": [weights[BUCKETS].tobytes()], "temperature": [best_temperature(logits, labels[kept_back])]})


@dataclass(frozen=True)
class Model:
    """Languages by code point, non-zero weights by bucket, and what turns counts into features."""

    langs: tuple[str, ...]
    buckets: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    idf: np.ndarray

    def dense(self) -> np.ndarray:
        table = np.zeros((BUCKETS, len(self.langs)))
        table[self.buckets] = self.weights
        return table


def fit(docs: DataFrame) -> Model:
    """The model of all learnable rows: ``SAMPLE`` of them at most for the weights, all of them for the idf."""
    rows = learnable(docs)
    idf = inverse_frequencies(rows)
    features = sampled(rows).mapInPandas(feature_rows, "place long, lang string, buckets binary, counts binary")
    # Rows that repeat id, text and language are one.
    features = features.groupBy("lang", "place").agg(
        F.any_value("buckets").alias("buckets"), F.any_value("counts").alias("counts"))
    shared = docs.sparkSession.sparkContext.broadcast(idf)
    fitted = features.groupBy(F.lit(0).alias("all")).applyInPandas(
        lambda group: fit_group(shared.value, group), MODEL_SCHEMA).collect()
    if not fitted:
        return Model((), np.zeros(0, np.int32), np.zeros((0, 0)), np.zeros(0), 1.0, idf)
    row = fitted[0]
    return Model(
        tuple(row.langs), np.frombuffer(row.buckets, np.int32),
        np.frombuffer(row.weights).reshape(-1, len(row.langs)), np.frombuffer(row.bias), row.temperature, idf)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    The likeliest language and its calibrated probability; of equally likely
    ones the first by code point.  A NULL text or one without a letter is
    ``und``, with score 1; from a model of no languages every text is ``und``,
    others with score 0.  Rows that repeat a doc_id are predicted each; a NULL
    doc_id is not held out unless the empty text would be.  An empty table
    gives no rows; columns other than doc_id and text are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        dense = model.dense()

        def best(text: str | None) -> tuple[str, float]:
            if text is None:
                return UNKNOWN, 1.0
            if not model.langs:
                return UNKNOWN, 0.0
            at, counts = gram_counts(text)
            logits = tf_idf(counts, model.idf[at]) @ dense[at] + model.bias
            chances = softmax(logits / model.temperature)
            first = int(np.argmax(chances))
            return model.langs[first], float(chances[first])

        for frame in frames:
            found = [best(text) for text in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "lang_pred": [lang for lang, _ in found],
                                "score": [score for _, score in found]})

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.when(text.rlike(r"\p{L}"), text).alias("text"))
    scored = rows.mapInPandas(run, "doc_id long, lang_pred string, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def identify(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """Languages of ``docs`` by a model of the rows of ``labelled`` (doc_id, text, lang)."""
    return predict(docs, fit(labelled))


def op12_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return identify(docs, docs)
