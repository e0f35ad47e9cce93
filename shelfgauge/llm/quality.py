"""Quality: a linear-chain conditional random field labels every line good or bad.

A line's features, and those of the lines before and after it, are compared
with cut points; every cut passed has a weight.  Weights and the transitions
between labels are fitted by the conditional likelihood of the lines' labels,
which are the document's.  A document's score is the mean of its lines'
probabilities of being good, from the forward-backward algorithm, weighted by
their lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfgauge.llm.common import in_chunks, read_table, texts
from shelfgauge.llm.training import held_out, training_rows

THRESHOLD = 0.5
# At most so many labelled rows are learned from.
SAMPLE = 4_000
CUTS = 12
STEPS, RATE, DECAY = 150, 0.1, 1e-4
# Bytes by kind; a line's shares of them are features.
KINDS = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "stop": b".,;:?",
    "mark": b"!",
    "symbol": b"#$%&*@^~|<>=+{}[]\\/_",
    "space": b" \t\r\x0b\x0c",
    "wide": bytes(range(128, 256)),
}
N_FEATURES = len(KINDS) + 6


def line_features(texts_: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of all texts, the lines' lengths in bytes plus one, and lines per text."""
    rows, lengths, counts = [], [], []
    data = [text.encode("utf-8", "replace") for text in texts_]
    for text in data:
        lines = text.split(b"\n")
        counts.append(len(lines))
        seen = set()
        for line in lines:
            found = line.split()
            n = len(found)
            distinct = len(set(found))
            twice = sum(map(bytes.__eq__, found, found[1:]))
            rows.append((
                np.log1p(n), (len(line) - n + 1) / (n + 1), distinct / n if n else 1.0,
                twice / n if n else 0.0, line in seen and n > 0, line.endswith((b".", b"?", b"!")),
            ))
            lengths.append(len(line) + 1)
            seen.add(line)
    lengths = np.array(lengths, dtype=np.int64)
    kind_of = np.full(256, len(KINDS), dtype=np.uint8)
    for number, members in enumerate(KINDS.values()):
        kind_of[list(members)] = number
    kinds = kind_of[np.frombuffer(b"\n".join(data) + b"\n", np.uint8)]
    starts = np.r_[0, np.cumsum(lengths)[:-1]].astype(np.int64)
    shares = np.stack([
        np.add.reduceat((kinds == number).astype(np.int32), starts) / lengths for number in range(len(KINDS))], 1)
    return np.concatenate([np.array(rows, dtype=np.float64), shares], 1), lengths, np.array(counts)


def passed(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many cut points of its feature each value has reached."""
    return np.stack([np.searchsorted(cuts[:, k], values[:, k], side="right") for k in range(values.shape[1])], 1)


def neighbours(level: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Levels of the line before, the line itself and the line after; 0 beyond the ends of a text."""
    first = np.zeros(len(level), dtype=bool)
    first[np.r_[0, np.cumsum(counts)[:-1]]] = True
    before = np.r_[level[:1], level[:-1]]
    after = np.r_[level[1:], level[-1:]]
    before = np.where(first[:, None], 0, before)
    after = np.where(np.r_[first[1:], True][:, None], 0, after)
    return [before, level, after]


def marginals(gain: np.ndarray, move: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line, and the expected number of each transition, by forward-backward.

    ``gain`` is a line's score for good over bad and ``move[a, b]`` that of b
    after a.  Texts are lanes, longest first, so each step works on those that
    still have lines.
    """
    order = np.argsort(-counts, kind="stable")
    starts = np.r_[0, np.cumsum(counts)[:-1]][order]
    lengths = counts[order]
    steps = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")
    factor = np.exp(move - move.max())
    emit = np.empty((len(gain), 2))
    emit[:, 1] = 1 / (1 + np.exp(-np.clip(gain, -500, 500)))
    emit[:, 0] = 1 - emit[:, 1]
    emit = np.maximum(emit, 1e-200)
    forward, scale = np.empty((len(gain), 2)), np.empty(len(gain))
    alpha = None
    for t in range(steps):
        at = starts[:active[t]] + t
        alpha = emit[at] if t == 0 else (alpha[:active[t]] @ factor) * emit[at]
        scale[at] = alpha.sum(1)
        alpha = alpha / scale[at][:, None]
        forward[at] = alpha
    good, moved = np.empty(len(gain)), np.zeros((2, 2))
    beta = np.ones((len(lengths), 2))
    for t in reversed(range(steps)):
        at = starts[:active[t]] + t
        if t + 1 < steps:
            k = active[t + 1]
            after = starts[:k] + t + 1
            step = emit[after] * beta[:k] / scale[after][:, None]
            moved += factor * (forward[at[:k]].T @ step)
            beta[:k] = step @ factor.T
        both = forward[at] * beta[:active[t]]
        good[at] = both[:, 1] / both.sum(1)
    return good, moved


def gains(levels: list[np.ndarray], tables: np.ndarray) -> np.ndarray:
    """Sum of the weights of all cuts passed; ``tables[place, feature, level]`` has the sums up to a level."""
    total = np.zeros(len(levels[0]))
    for place, level in enumerate(levels):
        for k in range(level.shape[1]):
            total += tables[place, k, level[:, k]]
    return total


def fit_lines(texts_: list[str], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut points, weight tables and transitions, by Adam on the conditional likelihood per text."""
    values, _, counts = line_features(texts_)
    shares = (np.arange(CUTS) + 0.5) / CUTS
    cuts = np.quantile(values, shares, axis=0)
    levels = neighbours(passed(values, cuts), counts)
    wanted = np.repeat(labels.astype(np.float64), counts)
    # Long texts count as one text, too.
    weight = np.repeat(1 / counts, counts)
    stay = np.zeros((2, 2))
    for label in (0, 1):
        stay[label, label] = (counts - 1)[labels == label].sum() / max(1, counts.sum())
    params = np.zeros(3 * N_FEATURES * (CUTS + 1) + 5)
    first, second = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, STEPS + 1):
        weights = params[:-5].reshape(3, N_FEATURES, CUTS + 1)
        tables, move, bias = np.cumsum(weights, 2), params[-5:-1].reshape(2, 2), params[-1]
        good, moved = marginals(gains(levels, tables) + bias, move, counts)
        error = (wanted - good) * weight
        slope = np.zeros((3, N_FEATURES, CUTS + 1))
        for place, level in enumerate(levels):
            for k in range(N_FEATURES):
                slope[place, k] = np.bincount(level[:, k], weights=error, minlength=CUTS + 1)[::-1].cumsum()[::-1]
        slope[:, :, 0] = 0  # level 0 is passed by all; the bias stands for it
        gradient = np.concatenate([
            slope.ravel() / len(counts), (stay - moved / max(1, counts.sum())).ravel(), [error.sum() / len(counts)]])
        gradient -= DECAY * params
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient * gradient
        params = params + RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    weights = params[:-5].reshape(3, N_FEATURES, CUTS + 1)
    tables = np.cumsum(weights, 2)
    tables[1, 0] += params[-1]
    return cuts, tables, params[-5:-1].reshape(2, 2)


def fit_group(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["place", "label"], kind="stable")
    model = fit_lines(list(group["text"]), group["label"].to_numpy())
    return pd.DataFrame({name: [part.tobytes()] for name, part in zip(("cuts", "tables", "move"), model)})


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = SAMPLE) -> tuple | None:
    """Cut points, weight tables and transitions, fitted in one task on at most ``bound`` labelled texts."""
    rows = training_rows(docs, labels, label, bound)
    fitted = rows.groupBy(F.lit(0).alias("all")).applyInPandas(
        fit_group, "cuts binary, tables binary, move binary").collect()
    if not fitted:
        return None
    cuts, tables, move = (np.frombuffer(bytes(part)) for part in fitted[0])
    return cuts.reshape(CUTS, N_FEATURES), tables.reshape(3, N_FEATURES, CUTS + 1), move.reshape(2, 2)


def text_scores(texts_: list[str], model: tuple | None) -> np.ndarray:
    if model is None:
        return np.full(len(texts_), 0.5)
    cuts, tables, move = model
    values, lengths, counts = line_features(texts_)
    good, _ = marginals(gains(neighbours(passed(values, cuts), counts), tables), move, counts)
    starts = np.r_[0, np.cumsum(counts)[:-1]]
    return np.add.reduceat(good * lengths, starts) / np.add.reduceat(lengths, starts)


def score(docs: DataFrame, model: tuple | None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    The score is the length-weighted mean of the lines' probabilities of being
    good.  NULL texts are empty; an empty text is one empty line.  Without
    labelled rows every score is 0.5.  Rows that repeat a doc_id are scored
    each.  An empty table gives no rows; columns other than doc_id and text are
    not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in in_chunks(frames):
            yield pd.DataFrame({"doc_id": frame["doc_id"], "score": text_scores(list(frame["text"]), shared.value)})

    scored = texts(docs).mapInPandas(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality(docs: DataFrame, labelled: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of ``docs`` by a model of the labelled rows of ``labelled``."""
    return score(docs, fit(labelled, labels))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality(docs, docs, read_table(spark, sf_dir, "labels"))
