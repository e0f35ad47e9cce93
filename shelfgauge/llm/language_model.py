"""A hidden Markov language model, trained by Baum-Welch over the training texts.

A state emits words; every word of the training texts has its own probability in
every state, and so has any unknown one.  Emissions of the FREQUENT most frequent
words are broadcast, which bounds the broadcast.  All others first emit alike in
every state, which needs no exchange, while the rounds learn moves, starts and
the frequent words' emissions.  The last round counts them by state as well, over
all training texts, in a table that is joined to the words of the texts scored.

A word's probability in a state is its smoothed frequency times how much likelier
the state is at the word than elsewhere, made to add up to 1.  That share of
states is drawn towards the mean by a prior weight in tokens.  A part of the
training texts is held back from the rounds: it ends them, and chooses the weight.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfgauge.llm.common import column_chunks, read_table, remainder, small_batches, texts, tidied, written

FOLDS, HELD_OUT = 7, 2
STATES = 8
# Rounds end when the log10 likelihood of the texts held back grows by less than this part of itself.
TOLERANCE = 1e-3
# One in so many training texts is held back from all rounds but the last.
HELD_BACK = 16
# Words whose counts and emissions are broadcast.
FREQUENT = 100_000
# How much the first states differ in their emissions, and how likely they last.
TILT, STAY = 0.3, 0.95
# Prior weights, in tokens, of the mean share of states in a word's; the rounds take the first one.
PRIORS = 4.0, 0.25, 1.0, 16.0
# Expected counts of other words are whole numbers of this part of a token, so that sums don't depend on their order.
PART = 2.0**-12
# Logarithms of shares are kept in 16 bits: steps of 1/SHARE_STEPS from -SHARE_RANGE to SHARE_RANGE.
SHARE_STEPS, SHARE_RANGE = 2_048, 16
# The end of a text, which no word equals.
END = ""
# Steps in which counts are told apart when the most frequent words are chosen.
STEPS_PER_DOUBLE = 8
# Tokens a task works on at once, and tokens, packed, among whose texts it puts those of like length together.
TOKENS, HELD = 1_000_000, 4_000_000
# Rows of words' counts that a task adds up before it gives them to Spark.
COUNTED = 1_000_000
# Rows of expected counts that a task gives to Spark at once.
ROWS = 50_000


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All texts' runs of ``[^\\x20\\x09-\\x0D]`` with A-Z lower-cased, end to end, and how many each text has."""
    pieces = pc.ascii_split_whitespace(pc.ascii_lower(column.cast(pa.large_string())))
    flat, owner = pc.list_flatten(pieces), pc.list_parent_indices(pieces).to_numpy()
    full = pc.not_equal(flat, "")
    return flat.filter(full), np.bincount(owner[full.to_numpy(zero_copy_only=False)], minlength=len(column))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c), stored: how often each word, and the end, comes in ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for piece in column_chunks(batch):
                counted = pc.value_counts(words_of(piece["text"])[0])
                held += [pa.record_batch([pa.array([END]), pa.array([piece.num_rows], pa.int64())], ["word", "n"]),
                         pa.record_batch([counted.field(0).cast(pa.string()), counted.field(1)], ["word", "n"])]
                size += len(counted)
                if size >= COUNTED:
                    yield from added(held)
                    held, size = [], 0
        if held:
            yield from added(held)

    def added(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        summed = pa.Table.from_batches(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
        return pa.table({"word": summed["word"], "n": summed["n_sum"]}).to_batches(max_chunksize=ROWS)

    counted = docs.mapInArrow(tidied(run), "word string, n long")
    return written(counted.groupBy("word").agg(F.sum("n").alias("c")), "word-counts")


class Vocabulary(NamedTuple):
    """What every task knows of the words: bounded by FREQUENT."""

    frequent: list[str]  # most frequent first; symbols 1, 2, ...; 0 is the end
    counts: np.ndarray  # of the frequent words
    limit: float  # the least count of a frequent word
    all_tokens: int
    all_words: int
    end_count: int

    def weights(self) -> np.ndarray:
        """Counts of the end and the frequent words, each one more, as an unknown word counts 1."""
        return np.concatenate([[self.end_count], self.counts]) + 1

    def other_weight(self) -> float:
        """The same for all other words and an unknown one together."""
        return max(self.all_tokens + self.all_words + 1 - self.weights().sum(), 1.0)


def frequent_from(counts: DataFrame) -> float:
    """The least count that no more than FREQUENT words reach, from a short table of steps of counts."""
    steps = counts.groupBy(F.floor(F.log2("c") * STEPS_PER_DOUBLE).alias("step")).agg(
        F.count(F.lit(1)).alias("words"), F.min("c").alias("least")).collect()
    limit, words = float("inf"), 0
    for row in sorted(steps, key=lambda row: -row["step"]):
        words += row["words"]
        if words > FREQUENT:
            break
        limit = row["least"]
    return limit


def vocabulary(counts: DataFrame) -> Vocabulary:
    every = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"),
                       F.sum(F.when(F.col("word") == END, F.col("c"))).alias("ends")).first()
    real = counts.where(F.col("word") != END)
    limit = frequent_from(real)
    top = sorted(real.where(F.col("c") >= limit).collect(), key=lambda row: (-row["c"], row["word"]))
    return Vocabulary([row["word"] for row in top], np.array([row["c"] for row in top], np.float64), limit,
                      every["n"] or 0, every["v"], every["ends"] or 0)


def packed_symbols(symbols: np.ndarray) -> bytes:
    """Bytes of equal weight together, since the upper ones are mostly zero, compressed."""
    return zlib.compress(symbols.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked_symbols(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def encoded(docs: DataFrame, known: Vocabulary) -> DataFrame:
    """One stored row per document: its symbols, the sum over frequent words, and its other words.

    ``base`` sums log10(c + 1) over frequent words and the end.  ``rare`` has the
    different other words; their symbols follow on those of the frequent words,
    in this order.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        frequent, gain = pa.array(v.frequent, pa.large_string()), np.log10(v.weights())
        for piece in (piece for batch in batches for piece in column_chunks(batch)):
            flat, sizes = words_of(piece["text"])
            coded = flat.dictionary_encode()
            codes, found = coded.indices.to_numpy(), pc.fill_null(pc.index_in(coded.dictionary, frequent), -1).to_numpy()
            symbols = found[codes].astype(np.int64) + 1
            # The different other words of each text, in order of text and code, number its other symbols.
            other = np.flatnonzero(symbols == 0)
            pairs = np.repeat(np.arange(len(sizes)), sizes)[other] * np.int64(len(found)) + codes[other]
            pairs, which = np.unique(pairs, return_inverse=True)
            text, code = np.divmod(pairs, max(len(found), 1))
            first = np.searchsorted(text, np.arange(len(sizes) + 1))
            symbols[other] = len(gain) + which - first[text[which]]
            names = coded.dictionary.take(pa.array(code)).cast(pa.string())
            rows, at = [], 0
            for size in sizes:
                own = np.append(symbols[at:at + size], 0)
                at += size
                seen = own[own < len(gain)]
                rows.append((packed_symbols(own), len(own), len(seen) - (v.end_count == 0), float(gain[seen].sum())))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64(), pa.float64()))),
                 pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(first, pa.int32()), names), piece["doc_id"], piece["train"]],
                ["symbols", "n_tokens", "n_frequent", "base", "n_rare", "rare", "doc_id", "train"])

    rows = docs.mapInArrow(tidied(run), "symbols binary, n_tokens long, n_frequent long, base double, "
                                        "n_rare long, rare array<string>, doc_id long, train boolean")
    return written(rows.withColumn("key", F.monotonically_increasing_id()), "encoded")


class Model(NamedTuple):
    start: np.ndarray  # per state
    move: np.ndarray  # from state, to state
    emit: np.ndarray  # symbol, state


class Others(NamedTuple):
    """Emissions of the other words.

    ``shares`` has a stored row per word: its count ``c`` and, packed, how much
    likelier each state is at the word than elsewhere; None as long as all words
    are alike.  A word's emission is (c + 1) * share / ``total``, and an unknown
    word's is 1 / ``total``.
    """

    shares: DataFrame | None
    total: np.ndarray

    @property
    def table(self) -> DataFrame:
        """(word, e): the emission of each word in each state."""
        return self.shares.select("word", F.array(*[
            w / float(t) for w, t in zip(weighted_shares(), self.total)]).alias("e"))

    @property
    def unknown(self) -> np.ndarray:
        return 1 / self.total


def packed_shares(shares: list[Column]) -> list[Column]:
    """Columns p0 and p1, each with the logarithms of four states' shares in 16 bits."""
    steps = [F.round((F.log(x) + SHARE_RANGE) * SHARE_STEPS) for x in shares]
    steps = [F.least(F.greatest(x, F.lit(0.0)), F.lit(65_535.0)).cast("bigint") for x in steps]
    halves = []
    for i in range(0, STATES, 4):
        packed = steps[i]
        for k in range(1, 4):
            packed = packed.bitwiseOR(F.shiftleft(steps[i + k], 16 * k))
        halves.append(packed.alias(f"p{i // 4}"))
    return halves


EQUAL_SHARES = sum(SHARE_RANGE * SHARE_STEPS << 16 * k for k in range(4)) - (1 << 64)


def weighted_shares() -> list[Column]:
    """(c + 1) * share for each state, from the columns of ``Others.shares``."""
    steps = [F.shiftrightunsigned(f"p{s // 4}", 16 * (s % 4)).bitwiseAND(F.lit(65_535)) for s in range(STATES)]
    return [(F.col("c") + 1) * F.exp(x / float(SHARE_STEPS) - SHARE_RANGE) for x in steps]


def unpacked_shares(p0: np.ndarray, p1: np.ndarray) -> np.ndarray:
    """Shares by word and state, as ``weighted_shares`` takes them."""
    steps = np.concatenate([p.astype("<i8").view("<u2").reshape(-1, 4) for p in (p0, p1)], 1)
    return np.exp(steps / SHARE_STEPS - SHARE_RANGE)


def stored_others(shares: DataFrame, frequent_total: np.ndarray) -> Others:
    """``shares`` (word, c, p0, p1) stored, and the sum of all words' weighted shares in each state."""
    shares = written(shares, "emissions")
    row = shares.agg(*[F.sum(w).alias(f"s{s}") for s, w in enumerate(weighted_shares())]).first()
    return Others(shares, frequent_total + np.array([x or 0.0 for x in row]) + 1)


def sums(table: DataFrame, column: str) -> np.ndarray:
    row = table.agg(*[F.sum(F.col(column)[s]).alias(f"s{s}") for s in range(STATES)]).first()
    return np.array([x or 0.0 for x in row])


def first_model(known: Vocabulary, counts: DataFrame, alike: bool = False) -> tuple[Model, Others]:
    """Mean emissions, each tilted at random, and states that last, so that texts part by what they are about.

    With ``alike`` those of the other words are not tilted and not stored.
    """
    random = np.random.default_rng(7)
    mean = known.weights()
    emit = mean[:, None] * np.exp(random.normal(0, TILT, (len(mean), STATES)))
    if alike:
        others = Others(None, emit.sum(0) + known.other_weight())
    else:
        rest = counts.where((F.col("word") != END) & (F.col("c") < known.limit))
        # Even numbers from a hash, of the same deviation.
        tilts = [F.exp(F.xxhash64("word", F.lit(s)) / 2.0**63 * (TILT * 3**0.5)) for s in range(STATES)]
        others = stored_others(rest.select("word", "c", *packed_shares(tilts)), emit.sum(0))
    move = np.full((STATES, STATES), (1 - STAY) / (STATES - 1)) + (STAY - (1 - STAY) / (STATES - 1)) * np.eye(STATES)
    return Model(np.full(STATES, 1 / STATES), move, emit / others.total), others


def with_shares(rows: DataFrame, others: Others) -> DataFrame:
    """``rows`` with the arrays c, p0 and p1 of their other words, in order; NULL without such words, missing if all are alike."""
    if others.shares is None:
        return rows
    words = rows.select("key", F.posexplode("rare").alias("place", "word"))
    found = [F.coalesce(x, F.lit(y).cast("bigint")).alias(x) for x, y in (("c", 0), ("p0", EQUAL_SHARES), ("p1", EQUAL_SHARES))]
    met = words.join(others.shares, "word", "left").select("key", "place", *found).groupBy(F.col("key").alias("of")).agg(
        F.array_sort(F.collect_list(F.struct("place", "c", "p0", "p1"))).alias("x"))
    met = met.select("of", *[F.col(f"x.{x}").alias(x) for x in ("c", "p0", "p1")])
    return rows.join(met, rows["key"] == met["of"], "left").drop("of")


def joined(arrays: pd.Series) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *[np.asarray(x, np.int64) for x in arrays if x is not None]])


def batch_model(frame: pd.DataFrame, model: Model, others: np.ndarray, alike: bool) -> tuple[np.ndarray, Model, np.ndarray]:
    """Symbols of a batch, the model with the other words of each of its texts in turn, and these words' counts.

    ``others`` is the total of ``Others``.  Words that are ``alike`` are one symbol, and
    their weight is left out: it is the same in all states.
    """
    symbols = np.concatenate([unpacked_symbols(x) for x in frame["symbols"]])
    if alike:
        return np.minimum(symbols, len(model.emit)), model._replace(emit=np.concatenate([model.emit, 1 / others[None]])), None
    sizes = frame["n_rare"].to_numpy()
    before = np.repeat(np.cumsum(sizes) - sizes, frame["n_tokens"].to_numpy())
    symbols += np.where(symbols >= len(model.emit), before, 0)
    if "c" in frame:
        c, shares = joined(frame["c"]), unpacked_shares(joined(frame["p0"]), joined(frame["p1"]))
    else:
        c, shares = np.zeros(int(sizes.sum()), np.int64), 1.0
    emit = np.concatenate([model.emit, (c[:, None] + 1) * shares / others])
    return symbols, model._replace(emit=emit), c


class Lanes(NamedTuple):
    """Sequences side by side, longest first; ``active[t]`` of them have a symbol t."""

    order: np.ndarray
    starts: np.ndarray
    active: np.ndarray


def in_lanes(lengths: np.ndarray) -> Lanes:
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    steps = np.arange(int(lengths.max()))
    return Lanes(order, starts, np.searchsorted(-lengths[order], -steps, side="left"))


def forward(symbols: np.ndarray, lanes: Lanes, model: Model) -> np.ndarray:
    """log10 probability of each sequence in the lanes' order, by the scaled forward recursion."""
    total = np.zeros(len(lanes.starts))
    alpha = np.broadcast_to(model.start, (len(lanes.starts), STATES))
    for t, k in enumerate(lanes.active):
        alpha = (alpha[:k] if t == 0 else alpha[:k] @ model.move) * model.emit[symbols[lanes.starts[:k] + t]]
        scale = alpha.sum(1)
        alpha /= scale[:, None]
        total[:k] += np.log10(scale)
    return total


def expected_counts(symbols: np.ndarray, lengths: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions, and the sum of log10 probabilities, by forward-backward.

    In single precision, which scaling allows.  The symbols of one step of all
    sequences lie side by side, so that a step reads and writes one slice.
    """
    lanes = in_lanes(lengths)
    ends = np.cumsum(lanes.active)
    slices = [slice(end - k, end) for k, end in zip(lanes.active, ends)]
    steps = np.repeat(np.arange(len(slices)), lanes.active)
    symbols = symbols[lanes.starts[np.arange(len(symbols)) - (ends - lanes.active)[steps]] + steps]
    start, move, emit = (x.astype(np.float32) for x in model)
    posterior, scales = np.empty((STATES, len(symbols)), np.float32), np.empty(len(symbols), np.float32)
    alpha = start[:, None]
    for t, at in enumerate(slices):
        alpha = (alpha if t == 0 else move.T @ alpha[:, :lanes.active[t]]) * emit.take(symbols[at], axis=0).T
        scales[at] = alpha.sum(0)
        alpha /= scales[at]
        posterior[:, at] = alpha
    moved = np.zeros((STATES, STATES))
    beta = np.ones((STATES, len(lengths)), np.float32)
    for t in reversed(range(len(slices))):
        if t + 1 < len(slices):
            after, k = slices[t + 1], lanes.active[t + 1]
            step = emit.take(symbols[after], axis=0).T * beta[:, :k] / scales[after]
            moved += posterior[:, slices[t]][:, :k] @ step.T
            beta[:, :k] = move @ step
        posterior[:, slices[t]] *= beta[:, :lanes.active[t]]
    emitted = np.stack([np.bincount(symbols, weights=x, minlength=len(emit)) for x in posterior], 1)
    return posterior[:, slices[0]].sum(1, dtype=np.float64), moved * model.move, emitted, float(np.log10(scales).sum(dtype=np.float64))


def in_batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of about TOKENS tokens, or one row, at a time; if there are more, texts of like length come together.

    A batch takes as many steps as its longest text has tokens, so long texts share theirs.
    """
    held, size = [], 0
    for frame in frames:
        for piece in pieces(frame):
            if held and size + int(piece["n_tokens"].sum()) > HELD:
                yield from by_length(held)
                held, size = [], 0
            held.append(piece)
            size += int(piece["n_tokens"].sum())
    if held:
        yield from by_length(held)


def pieces(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    ends = np.flatnonzero(np.diff(np.cumsum(frame["n_tokens"].to_numpy()) // TOKENS)) + 1
    for start, end in zip([0, *ends], [*ends, len(frame)]):
        if end > start:
            yield frame.iloc[start:end]


def by_length(held: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    frame = pd.concat(held, ignore_index=True)
    if frame["n_tokens"].sum() <= TOKENS:
        yield frame
        return
    for piece in pieces(frame.sort_values("n_tokens", kind="stable")):
        yield piece.reset_index(drop=True)


def improved(rows: DataFrame, model: Model, others: Others, known: Vocabulary, prior: float = PRIORS[0],
             all_words: bool = True) -> tuple[Model, Others, float]:
    """One round of Baum-Welch over ``rows``, and their log10 likelihood before it.

    Expected counts of frequent words reach the driver, a table of bounded size;
    those of the others stay in Spark, summed by word.  Without ``all_words`` the
    others stay alike, and are not counted.
    """
    counted, mean, shares, before = counted_round(rows, model, others, all_words)
    if not all_words:
        return *with_prior(counted, mean, known, prior), before
    frequent = weighted(counted.emit, mean, known, prior)
    others = stored_others(shares_of(shares, mean, prior), frequent.sum(0))
    return counted._replace(emit=frequent / others.total), others, before


def counted_round(rows: DataFrame, model: Model, others: Others,
                  all_words: bool) -> tuple[Model, np.ndarray, DataFrame | None, float]:
    """Starts and moves, expected emissions of frequent words, the mean share of states, those of other words, the likelihood."""
    shared = rows.sparkSession.sparkContext.broadcast((model, others.total))
    states = [f"s{s}" for s in range(STATES)]
    fixed = 3 + STATES

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, others_total = shared.value
        n = len(model.emit)
        total = np.zeros((fixed + n, STATES))
        for frame in in_batches(frames):
            symbols, own, _ = batch_model(frame, model, others_total, not all_words)
            start, moved, emitted, likelihood = expected_counts(symbols, frame["n_tokens"].to_numpy(), own)
            total[0, 0] += likelihood
            total[1:] += np.concatenate([start[None], moved, emitted.sum(0)[None], emitted[:n]])
            if all_words:
                c = np.bincount(symbols, minlength=len(own.emit))[n:]
                words = [word for rare in frame["rare"] for word in rare]
                for at in range(0, len(words), ROWS):
                    part = slice(at, at + ROWS)
                    yield pd.DataFrame(np.rint(emitted[n:][part] / PART).astype(np.int64), columns=states).assign(
                        c=c[part], word=pd.Series(words[part], dtype=object), place=-1)
            del symbols, own, emitted
        used = np.flatnonzero(total.any(1))
        counted = pd.DataFrame(np.rint(total[used] / PART).astype(np.int64), columns=states)
        yield counted.assign(c=0, word=pd.Series([""] * len(used), dtype=object), place=used)

    numbers = with_shares(rows.select("key", "symbols", "n_tokens", "n_rare", "rare"), others)
    if not all_words:
        numbers = numbers.drop("rare")
    counted = numbers.drop("key").mapInPandas(
        tidied(run), ", ".join(f"{s} long" for s in states) + ", c long, word string, place long")
    summed = counted.groupBy("place", "word").agg(*[F.sum(x).alias(x) for x in (*states, "c")])
    if all_words:
        summed = written(summed, "expected")
    total = np.zeros((fixed + len(model.emit), STATES))
    bounded = summed.where("place >= 0").select("place", *states).toArrow()
    total[bounded["place"].to_numpy()] = np.stack([bounded[s].to_numpy() for s in states], 1) * PART
    before, start, move, used, emit = total[0, 0], total[1] + 1, total[2:fixed - 1] + 1, total[fixed - 1] + 1, total[fixed:]
    return (Model(start / start.sum(), move / move.sum(1, keepdims=True), emit), used / used.sum(),
            summed.where("place < 0") if all_words else None, float(before))


def shares_of(counted: DataFrame, mean: np.ndarray, prior: float) -> DataFrame:
    """(word, c, p0, p1) from the expected counts of other words."""
    states = [F.col(f"s{s}") * PART for s in range(STATES)]
    weight = sum(states[1:], states[0]) + prior
    return counted.select("word", "c", *packed_shares([(x + float(prior * m)) / weight / float(m) for x, m in zip(states, mean)]))


def weighted(emitted: np.ndarray, mean: np.ndarray, known: Vocabulary, prior: float) -> np.ndarray:
    """A frequent word's count, one more, times how much likelier each state is at it than elsewhere."""
    shares = (emitted + prior * mean) / (emitted.sum(1, keepdims=True) + prior)
    return known.weights()[:, None] * shares / mean


def with_prior(counted: Model, mean: np.ndarray, known: Vocabulary, prior: float) -> tuple[Model, Others]:
    """The model from expected emissions, the other words being alike."""
    frequent = weighted(counted.emit, mean, known, prior)
    others = Others(None, frequent.sum(0) + known.other_weight())
    return counted._replace(emit=frequent / others.total), others


def likelihood(rows: DataFrame, model: Model, others: Others) -> float:
    """log10 probability of all rows."""
    return forward_scores(rows, model, others).agg(F.sum("chain")).first()[0] or 0.0


def trained(table: DataFrame, known: Vocabulary, counts: DataFrame) -> tuple[Model, Others]:
    """Rounds with the other words alike, to TOLERANCE on texts held back; then one over all words and training texts."""
    held_back = F.pmod(F.xxhash64("key"), F.lit(HELD_BACK)) == 0
    rows = table.where("train")
    learned, held = rows.where(~held_back), rows.where(held_back)
    model, others = first_model(known, counts, alike=True)
    best = likelihood(held, model, others)
    while True:
        counted, mean, _, _ = counted_round(learned, model, others, all_words=False)
        new = with_prior(counted, mean, known, PRIORS[0])
        now = likelihood(held, *new)
        if now <= best:
            break
        ended = now - best < TOLERANCE * abs(best)
        (model, others), best = new, now
        if ended:
            break
    tried = {prior: likelihood(held, *with_prior(counted, mean, known, prior)) for prior in PRIORS}
    return improved(rows, model, others, known, max(tried, key=tried.get))[:2]


def forward_scores(rows: DataFrame, model: Model, others: Others) -> DataFrame:
    """Per row: key, doc_id, n_tokens, how many are known, the sum of their log10(c + 1), and ``chain``.

    ``chain`` is the log10 probability of the row's words; while the other words are
    alike, their weights are missing in it, and in the sum and the number.
    """
    alike = others.shares is None
    shared = rows.sparkSession.sparkContext.broadcast((model, others.total))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, others_total = shared.value
        n = len(model.emit)
        for frame in in_batches(frames):
            symbols, own, c = batch_model(frame, model, others_total, alike)
            lengths = frame["n_tokens"].to_numpy()
            lanes = in_lanes(lengths)
            chain = np.empty(len(frame))
            chain[lanes.order] = forward(symbols, lanes, own)
            if alike:
                c = np.zeros(1, np.int64)
            gain = np.concatenate([np.zeros(n), np.log10(c + 1)])[symbols]
            met = np.concatenate([np.zeros(n, np.int64), c > 0])[symbols]
            first = np.cumsum(lengths) - lengths
            yield frame[["key", "doc_id", "n_tokens"]].assign(
                n_known=frame["n_frequent"] + np.add.reduceat(met, first),
                base=frame["base"] + np.add.reduceat(gain, first), chain=chain)

    columns = ["key", "doc_id", "symbols", "n_tokens", "n_frequent", "base", "n_rare", "rare"]
    return with_shares(rows.select(*columns), others).drop("rare").mapInPandas(
        tidied(run), "key long, doc_id long, n_tokens long, n_known long, base double, chain double")


def score(docs: DataFrame, train: Column, rounds: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows where ``train`` holds as ``trained`` does, or in so many
    rounds over all words where ``rounds`` is given, and scores all.  NULL texts are
    empty and have one token, the end.  Without training rows no token is known,
    the base score is 0 and the chain has the untrained model's probability.
    Rows that repeat a doc_id are scored each.  An empty table gives no rows;
    columns other than doc_id and text are not read.
    """
    with small_batches(docs.sparkSession):
        return written(scores(docs, train, rounds), "scores")


def scores(docs: DataFrame, train: Column, rounds: int | None) -> DataFrame:
    rows = texts(docs).withColumn("train", F.coalesce(train, F.lit(True)))
    counts = count_words(rows.where("train").select("doc_id", "text"))
    known = vocabulary(counts)
    table = encoded(rows, known)
    if rounds is None:
        model, others = trained(table, known, counts)
    else:
        model, others = first_model(known, counts)
        for _ in range(rounds):
            model, others, _ = improved(table.where("train"), model, others, known)
    spread = float(np.log10(known.all_tokens + known.all_words + 1))
    return forward_scores(table, model, others).select(
        "doc_id", "n_tokens", "n_known", F.lit(known.all_tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * spread).alias("base_score"), F.col("chain").alias("score"))


def op8_language_model(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    train = remainder(F.col("doc_id"), FOLDS) != HELD_OUT
    scored = score(docs, train)
    return scored.withColumn("held_out", remainder(F.col("doc_id"), FOLDS) == HELD_OUT)
