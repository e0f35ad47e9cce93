"""Adaptive context-mixing range coder for token ids, many blocks side by side.

A block starts from nothing: tables, weights and coder are reset.  For each id
the two ids before it (order 2) and the one before it (order 1) each predict
one id, from hashed tables with a confidence; order 0 predicts the block's ids
so far by their counts; an id that none of them knows is written plainly.  How
the coder's range is shared among the four is learned, per pair of confidences,
from how often each of them was right.

Predictions learn after every STEP ids, counts of order 0 less often as they
grow.  In between they are fixed, so the encoder works on whole steps at once
and the decoder on the next id of all blocks (lanes) at once, both by arrays.
"""

from __future__ import annotations

import struct
from zlib import crc32

import numpy as np

BLOCK = 2_048
LANES = 1_024
STEP = 128
# Blocks whose ids are sorted at once when order 0 is counted.
COUNTED_LANES = 64
# Order 0 counts anew when the block has grown by this part.
GROWN = 4
ID_BITS = 16
MAX_IDS = 1 << ID_BITS
TABLE_BITS = 10
# Confidences of a table entry are 0 to 3, and 4 if it holds no id.
CONFIDENCES = 5
NOTHING = -1 << 3 | 4
RISE = np.array([1, 1, 1, 0, 0], np.int32)
YIELDS = np.array([True, False, False, False, True])
ORDER2, ORDER1, ORDER0, PLAIN = range(4)
# Weights before anything is learned, by confidence of orders 2 and 1, and of order 0 and plain ids.
TRUST = np.array([1, 4, 12, 40, 0.1])
UNSURE = (4, 2)
# Cells of weights: whether orders 2 and 1 agree, and how sure each is.
CELLS = 2 * CONFIDENCES**2
SHARES = 65_535
LEAST_RANGE = np.uint64(1 << 32)
SHARE_BITS, WORD_BITS = np.uint64(16), np.uint64(32)
LOW16 = np.uint64(0xFFFF)
HEADER = struct.Struct("<4sIII")  # magic, ids, payload bytes, crc32 of the payload
MAGIC = b"SGT2"


def first_weights() -> np.ndarray:
    weights = np.empty((2, CONFIDENCES, CONFIDENCES, 4))
    weights[..., ORDER2] = TRUST[:, None]
    weights[..., ORDER1] = TRUST / 2
    weights[1, ..., ORDER1] = 0
    weights[..., ORDER0], weights[..., PLAIN] = UNSURE
    return weights.reshape(CELLS, 4)


class Predictions:
    """Orders 2 and 1 of ``n`` blocks and how far each order is trusted."""

    def __init__(self, n: int):
        # Entries are an id and, in the lowest three bits, how sure it is.
        self.tables = [np.full(n << TABLE_BITS, NOTHING, np.int32) for _ in range(2)]
        self.weights = np.tile(first_weights(), (n, 1))
        self.table_base = np.arange(n, dtype=np.int64) << TABLE_BITS
        self.cell_base = np.arange(n, dtype=np.int64) * CELLS
        self.set_limits()

    def set_limits(self) -> None:
        """Where the shares of the orders end, 16 bits for each, by cell; every share is at least 1."""
        sums = np.cumsum(self.weights, axis=1)
        ends = (sums * ((SHARES - 4) / sums[:, 3:])).astype(np.uint64)
        self.limits = (ends[:, 0] + np.uint64(1) | (ends[:, 1] + np.uint64(2)) << np.uint64(16)
                       | (ends[:, 2] + np.uint64(3)) << np.uint64(32) | np.uint64(SHARES << 48))

    def places(self, older: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the entries of orders 2 and 1 lie; the last axis is the block."""
        n = last.shape[-1]
        mask = (1 << TABLE_BITS) - 1
        mixed = last * np.int64(0x9E3779B1)
        return (((older * np.int64(0x2F0B4C47) + mixed >> 15) & mask) + self.table_base[:n],
                ((mixed >> 13) & mask) + self.table_base[:n])

    def cells(self, held2: np.ndarray, held1: np.ndarray) -> np.ndarray:
        same = (held2 >> 3 == held1 >> 3) * CONFIDENCES**2
        return (held2 & 7) * CONFIDENCES + (held1 & 7) + same + self.cell_base[:held2.shape[-1]]

    def learn(self, ids: np.ndarray, order: np.ndarray, places: tuple, helds: tuple, cells: np.ndarray) -> None:
        """From all ids of a step, in order of time; of two ids in one place the later stays."""
        for table, at, held in zip(self.tables, places, helds):
            sure = held & 7
            table[at] = np.where(held >> 3 == ids, held + RISE.take(sure),
                                 np.where(YIELDS.take(sure), ids << 3, held - 1))
        seen = np.bincount((cells * 4 + order).reshape(-1), minlength=self.weights.size)
        self.weights += seen.reshape(-1, 4)
        self.set_limits()


def schedule(steps: int) -> list[tuple[int, int, bool]]:
    """Start and end of each step, and whether order 0 counts anew before it."""
    out, counted = [], 0
    for start in range(0, steps, STEP):
        anew = start - counted >= max(STEP, counted // GROWN)
        counted = start if anew else counted
        out.append((start, min(start + STEP, steps), anew))
    return out


def block_codes(ids: np.ndarray) -> tuple[np.ndarray, int]:
    """Each row's ids as numbers that rise with the id, from 0 without gaps; the most numbers of a row."""
    n, steps = ids.shape
    place_bits = max(1, (steps - 1).bit_length())
    places = np.arange(steps, dtype=np.uint32)
    codes = np.empty((n, steps), np.int32)
    width = 0
    for row, out in zip(ids, codes):
        keyed = np.sort(row.astype(np.uint32) << place_bits | places)
        sorted_ids = keyed >> place_bits
        number = np.cumsum(sorted_ids[1:] != sorted_ids[:-1], dtype=np.int32)
        out[keyed & ((1 << place_bits) - 1)] = np.concatenate([[0], number])
        width = max(width, int(number[-1]) + 1 if steps > 1 else 1)
    return codes, width


def encode_lanes(ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """Code the rows of ``ids`` (lane, step), whose lengths must not rise."""
    n, steps = ids.shape
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")
    model = Predictions(n)
    codes, width = block_codes(ids)
    codes += (np.arange(n, dtype=np.int32) * width)[:, None]
    codes = np.ascontiguousarray(codes.T)  # (step, lane), into the counts
    columns = np.zeros((steps + 2, n), np.int32)
    columns[2:] = ids.T
    counts, before = np.zeros(n * width, np.int32), np.zeros(n * width, np.int32)
    counted = 0
    low, size = np.zeros(n, np.uint64), np.full(n, ~np.uint64(0))
    words, filled = np.zeros((n, steps + 2), np.uint32), np.zeros(n, np.int64)
    for start, end, anew in schedule(steps):
        if anew:
            counts += np.bincount(codes[counted:start].reshape(-1), minlength=len(counts)).astype(np.int32)
            table = counts.reshape(n, width)
            before = (np.cumsum(table, axis=1, dtype=np.int32) - table).reshape(-1)
            counted = start
        k = int(active[start])
        now = columns[start + 2:end + 2, :k]
        places = model.places(columns[start:end, :k], columns[start + 1:end + 1, :k])
        helds = tuple(table.take(at) for table, at in zip(model.tables, places))
        cells = model.cells(*helds)
        here = codes[start:end, :k]
        count = counts.take(here)
        order = np.where(helds[0] >> 3 == now, ORDER2, np.where(
            helds[1] >> 3 == now, ORDER1, np.where(count > 0, ORDER0, PLAIN)))
        limits, shift = model.limits.take(cells), (order << 4).astype(np.uint64)
        begin = limits << SHARE_BITS >> shift & LOW16
        share = (limits >> shift & LOW16) - begin
        parts = np.array([1, 1, max(counted, 1), MAX_IDS], np.uint64).take(order)
        is0, plain = order == ORDER0, order == PLAIN
        inside = np.where(is0, before.take(here), now * plain).astype(np.uint64)
        wide = np.where(is0, count, 1).astype(np.uint64)
        for t in range(end - start):
            m = int(active[start + t])
            unit = size[:m] >> SHARE_BITS
            moved = low[:m] + unit * begin[t, :m]
            unit *= share[t, :m]
            unit //= parts[t, :m]
            moved += unit * inside[t, :m]
            unit *= wide[t, :m]
            over = np.flatnonzero(moved < low[:m])
            at = filled[over] - 1
            while len(over):  # carry into the words already written
                raised = words[over, at] + np.uint32(1)
                words[over, at] = raised
                over, at = over[raised == 0], at[raised == 0] - 1
            out = np.flatnonzero(unit < LEAST_RANGE)
            if len(out):
                leading = moved[out]
                words[out, filled[out]] = leading >> WORD_BITS
                filled[out] += 1
                moved[out] = leading << WORD_BITS
                unit[out] <<= WORD_BITS
            low[:m], size[:m] = moved, unit
        if end < steps:
            k = int(active[end])
            model.learn(now[:, :k], order[:, :k], [at[:, :k] for at in places],
                        [held[:, :k] for held in helds], cells[:, :k])
    blocks = []
    for lane in range(n):
        tail = np.array([low[lane] >> WORD_BITS, low[lane]]).astype(np.uint32)
        payload = np.concatenate([words[lane, :filled[lane]], tail]).astype("<u4").tobytes()
        blocks.append(HEADER.pack(MAGIC, int(lengths[lane]), len(payload), crc32(payload)) + payload)
    return blocks


def count_entries(seen: np.ndarray) -> np.ndarray:
    """For every place among each row's sorted ids: the id, its first place and its count, 16 bits each."""
    n, width = seen.shape
    out = np.empty((n, width), np.uint64)
    for at in range(0, n, COUNTED_LANES):
        flat = np.sort(seen[at:at + COUNTED_LANES], axis=1, kind="stable").reshape(-1)
        new = np.empty(len(flat), bool)
        new[1:] = flat[1:] != flat[:-1]
        new[::width] = True
        first = np.flatnonzero(new)
        count = np.diff(first, append=len(flat))
        runs = flat[first].astype(np.uint64) | (first % width).astype(np.uint64) << np.uint64(16) | (
            count.astype(np.uint64) << np.uint64(32))
        out[at:at + COUNTED_LANES] = np.repeat(runs, count).reshape(-1, width)
    return out.reshape(-1)


def decode_lanes(payloads: list[bytes], lengths: np.ndarray) -> np.ndarray:
    """The ids (lane, step) of payloads whose lengths don't rise."""
    n, steps = len(lengths), int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")
    model = Predictions(n)
    widest = max(map(len, payloads)) // 4
    words = np.zeros((n, widest + 1), np.uint32)
    for lane, payload in enumerate(payloads):
        words[lane, :len(payload) // 4] = np.frombuffer(payload, "<u4")
    words, word_base = words.reshape(-1), np.arange(n) * (widest + 1)
    code = words[word_base].astype(np.uint64) << WORD_BITS | words[word_base + 1]
    taken, size = word_base + 2, np.full(n, ~np.uint64(0))
    columns = np.zeros((steps + 2, n), np.int32)
    seen = np.zeros((n, steps), np.uint16)
    entries, entry_base, counted = np.zeros(n, np.uint64), np.arange(n), 0
    shape = (STEP, n)
    place2, place1, cells, orders = (np.zeros(shape, np.int64) for _ in range(4))
    held2, held1 = np.zeros(shape, np.int32), np.zeros(shape, np.int32)
    for start, end, anew in schedule(steps):
        if anew:
            counted = start
            entries, entry_base = count_entries(seen[:, :counted]), np.arange(n) * counted
        parts = np.array([1, 1, max(counted, 1), MAX_IDS], np.uint64)
        table2, table1 = model.tables
        for t in range(end - start):
            m = int(active[start + t])
            place2[t, :m], place1[t, :m] = model.places(columns[start + t, :m], columns[start + t + 1, :m])
            sure2, sure1 = table2.take(place2[t, :m]), table1.take(place1[t, :m])
            held2[t, :m], held1[t, :m] = sure2, sure1
            cell = cells[t, :m] = model.cells(sure2, sure1)
            limits = model.limits.take(cell)
            unit = size[:m] >> SHARE_BITS
            rest = code[:m]
            point = rest // unit
            order = (point >= (limits & LOW16)).astype(np.uint64)
            order += point >= (limits >> np.uint64(16) & LOW16)
            order += point >= (limits >> np.uint64(32) & LOW16)
            shift = order << np.uint64(4)
            begin = limits << SHARE_BITS >> shift & LOW16
            share = (limits >> shift & LOW16) - begin
            order = orders[t, :m] = order.astype(np.int64)
            rest = rest - unit * begin
            unit *= share
            unit //= parts.take(order)
            place = rest // unit
            is0 = order == ORDER0
            entry = entries.take(np.where(is0, place.astype(np.int64), 0) + entry_base[:m])
            inside = np.where(is0, entry >> np.uint64(16) & LOW16, place)
            rest -= unit * inside
            unit *= np.where(is0, entry >> np.uint64(32), np.uint64(1))
            now = np.where(is0, entry & LOW16, place).astype(np.int32)
            now = np.where(order == ORDER2, sure2 >> 3, np.where(order == ORDER1, sure1 >> 3, now))
            out = np.flatnonzero(unit < LEAST_RANGE)
            if len(out):
                at = taken[out]
                rest[out] = rest[out] << WORD_BITS | words[at]
                taken[out] = at + 1
                unit[out] <<= WORD_BITS
            code[:m], size[:m] = rest, unit
            columns[start + t + 2, :m] = now
        seen[:, start:end] = columns[start + 2:end + 2].T
        if end < steps:
            k, s = int(active[end]), end - start
            model.learn(columns[start + 2:end + 2, :k], orders[:s, :k], (place2[:s, :k], place1[:s, :k]),
                        (held2[:s, :k], held1[:s, :k]), cells[:s, :k])
    return columns[2:].T


def together(blocks: int) -> list[tuple[int, int]]:
    """Even runs of about LANES blocks, which are coded side by side."""
    runs = max(1, round(blocks / LANES))
    ends = [blocks * i // runs for i in range(runs + 1)]
    return list(zip(ends[:-1], ends[1:]))


def encode(ids: np.ndarray) -> list[bytes]:
    """Blocks of BLOCK ids (the last one of the rest), each with its header; ids must be below MAX_IDS."""
    if not len(ids):
        return []
    if int(ids.max()) >= MAX_IDS:
        raise ValueError(f"token ids must be below {MAX_IDS}")
    blocks = []
    for first, last in together(-(-len(ids) // BLOCK)):
        part = ids[first * BLOCK:last * BLOCK]
        lengths = np.array([min(BLOCK, len(part) - k) for k in range(0, len(part), BLOCK)])
        padded = np.zeros(len(lengths) * BLOCK, np.int32)
        padded[:len(part)] = part
        blocks += encode_lanes(padded.reshape(-1, BLOCK)[:, :lengths[0]], lengths)
    return blocks


def decode(blocks: list[bytes]) -> np.ndarray:
    """The ids of blocks from ``encode``; a damaged block raises ValueError."""
    parts = []
    for first, last in together(len(blocks)) if blocks else []:
        payloads, lengths = [], []
        for block in blocks[first:last]:
            magic, n, size, check = HEADER.unpack_from(block)
            payload = block[HEADER.size:]
            if magic != MAGIC or len(payload) != size or crc32(payload) != check:
                raise ValueError("damaged block of token ids")
            payloads.append(payload)
            lengths.append(n)
        ids = decode_lanes(payloads, np.array(lengths))
        parts += [row[:n] for row, n in zip(ids, lengths)]
    return np.concatenate([*parts, np.zeros(0, np.int64)])
