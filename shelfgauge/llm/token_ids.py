"""Token ids in files: texts tokenized, coded by the range coder, and read back.

A file row holds a group of documents in ascending doc_id order: their ids and
lengths, and the blocks that hold their token ids end to end.  Rows are
numbered by part and group, which sort like the doc_ids, so a document's start
in the whole stream is the sum of the groups before its own.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable, Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfgauge.llm import range_coder
from shelfgauge.llm.common import in_chunks, read_table, small_batches, texts, tidied, written

END_ID = 2
# Token ids of a group: as many blocks as are coded side by side.
GROUP_IDS = range_coder.BLOCK * range_coder.LANES
# Pieces whose ids a Python worker remembers: those met since as many were, and those met before them.
REMEMBERED = 75_000
# Text bytes whose pieces are in memory at once.
CUT_BYTES = 500_000
FILE_SCHEMA = "part long, group long, n_ids long, doc_ids binary, lengths binary, blocks array<binary>"

# A single space between two of these characters, none of which is white space,
# always begins a token: byte-level BPE splits a text there before merging.
PLAIN = "!-~¡-ᙿᚁ-῿Ⰰ-⿿、-퟿"
CUT = re.compile(f"(?<=[{PLAIN}]) (?=[{PLAIN}])")
# Bytes of all white space but spaces and line feeds, and of some other characters.
UNUSUAL = bytes([*range(10), *range(11, 32), 127, 0xC2, 0xE1, 0xE2, 0xE3, *range(0xED, 256)])
UNUSUAL_RUNS = ("  ", " \n", "\n ", "\n\n\n")
# A single one of these after a letter or digit is always a token's last or only character.
SINGLE = ".,;:"
# Letters up to here are letters in every version of Unicode.
OLD_LETTERS = "\u024f"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use all cores
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_letters() -> list[str]:
    """The characters that byte-level vocabularies write for the bytes: visible ones for themselves, others from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(byte if byte in visible else next(hidden)) for byte in range(256)]


def pieces_of(text: str, special: list[str]) -> list[str]:
    """A text cut where tokens always begin.

    Pieces but the first begin with a space, which is left out, or a line feed.
    Where white space is only single spaces and one or two line feeds, between
    other characters, and no special token ends a run of it, a plain split does:
    each begins a token.
    """
    data = text.encode("utf-8", "replace")
    if (len(data.translate(None, UNUSUAL)) < len(data) or text[:1] in (" ", "\n") or text[-1:] in (" ", "\n")
            or any(run in text for run in UNUSUAL_RUNS) or any(token in text for token in special)):
        return CUT.split(text)
    return text.replace("\n", " \n").split(" ")


class Known(dict):
    """Ids of pieces that were met; those of others are made when asked for."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make = make

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = self.make(piece)
        return ids


class Encoder:
    """Ids of whole texts, from the tokenizer's ids of their pieces, which repeat.

    The tokenizer must be byte-level BPE without normalizer and added prefix
    space, for which a text's ids are those of its pieces in a row.
    """

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.known, self.older = Known(self.new_ids), {}
        self.letters = dict(enumerate(byte_letters()))
        self.single = dict(zip(SINGLE, self.ids(list(SINGLE))))
        # Such words hold no special token.
        self.one_word = self.keeps_words() and not any(token.replace(" ", "").isalpha() for token in self.special)

    def ids(self, some: list[str]) -> list[bytes]:
        return [np.array(c.ids, "<u4").tobytes()
                for c in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]

    def as_bytes(self, word: str) -> str:
        """A space and the word's letters, as the vocabulary writes their bytes."""
        if word.isascii():
            return self.letters[32] + word
        return (" " + word).encode().decode("latin-1").translate(self.letters)

    def keeps_words(self) -> bool:
        """Whether the tokenizer hands its model a space and the letters after it as one word, byte by byte."""
        words, splits = ["az", "AZ", "\xe9\u024f"], self.tokenizer.pre_tokenizer
        return self.tokenizer.normalizer is None and splits is not None and (
            [word for word, _ in splits.pre_tokenize_str("".join(" " + word for word in words))] == list(map(self.as_bytes, words)))

    def new_ids(self, piece: str) -> bytes:
        """Of a piece that begins with a space, left out, or a line feed."""
        ids = self.older.get(piece)
        if ids is not None:
            return ids
        if self.one_word and piece.isalpha() and max(piece) <= OLD_LETTERS:
            ids = [token.id for token in self.tokenizer.model.tokenize(self.as_bytes(piece))]
            return struct.pack(f"<{len(ids)}I", *ids)
        # "word," is "word" and ",": only the word is looked for.
        if piece[-1:] in self.single and piece[-2:-1].isalnum():
            return self.known[piece[:-1]] + self.single[piece[-1]]
        return self.ids([piece if piece[:1] == "\n" else " " + piece])[0]

    def encode(self, batch: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, Known(self.new_ids)
        cut = [pieces_of(text, self.special) for text in batch]
        firsts = self.ids([pieces[0] for pieces in cut])
        known = self.known.__getitem__
        return [first + b"".join(map(known, pieces[1:])) for first, pieces in zip(firsts, cut)]


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def file_row(group: int, doc_ids: list, ids: list[bytes]) -> dict:
    """The row of a group; ``ids`` are taken out of their list, for their memory."""
    lengths = np.array([len(part) // 4 for part in ids], np.int64)
    stream = np.frombuffer(b"".join(ids), "<u4")
    ids.clear()
    nulls = np.iinfo(np.int64).min
    return {
        "part": TaskContext.get().partitionId(), "group": group, "n_ids": len(stream),
        "doc_ids": np.array([nulls if pd.isna(x) else int(x) for x in doc_ids], np.int64).tobytes(),
        "lengths": lengths.tobytes(), "blocks": range_coder.encode(stream),
    }


def write_ids(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Tokenize, code and store ``docs``; returns the table of file rows.

    ``path`` names the tokenizer file, which every executor must have.
    """
    path = path or default_tokenizer()
    end = np.array([end_id], "<u4").tobytes()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_ids, held, size, group = [], [], 0, 0
        for frame in in_chunks(frames, size=CUT_BYTES):
            for doc_id, ids in zip(frame["doc_id"], encoder(path).encode(list(frame["text"]))):
                held_ids.append(doc_id)
                held.append(ids + end)
                size += len(ids) // 4 + 1
                if size >= GROUP_IDS:
                    yield pd.DataFrame([file_row(group, held_ids, held)])
                    held_ids, held, size, group = [], [], 0, group + 1
        if held:
            yield pd.DataFrame([file_row(group, held_ids, held)])

    # NULL ids come first; rows that repeat a doc_id are ordered by their texts.
    ordered = texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    with small_batches(docs.sparkSession):
        return written(ordered.mapInPandas(tidied(run), FILE_SCHEMA), "token-files")


def read_ids(files: DataFrame) -> DataFrame:
    """One row per document from the file rows: doc_id, start, n_tokens, ids_crc32."""
    nulls = np.iinfo(np.int64).min

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                stream = range_coder.decode([bytes(block) for block in row.blocks]).astype("<u4")
                if len(stream) != row.n_ids:
                    raise ValueError("a group of token ids is not complete")
                lengths = np.frombuffer(row.lengths, np.int64)
                ends = np.cumsum(lengths)
                doc_ids = np.frombuffer(row.doc_ids, np.int64)
                yield pd.DataFrame({
                    "part": row.part, "group": row.group,
                    "doc_id": pd.Series([None if x == nulls else x for x in doc_ids.tolist()], dtype="Int64"),
                    "inside": ends - lengths, "n_tokens": lengths,
                    "ids_crc32": [crc32(stream[a:b].tobytes()) for a, b in zip(ends - lengths, ends)]})

    decoded = files.mapInPandas(
        tidied(run), "part long, group long, doc_id long, inside long, n_tokens long, ids_crc32 long")
    # One row per part, of which there are no more than shuffle partitions; then one per group of a part.
    earlier = (Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select(
        "part", F.sum("n_ids").over(Window.orderBy("part").rowsBetween(*earlier)).alias("parts_before"))
    inside_part = Window.partitionBy("part").orderBy("group").rowsBetween(*earlier)
    groups = files.select("part", "group", F.sum("n_ids").over(inside_part).alias("groups_before"))
    offsets = groups.join(parts, "part").select(
        "part", "group",
        (F.coalesce("parts_before", F.lit(0)) + F.coalesce("groups_before", F.lit(0))).alias("before"))
    return decoded.join(offsets, ["part", "group"]).select(
        "doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_ids(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32.

    Each text is followed by the end id, which counts as a token; ``start`` is
    the number of ids of all documents before it, in ascending doc_id order,
    NULL ids first.  NULL texts are empty and have the end id only.  Rows that
    repeat a doc_id are documents of their own, in the order of their texts'
    hashes.  An empty table gives no rows; columns other than doc_id and text
    are not read.
    """
    return read_ids(write_ids(docs, path))


def op2_token_ids(spark, sf_dir: str) -> DataFrame:
    return token_ids(read_table(spark, sf_dir, "documents"))
