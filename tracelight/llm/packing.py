"""Best-fit packing (operator 5): sum-of-squares bin packing of tokenised documents.

Two jobs. The first tokenises every whole text once, cuts it into pieces of at most ``capacity``
ids and keeps only lengths and checksums. The second packs groups of pieces; a group is a hash
class of bounded expected size, so no task holds more than its share whatever the input.

Sum-of-squares rule (Csirik, Johnson, Kenyon, Orlin, Shor and Weber, 2006): with N(g) open
sequences of residual gap g, a piece goes where the sum of N(g)^2 afterwards is smallest.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.llm.common import columns_of, kind_of, per_process, ship, short_batches, stored

ship(__name__)

#: Parts of a lower-case ASCII word as the word tokenizer's own split pattern makes them (fixed
#: value).
ASCII_PARTS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: Lower-case Latin letters that composition and lower-casing leave alone.
PLAIN_LATIN = re.compile("[a-zß-öø-ÿāăąćĉċčďđēĕėęěĝğġģĥħĩīĭįıĵķłńņňōŏőœŕřśŝşšţťūŭůűųŵŷźżž]+")
END_ID = 1
PIECES = "piece int, start long, length long, ids_crc32 long"


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a letter: visible Latin-1 characters stand for
    themselves, the other bytes for the code points from 256 on, in order (fixed value)."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(256 + k) for k, b in enumerate(hidden)}


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordIds(dict):
    """Word (UTF-8, between white space) to its ids as little-endian bytes.

    The tokenizer drops white space and no pre-token crosses it, so a text's ids are those of its
    words in order. A word of plain lower-case letters is one pre-token and goes straight to the
    merge model; an ASCII word is first cut at its pre-token borders; any other word takes the
    tokenizer's whole path. Two generations of at most ``limit`` words bound the memory.
    """

    def __init__(self, name: str, limit: int = 250_000):
        import public_tokenizers
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.limit, self.old = limit, {}

    def __missing__(self, word: bytes) -> bytes:
        if word[-1] in b".," and word[-2:-1].isalpha():  # an ASCII letter ends its pre-token
            return self[word[:-1]] + self[word[-1:]]
        ids = self.old.get(word)
        if ids is None:
            ids = self.encode(word)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids

    def encode(self, word: bytes) -> bytes:
        if word.isascii():
            if b"<|" not in word and word == word.lower():
                parts = ASCII_PARTS.findall(word)
                if len(parts) > 1:
                    return b"".join([self[p] for p in parts])
                if word.isalpha():
                    return self.merged(word.decode())
        elif PLAIN_LATIN.fullmatch(text := word.decode().lower()):
            return self.merged(text.encode().decode("latin-1").translate(self.letters))
        elif text[-1] in ".," and PLAIN_LATIN.fullmatch(text[:-1]):
            return self[text[:-1].encode()] + self[word[-1:]]
        return packed(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids)

    def merged(self, letters: str) -> bytes:
        return packed([t.id for t in self.model.tokenize(letters)])


def document_ids(words: WordIds, text: str | None, end_id: int = END_ID) -> bytes:
    raw = (text or "").encode()
    if b"<|" not in raw:  # special tokens are written in lower case only
        raw = raw.lower()
    return b"".join(map(words.__getitem__, raw.split())) + end_id.to_bytes(4, "little")


def tokenized_pieces(
    docs: DataFrame,
    capacity: int = 4096,
    tokenizer: str = "word_bpe_49k.json",
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every whole text; null text counts as empty."""
    source = docs.select(F.col(id_column), F.col(text_column).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = per_process(f"ids:{tokenizer}", lambda: WordIds(tokenizer))
        for batch in short_batches(batches, "text"):
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(*columns_of(batch, id_column, "text"), strict=True):
                ids = document_ids(words, text)
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row = (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            kinds = (kind_of(batch, id_column), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            names = [id_column, "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    id_type = source.schema[id_column].dataType.simpleString()
    return source.mapInArrow(cut, f"`{id_column}` {id_type}, {PIECES}")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length, placed in the given order; ties take the smaller gap."""
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    n = np.zeros(capacity + 1, np.int64)  # n[g]: open sequences whose residual gap is g
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    made = 0
    for i, s in enumerate(lengths.tolist()):
        gaps = s + np.flatnonzero(n[s:capacity])
        best, gap = (2 * n[capacity - s] + 1 if s < capacity else 0), capacity
        if len(gaps):
            change = 1 - 2 * n[gaps]
            change += np.where(gaps > s, 2 * n[gaps - s] + 1, 0)
            at = int(change.argmin())
            if change[at] <= best:
                gap = int(gaps[at])
        if gap == capacity:
            chosen, made = made, made + 1
        else:
            chosen = open_at[gap].pop()
            n[gap] -= 1
        sequence[i], offset[i] = chosen, capacity - gap
        if gap > s:
            open_at[gap - s].append(chosen)
            n[gap - s] += 1
    return sequence, offset


def pack(
    pieces: DataFrame,
    capacity: int = 4096,
    id_column: str = "doc_id",
    group_rows: int = 20_000,
) -> DataFrame:
    """``pieces`` with (sequence_id, offset): every piece whole, no sequence over ``capacity``.

    ``pieces`` must be a stored table (it is counted first). Pieces are dealt to
    ``ceil(rows / group_rows)`` groups by hash of (id, piece) and each group is packed by itself,
    longest pieces first; a group leaves at most a few open sequences part-filled. Rows that
    repeat, null ids and other columns are kept; columns that are named sequence_id or offset are
    replaced. An empty table gives an empty result.
    """
    pieces = pieces.drop("sequence_id", "offset")
    own = "_group"
    while own in pieces.columns:
        own += "_"
    groups = max(1, math.ceil(pieces.count() / group_rows))
    dealt = pieces.withColumn(own, F.pmod(F.xxhash64(id_column, "piece"), F.lit(groups)))

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", id_column, "piece"], ascending=[False, True, True])
        sequence, offset = sum_of_squares(rows["length"].to_numpy(), capacity)
        rows["sequence_id"] = (rows[own].to_numpy() << 32) + sequence
        rows["offset"] = offset
        return rows.drop(columns=own)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.groupBy(own).applyInPandas(
        place, f"{fields}, sequence_id long, offset long"
    )


def pack_documents(
    docs: DataFrame,
    capacity: int = 4096,
    tokenizer: str = "word_bpe_49k.json",
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Token pieces of all documents with their sequence and place in it."""
    pieces = stored(tokenized_pieces(docs, capacity, tokenizer, id_column, text_column))
    return pack(pieces, capacity, id_column)
