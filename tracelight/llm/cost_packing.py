"""Cost-balanced packing (operator 12): sequences of equal length and about equal attention cost.

A document of n tokens costs ``linear * n + n * n``: the layers that see one token at a time, and
attention, which sees pairs. Documents go, the most costly first, to the sequence of the lowest
cost so far that still has room for the whole of them. Only where none has room is a document cut:
its beginning fills up the sequence of the lowest cost, the rest takes its turn by its own cost.

Padding: a group of documents with T tokens opens ``T // capacity`` whole sequences and, for the
rest of the division, one for each power of two in it. A sequence whose length is a power of two
needs no padding, and as the rooms add up to T exactly, no sequence is padded at all.

One job turns every whole text into ids once: a batch is split into words by Arrow kernels, each
distinct word is looked up once, and ``take`` puts the ids in order. Their 16 bits (32 for larger vocabularies) travel to
the packing groups, because where a document is cut is known there only. A group is a hash class
of about ``group_tokens`` tokens, so that no task holds more than its share.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.llm.common import per_process, ship, short_batches, stored
from tracelight.llm.packing import WordIds

ship(__name__)

END_ID = 2
#: Cost of a token beside attention, in pairs: 6 * width for layers of width 2,048.
LINEAR = 12_288
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def text_ids(words: WordIds, texts: pa.Array) -> list[np.ndarray]:
    """The tokenizer's ids of each of ``texts``; null is empty."""
    texts = pc.fill_null(texts, "")
    # special tokens are written in lower case only
    raw = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
    lists = pc.ascii_split_whitespace(raw)
    coded = pc.dictionary_encode(pc.list_flatten(lists))
    distinct = coded.dictionary.cast(pa.binary()).to_pylist()
    ids = pa.array([words[w] if w else b"" for w in distinct], pa.large_binary())
    taken = ids.take(coded.indices)
    ends = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1] // 4
    numbers = np.frombuffer(taken.buffers()[2] or b"", "<u4")
    counts = pc.list_value_length(lists).to_numpy()
    edges = ends[np.concatenate([[0], np.cumsum(counts)])].tolist()
    return [numbers[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """``docs`` (id, text) as (id, row, n, ids): ``row`` counts within the task, ``ids`` are
    little-endian numbers of 16 bits, or of 32 if one is larger."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = per_process(f"ids:{tokenizer}", lambda: WordIds(tokenizer))
        row = 0
        for batch in short_batches(batches, "text", 16_000_000):  # more text, fewer words twice
            ids, sizes = [], []
            for numbers in text_ids(words, batch.column(1)):
                numbers = np.append(numbers, np.uint32(end_id))
                sizes.append(len(numbers))
                ids.append(numbers.astype("<u2" if numbers.max() < 1 << 16 else "<u4").tobytes())
            columns = [
                batch.column(0),
                pa.array(range(row, row + len(sizes)), pa.int64()),
                pa.array(sizes, pa.int64()),
                pa.array(ids, pa.binary()),
            ]
            row += len(sizes)
            yield pa.RecordBatch.from_arrays(columns, names=["id", "row", "n", "ids"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(encode, f"id {kind}, row long, n long, ids binary")


def rooms_for(total: int, capacity: int) -> list[int]:
    """Lengths of the sequences that ``total`` tokens fill without padding, longest first."""
    rest = total % capacity
    powers = [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]
    return [capacity] * (total // capacity) + powers


def balanced(
    lengths: list[int], capacity: int, linear: int = LINEAR
) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents in descending length.

    Sequences whose room is too small for the document at hand are parked by their room and come
    back when the documents have become short enough: lengths only fall, so a sequence is looked
    at about as often as it receives something.
    """
    room = rooms_for(sum(lengths), capacity)
    size, cost = list(room), [0] * len(room)
    parked = [True] * len(room)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    for s, r in enumerate(room):
        by_room[r].append(s)
    spare = [(0, s) for s in range(len(room))]  # parked sequences by cost; some entries outdated
    open_: list[tuple[int, int]] = []
    rests: list[tuple[int, int, int]] = []  # (-length, document, start) of what cuts have left
    out, level, k = [], capacity + 1, 0

    def put(doc: int, start: int, n: int, s: int) -> None:
        out.append((doc, start, n, s, size[s] - room[s]))
        room[s] -= n
        cost[s] += linear * n + n * n

    def park(s: int) -> None:
        parked[s] = True
        by_room[room[s]].append(s)
        heapq.heappush(spare, (cost[s], s))

    while k < len(lengths) or rests:
        if rests and (k == len(lengths) or -rests[0][0] > lengths[k]):
            n, doc, start = heapq.heappop(rests)
            n = -n
        else:
            n, doc, start = lengths[k], k, 0
            k += 1
        while level > max(n, 0):
            level -= 1
            for s in by_room[level]:
                if parked[s] and room[s] == level:
                    parked[s] = False
                    heapq.heappush(open_, (cost[s], s))
            by_room[level] = []
        while open_ and room[open_[0][1]] < n:
            park(heapq.heappop(open_)[1])
        if open_:
            s = open_[0][1]
            put(doc, start, n, s)
            heapq.heapreplace(open_, (cost[s], s))
            continue
        while True:
            paid, s = heapq.heappop(spare)
            if parked[s] and room[s] and cost[s] == paid:
                break
        part = room[s]
        put(doc, start, part, s)
        heapq.heappush(rests, (part - n, doc, start + part))
    return out


def pack_by_cost(
    docs: DataFrame,
    capacity: int = 4096,
    tokenizer: str = "word_bpe_49k.json",
    id_column: str = "doc_id",
    text_column: str = "text",
    end_id: int = END_ID,
    linear: int = LINEAR,
    group_tokens: int = 1 << 22,
) -> DataFrame:
    """Pieces (id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all documents.

    Every id of a document (its text's tokens and ``end_id``) lies in exactly one piece; the
    pieces of a sequence follow each other without gaps and are at most ``capacity`` ids. Null
    text counts as empty, so that its document is ``end_id`` alone. Rows that repeat and rows
    without id are documents of their own. Columns beside id and text are not looked at. An empty
    table gives an empty result.
    """
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    rows = stored(tokenized(source, tokenizer, end_id))
    total = rows.agg(F.sum("n").alias("n")).first()["n"] or 0
    groups = max(1, math.ceil(total / group_tokens))
    # the row number keeps rows that repeat from falling into one group
    dealt = rows.withColumn("deal", F.pmod(F.xxhash64("id", "row", "n"), F.lit(groups)))
    kind = source.schema["id"].dataType.simpleString()

    def place(group: pa.Table) -> pa.Table:
        order = np.lexsort([group["row"].to_numpy(), -group["n"].to_numpy()])
        group = group.take(pa.array(order)).combine_chunks()
        lengths, ids = group["n"].to_pylist(), group["ids"].to_pylist()
        pieces = balanced(lengths, capacity, linear)
        doc, start, length, sequence, offset = map(np.array, zip(*pieces, strict=True))
        crc = np.zeros(len(doc), np.int64)
        for i, (d, at, n) in enumerate(zip(doc.tolist(), start.tolist(), length.tolist())):
            wide = len(ids[d]) // lengths[d]
            part = np.frombuffer(ids[d], f"<u{wide}")[at : at + n]
            crc[i] = zlib.crc32(part.astype("<u4").tobytes())
        first = int(group["deal"][0].as_py()) << 32
        columns = [start, length, crc, np.array(lengths)[doc], first + sequence, offset]
        own = group["id"].take(pa.array(doc)).combine_chunks()
        names = ["id", *[c.split()[0] for c in PIECES.split(", ")]]
        return pa.Table.from_arrays([own, *(pa.array(c, pa.int64()) for c in columns)], names)

    packed = dealt.groupBy("deal").applyInArrow(place, f"id {kind}, {PIECES}")
    return packed.withColumnRenamed("id", id_column)


def sequence_costs(pieces: DataFrame, linear: int = LINEAR) -> DataFrame:
    """(sequence_id, tokens, cost) of packed ``pieces``: how even the sequences have become."""
    n = F.col("length")
    return pieces.groupBy("sequence_id").agg(
        F.sum(n).alias("tokens"), F.sum(n * linear + n * n).alias("cost")
    )
