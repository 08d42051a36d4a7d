"""Near-duplicates (operator 9): an LSH forest over MinHash signatures, confirmed on full sets.

A tree of the forest is one sorted order of all distinct shingle sets, by ``DEPTH`` minima of its
own. The candidates of a set are its nearest neighbours in every order: those with the longest
common prefix. How deep the shared prefix is adapts by itself: neighbours in a dense region share
many minima, in a sparse one few. The orders are range-partitioned and streamed, so neither a
popular prefix nor a large group of copies gathers in a task, and a set has at most
2 * ``REACH`` such candidates a tree, however large its group is.

Sets that are equal are one node. Candidates are confirmed in three rounds: first the nearest
candidate of each set and its neighbour in the first tree, then every candidate pair whose ends
are still in different components, then what neighbours may have missed in dense regions. A region
is dense if more sets share their first ``SHARED`` minima in a tree than neighbours reach, and not
all of them are in one component yet. Its sets are searched exactly: shingles are ordered by how
many of these sets hold them, and two sets that are similar enough must share one of their rarest
few (with 80 %, one of the first fifth). A line or passage that very many texts share stands last
in that order, so texts that share it and little else never meet; variants of one text meet under
keys whose sets are in one component, and those are left out. No candidate that could change a
component is.

Two sets of similarity s share their first d minima in a tree with chance s^d; with 16 trees and
s = 0.8 a pair shares no four of them in any tree with chance 2e-4, however dense its region is.
The exact search has no such chance for any pair of sets of dense regions.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.llm.common import (
    columns_of,
    per_process,
    release,
    ship,
    short_batches,
    stored,
)
from tracelight.operators.graph import connected_components

ship(__name__)

TREES, DEPTH, REACH = 16, 8, 4
SHARED = 4  # minima of a tree that the sets of a region share
BLOCK = 1024  # rows of a key that meet as many others in one task
CELLS = 1 << 18  # numbers that tell rare shingles from frequent ones
PRIME, MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
#: Of 64 sketch bits, how many two sets of similarity 0.8 share at least (mean 57.6, sd 2.4).
SKETCH_LEAST = 47


class WordHashes(dict):
    """64-bit hashes of words, at most ``limit`` remembered."""

    def __init__(self, limit: int = 250_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def shingle_set(words: list[bytes], width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles; fewer words are one shingle."""
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    n = min(width, len(h))
    mixed = np.full(len(h) - n + 1, np.uint64(n))
    for k in range(n):
        mixed = (mixed ^ h[k : len(h) - n + 1 + k]) * PRIME
        mixed ^= mixed >> np.uint64(31)
    return np.unique(mixed * MIX)


def hash_functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    a, b = rng.integers(0, 1 << 63, (2, TREES * DEPTH), dtype=np.uint64)
    return a * np.uint64(2) + np.uint64(1), b


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The 32-bit minimum under each hash function."""
    best = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        hashed = shingles[at : at + 2048, None] * a
        hashed += b
        np.minimum(best, hashed.min(axis=0), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, sketch, trees) of ``docs`` (doc_id, text)."""
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_shingles", pa.int64()),
            ("set_key", pa.binary()),
            ("sketch", pa.int64()),
            ("trees", pa.binary()),
        ]
    )

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = per_process("word hashes", WordHashes)
        a, b = hash_functions()
        bits = np.linspace(0, TREES * DEPTH - 1, 64).astype(int)
        for batch in short_batches(batches, "text"):
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(*columns_of(batch, "doc_id", "text"), strict=True):
                shingles = shingle_set(words_of(text), width, hashes)
                row = [doc_id, len(shingles), None, None, None]
                if len(shingles):
                    minima = signature(shingles, a, b)
                    row[2] = xxhash.xxh3_128_digest(shingles.tobytes())
                    # minima are small, their low bits even: one for the sketch, 16 for the trees
                    low = np.packbits((minima[bits] & 1).astype(np.uint8)).tobytes()
                    row[3] = int.from_bytes(low, "big", signed=True)
                    row[4] = (minima >> np.uint32(1)).astype(np.uint16).astype(">u2").tobytes()
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            arrays = [pa.array(c, f.type) for c, f in zip(out, schema, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return docs.select("doc_id", "text").mapInArrow(
        sketch, "doc_id long, n_shingles long, set_key binary, sketch long, trees binary"
    )


PAIR = "a long, b long, apart int, tree int, step int"


def neighbour_pairs(keys, node, n, sketch, tree, first: int, percent: int) -> pa.RecordBatch:
    """Candidates among sorted rows: row i with rows i+1 .. i+REACH, from row ``first`` on."""
    parts = []
    for step in range(1, REACH + 1):
        low = np.arange(max(0, first - step), len(node) - step)
        high = low + step
        ok = (tree[low] == tree[high]) & (keys[low, 0] == keys[high, 0])
        small, large = np.minimum(n[low], n[high]), np.maximum(n[low], n[high])
        ok &= small * 100 >= large * percent
        apart = np.bitwise_count((sketch[low] ^ sketch[high]).view(np.uint64))
        ok &= apart <= 64 - SKETCH_LEAST
        low, high, apart = low[ok], high[ok], apart[ok]
        ends = np.minimum(node[low], node[high]), np.maximum(node[low], node[high])
        parts.append((*ends, apart, tree[low], np.full(len(low), step)))
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
    arrays = [pa.array(c.astype(k.to_pandas_dtype())) for c, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=["a", "b", "apart", "tree", "step"])


def numpy_rows(batch: pa.RecordBatch) -> list[np.ndarray]:
    keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u2").reshape(-1, DEPTH)
    node, n, sketch = (batch.column(k).to_numpy() for k in (2, 3, 4))
    return [keys.astype(np.uint16), node, n, sketch, batch.column(0).to_numpy()]


def forest_candidates(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, apart, tree, step), a < b: neighbours in the sorted orders of the stored ``sets``."""
    tree_keys = F.array(
        *[F.expr(f"substring(trees, {1 + 2 * DEPTH * t}, {2 * DEPTH})") for t in range(TREES)]
    )
    rows = sets.select(F.posexplode(tree_keys).alias("tree", "key"), "node", "n_shingles", "sketch")
    parts = max(2, int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(parts, "tree", "key", "node").sortWithinPartitions(
        "tree", "key", "node"
    )
    border = "border long, side int, place int, tree int, key binary, node long, n_shingles long, sketch long"

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, part = None, 0, TaskContext.get().partitionId()

        def edge(side: int, rows: list[np.ndarray]) -> pa.RecordBatch:
            keys, node, n, sketch, tree = rows
            m = len(node)
            data = [
                pa.array(np.full(m, part if side == 0 else part - 1), pa.int64()),
                pa.array(np.full(m, side), pa.int32()),
                pa.array(np.arange(m), pa.int32()),
                pa.array(tree, pa.int32()),
                pa.array([k.astype(">u2").tobytes() for k in keys], pa.binary()),
                *(pa.array(x, pa.int64()) for x in (node, n, sketch)),
            ]
            pad = [pa.nulls(m, pa.int64())] * 2 + [pa.nulls(m, pa.int32())] * 3
            return pa.RecordBatch.from_arrays([*pad, *data], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = numpy_rows(batch)
            start = 0
            if held is None:
                yield edge(1, [x[:REACH] for x in rows])
            else:
                start = len(held[1])
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            pairs = neighbour_pairs(*rows, start, percent)
            blank = [pa.nulls(pairs.num_rows, k) for k in border_kinds]
            yield pa.RecordBatch.from_arrays([*pairs.columns, *blank], names=names)
            held = [x[-REACH:] for x in rows]
        if held is not None:
            yield edge(0, held)

    border_kinds = [pa.int64(), *[pa.int32()] * 3, pa.binary(), *[pa.int64()] * 3]
    names = ["a", "b", "apart", "tree", "step"] + [
        f"border_{c.split()[0]}" for c in border.split(", ")
    ]
    typed = ", ".join(f"border_{c}" for c in border.split(", "))
    found = stored(ordered.mapInArrow(stream, f"{PAIR}, {typed}"))

    def join_borders(table: pa.Table) -> pa.Table:
        """The last rows of one range and the first of the next."""
        table = table.sort_by([("border_side", "ascending"), ("border_place", "ascending")])
        first = pa.compute.sum(pa.compute.equal(table["border_side"], 0)).as_py()
        columns = [f"border_{c}" for c in ("tree", "key", "node", "n_shingles", "sketch")]
        rows = numpy_rows(table.select(columns).combine_chunks().to_batches()[0])
        pairs = neighbour_pairs(*rows, first, percent)
        return pa.Table.from_batches([pairs])

    edges = found.filter("border_side IS NOT NULL").select(
        *[c for c in found.columns if c.startswith("border_")]
    )
    across = edges.groupBy("border_border").applyInArrow(join_borders, PAIR)
    within = found.filter("border_side IS NULL").select("a", "b", "apart", "tree", "step")
    return within.unionByName(across).filter("a != b")


def crowded_sets(sets: DataFrame, components: DataFrame) -> DataFrame:
    """(node, component) of the sets in dense regions that hold several components."""
    prefixes = F.array(
        *[F.expr(f"substring(trees, {1 + 2 * DEPTH * t}, {2 * SHARED})") for t in range(TREES)]
    )
    rows = (
        sets.join(components, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
        .select(F.posexplode(prefixes).alias("tree", "prefix"), "node", "component")
        .select(F.xxhash64("tree", "prefix").alias("region"), "node", "component")
    )
    dense = (
        rows.groupBy("region")
        .agg(
            F.count(F.lit(1)).alias("size"),
            F.min("component").alias("low"),
            F.max("component").alias("high"),
        )
        .filter((F.col("size") > REACH + 1) & (F.col("low") != F.col("high")))
    )
    return rows.join(dense.select("region"), "region").select("node", "component").distinct()


def shingle_sets(docs: DataFrame, bitmap: Broadcast, width: int) -> Callable:
    """A function over batches of ``docs``: (id, shingles) of the texts whose id is marked."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, np.ndarray]]]:
        hashes, marks = per_process("word hashes", WordHashes), bitmap.value
        places = len(marks) << 5
        for batch in short_batches(batches, "text"):
            found = []
            for doc_id, text in zip(*columns_of(batch, "doc_id", "text"), strict=True):
                if doc_id is None:
                    continue
                place = zlib.crc32(str(doc_id).encode()) % places
                if int(marks[place >> 5]) >> (place & 31) & 1:
                    shingles = shingle_set(words_of(text), width, hashes)
                    if len(shingles):
                        found.append((doc_id, shingles))
            yield found

    return sets


def cell_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles % np.uint64(CELLS)).astype(np.int64)


def shingle_cells(docs: DataFrame, sets: Callable) -> np.ndarray:
    """How many marked texts hold the shingles of each of ``CELLS`` hash classes."""
    schema = pa.schema([("cell", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for found in sets(batches):
            for _, shingles in found:
                np.add.at(total, cell_of(shingles), 1)
        used = np.flatnonzero(total)
        arrays = [pa.array(c, f.type) for c, f in zip((used, total[used]), schema, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    rows = docs.select("doc_id", "text").mapInArrow(count, "cell int, n long")
    sums = rows.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # ``CELLS`` rows at most
    out = np.zeros(CELLS, np.int64)
    out[sums["cell"].to_numpy(int)] = sums["n"].to_numpy(int)
    return out


def rare_shingles(docs: DataFrame, sets: Callable, cells: Broadcast, percent: int) -> DataFrame:
    """(key, node, n, place): the rarest shingles of each marked text, as many as any set of enough
    similarity must share one of, with their places in the common order."""
    schema = pa.schema([(n, pa.int64()) for n in ("key", "node", "n", "place")])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = cells.value
        for found in sets(batches):
            parts: list[list[np.ndarray]] = [[], [], [], []]
            for node, shingles in found:
                n = len(shingles)
                first = n + (-percent * n) // 100 + 1
                order = np.lexsort([shingles, frequency[cell_of(shingles)]])[:first]
                rows = (shingles[order].view(np.int64), np.full(first, node), np.full(first, n))
                for part, column in zip(parts, (*rows, np.arange(first)), strict=True):
                    part.append(column)
            arrays = [pa.array(np.concatenate(p) if p else [], pa.int64()) for p in parts]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return docs.select("doc_id", "text").mapInArrow(
        pick, "key long, node long, n long, place long"
    )


def crowded_candidates(
    docs: DataFrame, crowded: DataFrame, width: int, percent: int
) -> DataFrame:
    """(a, b), a < b: every pair of the stored ``crowded`` sets (node, component) of different
    components that may be similar enough, by their rare shingles.

    Sets of sizes m and n need an overlap of percent * (m + n) / (100 + percent); of the overlap
    nothing stands before the first shared shingle, so its place bounds what is left for it. Of a
    key's sets, those of its largest component meet the others only; a key of one component is
    dropped. What many sets share is cut into blocks, and every two blocks are a join key.
    """
    sc = docs.sparkSession.sparkContext
    bitmap = sc.broadcast(id_filter(crowded.select(F.col("node").alias("id"))))
    sets = shingle_sets(docs, bitmap, width)
    cells = sc.broadcast(shingle_cells(docs, sets))
    rows = stored(rare_shingles(docs, sets, cells, percent).join(crowded, "node"))
    groups = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"))
    shared = (
        groups.groupBy("key")
        .agg(
            F.sum("size").alias("size"),
            F.count(F.lit(1)).alias("groups"),
            F.max_by("component", F.struct("size", "component")).alias("largest"),
        )
        .filter("groups > 1")
        .select("key", "largest", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    )
    members = stored(
        rows.join(shared, "key").withColumn(
            "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        )
    )
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = members.filter("component != largest").withColumnRenamed("block", "own")
    left = left.withColumn("met", every)
    right = members.withColumn("own", every).withColumnRenamed("block", "met")
    named = {c: f"other_{c}" for c in ("node", "n", "place", "component")}
    right = right.drop("blocks", "largest").withColumnsRenamed(named)
    need = F.col("n") + F.col("other_n")
    left_over = F.least(F.col("n") - F.col("place"), F.col("other_n") - F.col("other_place"))
    pairs = left.join(right, ["key", "own", "met"]).filter(
        (F.col("component") != F.col("other_component"))
        & (left_over * (100 + percent) >= need * percent)
    )
    found = stored(
        pairs.select(
            F.least("node", "other_node").alias("a"), F.greatest("node", "other_node").alias("b")
        ).distinct()
    )
    release(rows, members)
    return found


def id_filter(ids: DataFrame, bits: int = 24) -> np.ndarray:
    """A bitmap of 2^bits places over crc32 of ``ids`` (id): 2 MB, no id is missed."""
    place = F.crc32(F.col("id").cast("string").cast("binary")) % (1 << bits)
    words = (
        ids.select((place / 32).cast("long").alias("word"), (place % 32).cast("int").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))
        .collect()
    )
    bitmap = np.zeros(1 << (bits - 5), np.uint32)
    for row in words:
        bitmap[row["word"]] = row["mask"]
    return bitmap


def full_sets(docs: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the documents that ``pairs`` name, read from the whole texts again.

    A bitmap of their ids keeps most other texts from being shingled; a chance hit only costs.
    """
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    marks = id_filter(ends)
    sets = shingle_sets(docs, docs.sparkSession.sparkContext.broadcast(marks), width)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in sets(batches):
            ids, shingles = [i for i, _ in found], [x.tobytes() for _, x in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(shingles, pa.binary())],
                names=["node", "shingles"],
            )

    return docs.select("doc_id", "text").mapInArrow(build, "node long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) whose full sets have the wanted similarity."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(*columns_of(batch, "left_set", "right_set"), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left_set"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right_set"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(check, "a long, b long")


def labelled(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """``pairs`` whose ends lie in different components (a node without one is its own)."""
    for end in ("a", "b"):
        names = components.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in"))
        pairs = pairs.join(names, end, "left")
    a, b = F.coalesce("a_in", "a"), F.coalesce("b_in", "b")
    return pairs.filter(a != b).select("a", "b")


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    width: int = 5,
    percent: int = 80,
) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row of ``docs``.

    ``width`` words make a shingle; sets whose intersection is at least ``percent`` of their union
    are linked. ``component_id`` is the smallest id reachable over links, ``kept`` whether it is
    the row's own. A text without words is linked with nothing. Rows that share an id are one
    node; a row whose id is null is linked with nothing, has no component and is kept.
    """
    source = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")
    )
    rows = stored(sketches(source, width))
    sets = stored(
        rows.filter("set_key IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("set_key")
        .agg(F.min(F.struct("doc_id", "n_shingles", "sketch", "trees")).alias("first"))
        .select("set_key", F.col("first.doc_id").alias("node"), "first.n_shingles",
                "first.sketch", "first.trees")
    )
    candidates = forest_candidates(sets, percent)
    pairs = stored(
        candidates.groupBy("a", "b").agg(
            F.min("apart").alias("apart"),
            F.bool_or((F.col("tree") == 0) & (F.col("step") == 1)).alias("chained"),
        )
    )
    ends = F.explode(F.array(F.struct(F.col("a").alias("id")), F.struct(F.col("b").alias("id"))))
    nearest = (
        pairs.select("a", "b", "apart", ends.alias("end"))
        .groupBy("end.id")
        .agg(F.min(F.struct("apart", "a", "b")).alias("best"))
        .select("best.a", "best.b")
    )
    texts = stored(full_sets(source, pairs, width))
    first = nearest.unionByName(pairs.filter("chained").select("a", "b")).distinct()
    links = stored(confirmed(first, texts, percent))
    components = stored(connected_components(links, "a", "b"))
    release()
    tried = first.withColumn("tried", F.lit(True))
    rest = labelled(pairs, components).join(tried, ["a", "b"], "left_anti")
    more = stored(confirmed(rest, texts, percent))
    if not more.isEmpty():
        links = links.unionByName(more)
        components = stored(connected_components(links, "a", "b"))
    tried = stored(pairs.select("a", "b"))
    release(pairs, texts)  # what is linked lives on in ``links``
    crowded = stored(crowded_sets(sets, components))
    if not crowded.isEmpty():
        found = crowded_candidates(source, crowded, width, percent)
        open_ = stored(found.join(tried, ["a", "b"], "left_anti"))
        if not open_.isEmpty():
            texts = stored(full_sets(source, open_, width))
            more = stored(confirmed(open_, texts, percent))
            release(texts)
            if not more.isEmpty():
                links = links.unionByName(more)
                components = stored(connected_components(links, "a", "b"))
    named = stored(
        sets.join(components, "node", "left").select(
            "set_key", F.coalesce("component", "node").alias("component_id")
        )
    )
    own = F.coalesce("component_id", "doc_id")
    return rows.join(named, "set_key", "left").select(
        F.col("doc_id").alias(id_column),
        "n_shingles",
        own.alias("component_id"),
        F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"),
    )
