"""Vector code compression (operator 11): product quantisation in integers.

Vectors become integers, ``floor(1024 * x)``, and are cut into ``PARTS`` equal parts; each part is
replaced by the index of its nearest entry in a codebook of at most ``ENTRIES`` entries, which a few
rounds of Lloyd's algorithm fit to all vectors. Nothing is computed in floating point after the
scaling, so a result does not depend on how rows are dealt over tasks.

The nearest entry is searched in the Walsh-Hadamard domain. Parts and entries are padded with
zeros to a power of two P and transformed by additions only. The transform keeps distances up to
the factor P, so sums of squared differences over the first coefficients, taken in sequency order
(slow changes first), never exceed P times the distance: entries whose sum has passed that of the
best one known are eliminated early, and what remains at the end is exact.

A round sends the sums and counts of at most PARTS * ENTRIES cells from each task; the codebooks,
ENTRIES * dimension integers whatever the corpus, travel with the next round's code.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.llm.common import ship, stored

ship(__name__)

PARTS, ENTRIES, SCALE = 4, 256, 1024
Codebooks = list[list[list[int]]]  # by part, entry and place within the part


def walsh(rows: np.ndarray, width: int) -> np.ndarray:
    """The Walsh-Hadamard transform of ``rows`` padded to ``width`` places, in sequency order."""
    n = len(rows)
    out = np.zeros((n, width), rows.dtype)
    out[:, : rows.shape[1]] = rows
    half = 1
    while half < width:
        pairs = out.reshape(n, width // (2 * half), 2, half)
        low, high = pairs[:, :, 0], pairs[:, :, 1]
        out = np.stack([low + high, low - high], axis=2).reshape(n, width)
        half *= 2
    return out[:, sequency_order(width)]


def sequency_order(width: int) -> list[int]:
    """Rows of the Hadamard matrix by their number of sign changes: the bit-reversed Gray code."""
    bits = width.bit_length() - 1
    gray = [s ^ (s >> 1) for s in range(width)]
    return [sum((g >> b & 1) << (bits - 1 - b) for b in range(bits)) for g in gray]


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) of each transformed point.

    Both are integer arrays of ``walsh``; of entries at the same distance the first is taken.
    While many entries are left the sums of all are carried on, which is cheaper than picking
    those that are left; from an eighth on, only theirs.
    """
    n, width = points.shape
    step = max(1, width // 8)
    sums = np.zeros((n, len(entries)), points.dtype)
    best, k = None, 0
    while True:
        for at in range(k, min(k + step, width)):
            apart = points[:, at, None] - entries[None, :, at]
            sums += apart * apart
        k += step
        guess = sums.argmin(axis=1)
        if k >= width:
            return guess, sums[np.arange(n), guess] // width
        apart = points - entries[guess]
        known = (apart * apart).sum(axis=1)  # the nearest entry is at most so far away
        best = known if best is None else np.minimum(best, known)
        open_ = np.asarray(sums <= best[:, None], bool)
        if np.count_nonzero(open_) * 8 <= open_.size:
            break
    row, entry = np.nonzero(open_)
    left = sums[row, entry]
    for at in range(k, width, step):
        apart = points[row, at : at + step] - entries[entry, at : at + step]
        left = left + (apart * apart).sum(axis=1, dtype=points.dtype)
        open_ = np.asarray(left <= best[row], bool)
        row, entry, left = row[open_], entry[open_], left[open_]
    least = np.minimum.reduceat(left, np.searchsorted(row, np.arange(n)))
    first = np.flatnonzero(left == least[row])
    first = first[np.searchsorted(row[first], np.arange(n))]
    return entry[first], least // width


def integer_kind(largest: int, size: int, width: int) -> type:
    """The narrowest integers that scaled squared distances fit, Python's own if none does."""
    most = width * max(1, size) * (2 * largest) ** 2
    return np.int32 if most < 1 << 31 else np.int64 if most < 1 << 63 else object


def padded_width(size: int) -> int:
    return 1 << max(0, size - 1).bit_length()


def assigned(
    vectors: np.ndarray, books: Codebooks, kind: type, rows: int = 1024
) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of every part of each row of ``vectors``, part by part."""
    n, size = len(vectors), vectors.shape[1] // PARTS
    width = padded_width(size)
    entry, far = np.zeros((n, PARTS), np.int64), np.zeros((n, PARTS), kind)
    for part in range(PARTS):
        entries = walsh(np.array(books[part], kind).reshape(len(books[part]), size), width)
        points = vectors[:, part * size : (part + 1) * size]
        for at in range(0, n, rows):
            found = nearest(walsh(points[at : at + rows], width), entries)
            entry[at : at + rows, part], far[at : at + rows, part] = found
    return entry, far


def padded_vectors(column: pa.Array, size: int, kind: type) -> np.ndarray:
    """The lists of ``column`` as rows of ``size`` integers; shorter ones end in zeros."""
    lengths = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), size), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, place] = values
    return out.astype(kind)


def whole_numbers(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))


def finite(vector: Column) -> Column:
    """Whether the vector and all its components are there and finite."""
    infinity = float("inf")
    return vector.isNotNull() & F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < infinity),
    )


def cell_sums(kept: DataFrame, books: Codebooks, size: int, kind: type) -> DataFrame:
    """(part, entry, place, n, total): what is assigned to each entry, added up over all rows."""
    schema = pa.schema(
        [("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]
    )
    each = size // PARTS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((PARTS, ENTRIES), np.int64)
        total = np.zeros((PARTS, ENTRIES, each), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = padded_vectors(batch.column(0), size, kind)
            entry, _ = assigned(vectors, books, kind)
            for part in range(PARTS):
                points = vectors[:, part * each : (part + 1) * each].astype(np.int64)
                order = np.argsort(entry[:, part], kind="stable")
                used, starts = np.unique(entry[order, part], return_index=True)
                if each:
                    total[part, used] += np.add.reduceat(points[order], starts, axis=0)
                count[part] += np.bincount(entry[:, part], minlength=ENTRIES)
        part, entry = np.nonzero(count)
        columns = [part, entry, count[part, entry], total[part, entry].tolist()]
        arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    cells = kept.select("vector").mapInArrow(add, "part int, entry int, n long, sums array<long>")
    return (
        cells.select("part", "entry", "n", F.posexplode("sums").alias("place", "value"))
        .groupBy("part", "entry", "place")
        .agg(F.sum("n").alias("n"), F.sum("value").alias("total"))
    )


def moved(books: Codebooks, kept: DataFrame, size: int, kind: type) -> Codebooks:
    """One round: every used entry becomes the floored mean of its parts."""
    out = [[list(entry) for entry in book] for book in books]
    for cell in cell_sums(kept, books, size, kind).collect():  # ENTRIES * dimension rows at most
        out[cell["part"]][cell["entry"]][cell["place"]] = cell["total"] // cell["n"]
    return out


def books_digest(books: Codebooks) -> str:
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    return hashlib.sha256(text.encode()).hexdigest()


def compress_vectors(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    rounds: int = 4,
) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every vector that is whole.

    Rows whose vector is null or holds a null or non-finite component are dropped. ``code`` is two
    hex digits a part, ``error`` the squared distance between the integer vector and its entries,
    ``label_error`` the sum of errors of all rows of the same label (null labels together).

    Vectors that are shorter than the longest, or whose length is no multiple of four, count as
    ending in zeros. Codebooks start from the smallest ids (null ids come last; rows that share an
    id by their components), fewer than ``ENTRIES`` rows make smaller codebooks. Repeated rows are
    kept. An empty table gives an empty result. Components whose squared distances could not fit a
    long (beyond 185,000 for 64 of them) raise ``ValueError``. Other columns are not looked at.
    """
    vector = F.col(vector_column)
    kept = stored(
        vectors.filter(finite(vector)).select(
            F.col(id_column).alias("id"),
            F.col(label_column).alias("label"),
            whole_numbers(vector).alias("vector"),
        )
    )
    widest = kept.agg(
        F.max(F.size("vector")).alias("size"),
        F.max(F.array_max(F.transform("vector", F.abs))).alias("largest"),
    ).first()
    each = math.ceil((widest["size"] or 0) / PARTS)
    size, largest = each * PARTS, widest["largest"] or 0
    if size * (2 * largest) ** 2 >= 1 << 63:
        raise ValueError(f"a component of {largest / SCALE:g} is too large for exact distances")
    kind = integer_kind(largest, each, padded_width(each))
    seeds = kept.orderBy(F.asc_nulls_last("id"), "vector").limit(ENTRIES).select("vector").collect()
    rows = [row["vector"] + [0] * (size - len(row["vector"])) for row in seeds]
    books = [[row[p * each : (p + 1) * each] for row in rows] for p in range(PARTS)]
    for _ in range(rounds):
        books = moved(books, kept, size, kind)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry, far = assigned(padded_vectors(batch.column(2), size, kind), books, kind)
            code = pa.array([bytes(row).hex() for row in entry.astype(np.uint8)], pa.string())
            error = pa.array(far.astype(object).sum(axis=1).tolist(), pa.int64())
            columns = [batch.column(0), batch.column(1), code, error]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    coded = stored(
        kept.mapInArrow(encode, f"id {kinds['id']}, label {kinds['label']}, code string, error long")
    )
    totals = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error")))
    own = totals.select(F.col("label").alias("of_label"), "label_error")
    return coded.join(own, F.col("label").eqNullSafe(F.col("of_label"))).select(
        F.col("id").alias(id_column),
        "code",
        "error",
        "label_error",
        F.lit(books_digest(books)).alias("codebooks_sha256"),
    )


def compress_sql(rounds: int = 4) -> str:
    """The same codes in SQL, for vectors of one length that is a multiple of four."""

    def chosen(k: int) -> str:
        return f"""a{k} AS MATERIALIZED (SELECT vec_id, p, min({{'d': d, 'e': e}}) AS m FROM (SELECT x.vec_id, x.p, b.e,
      list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
      FROM parts x JOIN b{k} b ON b.p = x.p) GROUP BY 1, 2)"""

    def means(k: int) -> str:
        return f"""b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.v, b.v) AS v FROM b{k} b LEFT JOIN (
      SELECT p, e, list(((s - ((s % c) + c) % c) // c)::BIGINT ORDER BY i) AS v FROM (
        SELECT x.p, a.m.e AS e, i, sum(x.v[i]) AS s, count(*) AS c FROM parts x JOIN a{k} a USING (vec_id, p),
          (SELECT unnest(range(1, (SELECT max(len(v)) FROM parts) + 1)) AS i) GROUP BY ALL) GROUP BY 1, 2) n
    ON n.p = b.p AND n.e = b.e)"""

    steps = ",\n  ".join(f"{chosen(k)},\n  {means(k)}" for k in range(rounds))
    return f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  parts AS MATERIALIZED (SELECT vec_id, p, q[p * (len(q) // {PARTS}) + 1 : (p + 1) * (len(q) // {PARTS})] AS v
    FROM kept, (SELECT unnest(range({PARTS})) AS p)),
  b0 AS MATERIALIZED (SELECT p, e, v FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept
    QUALIFY e < {ENTRIES}) USING (vec_id)),
  {steps},
  {chosen(rounds)},
  c AS (SELECT vec_id, string_agg(format('{{:02x}}', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY 1),
  f AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256
    FROM (SELECT p, e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM b{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN c USING (vec_id), f"""
