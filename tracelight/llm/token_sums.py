"""Sums over the tokens of each document, with every distinct token evaluated once.

1. ``count_tokens``: how often each distinct token occurs in the corpus (counted in the tasks,
   then added up), and in how many documents.
2. The caller evaluates each distinct token of that table once and stores the result.
3. ``sum_values``: the values of the most widespread tokens, at most ``hot_tokens`` of them, go to
   all tasks; every other token of a document is a row that joins the stored table. Tokens that a
   third of all documents hold are therefore never a join key, and the rows that are shuffled are
   those of rare tokens.

A *splitter* is a picklable function: make() -> split(text) -> (tokens as bytes, extra count).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.llm.common import columns_of, kind_of, ship, short_batches

ship(__name__)

Splitter = Callable[[], Callable[[str], list[bytes]]]
#: Distinct tokens that a task holds before it hands its counts on.
FLUSH = 400_000


def count_tokens(docs: DataFrame, make: Splitter) -> DataFrame:
    """(token, n, n_train, n_docs) of ``docs`` (text, train): occurrences in all texts and in
    those whose ``train`` is true, and documents that hold the token. Null text is empty."""
    schema = pa.schema(
        [("token", pa.binary()), ("n", pa.int64()), ("n_train", pa.int64()), ("n_docs", pa.int64())]
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = make()
        #: occurrences in texts that are not trained on, in those that are, and documents
        held: tuple[Counter, Counter, Counter] = (Counter(), Counter(), Counter())

        def flush() -> pa.RecordBatch:
            tokens = list(held[2])
            counts = np.array([[c.get(t, 0) for t in tokens] for c in held], np.int64)
            counts[0] += counts[1]
            arrays = [pa.array(tokens, pa.binary()), *(pa.array(c, pa.int64()) for c in counts)]
            for c in held:
                c.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        for batch in short_batches(batches, "text"):
            for text, train in zip(*columns_of(batch, "text", "train"), strict=True):
                tokens = split(text or "")
                held[1 if train else 0].update(tokens)
                held[2].update(set(tokens))
            if len(held[2]) > FLUSH:
                yield flush()
        yield flush()

    columns = "token binary, n long, n_train long, n_docs long"
    parts = docs.select("text", "train").mapInArrow(count, columns)
    return parts.groupBy("token").agg(
        F.sum("n").alias("n"), F.sum("n_train").alias("n_train"), F.sum("n_docs").alias("n_docs")
    )


def widespread(values: DataFrame, hot_tokens: int) -> DataFrame:
    """The rows of the most widespread tokens of up to 64 bytes, at most ``hot_tokens``: those above
    a threshold that is read off a histogram of n_docs with 16 steps per doubling."""
    values = values.filter(F.octet_length("token") <= 64)
    step = F.floor(F.log2(F.col("n_docs").cast("double")) * 16)
    histogram = values.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("c")).collect()
    kept, least = 0, None
    for row in sorted(histogram, key=lambda r: -r["step"]):
        kept += row["c"]
        if kept > hot_tokens:
            break
        least = row["step"]
    return values.filter(step >= least) if least is not None else values.limit(0)


def sum_values(
    docs: DataFrame,
    make: Splitter,
    values: DataFrame,
    names: list[str],
    id_column: str = "doc_id",
    hot_tokens: int = 200_000,
) -> DataFrame:
    """(id, n_tokens, n_bytes, *names): per id, tokens, UTF-8 bytes and the sums of ``names``.

    ``values`` is the stored table (token, n_docs, *names) of every token of ``docs`` (id, text).
    Rows that share an id are one document made of those rows; null is an id like any other.
    """
    columns = ["token", *names]
    hot = widespread(values, hot_tokens).select(*columns).toPandas()
    place = {bytes(t): i for i, t in enumerate(hot["token"])}
    table = np.zeros((len(hot) + 1, len(names)))  # the last row is zero: a token joined later
    table[: len(hot)] = hot[names].to_numpy(float)
    known = docs.sparkSession.sparkContext.broadcast((place, table))
    source = docs.select(id_column, "text")
    id_field = source.schema[id_column].dataType.simpleString()
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), *[pa.float64()] * len(names)]
    labels = [id_column, "token", "times", "n_tokens", "n_bytes", *names]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = make()
        place, table = known.value
        last = len(table) - 1
        for batch in short_batches(batches, "text"):
            ids, tokens, times, totals, sizes, sums = [], [], [], [], [], []
            for doc_id, text in zip(*columns_of(batch, id_column, "text"), strict=True):
                found = split(text or "")
                at = [place.get(t, last) for t in found]
                ids.append(doc_id)
                # the id's own sums travel under a name that is no UTF-8, so it meets no token
                tokens.append(b"\xff" + str(doc_id).encode())
                times.append(0)
                totals.append(len(found))
                sizes.append(len((text or "").encode()))
                sums.append(table[at].sum(axis=0))
                cold = Counter(t for t, p in zip(found, at, strict=True) if p == last)
                ids += [doc_id] * len(cold)
                tokens += cold.keys()
                times += cold.values()
                zeros = [0] * len(cold)
                totals += zeros
                sizes += zeros
                sums += [table[last]] * len(cold)
            rows = np.array(sums).reshape(len(ids), len(names))
            data = [tokens, times, totals, sizes, *rows.T]
            arrays = [pa.array(c, k) for c, k in zip(data, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, kind_of(batch, id_column)), *arrays], names=labels
            )

    fields = ", ".join(f"`{n}` double" for n in names)
    rows = source.mapInArrow(
        spread,
        f"`{id_column}` {id_field}, token binary, times long, n_tokens long, n_bytes long, {fields}",
    )
    worth = values.select("token", *[F.col(n).alias(f"_{n}") for n in names])
    joined = rows.join(worth, "token", "left")
    added = [
        F.sum(F.col(n) + F.col("times") * F.coalesce(F.col(f"_{n}"), F.lit(0.0))).alias(n)
        for n in names
    ]
    return joined.groupBy(id_column).agg(
        F.sum("n_tokens").alias("n_tokens"), F.sum("n_bytes").alias("n_bytes"), *added
    )
