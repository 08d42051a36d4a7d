"""Target-distribution importance resampling (operator 13): documents drawn towards a target set.

Features of a text are its runs of 1 to ``longest`` words, hashed into buckets. A bucket's gain is
the log-ratio of its smoothed shares in the target texts and in all texts; a document's weight is
the mean gain of its features. Gumbel noise, fixed by seed and id, turns the highest scores into a
draw without replacement in proportion to the weights.

Two passes over the texts, both of Arrow kernels on whole batches: ``ascii_lower``,
``split_pattern_regex``, ``list_flatten`` and ``dictionary_encode`` give word indices; indices
shifted by one form n-grams, each distinct one of a batch is hashed once, and ``take`` with sums
over the segment of each document gives its weight. Bucket counts (``buckets`` numbers, whatever
the corpus) are all that leaves the first pass; the second one's rows are ranked by range.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.llm.common import ship, short_batches, stored
from tracelight.operators.ordering import ranked

ship(__name__)

#: What stands between words: ASCII other than digits and lower-case letters (fixed value).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEED, LONGEST, BUCKETS = 7, 2, 10_000


def word_indices(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(document, word) index of every word of ``texts``, in order, and the distinct words."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), BETWEEN)
    words, doc = pc.list_flatten(lists), pc.list_parent_indices(lists)
    there = pc.not_equal(words, "")
    coded = pc.dictionary_encode(words.filter(there))
    distinct = [w.encode() for w in coded.dictionary.to_pylist()]
    return doc.filter(there).to_numpy(), coded.indices.to_numpy(), distinct


def grams(
    texts: pa.Array, longest: int, buckets: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of 1, 2, .. ``longest`` words: (document and distinct run of every occurrence,
    bucket of every distinct run)."""
    doc, word, words = word_indices(texts)
    tails = [b" " + w for w in words]
    run, crc = word.astype(np.int64), [zlib.crc32(w) for w in words]
    yield doc, run, np.array(crc, np.int64) % buckets
    for k in range(1, longest):
        # the run of k words at i goes on by one word if word i + k is of the same document
        at = np.flatnonzero(doc[: max(0, len(doc) - k)] == doc[k:])
        coded = pc.dictionary_encode(pa.array(run[at] * len(words) + word[at + k], pa.int64()))
        pairs = coded.dictionary.to_numpy()
        heads, ends = pairs // max(1, len(words)), pairs % max(1, len(words))
        crc = [
            zlib.crc32(tails[w], crc[h]) for h, w in zip(heads.tolist(), ends.tolist(), strict=True)
        ]
        run = np.full(len(word), -1, np.int64)
        run[at] = coded.indices.to_numpy()
        yield doc[at], run[at], np.array(crc, np.int64) % buckets


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all ``texts`` (text) fall into each bucket."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in short_batches(batches, "text"):
            for _, run, bucket in grams(batch.column(0), longest, buckets):
                times = np.bincount(run, minlength=len(bucket))
                np.add.at(total, bucket, times)
        used = np.flatnonzero(total)
        arrays = [pa.array(c, f.type) for c, f in zip((used, total[used]), schema, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    parts = texts.select("text").mapInArrow(count, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # ``buckets`` rows
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log-ratio) of the smoothed shares of every bucket."""
    size = len(source)
    all_source, all_target = float(source.sum() + size), float(target.sum() + size)
    return np.array(
        [
            math.floor(1000 * math.log((t + 1) * all_source / ((s + 1) * all_target)))
            for s, t in zip(source.astype(float).tolist(), target.astype(float).tolist(), strict=True)
        ],
        np.int64,
    )


def weighted(docs: DataFrame, gains: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """``docs`` (id, text) as (id, n_words, n_features, weight)."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short_batches(batches, "text"):
            total, n = np.zeros((2, batch.num_rows), np.int64)
            n_words = None
            for doc, run, bucket in grams(batch.column(1), longest, len(gains)):
                edges = np.searchsorted(doc, np.arange(batch.num_rows + 1))
                so_far = np.concatenate([[0], np.cumsum(gains[bucket].take(run))])
                total += so_far[edges[1:]] - so_far[edges[:-1]]
                n += np.diff(edges)
                n_words = np.diff(edges) if n_words is None else n_words
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            columns = [pa.array(c, pa.int64()) for c in (n_words, n, weight)]
            names = ["id", "n_words", "n_features", "weight"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInArrow(
        weigh, f"id {kind}, n_words long, n_features long, weight long"
    )


def gumbel(id_column: Column, seed: int) -> Column:
    """Noise of thousandths that depends on seed and id only; a null id counts as empty."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit("")))
    number = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((number + 0.5) / F.lit(4294967296.0))))


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    target_column: str = "text",
    percent: int = 25,
    least_words: int = 20,
    seed: int = SEED,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row of ``docs``.

    ``rank`` counts the ``percent`` of the rows of at least ``least_words`` words that are drawn,
    by falling score and then by id (null ids last); it is null for all others. A null or empty
    text has no feature and weight 0. Rows that repeat are rows of their own, in any order among
    themselves. Without target texts all gains follow the source alone. Other columns are not
    looked at; an empty table gives an empty result.
    """
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    aims = target.select(F.col(target_column).alias("text"))
    counts = [bucket_counts(t, longest, buckets) for t in (source, aims)]
    scored = stored(
        weighted(source, bucket_gains(*counts), longest).withColumn(
            "score", F.col("weight") + gumbel(F.col("id"), seed)
        )
    )
    long_enough = F.col("n_words") >= least_words
    drawn = scored.filter(long_enough).count() * percent // 100
    pool = ranked(scored.filter(long_enough), F.desc("score"), F.asc_nulls_last("id"))
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    rest = scored.filter(~long_enough).withColumn("rank", F.lit(None).cast("long"))
    return (
        pool.withColumn("rank", rank)
        .unionByName(rest)
        .select(F.col("id").alias(id_column), "n_features", "weight", "score", "rank")
    )
