"""Benchmark decontamination (operator 6): winnowing (Schleimer, Wilkerson and Aiken, 2003).

Of every ``WINDOW - GRAM + 1`` consecutive hashes of ``GRAM``-word grams the smallest is kept (the
last of equal ones). Any ``WINDOW`` words that a document shares with an item hold one whole such
window in both, so both keep the same hash at the same place: every shared span of ``WINDOW``
words leaves a common fingerprint. Hits are extended word by word, so the result is exact.

Fingerprints stay inside the document's row until a bitmap of the benchmark's hashes has dropped
nearly all; only the rest are exploded, with the words around them, and joined. Items shorter than
a window are matched whole, by a hash of all their words.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelight.functions.columns import indexes, let
from tracelight.llm.common import stored

WINDOW, GRAM = 10, 5
SPAN = WINDOW - GRAM  # words on each side of a gram that a window around it can reach
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What lies between words, before A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
MAX_BITS = 22  # the bitmap has at most 2^22 places, half a megabyte


def words_of(text: Column) -> Column:
    """Words of ``text`` with A-Z lower-cased; other letters stay as they are."""
    found = F.filter(F.split(F.coalesce(text, F.lit("")), BETWEEN), lambda w: w != "")
    return F.transform(
        found,
        lambda w: F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(
            F.translate(w, UPPER, LOWER)
        ),
    )


def gram_hash(words: Column, i: Column, n: int) -> Column:
    """31-bit hash of ``n`` words from place ``i``."""
    return F.shiftrightunsigned(F.xxhash64(*[F.get(words, i + k) for k in range(n)]), 33)


def fingerprints(words: Column) -> Column:
    """Winnowed grams as longs: hash in the upper bits, place (counted down) in the lower 31."""
    last = (1 << 31) - 1

    def select(marked: Column) -> Column:
        each = F.transform(
            indexes(F.size(marked) - SPAN),
            lambda j: F.least(*[F.get(marked, j + k) for k in range(SPAN + 1)]),
        )
        return F.array_distinct(each)

    marked = F.transform(
        indexes(F.size(words) - (GRAM - 1)),
        lambda i: F.shiftleft(gram_hash(words, i, GRAM), 31) + (F.lit(last).cast("long") - i),
    )
    return let(marked, select)


def hash_of(mark: Column) -> Column:
    return F.shiftrightunsigned(mark, 31)


def place_of(mark: Column) -> Column:
    last = (1 << 31) - 1
    return (F.lit(last).cast("long") - mark.bitwiseAND(F.lit(last).cast("long"))).cast("int")


def bitmap(hashes: DataFrame) -> tuple[list[int], int]:
    """(words of 32 bits, bits) over the column ``h``: 128 places a hash, at most 2^MAX_BITS."""
    bits = min(MAX_BITS, max(10, (128 * max(1, hashes.count())).bit_length()))
    place = F.col("h") % (1 << bits)
    rows = (
        hashes.select((place / 32).cast("int").alias("w"), (place % 32).cast("int").alias("b"))
        .groupBy("w")
        .agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("mask"))
        .collect()
    )
    words = [0] * (1 << (bits - 5))
    for r in rows:
        words[r["w"]] = r["mask"]
    return words, bits


def in_bitmap(h: Column, words: list[int], bits: int) -> Column:
    """Whether the place of ``h`` is set; the bitmap is one constant array of the plan."""
    table = F.from_json(F.lit(json.dumps(words)), "array<bigint>")
    place = h % (1 << bits)
    mask = F.get(table, (place / 32).cast("int"))
    return F.call_function("shiftright", mask, (place % 32).cast("int")).bitwiseAND(F.lit(1)) == 1


def context(words: Column, at: Column) -> Column:
    """The words up to SPAN before and after the gram at ``at``."""
    start = F.greatest(at - SPAN, F.lit(0))
    return F.slice(words, start + 1, at - start + GRAM + SPAN)


def same_words(a: Column, b: Column, steps: int, sign: int, size_a: Column, size_b: Column) -> Column:
    """How many of the next ``steps`` words before (-1) or after (1) both grams agree in a row."""
    run, going = F.lit(0), F.lit(True)
    for k in range(1, steps + 1):
        i, j = (size_a - k, size_b - k) if sign < 0 else (size_a + GRAM - 1 + k, size_b + GRAM - 1 + k)
        going = going & F.coalesce(F.get(a, i) == F.get(b, j), F.lit(False))
        run = run + going.cast("int")
    return run


def window_hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, length): spans of documents that hold windows of long items."""
    marks = (
        items.filter(F.size("words") >= WINDOW)
        .select("item_id", "words", F.explode(fingerprints(F.col("words"))).alias("mark"))
        .select(
            "item_id",
            hash_of(F.col("mark")).alias("h"),
            context(F.col("words"), place_of(F.col("mark"))).alias("item_words"),
            F.least(place_of(F.col("mark")), F.lit(SPAN)).alias("item_before"),
        )
    )
    marks = stored(marks)
    if marks.isEmpty():
        return no_hits(docs.sparkSession)
    masks, bits = bitmap(marks.select("h").distinct())
    near = F.filter(fingerprints(F.col("words")), lambda m: in_bitmap(hash_of(m), masks, bits))
    packed = F.transform(
        near,
        lambda m: F.struct(
            hash_of(m).alias("h"),
            place_of(m).alias("at"),
            context(F.col("words"), place_of(m)).alias("words"),
        ),
    )
    found = docs.select("doc_id", F.inline(packed)).join(marks, "h")
    before = F.least(F.col("at"), F.lit(SPAN))
    item_before = F.col("item_before")
    a, b = F.col("words"), F.col("item_words")
    gram = F.slice(a, before + 1, GRAM) == F.slice(b, item_before + 1, GRAM)
    left = same_words(a, b, SPAN, -1, before, item_before)
    right = same_words(a, b, SPAN, 1, before, item_before)
    spans = found.filter(gram).select(
        "doc_id", "item_id", (F.col("at") - left).alias("start"), (left + GRAM + right).alias("length")
    )
    return spans.filter(F.col("length") >= WINDOW)


def no_hits(spark: SparkSession) -> DataFrame:
    kinds = {"doc_id": "long", "item_id": "long", "start": "int", "length": "int"}
    return spark.range(0).select(*[F.col("id").cast(k).alias(n) for n, k in kinds.items()])


def short_hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Spans of documents that equal a whole item of fewer than WINDOW words."""
    short = items.filter((F.size("words") > 0) & (F.size("words") < WINDOW))
    out = no_hits(docs.sparkSession)
    for (n,) in sorted(short.select(F.size("words")).distinct().collect()):  # at most 9 lengths
        own = stored(
            short.filter(F.size("words") == n).select(
                "item_id", gram_hash(F.col("words"), F.lit(0), n).alias("h"), "words"
            )
        )
        masks, bits = bitmap(own.select("h").distinct())
        found = docs.select("doc_id", F.inline(short_grams(n, masks, bits)))
        same = found.join(own.withColumnRenamed("words", "item_words"), "h")
        out = out.unionByName(
            same.filter(F.col("item_words") == F.col("words")).select(
                "doc_id", "item_id", F.col("at").alias("start"), F.lit(n).alias("length")
            )
        )
    return out


def short_grams(n: int, masks: list[int], bits: int) -> Column:
    words = F.col("words")
    hashed = F.transform(
        indexes(F.size(words) - (n - 1)),
        lambda i: F.struct(gram_hash(words, i, n).alias("h"), i.alias("at")),
    )
    return F.transform(
        F.filter(hashed, lambda g: in_bitmap(g["h"], masks, bits)),
        lambda g: F.struct(g["h"], g["at"], F.slice(words, g["at"] + 1, n).alias("words")),
    )


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) of every document.

    A word is hit if it lies inside an occurrence of WINDOW consecutive words of an item, or of a
    whole shorter item. Null text has no words. Rows that share an id are one document for hits;
    each keeps its own n_words. An empty benchmark leaves every document clean. A document
    whose id is null has no hits; an item whose id is null is not looked for.
    """
    texts = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), words_of(F.col(text_column)).alias("words")
    )
    wanted = stored(
        items.filter(F.col(item_column).isNotNull()).select(
            F.col(item_column).cast("long").alias("item_id"),
            words_of(F.col(item_text_column)).alias("words"),
        )
    )
    known = texts.filter("doc_id IS NOT NULL")
    hits = stored(
        window_hits(known, wanted).unionByName(short_hits(known, wanted)).distinct()
    )
    words = (
        hits.select("doc_id", F.explode(F.sequence("start", F.expr("start + length - 1"))).alias("at"))
        .distinct()
        .groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("n_hit"))
    )
    names = F.array_sort(F.collect_set(F.col("item_id").cast("string")))
    found = stored(
        hits.select("doc_id", "item_id")
        .distinct()
        .groupBy("doc_id")
        .agg(names.alias("names"))
        .join(words, "doc_id")
    )
    counted = texts.select("doc_id", F.size("words").cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0))
    listed = F.coalesce(F.array_join("names", ","), F.lit(""))
    return counted.join(found, "doc_id", "left").select(
        F.col("doc_id").alias(id_column),
        "n_words",
        n_hit.alias("n_hit"),
        F.greatest(F.size(F.coalesce("names", F.array().cast("array<string>"))), F.lit(0))
        .cast("long")
        .alias("n_items"),
        F.sha2(listed.cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
