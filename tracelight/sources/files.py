"""Reading files, checking them, and replacing or merging stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Leading bytes, in hex, per image format.
MAGIC = {"JPEG": ["FFD8FF"], "PNG": ["89504E470D0A1A0A"], "TIFF": ["49492A00", "4D4D002A"]}


def sniff_format(content: Column) -> Column:
    """Image format from the leading bytes only; null for anything else."""
    head = F.hex(F.substring(content, 1, 12))
    out = F.when(
        head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "WEBP"
    )
    for name, prefixes in MAGIC.items():
        out = out.when(reduce(Column.__or__, [head.startswith(p) for p in prefixes]), name)
    return out


def ingest_files(spark: SparkSession, path: str, max_bytes: int = 20 * 1024 * 1024) -> DataFrame:
    """(path, size, format, sha256, md5, reason): one row per file, rejected ones with a reason.

    Oversize files are judged from the listing: the size filter is pushed into the file source, so
    their bytes are never read.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = sniff_format(F.col("content"))
    read = raw.filter(F.col("length") <= max_bytes).select(
        "path",
        F.col("length").alias("size_bytes"),
        kind.alias("format"),
        F.sha2("content", 256).alias("sha256"),
        F.md5("content").alias("md5"),
        F.when(F.col("length") == 0, "EMPTY").when(kind.isNull(), "UNSUPPORTED").alias("reason"),
    )
    none = F.lit(None).cast("string")
    skipped = raw.filter(F.col("length") > max_bytes).select(
        "path",
        F.col("length").alias("size_bytes"),
        none.alias("format"),
        none.alias("sha256"),
        none.alias("md5"),
        F.lit("TOO_LARGE").alias("reason"),
    )
    return read.unionByName(skipped)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, valid_utf8): whole text files; undecodable bytes become U+FFFD."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    body = F.col("content").cast("string")
    return raw.select(
        "path", F.make_valid_utf8(body).alias("text"), F.is_valid_utf8(body).alias("valid_utf8")
    )


def verify_integrity(stored: DataFrame, records: DataFrame, key: str = "item_id") -> DataFrame:
    """(key, problem): MISSING, UNRECORDED, HASH_MISMATCH or BAD_ENCODING.

    ``stored`` (key, content), ``records`` (key, sha256).
    """
    held = stored.select(key, F.sha2("content", 256).alias("_have"), F.is_valid_utf8("content").alias("_utf8"), F.lit(True).alias("_stored"))
    known = records.select(key, "sha256", F.lit(True).alias("_known"))
    problem = (
        F.when(F.col("_stored").isNull(), "MISSING")
        .when(F.col("_known").isNull(), "UNRECORDED")
        .when(F.col("_have") != F.col("sha256"), "HASH_MISMATCH")
        .when(~F.col("_utf8"), "BAD_ENCODING")
    )
    return (
        held.join(known, key, "full")
        .withColumn("problem", problem)
        .filter(F.col("problem").isNotNull())
        .select(key, "problem")
    )


def replace_by_key(existing: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """All rows of a key that has fresh rows are replaced; running it twice changes nothing."""
    kept = existing.join(fresh.select(key).distinct(), key, "left_anti")
    return kept.unionByName(fresh.select(*existing.columns))


def write_replacing(fresh: DataFrame, path: str, *partition_by: str) -> None:
    """Replaces exactly the partitions that ``fresh`` holds, leaving all others alone."""
    (
        fresh.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def merge_columns(existing: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Column-wise upsert: what the patch does not know stays as it was."""
    columns = [c for c in dict.fromkeys([*existing.columns, *patch.columns]) if c != key]
    joined = existing.alias("e").join(patch.alias("p"), key, "full")

    def merged(c: str) -> Column:
        sides = [F.col(f"p.{c}")] * (c in patch.columns) + [F.col(f"e.{c}")] * (c in existing.columns)
        return F.coalesce(*sides).alias(c)

    return joined.select(key, *[merged(c) for c in columns])
