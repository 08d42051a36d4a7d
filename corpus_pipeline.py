"""The corpus pipeline: stages on documents, each written as Parquet and read as the next one's.

Each stage returns the columns of documents, the last one token pieces with their sequences. A
document whose id is null passes every filter that goes by id; rows that share an id go together.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from tracelight.llm.common import delete, stored
from tracelight.llm.lsh_forest import near_duplicates
from tracelight.llm.packing import pack_documents
from tracelight.llm.quality_rules import judged, with_statistics
from tracelight.llm.secret_forest import redact_secrets
from tracelight.llm.winnowing import decontaminate
from tracelight.session import checkpoint_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that neither the base rules nor the learned list rejects (operator 4)."""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")
    measured = stored(with_statistics(rows).select("row", "doc_id", "stats"))
    return judged(measured, labels).filter("kept").select("row.*")


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    return docs.join(dropped.select("doc_id"), "doc_id", "left_anti").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest id (operator 9)."""
    return without(docs, stored(near_duplicates(docs).filter("NOT kept")))


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no window of a benchmark item (operator 6)."""
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    return without(docs, stored(decontaminate(docs, items).filter("contaminated")))


def secret_scans(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced (operator 8)."""
    clean = redact_secrets(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The kept documents as token sequences (operator 5)."""
    return pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: Learned rules, locality-sensitive hashing, a forest and a tokenizer are beyond SQL; the stages
#: are tested against plain-Python versions in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    place = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for number, (name, stage) in enumerate(STAGES):
        path = f"{place}/{number}-{name}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:  # the stage that read it has been written
            delete(spark, before)
        before = path
    return docs
