"""What the operators of this folder share: stored tables, shipping code to workers, splits."""

from __future__ import annotations

import gc
import sys
import types
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import SparkContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelight.session import checkpoint_folder

#: ASCII white space of the word contracts: space and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"


def ship(module: str) -> None:
    """Pickle this module's functions by value, so that workers need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def per_process(key: str, make: Callable[[], Any]) -> Any:
    """``make()`` once per Python worker, however many tasks it runs.

    A worker holds one such object at a time: workers outlive jobs, and what the operator before
    has left would add to the next one's memory.
    """
    name = "tracelight_llm_process"
    store = sys.modules.setdefault(name, types.ModuleType(name)).__dict__
    if key not in store:
        for other in [k for k in store if not k.startswith("__")]:
            del store[other]
        store[key] = make()
    return store[key]


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the cluster's shared checkpoint folder and read again.

    Cuts lineage, survives lost executors and is removed when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, folder: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target.getFileSystem(conf).delete(target, True)


def release(*tables: DataFrame) -> None:
    """Deletes ``stored`` tables that nothing will read again, and lets Spark's cleaner drop the
    shuffle files and checkpoints of steps that are done: it waits for the JVM's own collection,
    which a driver that only plans may not need for long."""
    for table in tables:
        for folder in {name.rpartition("/")[0] for name in table.inputFiles()}:
            if folder.rpartition("/")[2].startswith("table-"):
                delete(table.sparkSession, folder)
    gc.collect()
    SparkContext._active_spark_context._jvm.System.gc()


def sent(spark: SparkSession, *models: Any) -> Callable[[], list[Any]]:
    """A function that gives ``models`` (dataclass objects) in a task, broadcast as their fields.

    A broadcast names the classes of what it holds by module, which workers would have to import;
    plain fields need none, and the classes travel with the function that uses them.
    """
    held = spark.sparkContext.broadcast([tuple(vars(m).values()) for m in models])
    kinds = [type(m) for m in models]

    def received() -> list[Any]:
        return [kind(*fields) for kind, fields in zip(kinds, held.value, strict=True)]

    return received


def kind_of(batch: pa.RecordBatch, name: str) -> pa.DataType:
    return batch.schema.field(name).type


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5: the contracts' split; null ids are in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0))


def short_batches(
    batches: Iterator[pa.RecordBatch], column: str, chars: int = 4_000_000
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``chars`` bytes of text; a longer text comes alone."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        start = size = 0
        for i, n in enumerate(pa.compute.binary_length(texts).to_pylist()):
            if i > start and size + (n or 0) > chars:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n or 0
        if batch.num_rows > start:
            yield batch.slice(start)


def columns_of(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]
