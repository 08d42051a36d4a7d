"""Global order of a table without one task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tracelight.session import cut_lineage


def placed(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` in ranges of ``order`` of about equal row counts, stored: ``_part`` numbers the
    range, ``_at`` the row, both rising with the order.

    Rows that tie are spread over ranges, too, so a value that a third of all rows hold is not one
    task's work; which of them comes first is not defined.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = df.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
    return cut_lineage(
        salted.repartitionByRange(parts, *order, "_tie")
        .sortWithinPartitions(*order, "_tie")
        .drop("_tie")
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", 33))
    )


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """``df`` with ``name``: 1 for the first row in ``order``, 2 for the next, and so on.

    Rows are numbered in the task that holds their range; the rows of the ranges before, one
    number a task, are then added. End ``order`` with a key where the order of ties matters.
    """
    rows = placed(df, *order)
    # one row a task of the sort, whatever the table's size
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    so_far = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(so_far), F.lit(0)).alias("_before"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        rows.join(F.broadcast(before), "_part")
        .withColumn(name, F.col("_before") + place + 1)
        .drop("_part", "_at", "_before")
    )
