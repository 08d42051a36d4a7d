"""Ordered per-key calculations that do not put one key's whole history into one task.

A plain window partitions by key alone, so a key with a third of all rows is one task. Here rows
are dealt to ranges of (key, time) of about equal size, whatever key or day they hold; the fine
window runs per (key, range), and a small table, one row a key and range, carries what each range
must know about the ones before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tracelight.operators.ordering import placed


def joined(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of their key and range in ``table``; null keys are equal."""
    on = F.col("_part") == F.col("_part_of")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}_of"))
    named = table.withColumnsRenamed({c: f"_{c.strip('_')}_of" for c in (*keys, "_part")})
    return rows.join(named, on).drop("_part_of", *[f"_{k}_of" for k in keys])


def running_before(
    df: DataFrame, keys: list[str], ts: str, tie: str, value: Column, out: str
) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the key's earlier rows (0 for the first)."""
    rows = placed(df.withColumn("_v", value), *keys, ts, tie)
    totals = rows.groupBy(*keys, "_part").agg(F.sum("_v").alias("_s"))
    so_far = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(
        *keys, "_part", F.coalesce(F.sum("_s").over(so_far), F.lit(0)).alias("_base")
    )
    inside = (
        Window.partitionBy(*keys, "_part")
        .orderBy("_at")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    summed = rows.withColumn("_in", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    return (
        joined(summed, base, keys)
        .withColumn(out, F.col("_base") + F.col("_in"))
        .drop("_part", "_at", "_v", "_in", "_base")
    )


def highest_so_far(
    df: DataFrame, keys: list[str], order: list[str], value: str, out: str
) -> DataFrame:
    """Adds ``out``: the largest ``value`` of the key's rows up to this one in ``order``, null where
    none has one."""
    rows = placed(df, *keys, *order)
    tops = rows.groupBy(*keys, "_part").agg(F.max(value).alias("_top"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(*keys, "_part", F.max("_top").over(before).alias("_carry"))
    inside = (
        Window.partitionBy(*keys, "_part")
        .orderBy("_at")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = rows.withColumn("_in", F.max(value).over(inside))
    return (
        joined(found, carried, keys)
        .withColumn(out, F.greatest("_in", "_carry"))
        .drop("_part", "_at", "_in", "_carry")
    )


def nearest_known(
    df: DataFrame, keys: list[str], order: list[str], value: Column, out: str,
    following: bool = False,
) -> DataFrame:
    """Adds ``out``: of the key's rows before (or ``following``) in ``order``, the ``value`` of the
    nearest one that has one.

    Rows that follow are scanned backwards: a frame that ends with the key's last row would be
    summed up anew for every row.
    """
    rows = placed(df.withColumn("_v", value), *keys, *order)
    known = F.when(F.col("_v").isNotNull(), F.col("_at"))
    edge, way = (F.min_by, F.desc) if following else (F.max_by, F.asc)
    ends = rows.groupBy(*keys, "_part").agg(edge("_v", known).alias("_end"))

    def scan(*by: str, along: str):
        frame = Window.partitionBy(*by).orderBy(way(along))
        return frame.rowsBetween(Window.unboundedPreceding, -1)

    beyond, inside = scan(*keys, along="_part"), scan(*keys, "_part", along="_at")
    carried = ends.select(*keys, "_part", F.last("_end", ignorenulls=True).over(beyond).alias("_carry"))
    found = rows.withColumn("_in", F.last("_v", ignorenulls=True).over(inside))
    return (
        joined(found, carried, keys)
        .withColumn(out, F.coalesce("_in", "_carry"))
        .drop("_part", "_at", "_v", "_in", "_carry")
    )


def previous_value(
    df: DataFrame, keys: list[str], ts: str, tie: str, value: str, out: str
) -> DataFrame:
    """Adds ``out``: ``value`` of the key's previous row, null for its first."""
    held = nearest_known(df, keys, [ts, tie], F.struct(F.col(value).alias("v")), "_held")
    return held.withColumn(out, F.col("_held.v")).drop("_held")


def count_in_window(
    df: DataFrame, keys: list[str], ts: str, seconds: int, out: str
) -> DataFrame:
    """Adds ``out``: other rows of the key in (t - seconds, t].

    Every row also visits the next time bucket as context, so each bucket sees all it needs.
    """
    width = seconds * 1_000_000
    micros = F.unix_micros(F.col(ts))
    staged = df.withColumn("_t", micros).withColumn("_home", F.floor(F.col("_t") / width))
    placed = staged.withColumn(
        "_b", F.explode_outer(F.array(F.col("_home"), F.col("_home") + 1))
    )
    frame = Window.partitionBy(*keys, "_b").orderBy("_t").rangeBetween(-(width - 1), 0)
    return (
        placed.withColumn(out, F.count(F.lit(1)).over(frame) - 1)
        .filter(F.col("_b") == F.col("_home"))
        .drop("_t", "_home", "_b")
    )


def first_n_cutoff(
    df: DataFrame, keys: list[str], ts: str, tie: str, n: int
) -> DataFrame:
    """Per key, the (ts, tie) of its n-th earliest row; keys with fewer rows are absent.

    A key's rows are counted by range; only the range that holds the n-th row is looked into.
    """
    rows = placed(df.select(*keys, ts, tie), *keys, ts, tie)
    sizes = rows.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    so_far = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    wanted = (
        sizes.withColumn("_before", F.coalesce(F.sum("_n").over(so_far), F.lit(0)))
        .filter((F.col("_before") < n) & (F.col("_before") + F.col("_n") >= n))
        .select(*keys, "_part", "_before")
    )
    inside = Window.partitionBy(*keys, "_part").orderBy("_at")
    return (
        joined(rows, wanted, keys)
        .withColumn("_rn", F.row_number().over(inside))
        .filter(F.col("_before") + F.col("_rn") == n)
        .select(*keys, F.struct(ts, tie).alias("cutoff"))
    )
