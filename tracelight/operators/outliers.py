"""Outliers inside groups of a measure, by deviation or by order statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tracelight.session import cut_lineage


def _judge(
    df: DataFrame, group: list[str], eligible: Column, outlier: Column, low: float, high: float
) -> DataFrame:
    """Adds ``outlier``, the group's ``share`` of outliers and ``flagged`` (share within the gate).

    ``df`` is a join on the group. Grouping by a struct does not reuse its partitioning, so a hot
    group's join stays free to be split; the stored shares keep the second join so too.
    """
    marked = df.withColumn("outlier", F.coalesce(eligible & outlier, F.lit(False)))
    share = F.count_if("outlier") / F.count(F.lit(1))
    shares = cut_lineage(
        marked.groupBy(F.struct(*group).alias("_g")).agg(share.alias("share")).select("_g.*", "share")
    )
    return marked.join(shares, group).withColumn("flagged", F.col("share").between(low, high))


def sigma_outliers(
    df: DataFrame, group: str, value: str, k: float = 2.5, floor: float = 4.0,
    low: float = 0.005, high: float = 0.2,
) -> DataFrame:
    """Values above the group's mean + k population deviations *and* above ``floor``.

    Statistics are one combined aggregation per group, stored; rows meet them by an equi-join of
    two shuffled tables, whose hot groups adaptive execution can split.
    """
    stats = cut_lineage(
        df.groupBy(group).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sigma"))
    )
    joined = df.join(stats, group)
    above = (F.col(value) > F.col("_mean") + k * F.col("_sigma")) & (F.col(value) > floor)
    return _judge(joined, [group], F.lit(True), above, low, high).drop("_mean", "_sigma")


def group_quantiles(
    df: DataFrame, group: str, value: str, probabilities: dict[str, float], bins: int = 1024
) -> DataFrame:
    """Exact interpolated quantiles per group, one column each.

    A ``percentile`` aggregate keeps all distinct values of a group in one buffer. Here values are
    counted first, laid into bins, and only the bins that hold a wanted rank are ordered.
    """
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(group, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    span = counted.groupBy(group).agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("_total")
    )
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("_v") - F.col("_lo")) / width))).otherwise(0)
    binned = counted.join(span, group).withColumn("_bin", place)
    before = Window.partitionBy(group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        binned.groupBy(group, "_bin")
        .agg(F.sum("_n").alias("_size"), F.first("_total").alias("_total"))
        .withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    )
    wanted = F.array(
        *[
            F.struct(F.lit(name).alias("q"), side(F.lit(p) * (F.col("_total") - 1)).cast("long").alias("r"), F.lit(end).alias("end"))
            for name, p in probabilities.items()
            for end, side in (("lo", F.floor), ("hi", F.ceil))
        ]
    )
    targets = (
        sizes.withColumn("t", F.explode(wanted))
        .filter((F.col("t.r") >= F.col("_before")) & (F.col("t.r") < F.col("_before") + F.col("_size")))
        .select(group, "_bin", "_before", "_total", "t.*")
    )
    inside = Window.partitionBy(group, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    needed = targets.select(group, "_bin", "_before").distinct()
    ordered = (
        binned.drop("_total")
        .join(needed, [group, "_bin"])
        .withColumn("_upto", F.col("_before") + F.sum("_n").over(inside))
        .withColumn("_from", F.col("_upto") - F.col("_n"))
    )
    found = (
        targets.drop("_before")
        .join(ordered.select(group, "_bin", "_v", "_from", "_upto"), [group, "_bin"])
        .filter((F.col("r") >= F.col("_from")) & (F.col("r") < F.col("_upto")))
    )

    def pick(name: str, end: str) -> Column:
        return F.max(F.when((F.col("q") == name) & (F.col("end") == end), F.col("_v")))

    columns = []
    for name, p in probabilities.items():
        exact = F.lit(p) * (F.first("_total") - 1)
        part = exact - F.floor(exact)
        lo, hi = pick(name, "lo"), pick(name, "hi")
        columns.append((lo + (hi - lo) * part).alias(name))
    return found.groupBy(group).agg(*columns)


def robust_outliers(
    df: DataFrame, group: str, value: str, k: float = 3.0, floor: float = 1.0,
    low: float = 0.005, high: float = 0.25,
) -> DataFrame:
    """Values further from the group's median than max(k x IQR, floor, half the median)."""
    quartiles = {"_q1": 0.25, "_median": 0.5, "_q3": 0.75}
    stats = cut_lineage(group_quantiles(df, group, value, quartiles))
    joined = df.join(stats, group)
    limit = F.greatest(
        k * (F.col("_q3") - F.col("_q1")), F.lit(floor), 0.5 * F.col("_median")
    )
    far = F.abs(F.col(value) - F.col("_median")) > limit
    return _judge(joined, [group], F.lit(True), far, low, high).drop("_q1", "_q3").withColumnRenamed(
        "_median", "median"
    )
