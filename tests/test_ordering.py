"""Global ranks against a sort on the driver."""

import random

from pyspark.sql import functions as F

from tracelight.operators.ordering import ranked


def test_ranked(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, 1, 2, 3, 50]), rng.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, a int, b double").repartition(6)
    got = ranked(df, F.desc_nulls_last("a"), F.asc("id"))
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [r["id"] for r in sorted(got.collect(), key=lambda r: r["rank"])] == [r[0] for r in want]
    assert sorted(r["rank"] for r in got.collect()) == list(range(1, 3001))


def test_equal_rows_are_spread(spark):
    df = spark.range(20_000).select(F.lit(7).alias("a"))
    got = ranked(df, F.asc("a"), name="n")
    spread = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) > 4 and max(r["count"] for r in spread) < 6000
    assert got.select("n").distinct().count() == 20_000 == got.agg(F.max("n")).first()[0]


def test_empty(spark):
    assert ranked(spark.createDataFrame([], "a int"), F.asc("a")).count() == 0
