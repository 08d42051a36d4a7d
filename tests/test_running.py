"""Scans over ranges and the expiring cache against folds, with a key that holds most rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracelight.operators import ledger
from tracelight.operators.ordering import placed
from tracelight.operators.running import first_n_cutoff, nearest_known, previous_value, running_before

T0 = datetime(2024, 1, 1)


def calls(seed, n=1200):
    rng = random.Random(seed)
    keys = ["hot"] * 6 + ["a", "b", "c", None]
    return [
        (i, rng.choice(keys), T0 + timedelta(hours=rng.randrange(0, 2400, 6)), rng.random() < 0.7)
        for i in range(n)
    ]


def fold(rows, ttl):
    """The cache itself, call by call."""
    out, until = {}, {}
    for call_id, key, at, kept in sorted(rows, key=lambda r: (r[2], r[0])):
        free = key is not None and key in until and at < until[key]
        out[call_id] = free
        if not free and kept and key is not None:
            until[key] = at + ttl
    return out


@pytest.mark.parametrize("hours", [1, 6, 30, 24 * 7, 24 * 400])
def test_cache_expires(spark, hours):
    rows = calls(hours)
    df = spark.createDataFrame(rows, "call_id long, content_key string, created_at timestamp, ok boolean")
    df = df.withColumn("cost", F.lit(2).cast("decimal(12,6)"))
    got = ledger.dedupe_requests(df, hours * 3600, F.col("ok")).collect()
    want = fold(rows, timedelta(hours=hours))
    assert {r["call_id"]: r["cached"] for r in got} == want and len(got) == len(rows)
    assert all(r["charged"] == (0 if r["cached"] else 2) for r in got)
    paid = sum(not free for (i, key, _, _), free in zip(rows, map(want.get, range(len(rows)))) if key == "hot")
    assert paid > (1 if hours == 24 * 400 else 10) or hours == 24 * 400


def test_no_calls(spark):
    empty = spark.createDataFrame(
        [], "call_id long, content_key string, created_at timestamp, cost decimal(12,6)"
    )
    assert ledger.dedupe_requests(empty).count() == 0


def test_scans(spark):
    rows = [(i, k, t, i % 7 if i % 3 else None) for i, k, t, _ in calls(5)]
    df = spark.createDataFrame(rows, "id long, key string, ts timestamp, v long")
    before, last, prev, counts = {}, {}, {}, {}
    total, known, value, cut = {}, {}, {}, {}
    for i, k, t, v in sorted(rows, key=lambda r: (r[2], r[0])):
        before[i], last[i], prev[i] = total.get(k, 0), known.get(k), value.get(k)
        total[k] = total.get(k, 0) + (v or 0)
        value[k] = v
        known[k] = v if v is not None else known.get(k)
        counts[k] = counts.get(k, 0) + 1
        if counts[k] == 50:
            cut[k] = (t, i)
    got = running_before(df, ["key"], "ts", "id", F.coalesce("v", F.lit(0)), "x").collect()
    assert {r["id"]: r["x"] for r in got} == before
    got = nearest_known(df, ["key"], ["ts", "id"], F.col("v"), "x").collect()
    assert {r["id"]: r["x"] for r in got} == last
    got = previous_value(df, ["key"], "ts", "id", "v", "x").collect()
    assert {r["id"]: r["x"] for r in got} == prev
    got = first_n_cutoff(df, ["key"], "ts", "id", 50).collect()
    assert {r["key"]: tuple(r["cutoff"]) for r in got} == cut


def test_a_hot_day_is_spread(spark):
    """One owner's rows of one day, a third of all, lie in ranges of about equal size."""
    n = 60_000
    hot = F.col("id") % 3 == 0
    df = spark.range(n).select(
        F.when(hot, F.lit(-1)).otherwise(F.col("id") % 5000).alias("owner"),
        (F.lit(T0).cast("timestamp") + F.make_interval(secs=F.col("id") % 86_400)).alias("ts"),
        "id",
    )
    sizes = [r["count"] for r in placed(df, "owner", "ts", "id").groupBy("_part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * sorted(sizes)[4]
