import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracelight.operators import ledger, running
from tracelight.sources import files
from tracelight.streaming import jobs

START = datetime(2024, 1, 1)


def activity(spark, n=600, owners=3):
    """One owner holds most rows, as a busy account would."""
    rng = random.Random(7)
    rows = [
        (rng.choice([1] * 8 + list(range(2, 2 + owners))), i, START + timedelta(minutes=rng.randrange(60 * 24 * 9)), rng.randrange(1, 90))
        for i in range(n)
    ]
    return rows, spark.createDataFrame(rows, "owner long, item_id long, ts timestamp, bytes long")


def test_storage_decisions_follow_the_sequential_rule(spark):
    rows, df = activity(spark)
    used, want = {}, {}
    for owner, item, _, size in sorted(rows, key=lambda r: (r[2], r[1])):
        want[item] = used.get(owner, 0) + size <= 400
        used[owner] = used.get(owner, 0) + size * want[item]
    got = {r.item_id: r.accepted for r in ledger.storage_breaches(df, 400).collect()}
    assert got == want


def test_running_sums_and_previous_values_cross_buckets(spark):
    rows, df = activity(spark)
    got = {r.item_id: (r.before, r.prev) for r in running.previous_value(
        running.running_before(df, ["owner"], "ts", "item_id", F.col("bytes"), "before"),
        ["owner"], "ts", "item_id", "bytes", "prev").collect()}
    total, last, want = {}, {}, {}
    for owner, item, _, size in sorted(rows, key=lambda r: (r[2], r[1])):
        want[item] = (total.get(owner, 0), last.get(owner))
        total[owner], last[owner] = total.get(owner, 0) + size, size
    assert got == want


def test_window_edges_are_half_open(spark):
    times = [0, 59, 60, 61]
    df = spark.createDataFrame([(1, i, START + timedelta(seconds=s)) for i, s in enumerate(times)], "key long, i long, ts timestamp")
    got = {r.i: r.n for r in running.count_in_window(df, ["key"], "ts", 60, "n").collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 2}


def test_stream_limiter_equals_a_fold(spark, tmp_path):
    rng = random.Random(2)
    rows = sorted((START + timedelta(seconds=rng.randrange(4000)), i, rng.randrange(4), rng.random() < 0.05) for i in range(400))
    source = str(tmp_path / "in")
    spark.createDataFrame(
        [(k, i, t, s) for t, i, k, s in rows], "key long, event_id long, ts timestamp, success boolean"
    ).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("key long, event_id long, ts timestamp, success boolean").parquet(source)
    out = jobs.run_available(jobs.stream_limiter(stream, 3, 60), str(tmp_path / "out"))
    hits, want = {}, {}
    for t, i, k, success in rows:
        kept = [h for h in hits.get(k, []) if h > t - timedelta(seconds=60)]
        allowed = len(kept) < 3
        want[i] = allowed
        hits[k] = [] if allowed and success else kept + [t] * allowed
    assert {r.event_id: r.allowed for r in out.collect()} == want


def test_unlimited_reads_as_null(spark):
    usage = spark.createDataFrame([(1, 5, 2.5)], "owner long, analyses_count long, call_cost double")
    storage = spark.createDataFrame([], "owner long, total_bytes long")
    row = ledger.usage_status(usage, storage, 0, 10, 2).first()
    assert (row.analyses_remaining, row.storage_remaining, row.budget_remaining) == (None, 10, 0)


def test_replace_twice_changes_nothing(spark):
    old = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string")
    new = spark.createDataFrame([(1, "z")], "k long, v string")
    once = files.replace_by_key(old, new, "k")
    twice = files.replace_by_key(once, new, "k")
    assert sorted(once.collect()) == sorted(twice.collect()) == [(1, "z"), (2, "c")]


def test_partition_replacement_leaves_others_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    files.write_replacing(spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), path, "k")
    files.write_replacing(spark.createDataFrame([(2, "c")], "k long, v string"), path, "k")
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]


@pytest.mark.parametrize(
    ("head", "kind"),
    [
        (b"\xff\xd8\xff\xe0", "JPEG"),
        (b"\x89PNG\r\n\x1a\n....", "PNG"),
        (b"II*\x00", "TIFF"),
        (b"RIFF1234WEBP", "WEBP"),
        (b"RIFF1234WAVE", None),
        (b"GIF89a", None),
    ],
)
def test_formats_by_leading_bytes(spark, tmp_path, head, kind):
    (tmp_path / "f.bin").write_bytes(head + b"rest")
    row = files.ingest_files(spark, str(tmp_path)).first()
    assert (row.format, row.reason) == (kind, None if kind else "UNSUPPORTED")
    big = files.ingest_files(spark, str(tmp_path), max_bytes=3).first()
    assert (big.reason, big.sha256) == ("TOO_LARGE", None)


def test_deep_pages(spark, monkeypatch):
    """Every page of a table is the same whether it is taken near or deep."""
    rows = [(i, 1, datetime(2024, 1, 1 + i % 7), None) for i in range(1, 301)]
    items = spark.createDataFrame(rows, "item_id long, owner long, created_at timestamp, deleted_at timestamp")
    near = [[r["item_id"] for r in ledger.page_items(items, p, 40).collect()] for p in (1, 4, 8, 9)]
    monkeypatch.setattr(ledger, "NEAR", 0)
    deep = [[r["item_id"] for r in ledger.page_items(items, p, 40).collect()] for p in (1, 4, 8, 9)]
    assert near == deep and [len(p) for p in near] == [40, 40, 20, 0]
