import random
from datetime import datetime, timedelta

from tracelight.streaming import jobs

START = datetime(2024, 1, 1)
SCHEMA = "key long, event_id long, ts timestamp, success boolean"


def fold(rows, limit, seconds):
    hits, out = {}, {}
    for t, i, k, success in sorted(rows):
        kept = [h for h in hits.get(k, []) if h > t - timedelta(seconds=seconds)]
        allowed = len(kept) < limit
        wait = 0 if allowed else -(-((kept[0] - t) // timedelta(microseconds=1) + seconds * 10**6) // 10**6)
        out[i] = (allowed, max(limit - len(kept), 0), wait)
        hits[k] = [] if allowed and success else kept + [t] * allowed
    return out


def test_files_out_of_order_and_a_restart_equal_the_fold(spark, tmp_path):
    """Attempts up to 100 s out of order over five micro-batches; the closing run is a restart."""
    rng = random.Random(5)
    rows = [
        (START + timedelta(microseconds=rng.randrange(600 * 10**6)), i, rng.randrange(3), rng.random() < 0.05)
        for i in range(250)
    ]
    rows += [(rows[0][0], 250, rows[0][2], False)]  # two attempts of one moment
    # a file holds attempts that arrive up to 100 s after they were made
    arrival = sorted(rows, key=lambda r: r[0] + timedelta(seconds=rng.randrange(100)))
    source = str(tmp_path / "in")
    size = -(-len(arrival) // 5)
    for start in range(0, len(arrival), size):
        part = [(k, i, t, s) for t, i, k, s in arrival[start : start + size]]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    out = jobs.limited_to_the_end(stream, str(tmp_path / "out"), 3, 60, "200 seconds").collect()
    got = {r.event_id: (r.allowed, r.remaining, r.retry_after) for r in out}
    assert len(out) == len(rows) and got == fold(rows, 3, 60)
    assert len({r.batch for r in out}) > 2  # released as the watermark moves, not all at the end
    assert any(not allowed for allowed, _, _ in got.values())


def test_attempts_behind_the_watermark_are_dropped(spark, tmp_path):
    on_time = [(START + timedelta(seconds=s), s, 1, False) for s in (0, 10, 500, 505)]
    late = (START + timedelta(seconds=5), 99, 1, False)
    source = str(tmp_path / "in")
    # the second file lets the watermark of the first take effect
    for part in (on_time[:3], on_time[3:], [late]):
        spark.createDataFrame([(k, i, t, s) for t, i, k, s in part], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    out = jobs.limited_to_the_end(stream, str(tmp_path / "out"), 2, 60, "20 seconds").collect()
    assert {r.event_id: (r.allowed, r.remaining, r.retry_after) for r in out} == fold(on_time, 2, 60)


def test_an_empty_stream_has_no_decisions(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([], SCHEMA).write.parquet(source)
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    assert jobs.limited_to_the_end(stream, str(tmp_path / "out"), 2, 60, "1 day").count() == 0
