"""The streaming sweep against passes that run over the whole tables at each moment."""

import random
from datetime import datetime, timedelta

from tracelight.streaming import jobs, retention
from tracelight.streaming.retention import DAY, Policy

T0 = datetime(2024, 1, 1)
ITEMS = (
    "item_id long, created_at timestamp, retention_at timestamp, deleted_at timestamp, "
    "kept_at timestamp, purged_at timestamp, arrived timestamp"
)
CALLS = "call_id long, created_at timestamp, payload string, arrived timestamp"
POLICY = Policy(payload_days=5, item_days=20, grace_days=7)


def us(at):
    return None if at is None else round((at - datetime(1970, 1, 1)).total_seconds() * 1_000_000)


def test_several_triggers(spark, tmp_path):
    rng = random.Random(1)
    days = [0, 3, 9, 9.5, 27, 40, 60]  # the moments of the sweeps
    moments = [T0 + timedelta(days=d) for d in days]
    batches, known = [], {}
    for k, now in enumerate(moments):
        items, calls = [], []
        for i in range(12):
            created = now - timedelta(hours=rng.randrange(0, 24 * 30))
            kept = created if rng.random() < 0.2 else None
            gone = created + timedelta(days=1) if rng.random() < 0.2 else None
            items.append((100 * k + i, created, created + timedelta(days=2), gone, kept, None, now))
            calls.append((100 * k + i, created, rng.choice(["x", None]), now))
        if k:  # an item of the batch before is kept, another one deleted
            a, b = (known[100 * (k - 1) + i] for i in (0, 1))
            items += [(*a[:4], now, *a[5:6], now), (*b[:3], now, *b[4:6], now)]
        known |= {r[0]: r for r in items}
        batches.append((items, calls))
    for k, (items, calls) in enumerate(batches):
        spark.createDataFrame(items, ITEMS).coalesce(1).write.parquet(f"{tmp_path}/items/{k}")
        spark.createDataFrame(calls, CALLS).coalesce(1).write.parquet(f"{tmp_path}/calls/{k}")

    def stream(name, schema):
        reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
        return reader.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/{name}")

    rows = retention.retained(stream("items", ITEMS), stream("calls", CALLS))
    out = jobs.run_available(retention.stream_sweep(rows, POLICY), f"{tmp_path}/out")
    got = {(r["step"], r["id"], r["swept_us"]) for r in out.collect()}

    def first(state, now):  # content, then payloads, then retirement, then removal
        taken = set()
        for key, s in list(state.items()):
            if key[0] == "item" and s["deleted"] is None and s["kept"] is None and s["purged"] is None and s["retention"] <= now:
                s["purged"] = now
                taken.add((1, key[1], now))
            if key[0] == "call" and s["payload"] and s["created"] < now - 5 * DAY:
                s["payload"] = False
                taken.add((2, key[1], now))
            if key[0] == "item" and s["deleted"] is None and s["created"] < now - 20 * DAY:
                s["deleted"] = now
                taken.add((3, key[1], now))
            if key[0] == "item" and s["deleted"] is not None and s["deleted"] < now - 7 * DAY:
                del state[key]
                taken.add((4, key[1], now))
        return taken

    state, want = {}, set()
    for (items, calls), at in zip(batches, moments, strict=True):
        for i, created, keep_until, gone, kept, purged, _ in items:
            state["item", i] = {
                "created": us(created), "retention": us(keep_until), "deleted": us(gone),
                "kept": us(kept), "purged": us(purged),
            }
        for i, created, payload, _ in calls:
            state["call", i] = {"created": us(created), "payload": payload is not None}
        want |= first(state, us(at))
    assert sorted(got - want) == sorted(want - got)
    assert {step for step, _, _ in got} == {1, 2, 3, 4} and len({now for _, _, now in got}) > 4
