"""Retention as a stream: items and calls are kept as state, and a timer wakes them when the next
deadline passes, so a sweep touches the buckets in which something is due and nothing else.

The clock is the stream's event time: every row says when it ``arrived``, and the watermark, the
latest arrival, is the sweep's *now*. Rows that change an item (kept, deleted) replace its state
and move its timer. What falls due between two triggers is found by the later one.

State is dealt to buckets of items and calls by hash: a visit of the Python worker costs as much as
thousands of rows, so that a bucket's rows are one array, judged at once.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: State of a bucket: its rows (``HELD``) as bytes.
STATE = "rows binary"
#: A row of state, in microseconds; NONE where a moment has not come.
HELD = np.dtype(
    [("call", "?"), ("payload", "?")]
    + [(n, "<i8") for n in ("id", "arrived", "created", "retention", "deleted", "kept", "purged")]
)
NONE, NEVER = np.iinfo(np.int64).min, np.iinfo(np.int64).max
SWEPT = "step int, pass string, id bigint, swept_us bigint"
DAY = 86_400_000_000
NAMES = {1: "content_expired", 2: "payloads_purged", 3: "records_retired", 4: "records_purged"}


@dataclass
class Policy:
    """Days after which payloads go and records retire (0: never), and the grace of deleted ones."""

    payload_days: int
    item_days: int
    grace_days: int


def due(held: np.ndarray, step: int, policy: Policy) -> np.ndarray:
    """The first microsecond at which the pass takes each row, NEVER where it does not.

    No pass sees a row before it arrived.
    """
    item = ~held["call"]
    if step == 1:
        open_ = item & (held["deleted"] == NONE) & (held["kept"] == NONE) & (held["purged"] == NONE)
        since, wait = held["retention"], 0
    elif step == 2:
        open_ = held["call"] & held["payload"] & (policy.payload_days > 0)
        since, wait = held["created"], policy.payload_days * DAY + 1
    elif step == 3:
        open_ = item & (held["deleted"] == NONE) & (policy.item_days > 0)
        since, wait = held["created"], policy.item_days * DAY + 1
    else:
        open_ = item
        since, wait = held["deleted"], policy.grace_days * DAY + 1
    taken = open_ & (since != NONE)
    return np.where(taken, np.maximum(np.where(taken, since, 0) + wait, held["arrived"]), NEVER)


def sweep_bucket(
    held: np.ndarray, now: int, policy: Policy
) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The rows after a sweep at ``now``, without removed ones, and the ids that each pass took."""
    held, taken = held.copy(), []
    for step in NAMES:
        hit = due(held, step, policy) <= now
        taken.append((step, held["id"][hit]))
        if step == 1:
            held["purged"][hit] = now
        elif step == 2:
            held["payload"][hit] = False
        elif step == 3:
            held["deleted"][hit] = now
        else:
            held = held[~hit]
    return held, taken


def newest_rows(frames: Iterator[pd.DataFrame]) -> np.ndarray:
    """The row of every item and call that arrived last, as state."""
    parts = []
    for frame in frames:
        rows = np.empty(len(frame), HELD)
        rows["call"], rows["payload"] = frame["kind"] == "call", frame["payload"]
        rows["arrived"] = frame["arrived_us"]
        for name in HELD.names[2:]:
            if name != "arrived":
                rows[name] = frame[f"{name}_us"]
        parts.append(rows)
    rows = np.concatenate(parts)
    rows = rows[np.argsort(rows["arrived"], kind="stable")][::-1]
    return rows[np.sort(np.unique(rows[["call", "id"]], return_index=True)[1])]


def _sweeper(policy: Policy) -> StatefulProcessor:
    class Sweeper(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self._handle = handle
            self._rows = handle.getValueState("rows", STATE)

        def _held(self) -> np.ndarray:
            return np.frombuffer(self._rows.get()[0], HELD) if self._rows.exists() else np.empty(0, HELD)

        def _keep(self, held: np.ndarray) -> None:
            """Stores the rows and one timer, at their next deadline."""
            for at in list(self._handle.listTimers()):
                self._handle.deleteTimer(at)
            if not len(held):
                self._rows.clear()
                return
            self._rows.update((held.tobytes(),))
            first = min(int(due(held, step, policy).min()) for step in NAMES)
            if first < NEVER:
                self._handle.registerTimer(-(-first // 1000))

        def _swept(self, taken: list[tuple[int, np.ndarray]], now: int) -> Iterator[pd.DataFrame]:
            for step, ids in taken:
                if len(ids):
                    known = pd.array(ids, dtype="Int64")
                    known[ids == NONE] = pd.NA
                    yield pd.DataFrame({"step": step, "pass": NAMES[step], "id": known, "swept_us": now})

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            now = timerValues.getCurrentWatermarkInMs() * 1000
            # the sweep at the watermark was before these rows arrived
            held, taken = sweep_bucket(self._held(), now, policy)
            new = newest_rows(rows)
            if len(held):
                held = held[~np.isin(held[["call", "id"]], new[["call", "id"]])]
            self._keep(np.concatenate([held, new]))
            yield from self._swept(taken, now)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            now = timerValues.getCurrentWatermarkInMs() * 1000
            held, taken = sweep_bucket(self._held(), now, policy)
            self._keep(held)
            yield from self._swept(taken, now)

        def close(self) -> None:
            pass

    return Sweeper()


def retained(items: DataFrame, calls: DataFrame, arrived: str = "arrived") -> DataFrame:
    """One stream of items (item_id, created_at, retention_at, deleted_at, kept_at, purged_at) and
    calls (call_id, created_at, payload), both with the moment they ``arrived``."""

    def us(name: str):
        return F.unix_micros(F.col(name).cast("timestamp"))

    none = F.lit(None).cast("long")
    times = {"retention": "retention_at", "deleted": "deleted_at", "kept": "kept_at", "purged": "purged_at"}
    first = items.select(
        F.lit("item").alias("kind"), F.col("item_id").cast("long").alias("id"), F.col(arrived).alias("arrived"),
        us("created_at").alias("created"), *[us(c).alias(n) for n, c in times.items()], F.lit(False).alias("payload"),
    )
    second = calls.select(
        F.lit("call").alias("kind"), F.col("call_id").cast("long").alias("id"), F.col(arrived).alias("arrived"),
        us("created_at").alias("created"), *[none.alias(n) for n in times], F.col("payload").isNotNull().alias("payload"),
    )
    return first.unionByName(second)


def stream_sweep(rows: DataFrame, policy: Policy, buckets: int = 8192) -> DataFrame:
    """(step, pass, id, swept_us) of everything a pass has taken, each once, as it falls due.

    ``rows`` as of ``retained``. State is one small row an item or call, dealt to ``buckets`` by
    hash; a record that is purged leaves none. Of several rows of an item in one batch the one that
    arrived last counts. A stream keeps the number of buckets it began with.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    moments = ("id", "created", "retention", "deleted", "kept", "purged")
    known = [F.coalesce(F.col(n), F.lit(NONE)).alias(f"{n}_us") for n in moments]
    return (
        rows.withWatermark("arrived", "0 seconds")
        .select(
            F.pmod(F.xxhash64("kind", "id"), F.lit(buckets)).alias("bucket"), "kind", "payload",
            "arrived", F.unix_micros("arrived").alias("arrived_us"), *known,
        )
        .groupBy("bucket")
        .transformWithStateInPandas(
            statefulProcessor=_sweeper(policy),
            outputStructType=StructType.fromDDL(SWEPT),
            outputMode="Append",
            timeMode="EventTime",
        )
    )
