"""Structured Streaming forms of the ledger and text jobs.

Every job reads new rows once, keeps bounded state (a watermark, a window or a limit) and writes
one folder per micro-batch, so a replayed batch overwrites itself.
"""

from __future__ import annotations

import sys
import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tracelight.operators.fingerprints import text_fingerprints
from tracelight.operators.text import admit_documents, normalize_corpus
from tracelight.streaming.keyed import KeyedTable
from tracelight.session import checkpoint_folder

# the limiter's code travels by value: workers need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def table_stream(
    spark: SparkSession, folder: str, name: str, files_per_trigger: int = 64
) -> DataFrame:
    """The parquet files of one table as a stream; the trigger bound also bounds what one key can
    bring into one micro-batch.

    The table is a folder of part files, or one file, which is picked out of its folder.
    """
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.getFileStatus(target).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def scratch(spark: SparkSession) -> str:
    """A new folder for sinks and offsets below the cluster's shared folder."""
    return f"{checkpoint_folder(spark).rstrip('/')}/stream-{uuid.uuid4()}"


def run_available(
    stream: DataFrame,
    folder: str,
    mode: str = "append",
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """Processes everything available, then reads the sink back with its ``batch`` column.

    A stream without rows gives an empty table of the same columns.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        prepare(batch).write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")

    ran = drain(stream, folder, write, mode)
    if not ran and not sink_exists(spark, f"{folder}/rows"):
        nothing = prepare(spark.createDataFrame([], stream.schema))
        return nothing.withColumn("batch", F.lit(0))
    return spark.read.parquet(f"{folder}/rows")


def drain(
    stream: DataFrame, folder: str, write: Callable[[DataFrame, int], None], mode: str = "append"
) -> list[int]:
    """Processes everything available through ``write``; the numbers of the batches that ran."""
    ran: list[int] = []

    def each(batch: DataFrame, batch_id: int) -> None:
        write(batch, batch_id)
        ran.append(batch_id)

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{folder}/offsets")
        .trigger(availableNow=True)
        .foreachBatch(each)
        .start()
    )
    query.awaitTermination()
    return ran


def sink_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def latest_by_key(rows: DataFrame, *keys: str, version: str | None = None) -> DataFrame:
    """The newest row of every key from a sink of updates: of the last batch, in it of the highest
    ``version``; rows that tie on both are told apart by hash, so a replay picks the same one."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    order = [F.col("batch"), *([F.col(version)] if version else []), F.xxhash64(*rest)]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return rows.groupBy(*keys).agg(newest).select(*keys, "_r.*")


# -- limiter --------------------------------------------------------------------------------------

DECISIONS = "key bigint, event_id bigint, t bigint, allowed boolean, remaining int, retry_after int"


def decide(hits: list[int], t: int, limit: int, window_us: int) -> tuple[list[int], bool, int, int]:
    """One attempt at time ``t`` (microseconds) against the sorted accepted ``hits`` of its key.

    (hits still in the window, allowed, attempts left before this one, whole seconds until the
    oldest hit leaves the window, rounded up).
    """
    inside = hits[bisect_right(hits, t - window_us) :]
    room = limit - len(inside)
    if room > 0:
        return [*inside, t], True, room, 0
    left_us = inside[0] - (t - window_us)
    return inside, False, 0, -(-left_us // 1_000_000)


def _limiter(limit: int, window_us: int) -> StatefulProcessor:
    class Limiter(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self._hits = handle.getListState("hits", "t bigint")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            frames = list(rows)  # one key's rows of one micro-batch
            batch = pd.concat(frames).sort_values(["t", "event_id"])
            hits = [r[0] for r in self._hits.get()] if self._hits.exists() else []
            out = []
            for event_id, t, success in zip(batch["event_id"], batch["t"], batch["success"]):
                hits, allowed, remaining, wait = decide(hits, int(t), limit, window_us)
                out.append((int(key[0]), int(event_id), int(t), allowed, remaining, wait))
                if success and allowed:
                    hits = []
            if hits:
                self._hits.put([(h,) for h in hits])
            else:
                self._hits.clear()
            yield pd.DataFrame(
                out, columns=["key", "event_id", "t", "allowed", "remaining", "retry_after"]
            )

        def close(self) -> None:
            pass

    return Limiter()


def stream_limiter(events: DataFrame, limit: int, window_seconds: int) -> DataFrame:
    """Sliding-window decisions per key: accepted while fewer than ``limit`` accepted attempts
    lie in (t - window, t]. Refused attempts do not count; a success clears the key.

    ``events`` (key, event_id, ts, success). State is at most ``limit`` numbers per key.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = events.select("key", "event_id", F.unix_micros("ts").alias("t"), "success")
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=_limiter(limit, window_seconds * 1_000_000),
        outputStructType=StructType.fromDDL(DECISIONS),
        outputMode="Append",
        timeMode="None",
    )


def _ordered_limiter(limit: int, window_us: int) -> StatefulProcessor:
    columns = ["key", "event_id", "t", "allowed", "remaining", "retry_after"]

    class OrderedLimiter(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self._handle = handle
            self._hits = handle.getListState("hits", "t bigint")
            self._waiting = handle.getListState("waiting", "t bigint, event_id bigint, success boolean")

        def _wake(self, first_us: int, fired_ms: int = -1) -> None:
            """One timer a key, at its earliest waiting attempt."""
            at = -(-first_us // 1000)
            timers = list(self._handle.listTimers())
            # while timers fire, those up to the watermark are still listed
            earlier = [held for held in timers if fired_ms < held <= at]
            if not earlier:
                for held in timers:
                    self._handle.deleteTimer(held)
                self._handle.registerTimer(at)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            for frame in rows:
                columns = (frame["t"], frame["event_id"], frame["success"])
                self._waiting.appendList(
                    [(int(t), int(e), bool(s)) for t, e, s in zip(*columns, strict=True)]
                )
                self._wake(int(frame["t"].min()))
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            now = timerValues.getCurrentWatermarkInMs() * 1000
            known, later = [], []
            for row in self._waiting.get() if self._waiting.exists() else ():
                (known if row[0] <= now else later).append(tuple(row))
            hits = [r[0] for r in self._hits.get()] if self._hits.exists() else []
            out = []
            for t, event_id, success in sorted(known):
                hits, allowed, remaining, wait = decide(hits, t, limit, window_us)
                out.append((int(key[0]), event_id, t, allowed, remaining, wait))
                if success and allowed:
                    hits = []
            for state, left in ((self._hits, [(h,) for h in hits]), (self._waiting, later)):
                state.put(left) if left else state.clear()
            if later:
                self._wake(min(later)[0], now // 1000)
            yield pd.DataFrame(out, columns=columns)

        def close(self) -> None:
            pass

    return OrderedLimiter()


def stream_limiter_ordered(
    events: DataFrame, limit: int, window_seconds: int, late: str
) -> DataFrame:
    """``stream_limiter`` in the order of event time, whatever batches bring the attempts.

    An attempt waits in state until the watermark, ``late`` behind the newest attempt, has passed
    it; then nothing earlier can come. What comes later than that is dropped, as with every
    watermark. Attempts of one moment are taken by ``event_id``. State per key is the attempts of
    the last ``late`` and at most ``limit`` accepted ones.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = events.withWatermark("ts", late).withColumn("t", F.unix_micros("ts"))
    return (
        rows.select("key", "event_id", "ts", "t", "success")
        .groupBy("key")
        .transformWithStateInPandas(
            statefulProcessor=_ordered_limiter(limit, window_seconds * 1_000_000),
            outputStructType=StructType.fromDDL(DECISIONS),
            outputMode="Append",
            timeMode="EventTime",
        )
    )


#: Ends a stream: its own row is never released, all others are.
CLOSING = "SELECT -1L AS key, -1L AS event_id, TIMESTAMP '2250-01-01 00:00:00' AS ts, false AS success"


def limited_to_the_end(
    events: DataFrame, folder: str, limit: int, window_seconds: int, late: str
) -> DataFrame:
    """All decisions over a finite stream: drained once, then run on from the same checkpoint with
    one closing row, which moves the watermark past the attempts that still wait."""
    spark = events.sparkSession
    fields = ["key long", "event_id long", "ts timestamp", "success boolean"]
    closing = f"{folder}/closing"
    spark.createDataFrame([], ", ".join(fields)).write.mode("append").parquet(closing)

    def run() -> DataFrame:
        ends = spark.readStream.schema(", ".join(fields)).parquet(closing)
        both = events.select("key", "event_id", "ts", "success").unionByName(ends)
        return run_available(stream_limiter_ordered(both, limit, window_seconds, late), folder)

    run()
    spark.sql(CLOSING).write.mode("append").parquet(closing)
    return run()


# -- aggregates -----------------------------------------------------------------------------------


def stream_usage(activity: DataFrame, late: str = "2 days") -> DataFrame:
    """Daily counters per owner, in update mode; days roll up to months with ``monthly``.

    Daily windows, unlike months, let the watermark retire old state.
    """
    return (
        activity.withWatermark("ts", late)
        .groupBy(F.window("ts", "1 day"), "owner")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"))
        .select(F.col("window.start").alias("day"), "owner", "n", "cost")
    )


def monthly(days: DataFrame) -> DataFrame:
    return (
        latest_by_key(days, "day", "owner")
        .groupBy(F.trunc("day", "MM").alias("period"), "owner")
        .agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"))
    )


def stream_metrics(calls: DataFrame, width: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Count, sum and maximum latency per provider and tumbling window, in update mode."""
    return (
        calls.withWatermark("created_at", late)
        .groupBy(F.window("created_at", width), "provider")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("latency_ms").alias("total_ms"),
            F.max("latency_ms").alias("max_ms"),
        )
        .select(F.col("window.start").alias("start"), "provider", "n", "total_ms", "max_ms")
    )


def stream_dedupe(events: DataFrame, key: str, ts: str, ttl: str) -> DataFrame:
    """First arrival per key; later ones within the time to live are dropped."""
    return events.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])


# -- ingestion and retention ----------------------------------------------------------------------


def ingest_batch(
    documents: DataFrame, table: KeyedTable, folder: str, batch_id: int, version: str | None
) -> None:
    """Admits, normalises and fingerprints one micro-batch; what is turned away goes to a table."""
    accepted, rejected = admit_documents(documents)
    own = ["doc_id", "source", *([version] if version else [])]
    table.upsert(text_fingerprints(normalize_corpus(accepted), keep=tuple(own)), batch_id)
    told = rejected.select(*own, "reason", F.length("text").cast("long").alias("n_chars"))
    told.write.mode("overwrite").parquet(f"{folder}/rejected/batch={batch_id}")


def stream_ingest(
    documents: DataFrame, folder: str, version: str | None = None, buckets: int = 64
) -> tuple[DataFrame, DataFrame]:
    """(fingerprints, rejected) of a document stream.

    Fingerprints are a keyed table: of a document's rows the one of the highest ``version`` stays,
    whatever batch brought it; without versions that of the latest batch. A rejected row replaces
    nothing and is listed with its batch and reason. Every batch overwrites what it wrote itself.
    """
    spark = documents.sparkSession
    table = KeyedTable(
        spark, f"{folder}/fingerprints", ["doc_id"], [version] if version else [], buckets
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, table, folder, batch_id, version)

    ran = drain(documents, folder, write)
    if not ran and not table.batches():
        write(spark.createDataFrame([], documents.schema), 0)
    rows = table.read()
    if rows is None:
        own = ("doc_id", "source", *([version] if version else []))
        nothing = spark.createDataFrame([], documents.schema)
        rows = text_fingerprints(normalize_corpus(nothing), keep=own)
    return rows, spark.read.parquet(f"{folder}/rejected")

