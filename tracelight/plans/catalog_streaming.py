"""Streaming queries: each drains its stream once and returns the sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.plans import catalog_ledger as ledger
from tracelight.plans.derive import fp_sql
from tracelight.plans.registry import Tables, query
from tracelight.sources import tables as src
from tracelight.streaming import jobs, retention


class Streams(Tables):
    """The same tables as streams, so that batch derivations apply to them unchanged."""

    def __getattr__(self, name: str):
        return jobs.table_stream(self.spark, self.folder, name)

    @property
    def documents(self):
        return self.__getattr__("documents")


def _streams(t: Tables) -> Streams:
    return Streams(t.spark, t.folder)


#: one step a key's attempt, in order of time: which accepted ones its window still holds
LIMITER_SQL = """WITH RECURSIVE attempt AS (SELECT user_id AS key, event_id, epoch_us(ts::TIMESTAMP) AS t, event_type = 'signup' AS success,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL),
      fold AS (SELECT key, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::BIGINT AS t, []::BIGINT[] AS inside, false AS success
        FROM attempt WHERE n = 1
      UNION ALL SELECT a.key, a.n, a.event_id, a.t,
        list_filter(CASE WHEN len(f.inside) >= 5 THEN f.inside WHEN f.success THEN [] WHEN f.t IS NULL THEN []
          ELSE list_append(f.inside, f.t) END, lambda h: h > a.t - 21600000000), a.success
        FROM fold f JOIN attempt a ON a.key = f.key AND a.n = f.n + 1)
    SELECT key, event_id, t, len(inside) < 5 AS allowed, greatest(5 - len(inside), 0)::BIGINT AS remaining,
      CASE WHEN len(inside) < 5 THEN 0 ELSE ceil((inside[1] - (t - 21600000000)) / 1e6) END::BIGINT AS retry_after
    FROM fold WHERE n > 0"""


def _attempts(t: Tables) -> DataFrame:
    return _streams(t).events.filter("user_id IS NOT NULL").select(
        F.col("user_id").alias("key"),
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_type") == "signup").alias("success"),
    )


@query("stream_limiter", LIMITER_SQL)
def _(t: Tables):
    decisions = jobs.stream_limiter(_attempts(t), limit=5, window_seconds=6 * 3600)
    return jobs.run_available(decisions, jobs.scratch(t.spark)).drop("batch")


@query("stream_limiter_ordered", LIMITER_SQL)
def _(t: Tables):
    # no order of the table's files is known: attempts wait for up to ten years
    return jobs.limited_to_the_end(
        _attempts(t), jobs.scratch(t.spark), 5, 6 * 3600, "3650 days"
    ).drop("batch")


@query(
    "stream_usage",
    f"""WITH {src.CALLS_SQL} SELECT strftime(date_trunc('month', created_at), '%Y-%m-%d') AS period, item_id AS owner, count(*) AS n,
      sum(micros)::BIGINT / 1e6 AS cost FROM calls GROUP BY 1, 2""",
)
def _(t: Tables):
    activity = src.calls(_streams(t).events).select(
        F.col("item_id").alias("owner"), F.col("created_at").alias("ts"), "cost"
    )
    days = jobs.run_available(jobs.stream_usage(activity), jobs.scratch(t.spark), "update")
    return jobs.monthly(days).withColumn("period", F.date_format("period", "yyyy-MM-dd"))


@query(
    "stream_metrics",
    f"""WITH {src.CALLS_SQL} SELECT epoch(time_bucket(INTERVAL 6 HOUR, created_at))::BIGINT AS start, provider, count(*) AS n,
      sum(hundredths)::BIGINT / 100 AS total_ms, max(latency_ms) AS max_ms FROM calls GROUP BY 1, 2""",
)
def _(t: Tables):
    calls = src.calls(_streams(t).events).withColumn("latency_ms", F.col("latency_ms").cast("decimal(18,2)"))
    rows = jobs.run_available(jobs.stream_metrics(calls), jobs.scratch(t.spark), "update")
    return jobs.latest_by_key(rows, "start", "provider").withColumn("start", F.unix_timestamp("start"))


@query(
    "stream_dedupe",
    f"WITH {src.CALLS_SQL} SELECT DISTINCT content_key, 1::BIGINT AS kept FROM calls",
)
def _(t: Tables):
    calls = src.calls(_streams(t).events).select("content_key", "created_at", "call_id")
    kept = jobs.run_available(
        jobs.stream_dedupe(calls, "content_key", "created_at", "60 days"), jobs.scratch(t.spark)
    )
    return kept.groupBy("content_key").agg(F.count(F.lit(1)).alias("kept"))


@query(
    "stream_ingest",
    f"""WITH {fp_sql()}, n AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY 1)
    SELECT doc_id, canonical_sha256, coalesce(n, 0)::BIGINT AS shingle_count FROM fp LEFT JOIN n USING (doc_id)
    WHERE length(text) <= 200000 AND regexp_matches(text, '\\S')""",
)
def _(t: Tables):
    table, _ = jobs.stream_ingest(_streams(t).documents, jobs.scratch(t.spark))
    return table.select("doc_id", "canonical_sha256", "shingle_count")


@query(
    "stream_ingest_rejected",
    r"""SELECT doc_id, CASE WHEN text IS NULL OR NOT regexp_matches(text, '\S') THEN 'EMPTY' ELSE 'TOO_LARGE' END AS reason,
      length(text)::BIGINT AS n_chars FROM documents
    WHERE text IS NULL OR NOT regexp_matches(text, '\S') OR length(text) > 200000""",
)
def _(t: Tables):
    _, rejected = jobs.stream_ingest(_streams(t).documents, jobs.scratch(t.spark))
    return rejected.select("doc_id", "reason", "n_chars")


@query(
    "sweep",
    f"""WITH {ledger.ITEMS}, {src.CALLS_SQL}
    SELECT 'content_expired' AS pass, item_id AS id FROM items WHERE deleted_at IS NULL AND kept_at IS NULL AND purged_at IS NULL
      AND retention_at <= TIMESTAMP '{ledger.NOW}'
    UNION ALL SELECT 'payloads_purged', call_id FROM calls WHERE created_at < TIMESTAMP '{ledger.NOW}' - INTERVAL 30 DAY AND payload IS NOT NULL
    UNION ALL SELECT 'records_retired', item_id FROM items WHERE deleted_at IS NULL AND created_at < TIMESTAMP '{ledger.NOW}' - INTERVAL 900 DAY
    UNION ALL SELECT 'records_purged', item_id FROM items WHERE deleted_at < TIMESTAMP '{ledger.NOW}' - INTERVAL 14 DAY""",
)
def _(t: Tables):
    now, streams = F.lit(ledger.NOW).cast("timestamp"), _streams(t)
    rows = retention.retained(
        ledger.items(streams).withColumn("arrived", now),
        src.calls(streams.events).withColumn("arrived", now),
    )
    swept = retention.stream_sweep(rows, retention.Policy(30, 900, 14))
    return jobs.run_available(swept, jobs.scratch(t.spark)).select("pass", "id")
