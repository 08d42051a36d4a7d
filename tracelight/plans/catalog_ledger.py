"""Ledger queries: usage, costs, caches, limits, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.operators import ledger as op
from tracelight.plans.registry import Tables, query
from tracelight.sources import tables as src

NOW = "2000-06-01 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


def _epoch(*names: str):
    return [F.unix_timestamp(n).alias(n) for n in names]


def items(t: Tables) -> DataFrame:
    created = F.col("o_orderdate").cast("timestamp")
    key = F.col("o_orderkey")
    base = t.orders.select(
        key.alias("item_id"),
        F.col("o_custkey").alias("owner"),
        F.when(key % 2 == 0, "image").otherwise("text").alias("type"),
        created.alias("created_at"),
        F.when(F.col("o_orderstatus") == "P", created + F.expr("INTERVAL 30 DAYS")).alias("deleted_at"),
        F.when(key % 5 == 0, created + F.expr("INTERVAL 1 HOUR")).alias("kept_at"),
        F.when(key % 7 == 0, created + F.expr("INTERVAL 2 DAYS")).alias("purged_at"),
    )
    return op.retention_deadlines(base, 24)


ITEMS = """items AS (SELECT o_orderkey AS item_id, o_custkey AS owner,
    CASE WHEN o_orderkey % 2 = 0 THEN 'image' ELSE 'text' END AS type, o_orderdate AS created_at,
    CASE WHEN o_orderstatus = 'P' THEN o_orderdate + INTERVAL 30 DAY END AS deleted_at,
    CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate + INTERVAL 1 HOUR END AS kept_at,
    CASE WHEN o_orderkey % 7 = 0 THEN o_orderdate + INTERVAL 2 DAY END AS purged_at,
    o_orderdate + INTERVAL 24 HOUR AS retention_at FROM orders)"""


def files(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_orderkey").alias("item_id"),
        F.when(F.col("l_linenumber") > 1, "sidecar").otherwise("original").alias("role"),
        F.concat_ws("/", "l_orderkey", "l_linenumber").alias("object_key"),
        (F.col("l_quantity") * 1000).cast("long").alias("size_bytes"),
    )


FILES = """files AS (SELECT l_orderkey AS item_id, l_orderkey || '/' || l_linenumber AS object_key,
    (l_quantity * 1000)::BIGINT AS size_bytes FROM lineitem)"""


def reports(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    return t.orders.filter(F.col("o_orderpriority") != "5-LOW").select(
        key.alias("item_id"),
        F.when(key % 4 != 0, F.concat(F.lit("report/"), key)).alias("object_key"),
        F.lit("ready").alias("status"),
        (F.col("o_totalprice") / 10).cast("long").alias("size_bytes"),
    )


REPORTS = """reports AS (SELECT o_orderkey AS item_id,
    CASE WHEN o_orderkey % 4 <> 0 THEN 'report/' || o_orderkey END AS object_key,
    trunc(o_totalprice / 10)::BIGINT AS size_bytes FROM orders WHERE o_orderpriority <> '5-LOW')"""


def artifacts(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    one = F.struct(F.concat(F.lit("map/"), key, F.lit("/0")).alias("object_key"), (key % 100 + 1).alias("size_bytes"))
    two = F.struct(F.concat(key, F.lit("/1")).alias("object_key"), F.lit(7).cast("long").alias("size_bytes"))
    return t.orders.filter(F.col("o_orderstatus") == "F").select(
        key.alias("item_id"), F.array(one, two).alias("artifacts")
    )


ARTIFACTS = """artifacts AS (SELECT o_orderkey AS item_id, 'map/' || o_orderkey || '/0' AS object_key,
    o_orderkey % 100 + 1 AS size_bytes FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT o_orderkey, o_orderkey || '/1', 7 FROM orders WHERE o_orderstatus = 'F')"""


def activity(t: Tables) -> DataFrame:
    """Orders as analyses, reports and calls of their customer; prices in cents keep sums exact."""
    key = F.col("o_orderkey")
    return t.orders.select(
        F.col("o_custkey").alias("owner"),
        key.alias("item_id"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.when(key % 10 == 3, "report").when(key % 10 == 7, "call").otherwise("analysis").alias("event"),
        F.when(key % 2 == 0, "image").otherwise("text").alias("type"),
        F.floor(F.col("o_totalprice")).alias("bytes"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("cost"),
    )


ACTIVITY = """activity AS (SELECT o_custkey AS owner, o_orderkey AS item_id, o_orderdate AS ts,
    CASE o_orderkey % 10 WHEN 3 THEN 'report' WHEN 7 THEN 'call' ELSE 'analysis' END AS event,
    CASE WHEN o_orderkey % 2 = 0 THEN 'image' ELSE 'text' END AS type,
    floor(o_totalprice)::BIGINT AS bytes, o_totalprice::DECIMAL(18,2) AS cost FROM orders)"""
USAGE = f"""{ACTIVITY}, usage AS (SELECT owner, date_trunc('month', ts) AS period,
    count(*) FILTER (event = 'analysis') AS analyses_count,
    count(*) FILTER (event = 'analysis' AND type = 'image') AS image_count,
    count(*) FILTER (event = 'analysis' AND type = 'text') AS text_count,
    count(*) FILTER (event = 'report') AS reports_count,
    count(*) FILTER (event = 'call') AS calls_count,
    coalesce(sum(cost) FILTER (event = 'call'), 0)::DOUBLE AS call_cost,
    coalesce(sum(bytes) FILTER (event <> 'call'), 0)::BIGINT AS storage_bytes
    FROM activity GROUP BY 1, 2)"""
def _period():
    return F.date_format("period", "yyyy-MM-dd").alias("period")


_PERIOD_SQL = "strftime(period, '%Y-%m-%d') AS period"


@query("live_items", f"WITH {ITEMS} SELECT item_id, owner, type FROM items WHERE deleted_at IS NULL")
def _(t: Tables):
    return op.live_items(items(t)).select("item_id", "owner", "type")


@query(
    "counts_by_type",
    f"""WITH {ITEMS} SELECT owner, count(*) AS total, count(*) FILTER (type = 'image') AS image,
    count(*) FILTER (type = 'text') AS text FROM items WHERE deleted_at IS NULL GROUP BY 1""",
)
def _(t: Tables):
    return op.counts_by_type(items(t))


@query(
    "page_items",
    f"""WITH {ITEMS}, live AS (SELECT * FROM items WHERE deleted_at IS NULL)
    SELECT item_id, owner, (SELECT count(*) FROM live) AS total FROM live
    ORDER BY created_at DESC, item_id DESC LIMIT 20 OFFSET 40""",
)
def _(t: Tables):
    return op.page_items(items(t), page=3, size=20).select("item_id", "owner", "total")


@query(
    "expired_first",
    f"""WITH {ITEMS} SELECT item_id, epoch(retention_at)::BIGINT AS retention_at FROM items
    WHERE deleted_at IS NULL AND kept_at IS NULL AND purged_at IS NULL AND retention_at <= TIMESTAMP '{NOW}'
    ORDER BY items.retention_at, item_id LIMIT 500""",
)
def _(t: Tables):
    return op.expired_first(items(t), _now()).select("item_id", *_epoch("retention_at"))


@query(
    "dedupe_first",
    f"""WITH {ACTIVITY} SELECT owner, type, item_id, epoch(ts)::BIGINT AS ts FROM activity
    QUALIFY row_number() OVER (PARTITION BY owner, type ORDER BY activity.ts, item_id) = 1""",
)
def _(t: Tables):
    rows = activity(t).select("owner", "type", "ts", "item_id")
    return op.dedupe_first(rows, ["owner", "type"], ["ts", "item_id"]).select(
        "owner", "type", "item_id", *_epoch("ts")
    )


@query("usage_monthly", f"WITH {USAGE} SELECT * REPLACE ({_PERIOD_SQL}) FROM usage")
def _(t: Tables):
    usage = op.usage_monthly(activity(t))
    return usage.select("owner", _period(), *usage.columns[2:])


_STORAGE = f"""{FILES}, {REPORTS}, {ARTIFACTS},
  live AS (SELECT item_id, owner FROM items WHERE deleted_at IS NULL AND purged_at IS NULL),
  held AS (SELECT item_id, 'f' AS kind, size_bytes FROM files
    UNION ALL SELECT item_id, 'r', size_bytes FROM reports WHERE object_key IS NOT NULL
    UNION ALL SELECT item_id, 'a', size_bytes FROM artifacts),
  storage AS (SELECT owner, coalesce(sum(size_bytes) FILTER (kind = 'f'), 0)::BIGINT AS files_bytes,
    coalesce(sum(size_bytes) FILTER (kind = 'r'), 0)::BIGINT AS reports_bytes,
    coalesce(sum(size_bytes) FILTER (kind = 'a'), 0)::BIGINT AS artifacts_bytes,
    sum(size_bytes)::BIGINT AS total_bytes FROM held JOIN live USING (item_id) GROUP BY 1)"""


@query("live_storage", f"WITH {ITEMS}, {_STORAGE} SELECT * FROM storage")
def _(t: Tables):
    return op.live_storage(items(t), files(t), reports(t), artifacts(t))


@query(
    "usage_status",
    f"""WITH {USAGE}, {ITEMS}, {_STORAGE}
    SELECT usage.owner, {_PERIOD_SQL},
      greatest(0, 3 - analyses_count)::BIGINT AS analyses_remaining,
      greatest(0, 600000 - coalesce(total_bytes, 0))::BIGINT AS storage_remaining,
      NULL::DOUBLE AS budget_remaining
    FROM usage LEFT JOIN storage USING (owner)""",
)
def _(t: Tables):
    storage = op.live_storage(items(t), files(t), reports(t), artifacts(t))
    status = op.usage_status(op.usage_monthly(activity(t)), storage, 3, 600_000, 0)
    return status.select(
        "owner", _period(), "analyses_remaining", "storage_remaining", "budget_remaining"
    )


@query(
    "usage_history",
    f"""WITH {USAGE} SELECT owner, {_PERIOD_SQL}, analyses_count, call_cost,
      row_number() OVER (PARTITION BY owner ORDER BY usage.period DESC) AS age FROM usage QUALIFY age <= 6""",
)
def _(t: Tables):
    return op.usage_history(op.usage_monthly(activity(t))).select(
        "owner", _period(), "analyses_count", "call_cost", "age"
    )


@query(
    "limit_breaches",
    f"""WITH {ACTIVITY} SELECT owner, item_id, epoch(ts)::BIGINT AS ts FROM activity
    QUALIFY row_number() OVER (PARTITION BY owner, date_trunc('month', activity.ts) ORDER BY activity.ts, item_id) > 1""",
)
def _(t: Tables):
    return op.limit_breaches(activity(t), 1).select("owner", "item_id", *_epoch("ts"))


@query(
    "storage_breaches",
    f"""WITH RECURSIVE {ACTIVITY},
    seq AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY ts, item_id) AS i FROM activity),
    fold AS (SELECT owner, item_id, i, bytes <= 900000 AS accepted,
        CASE WHEN bytes <= 900000 THEN bytes ELSE 0 END AS used FROM seq WHERE i = 1
      UNION ALL SELECT s.owner, s.item_id, s.i, f.used + s.bytes <= 900000,
        CASE WHEN f.used + s.bytes <= 900000 THEN f.used + s.bytes ELSE f.used END
      FROM fold f JOIN seq s ON s.owner = f.owner AND s.i = f.i + 1)
    SELECT owner, item_id, accepted FROM fold""",
)
def _(t: Tables):
    return op.storage_breaches(activity(t), 900_000).select("owner", "item_id", "accepted")


# -- calls ----------------------------------------------------------------------------------------


@query(
    "estimate_costs",
    f"""WITH {src.CALLS_SQL} SELECT call_id, (floor((tokens_in * 2500000::HUGEINT + tokens_out * 10000000::HUGEINT)
      / 1000000 + 0.5) / 1000000)::DOUBLE AS estimate FROM calls""",
)
def _(t: Tables):
    return op.estimate_costs(src.calls(t.events), "2.5", "10").select("call_id", "estimate")


@query(
    "call_costs",
    f"WITH {src.CALLS_SQL} SELECT item_id, coalesce(sum(micros), 0) / 1e6 AS total_cost, count(*) AS calls FROM calls GROUP BY 1",
)
def _(t: Tables):
    return op.call_costs(src.calls(t.events))


@query(
    "engine_notes",
    f"""WITH {src.CALLS_SQL} SELECT provider, model_version, string_agg(DISTINCT operation, ',' ORDER BY operation) AS operations,
      count(*) AS calls, count(*) FILTER (status = 'cached') AS cached,
      count(*) FILTER (status IN ('failed', 'timeout')) AS failed FROM calls GROUP BY 1, 2""",
)
def _(t: Tables):
    return op.engine_notes(src.calls(t.events)).withColumn(
        "operations", F.array_join("operations", ",")
    )


@query(
    "latency_metrics",
    f"""WITH {src.CALLS_SQL} SELECT provider, operation, count(*) AS n,
      sum(hundredths)::BIGINT / 100 AS total_ms, max(latency_ms) AS max_ms,
      count(*) FILTER (status = 'failed') AS failures
    FROM calls GROUP BY GROUPING SETS ((provider, operation), ())""",
)
def _(t: Tables):
    exact = src.calls(t.events).withColumn("latency_ms", F.col("latency_ms").cast("decimal(18,2)"))
    return op.latency_metrics(exact, "provider", "operation")


@query(
    "step_outcomes",
    f"""WITH {src.STEPS_SQL},
    s AS (SELECT item_id, min(position) AS stop_at FROM steps WHERE status = 'failed' AND critical GROUP BY 1),
    j AS (SELECT steps.*, stop_at, stop_at IS NULL OR position <= stop_at AS ran FROM steps LEFT JOIN s USING (item_id))
    SELECT item_id, count(*) FILTER (ran AND status = 'completed') AS completed,
      count(*) FILTER (ran AND status = 'failed') AS failed, count(*) FILTER (NOT ran) AS skipped,
      coalesce(sum(duration_ms) FILTER (ran), 0)::BIGINT AS duration_ms,
      max(name) FILTER (position = stop_at) AS failed_step,
      CASE WHEN max(stop_at) IS NULL THEN 'completed' ELSE 'failed' END AS status
    FROM j GROUP BY 1""",
)
def _(t: Tables):
    return op.step_outcomes(src.step_runs(t.events))


_STATUS_SQL = """st AS (SELECT user_id AS item_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'queued'
    WHEN 'view' THEN 'processing' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status FROM events)"""


@query(
    "status_transitions",
    f"""WITH {_STATUS_SQL}, m AS (SELECT *, lag(status) OVER (PARTITION BY item_id ORDER BY ts, event_id) AS before FROM st)
    SELECT item_id, event_id, before, status FROM m WHERE before IS NOT NULL AND (before || '>' || status) NOT IN
      ('queued>processing', 'queued>failed', 'processing>completed', 'processing>failed')""",
)
def _(t: Tables):
    kind = F.col("event_type")
    history = t.events.select(
        F.col("user_id").alias("item_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        F.when(kind == "signup", "queued")
        .when(kind.isin("view", "click"), "processing")
        .when(kind == "purchase", "completed")
        .otherwise("failed")
        .alias("status"),
    )
    return op.status_transitions(history).select("item_id", "event_id", "before", "status")


_CACHE_NOW = "2024-01-16 00:00:00"
_CACHE = f"""{src.CALLS_SQL},
    keyed AS (SELECT *, sha256(provider || chr(31) || operation || chr(31) || model_version || chr(31) || content_key) AS cache_key FROM calls),
    early AS (SELECT * FROM keyed WHERE created_at < TIMESTAMP '2024-01-12'),
    cache AS (SELECT cache_key, any_value(provider) AS provider, any_value(operation) AS operation,
      min(created_at) + INTERVAL 7 DAY AS expires_at, count(*) - 1 AS hit_count,
      arg_min(status, (created_at, call_id)) <> 'failed' AS complete FROM early GROUP BY 1),
    requests AS (SELECT * FROM keyed WHERE created_at >= TIMESTAMP '2024-01-12')"""


def _keyed(t: Tables) -> DataFrame:
    calls = src.calls(t.events)
    return calls.withColumn(
        "cache_key", op.cache_key(*[F.col(c) for c in ("provider", "operation", "model_version", "content_key")])
    )


def _cache(t: Tables) -> DataFrame:
    early = _keyed(t).filter(F.col("created_at") < F.lit("2024-01-12").cast("timestamp"))
    return early.groupBy("cache_key").agg(
        F.first("provider").alias("provider"),
        F.first("operation").alias("operation"),
        (F.min("created_at") + F.expr("INTERVAL 7 DAYS")).alias("expires_at"),
        (F.count(F.lit(1)) - 1).alias("hit_count"),
        (F.min_by("status", F.struct("created_at", "call_id")) != "failed").alias("complete"),
        F.lit("{}").alias("payload"),
    )


@query(
    "cross_user_cache_lookup",
    f"""WITH {_CACHE} SELECT call_id, CASE WHEN c.cache_key IS NULL THEN 'miss' ELSE 'hit' END AS outcome,
      CASE WHEN c.cache_key IS NULL THEN latency_ms ELSE 0 END AS latency_ms,
      CASE WHEN c.cache_key IS NULL THEN micros ELSE 0 END / 1e6 AS cost,
      coalesce(c.cache_key IS NULL AND row_number() OVER (PARTITION BY r.cache_key ORDER BY created_at, call_id) = 1, false) AS compute
    FROM requests r LEFT JOIN (SELECT * FROM cache WHERE expires_at > TIMESTAMP '{_CACHE_NOW}' AND complete) c USING (cache_key)""",
)
def _(t: Tables):
    requests = _keyed(t).filter(F.col("created_at") >= F.lit("2024-01-12").cast("timestamp"))
    looked = op.cross_user_cache_lookup(requests, _cache(t), F.lit(_CACHE_NOW).cast("timestamp"))
    todo = op.missing_requests(looked).select("call_id", F.lit(True).alias("todo"))
    return looked.join(todo, "call_id", "left").select(
        "call_id", "outcome", "latency_ms", "cost", F.coalesce("todo", F.lit(False)).alias("compute")
    )


@query(
    "cache_stats",
    f"""WITH {_CACHE} SELECT provider, operation, count(*) AS entries, sum(hit_count)::BIGINT AS hits,
      count(*) FILTER (expires_at <= TIMESTAMP '{_CACHE_NOW}') AS expired FROM cache GROUP BY 1, 2""",
)
def _(t: Tables):
    return op.cache_stats(_cache(t), F.lit(_CACHE_NOW).cast("timestamp"))


@query(
    "dedupe_requests",
    f"""WITH RECURSIVE {src.CALLS_SQL}, s AS MATERIALIZED (SELECT content_key, {{'t': created_at, 'id': call_id}} AS c FROM calls
      WHERE status <> 'failed' AND content_key IS NOT NULL),
    p AS MATERIALIZED (SELECT a.content_key, a.c, min(b.c) AS next FROM s a JOIN s b ON a.content_key = b.content_key
      AND b.c.t >= a.c.t + INTERVAL 7 DAY GROUP BY 1, 2),
    o AS (SELECT content_key, min(c) AS c FROM s GROUP BY 1 UNION ALL SELECT p.content_key, p.next FROM o JOIN p ON p.content_key = o.content_key AND p.c = o.c),
    f AS (SELECT call_id, bool_or(o.c.id <> call_id AND o.c.t + INTERVAL 7 DAY > created_at AND o.c < {{'t': created_at, 'id': call_id}}) AS cached
      FROM calls JOIN o USING (content_key) GROUP BY 1)
    SELECT call_id, coalesce(cached, false) AS cached, CASE WHEN cached THEN 0 ELSE micros END / 1e6 AS charged FROM calls LEFT JOIN f USING (call_id)""",
)
def _(t: Tables):
    calls = src.calls(t.events)
    return op.dedupe_requests(calls, kept=F.col("status") != "failed").select(
        "call_id", "cached", "charged"
    )


@query(
    "budget_exhausted",
    f"""WITH {src.CALLS_SQL}, r AS (SELECT *, coalesce(sum(micros) OVER (PARTITION BY item_id, date_trunc('month', created_at)
      ORDER BY created_at, call_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM calls)
    SELECT call_id, before / 1e6 AS spent_before, before >= 5000000 AS skipped FROM r""",
)
def _(t: Tables):
    calls = src.calls(t.events).withColumn("owner", F.col("item_id"))
    return op.budget_exhausted(calls, 5).select("call_id", "spent_before", "skipped")


@query(
    "attempts_in_window",
    """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)
      RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW) - 1 AS attempts FROM events""",
)
def _(t: Tables):
    events = t.events.select("event_id", F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return op.attempts_in_window(events, 6 * 3600).select("event_id", "attempts")


# -- retention ------------------------------------------------------------------------------------


@query(
    "retention_deadlines",
    f"WITH {ITEMS} SELECT item_id, epoch(created_at + INTERVAL 48 HOUR)::BIGINT AS retention_at FROM items",
)
def _(t: Tables):
    return op.retention_deadlines(items(t), 48).select("item_id", *_epoch("retention_at"))


_DUE = f"""due AS (SELECT item_id FROM items WHERE deleted_at IS NULL AND kept_at IS NULL
    AND purged_at IS NULL AND retention_at <= TIMESTAMP '{NOW}')"""


@query(
    "expire_content",
    f"""WITH {ITEMS}, {REPORTS}, {_DUE}
    SELECT 'item' AS kind, item_id, epoch(CASE WHEN d.item_id IS NULL THEN purged_at ELSE TIMESTAMP '{NOW}' END)::BIGINT AS purged_at,
      NULL AS object_key, NULL AS status FROM items LEFT JOIN due d USING (item_id)
    UNION ALL SELECT 'report', item_id, NULL, CASE WHEN d.item_id IS NULL THEN object_key END,
      CASE WHEN d.item_id IS NULL THEN 'ready' ELSE 'expired' END FROM reports LEFT JOIN due d USING (item_id)""",
)
def _(t: Tables):
    marked, expired = op.expire_content(items(t), reports(t), _now())
    none = F.lit(None).cast("string")
    return marked.select(
        F.lit("item").alias("kind"), "item_id", *_epoch("purged_at"), none.alias("object_key"), none.alias("status")
    ).unionByName(
        expired.select(
            F.lit("report").alias("kind"), "item_id", F.lit(None).cast("long").alias("purged_at"), "object_key", "status"
        )
    )


@query(
    "purge_payloads",
    f"""WITH {src.CALLS_SQL} SELECT call_id, CASE WHEN created_at < TIMESTAMP '2024-01-15' THEN NULL ELSE payload END AS payload,
      created_at < TIMESTAMP '2024-01-15' AND payload IS NOT NULL AS purged FROM calls""",
)
def _(t: Tables):
    out = op.purge_payloads(src.calls(t.events), F.lit("2024-01-15").cast("timestamp"))
    return out.select("call_id", "payload", F.col("purged_at").isNotNull().alias("purged"))


_CUT = "1998-01-01 00:00:00"


@query(
    "retire_old",
    f"""WITH {ITEMS} SELECT item_id, epoch(CASE WHEN deleted_at IS NULL AND created_at < TIMESTAMP '{_CUT}'
      THEN TIMESTAMP '{NOW}' ELSE deleted_at END)::BIGINT AS deleted_at FROM items""",
)
def _(t: Tables):
    return op.retire_old(items(t), F.lit(_CUT).cast("timestamp"), _now()).select(
        "item_id", *_epoch("deleted_at")
    )


@query(
    "purge_deleted",
    f"""WITH {ITEMS}, {FILES}, gone AS (SELECT item_id FROM items WHERE deleted_at < TIMESTAMP '{_CUT}')
    SELECT 'item' AS kind, item_id, NULL AS object_key FROM items ANTI JOIN gone USING (item_id)
    UNION ALL SELECT 'file', item_id, object_key FROM files ANTI JOIN gone USING (item_id)""",
)
def _(t: Tables):
    kept, children = op.purge_deleted(items(t), {"file": files(t)}, F.lit(_CUT).cast("timestamp"))
    return kept.select(
        F.lit("item").alias("kind"), "item_id", F.lit(None).cast("string").alias("object_key")
    ).unionByName(children["file"].select(F.lit("file").alias("kind"), "item_id", "object_key"))


@query(
    "purge_orphans",
    f"""WITH {ITEMS}, {FILES} SELECT item_id, object_key FROM files
    WHERE item_id NOT IN (SELECT item_id FROM items WHERE deleted_at IS NOT NULL)""",
)
def _(t: Tables):
    gone = items(t).filter(F.col("deleted_at").isNotNull())
    return op.purge_orphans(files(t), gone).select("item_id", "object_key")


@query(
    "retention_report",
    f"""WITH {ITEMS}, {src.CALLS_SQL}, {_DUE},
    retired AS (SELECT item_id, CASE WHEN deleted_at IS NULL AND created_at < TIMESTAMP '{NOW}' - INTERVAL 900 DAY
      THEN TIMESTAMP '{NOW}' ELSE deleted_at END AS deleted_at FROM items)
    SELECT 1::BIGINT AS step, 'content_expired' AS pass, count(*) AS n FROM due
    UNION ALL SELECT 2, 'payloads_purged', count(*) FROM calls WHERE created_at < TIMESTAMP '{NOW}' - INTERVAL 30 DAY AND payload IS NOT NULL
    UNION ALL SELECT 3, 'records_retired', count(*) FROM items WHERE deleted_at IS NULL AND created_at < TIMESTAMP '{NOW}' - INTERVAL 900 DAY
    UNION ALL SELECT 4, 'records_purged', count(*) FROM retired WHERE deleted_at < TIMESTAMP '{NOW}' - INTERVAL 14 DAY""",
)
def _(t: Tables):
    return op.retention_report(
        items(t), src.calls(t.events), _now(), payload_days=30, item_days=900, grace_days=14
    )


@query(
    "object_inventory",
    f"""WITH {FILES}, {REPORTS}, {ARTIFACTS} SELECT item_id, object_key FROM files UNION SELECT item_id, object_key FROM artifacts
    UNION SELECT item_id, object_key FROM reports WHERE object_key IS NOT NULL""",
)
def _(t: Tables):
    return op.object_inventory(files(t), artifacts(t), reports(t))
