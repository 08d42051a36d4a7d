"""Ledger tables read out of the event stream: provider calls and step runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def calls(events: DataFrame) -> DataFrame:
    """Events as audited provider calls; costs are exact decimals."""
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("call_id"),
        F.col("user_id").alias("item_id"),
        kind.alias("provider"),
        F.concat(F.lit("op."), F.col("event_id") % 3).alias("operation"),
        F.concat(F.lit("v"), F.col("event_id") % 2).alias("model_version"),
        F.when(kind == "error", "failed").when(kind == "signup", "cached").otherwise("success").alias("status"),
        F.col("value").alias("latency_ms"),
        (F.round(F.col("value") * 1000).cast("decimal(18,0)") / F.lit(1_000_000).cast("decimal(7,0)"))
        .cast("decimal(12,6)")
        .alias("cost"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.get_json_object("props", "$.k").alias("content_key"),
        F.when(F.col("event_id") % 4 != 0, F.col("props")).alias("payload"),
        F.when(kind != "error", F.floor(F.col("value") * 10)).alias("tokens_in"),
        F.when(kind != "error", F.floor(F.col("value"))).alias("tokens_out"),
    )


CALLS_SQL = """calls AS (SELECT event_id AS call_id, user_id AS item_id, event_type AS provider,
    'op.' || event_id % 3 AS operation, 'v' || event_id % 2 AS model_version,
    CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'cached' ELSE 'success' END AS status,
    value AS latency_ms, round(value * 100)::BIGINT AS hundredths, round(value * 1000)::BIGINT AS micros,
    ts AS created_at, json_extract_string(props, '$.k') AS content_key,
    CASE WHEN event_id % 4 <> 0 THEN props END AS payload,
    CASE WHEN event_type <> 'error' THEN floor(value * 10)::BIGINT END AS tokens_in,
    CASE WHEN event_type <> 'error' THEN floor(value)::BIGINT END AS tokens_out FROM events)"""


def step_runs(events: DataFrame) -> DataFrame:
    position = F.col("event_id") % 8
    return events.select(
        F.floor(F.col("event_id") / 8).alias("item_id"),
        position.alias("position"),
        F.concat(F.lit("step"), position).alias("name"),
        F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"),
        position.isin(0, 2, 3).alias("critical"),
        F.floor(F.col("value")).alias("duration_ms"),
    )


STEPS_SQL = """steps AS (SELECT event_id // 8 AS item_id, event_id % 8 AS position, 'step' || event_id % 8 AS name,
    CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status,
    event_id % 8 IN (0, 2, 3) AS critical, floor(value)::BIGINT AS duration_ms FROM events)"""
