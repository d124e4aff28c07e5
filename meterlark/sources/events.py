"""The synthetic ``events`` table read as usage: which column stands for what is a fixed rule, written the same in SQL_USAGE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Event types and the tool that each stands for; models by k modulo 6 (fixed values).
TOOLS = {"click": "claude-code", "error": "codex", "purchase": "grok", "signup": "pi", "view": "cursor"}
MODELS = ("cursor-grok-4.6-xhigh-fast", "cursor-grok-4.6-high", "composer-2.5-medium", "composer-2.5-fast", "grok-4.6-build", "no-such-model")


def read_usage(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """One row per event (of ``events``, such as a stream of them, if given): host_id, source, model, project, session_id, role, seq, at and the five token counts."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet") if events is None else events
    k = F.get_json_object("props", "$.k").cast("int")
    tool = F.coalesce(*[F.when(F.col("event_type") == a, F.lit(b)) for a, b in TOOLS.items()])
    account = F.concat(F.lit("acct:"), F.substring(F.sha2(F.concat(F.lit("acct-"), F.col("user_id") % 3), 256), 1, 32))
    rows = events.select("event_id", F.col("ts").cast("timestamp").alias("at"), "user_id", "event_type", "value", k.alias("k"), tool.alias("source"))
    return rows.select(
        F.when(F.col("source") == "cursor", account).otherwise(F.concat(F.lit("host"), F.col("user_id") % 7)).alias("host_id"),
        "source", F.element_at(F.array(*[F.lit(m) for m in MODELS]), F.col("k") % 6 + 1).alias("model"),
        F.concat(F.lit("proj"), F.col("user_id") % 11).alias("project"),
        F.concat_ws("-", "user_id", F.date_format("at", "yyyy-MM-dd")).alias("session_id"),
        F.when(F.col("event_type").isin("click", "signup"), F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.col("event_id").alias("seq"), "at",
        F.floor(F.col("value") * 100).cast("bigint").alias("input"), (F.col("k") * 10).cast("bigint").alias("output"),
        (F.floor(F.col("value") * 10) * (F.col("k") % 3)).cast("bigint").alias("cache_read"), (F.col("k") % 4 * 7).cast("bigint").alias("cache_creation"), (F.col("k") % 5).cast("bigint").alias("reasoning"),
    )


SQL_USAGE = f"""
raw AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k,
    CASE event_type {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in TOOLS.items())} END AS source FROM events
), entries AS (
  SELECT CASE WHEN source = 'cursor' THEN 'acct:' || substr(sha256('acct-' || (user_id % 3)), 1, 32) ELSE 'host' || (user_id % 7) END AS host_id, source,
    {list(MODELS)}[k % 6 + 1] AS model, 'proj' || (user_id % 11) AS project, user_id || '-' || strftime(ts, '%Y-%m-%d') AS session_id,
    CASE WHEN event_type IN ('click', 'signup') THEN 'user' ELSE 'assistant' END AS role, event_id AS seq, ts AS moment,
    floor(value * 100)::BIGINT AS input, (k * 10)::BIGINT AS output, (floor(value * 10) * (k % 3))::BIGINT AS cache_read, (k % 4 * 7)::BIGINT AS cache_creation, (k % 5)::BIGINT AS reasoning
  FROM raw
), buckets AS (
  SELECT host_id, source, model, project, time_bucket(INTERVAL 30 MINUTE, moment) AS bucket_start, sum(input)::BIGINT AS input, sum(output)::BIGINT AS output,
    sum(cache_read)::BIGINT AS cache_read, sum(cache_creation)::BIGINT AS cache_creation, sum(reasoning)::BIGINT AS reasoning, sum(input + output + cache_read + cache_creation + reasoning)::BIGINT AS total
  FROM entries GROUP BY ALL
)"""
