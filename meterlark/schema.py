"""Schemas of the tables that the engine reads and keeps. Times are UTC."""

from __future__ import annotations

from pyspark.sql import types as T

#: The five disjoint token categories; their sum is the total.
TOKENS = ("input", "output", "cache_read", "cache_creation", "reasoning")
#: Sources that are accepted (fixed values); rows of others are dropped and reported.
SOURCES = ("claude-code", "codex", "grok", "pi", "cursor")
#: Sources whose usage belongs to an account rather than to a machine.
ACCOUNT_SOURCES = ("cursor",)


_KINDS = {"STRING": T.StringType(), "BIGINT": T.LongType(), "DOUBLE": T.DoubleType(), "TIMESTAMP": T.TimestampType()}


def _struct(text: str) -> T.StructType:
    """A struct from "name KIND, ..."; StructType.fromDDL would need a running session."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (x.split() for x in text.split(","))])


_TOKENS = ", ".join(f"{c} BIGINT" for c in TOKENS)
ENTRY = _struct(f"source STRING, model STRING, project STRING, session_id STRING, at TIMESTAMP, {_TOKENS}")
EVENT = _struct("session_id STRING, source STRING, project STRING, role STRING, at TIMESTAMP, seq BIGINT")
BUCKET = _struct(f"host_id STRING, source STRING, model STRING, project STRING, bucket_start TIMESTAMP, {_TOKENS}, total BIGINT")
SESSION = _struct(
    "host_id STRING, source STRING, project STRING, session_hash STRING, first_at TIMESTAMP, last_at TIMESTAMP, duration_seconds BIGINT, "
    "active_seconds BIGINT, message_count BIGINT, user_message_count BIGINT, input BIGINT, output BIGINT, cache_read BIGINT, total BIGINT"
)
ACCOUNT = _struct(
    "account_hash STRING, label STRING, membership STRING, api_percent DOUBLE, auto_percent DOUBLE, bot_percent DOUBLE, used_cents BIGINT, "
    "cycle_start TIMESTAMP, cycle_end TIMESTAMP, fetched_at TIMESTAMP, archived_at TIMESTAMP"
)
PRICE = _struct("key STRING, input DOUBLE, output DOUBLE, cache_read DOUBLE, cache_write DOUBLE, reasoning DOUBLE")
HOST = _struct("host_id STRING, hostname STRING, last_seen TIMESTAMP, agent_version STRING, timezone STRING")
TOKEN = _struct("token_hash STRING, host_id STRING, prefix STRING, label STRING, created_at TIMESTAMP, revoked_at TIMESTAMP")
JOIN_REQUEST = _struct("join_id STRING, claim_hash STRING, hostname STRING, ip STRING, status STRING, created_at TIMESTAMP, expires_at TIMESTAMP, token STRING, token_hash STRING")
#: One upload: the batch envelope.
UPLOAD = T.StructType([
    T.StructField("schema_version", T.IntegerType()), T.StructField("hostname", T.StringType()), T.StructField("agent_version", T.StringType()), T.StructField("timezone", T.StringType()),
    T.StructField("buckets", T.ArrayType(_struct(f"source STRING, model STRING, project STRING, bucket_start TIMESTAMP, account_hash STRING, account_label STRING, {_TOKENS}"))),
    T.StructField("sessions", T.ArrayType(_struct("source STRING, project STRING, session_hash STRING, first_at TIMESTAMP, last_at TIMESTAMP, duration_seconds BIGINT, active_seconds BIGINT, message_count BIGINT, user_message_count BIGINT, input BIGINT, output BIGINT, cache_read BIGINT, total BIGINT"))),
    T.StructField("accounts", T.ArrayType(ACCOUNT)),
])
