"""Entries to buckets, events to sessions, and the order-dependent folds of the logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import token_sum
from ..functions.text import account_host, clamped, clamped_or_unknown, is_account_hash, joined_hash
from ..functions.times import half_hour
from ..schema import ACCOUNT_SOURCES, TOKENS
from .folds import hour_chunk, last_seen, line_chunk, running_count

MODEL_CHARS, PROJECT_CHARS, SOURCE_CHARS, LABEL_CHARS, HASH_CHARS = 100, 200, 64, 200, 64


def sums(*columns: str) -> list[Column]:
    return [F.sum(c).alias(c) for c in columns]


def usage_buckets(entries: DataFrame, *keys: str) -> DataFrame:
    """Token sums by half hour, source, model, project and ``keys``. Partial sums are made before the shuffle."""
    by = [*keys, "source", "model", "project", half_hour(F.col("at")).alias("bucket_start")]
    return entries.groupBy(*by).agg(*sums(*TOKENS)).withColumn("total", token_sum())


def normalized_buckets(buckets: DataFrame) -> DataFrame:
    """Names trimmed, cut and filled, counts at least 0, the total recomputed, the start on the half hour."""
    cols = {
        "source": clamped(F.col("source"), SOURCE_CHARS),
        "model": clamped_or_unknown(F.col("model"), MODEL_CHARS),
        "project": clamped_or_unknown(F.col("project"), PROJECT_CHARS),
        "bucket_start": half_hour(F.col("bucket_start")),
        **{c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)) for c in TOKENS},
    }
    if "account_hash" in buckets.columns:
        cols |= {"account_hash": clamped(F.col("account_hash"), 64), "account_label": clamped(F.col("account_label"), LABEL_CHARS)}
    return buckets.withColumns(cols).withColumn("total", token_sum())


def normalized_sessions(sessions: DataFrame) -> DataFrame:
    """Names trimmed, cut and filled, counts and seconds at least 0."""
    counts = ("duration_seconds", "active_seconds", "message_count", "user_message_count", "input", "output", "cache_read", "total")
    return sessions.withColumns({
        "source": clamped(F.col("source"), SOURCE_CHARS), "project": clamped_or_unknown(F.col("project"), PROJECT_CHARS), "session_hash": clamped(F.col("session_hash"), HASH_CHARS),
        **{c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)) for c in counts},
    })


def normalized_accounts(accounts: DataFrame) -> DataFrame:
    """Account snapshots with hash and label trimmed and cut."""
    return accounts.withColumns({"account_hash": clamped(F.col("account_hash"), HASH_CHARS), "label": clamped(F.col("label"), LABEL_CHARS)})


def first_of_each_account(rows: DataFrame, order: str) -> DataFrame:
    """One row per account_hash: the first in ``order``."""
    best = rows.groupBy("account_hash").agg(F.min_by(F.struct(*rows.columns), order).alias("row"))
    return best.select("row.*")


def with_session(entries: DataFrame, session_id: Column) -> DataFrame:
    """Fills in the session of entries that name none."""
    return entries.withColumn("session_id", F.coalesce(F.nullif("session_id", F.lit("")), session_id, F.lit("")))


def hide_projects(rows: DataFrame) -> DataFrame:
    return rows.withColumn("project", F.lit("unknown"))


def regrouped(buckets: DataFrame, *keys: str) -> DataFrame:
    """Sums rows that masking has made equal."""
    return buckets.groupBy(*keys).agg(*sums(*TOKENS, "total"))


def storage_host(host: Column, source: Column, account_hash: Column) -> Column:
    """Usage of an account is stored under the account, so that several machines do not count it twice; null (nowhere) where the account is none."""
    return F.when(~F.coalesce(source.isin(*ACCOUNT_SOURCES), F.lit(False)), host).when(is_account_hash(account_hash), account_host(account_hash))


def client_key(*extra: str) -> Column:
    """What a collector knows a bucket by; an account only where there is one."""
    parts = [F.col(c) for c in ("source", "model", "project")] + [F.date_format("bucket_start", "yyyy-MM-dd'T'HH:mm:ss'Z'")]
    return F.concat_ws("|", *parts, *[F.when(F.col(c) != "", F.col(c)) for c in extra])


def content_hash(columns: tuple[str, ...] = (*TOKENS, "total")) -> Column:
    return joined_hash(*[F.col(c).cast("string") for c in columns])


def active_seconds(events: DataFrame) -> DataFrame:
    """(source, session_id, active_seconds): a turn runs from a user event to the next; it is active from its first to its last other event."""
    numbered = running_count(events.select("source", "session_id", "role", "at", "seq"), F.col("role") == "user", "turn", ["source", "session_id"], ["at", "seq"], hour_chunk("at"))
    turns = numbered.where((F.col("role") != "user") & (F.col("turn") > 0))
    spans = turns.groupBy("source", "session_id", "turn").agg(F.floor((F.unix_micros(F.max("at")) - F.unix_micros(F.min("at"))) / 1_000_000).alias("s"))
    return spans.groupBy("source", "session_id").agg(F.sum("s").cast("bigint").alias("active_seconds"))


def usage_sessions(events: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per session with an event; token sums are 0 without entries."""
    seen = events.where("session_id <> ''")
    order = F.struct("at", "seq")
    facts = seen.groupBy("source", "session_id").agg(
        F.coalesce(F.nullif(F.min_by("project", order), F.lit("")), F.lit("unknown")).alias("project"),
        F.min("at").alias("first_at"), F.max("at").alias("last_at"),
        F.count("*").alias("message_count"), F.count_if(F.col("role") == "user").alias("user_message_count"),
    )
    used = entries.where("session_id <> ''").groupBy("source", "session_id").agg(*sums(*TOKENS))
    active = active_seconds(seen)
    keys = ["source", "session_id"]
    rows = facts.join(active, keys, "left").join(used, keys, "left").fillna(0, [*TOKENS, "active_seconds"])
    duration = F.floor((F.unix_micros("last_at") - F.unix_micros("first_at")) / 1_000_000)
    return rows.withColumn("duration_seconds", duration.cast("bigint")).withColumn("total", token_sum())


def carried_forward(rows: DataFrame, value: str, keys: list[str], order: list[str], default: str, ignore: tuple[str, ...] = (), chunk: Column | None = None) -> DataFrame:
    """Fills ``value`` with the last one seen before; blank and ignored values count as missing. ``chunk`` rises with the order (folds.py)."""
    usable = F.when(~F.coalesce(F.trim(F.col(value)).isin("", *ignore), F.lit(True)), F.col(value))
    seen = last_seen(rows.withColumn("usable", usable), {"usable": "carried"}, keys, order, line_chunk() if chunk is None else chunk, current=True)
    return seen.withColumn(value, F.coalesce("carried", F.lit(default))).drop("usable", "carried")


def counter_rises(rows: DataFrame, counters: str, total: str, keys: list[str], order: list[str], chunk: Column | None = None) -> DataFrame:
    """Turns running counters into increments: ``counters`` is a struct of them, ``total`` a number; either may be null where a row tells nothing of it.

    Adds ``rise``, a struct like ``counters``, and ``repeated``. Where any counter fell below the last ones seen, or none were seen, the counters began anew and are the
    increments. A row is repeated if its total equals the last one seen and is above 0.
    """
    names = rows.schema[counters].dataType.names
    seen = last_seen(rows, {counters: "counters_before", total: "total_before"}, keys, order, line_chunk() if chunk is None else chunk)
    fell = F.lit(False)
    for c in names:
        fell = fell | (F.col(f"{counters}.{c}") < F.col(f"counters_before.{c}"))
    rise = F.struct(*[(F.col(f"{counters}.{c}") - F.col(f"counters_before.{c}")).alias(c) for c in names])
    repeated = F.coalesce((F.col(total) > 0) & (F.col(total) == F.col("total_before")), F.lit(False))
    found = F.when(F.col("counters_before").isNull() | fell, F.col(counters)).otherwise(rise)
    return seen.withColumns({"rise": F.when(F.col(counters).isNotNull(), found), "repeated": repeated}).drop("counters_before", "total_before")


def largest_of_each(rows: DataFrame, key: str, score: Column, tie: list[str]) -> DataFrame:
    """Of rows with one key the one with the highest score stays, then the first by ``tie``; rows without a key all stay."""
    values = [c for c in rows.columns if c != key]
    # The first by ``tie`` of those with the greatest score: partial bests are made before the shuffle.
    keyed = rows.where(F.col(key).isNotNull()).withColumn("largest", score)
    best = keyed.groupBy(key).agg(F.min_by(F.struct(*values), F.struct(F.col("largest").isNull().alias("none"), (-F.col("largest")).alias("less"), *tie)).alias("row"))
    return best.select(*[F.col(key) if c == key else F.col(f"row.{c}").alias(c) for c in rows.columns]).unionByName(rows.where(F.col(key).isNull()))
