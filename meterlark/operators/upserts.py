"""Idempotent writes: pure functions from a stored table and a batch to the next table.

A batch carries ``seq``, the order in which its rows arrived; stored rows count as older than any of them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import token_sum
from ..functions.text import is_account_hash, trimmed
from ..schema import ACCOUNT_SOURCES, SOURCES
from .usage import normalized_accounts, normalized_buckets, normalized_sessions, storage_host

BUCKET_KEY = ("host_id", "source", "model", "project", "bucket_start")
#: Names of unknown sources that a response lists at most; unknown_sources() has all of them.
MOST_UNKNOWN = 1000
SESSION_KEY = ("host_id", "source", "session_hash")


def _together(stored: DataFrame, batch: DataFrame) -> DataFrame:
    return stored.withColumn("seq", F.lit(-1).cast("bigint")).unionByName(batch, allowMissingColumns=True)


def _last(rows: DataFrame, keys: tuple[str, ...], order: Column, columns: list[str]) -> DataFrame:
    """Per key the row with the greatest ``order``; partial maxima are made before the shuffle."""
    values = [c for c in columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"row.{c}").alias(c) for c in columns])


def upsert_buckets(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """A snapshot replaces the stored one unless it holds fewer tokens; equal ones are replaced too."""
    return _last(_together(stored, batch), BUCKET_KEY, F.struct(token_sum().alias("score"), "seq"), stored.columns)


def protected_rows(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """``batch`` with ``protected``: a larger snapshot of the key was there before the row came."""
    before = Window.partitionBy(*BUCKET_KEY).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    touched = stored.join(batch.select(*BUCKET_KEY).distinct(), list(BUCKET_KEY), "left_semi")
    rows = _together(touched, batch).withColumn("score", token_sum())
    return rows.withColumn("protected", F.coalesce(F.max("score").over(before) > F.col("score"), F.lit(False))).where("seq >= 0").drop("score")


def upsert_sessions(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """The last writer wins."""
    return _last(_together(stored, batch), SESSION_KEY, F.col("seq"), stored.columns)


def upsert_accounts(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """The newest snapshot wins, of equally new ones the later arrival; the archive mark stays with the account."""
    rows = _together(stored, batch.drop("archived_at"))
    values = [c for c in stored.columns if c not in ("account_hash", "archived_at")]
    newest = F.struct(F.col("fetched_at").isNotNull(), "fetched_at", "seq")
    best = rows.groupBy("account_hash").agg(F.max_by(F.struct(*values), newest).alias("row"), F.max(F.when(F.col("seq") < 0, F.col("archived_at"))).alias("archived_at"))
    return best.select(*[F.col(c) if c in ("account_hash", "archived_at") else F.col(f"row.{c}").alias(c) for c in stored.columns])


def unarchived(accounts: DataFrame, buckets: DataFrame) -> DataFrame:
    """Clears the archive mark of accounts with usage after it."""
    seen = buckets.where(F.col("source").isin(*ACCOUNT_SOURCES)).groupBy(F.expr("substring(host_id, 6)").alias("account_hash")).agg(F.max("bucket_start").alias("active_at"))
    joined = accounts.join(seen, "account_hash", "left")
    back = F.coalesce(F.col("active_at") > F.col("archived_at"), F.lit(False))
    return joined.withColumn("archived_at", F.when(~back, F.col("archived_at"))).select(*accounts.columns)


def upsert_hosts(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """The latest name and time; a version or time zone that is not given keeps the one before."""
    rows = _together(stored, batch)
    kept = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return rows.groupBy("host_id").agg(F.max_by("hostname", "seq").alias("hostname"), F.max_by("last_seen", "seq").alias("last_seen"), kept("agent_version"), kept("timezone")).select(*stored.columns)


def account_names(labels: DataFrame) -> DataFrame:
    """(host_id, hostname): the last label that looks like a mail address, else the first that is not empty, else nothing."""
    mail = F.max_by("label", F.when(F.col("label").contains("@"), F.col("seq")))
    plain = F.min_by("label", F.when(trimmed(F.col("label")) != "", F.col("seq")))
    return labels.groupBy("host_id").agg(F.coalesce(mail, plain, F.lit("")).alias("hostname"))


@dataclass(frozen=True)
class Store:
    """The kept tables, with the columns of schema.HOST, BUCKET, SESSION and ACCOUNT."""

    hosts: DataFrame
    buckets: DataFrame
    sessions: DataFrame
    accounts: DataFrame


def uploaded(uploads: DataFrame, part: str) -> DataFrame:
    """The rows of one array of the uploads, with host_id, received_at and ``seq`` (upload by upload, in order)."""
    rows = uploads.select("upload_id", "host_id", "received_at", F.posexplode(part).alias("pos", "row"))
    return rows.select("host_id", "received_at", (F.col("upload_id") * (1 << 32) + F.col("pos")).alias("seq"), "row.*")


def placed_buckets(uploads: DataFrame) -> DataFrame:
    """All bucket rows, normalised, with the host they are stored under and ``known``; the host is null where a row has no place: an unknown source, no start, or usage of an account without a valid hash."""
    rows = normalized_buckets(uploaded(uploads, "buckets")).withColumn("known", F.coalesce(F.col("source").isin(*SOURCES), F.lit(False)))
    place = storage_host(F.col("host_id"), F.col("source"), F.col("account_hash"))
    return rows.withColumn("host_id", F.when(F.col("known") & F.col("bucket_start").isNotNull(), place))


def new_buckets(uploads: DataFrame) -> DataFrame:
    """The bucket rows that are taken, usage of accounts under the account."""
    return placed_buckets(uploads).where("host_id is not null").drop("known")


def unknown_sources(uploads: DataFrame) -> DataFrame:
    """(source, seq): each source of buckets that is not known, and where it was first seen."""
    return unknown_of(placed_buckets(uploads))


def unknown_of(placed: DataFrame) -> DataFrame:
    return placed.where(~F.col("known")).groupBy("source").agg(F.min("seq").alias("seq"))


def new_sessions(uploads: DataFrame) -> DataFrame:
    """Session rows of known sources; they always stay with the machine."""
    return normalized_sessions(uploaded(uploads, "sessions")).where(F.col("source").isin(*SOURCES))


def hosts_after(hosts: DataFrame, uploads: DataFrame, buckets: DataFrame) -> DataFrame:
    """Hosts after uploads: the machines that sent them and the accounts of their buckets (new_buckets)."""
    machines = uploads.select("host_id", "hostname", F.col("received_at").alias("last_seen"), "agent_version", "timezone", F.col("upload_id").alias("seq"))
    owned = buckets.where(F.col("source").isin(*ACCOUNT_SOURCES)).select("host_id", F.col("account_label").alias("label"), "received_at", "seq")
    known = hosts.where(F.col("host_id").startswith("acct:")).select("host_id", F.col("hostname").alias("label"), F.col("last_seen").alias("received_at"), F.lit(-1).cast("bigint").alias("seq"))
    names = account_names(owned.unionByName(known))
    seen = owned.groupBy("host_id").agg(F.max("received_at").alias("last_seen"), F.max("seq").alias("seq")).join(names, "host_id")
    return upsert_hosts(hosts, machines.unionByName(seen.select("host_id", "hostname", "last_seen", "seq"), allowMissingColumns=True))


def accounts_after(accounts: DataFrame, fresh: DataFrame, buckets: DataFrame) -> DataFrame:
    """Accounts after snapshots (those without a valid hash are left out) and buckets (new_buckets)."""
    valid = fresh.where(is_account_hash(F.col("account_hash")))
    return unarchived(upsert_accounts(accounts, valid.select(*accounts.columns, "seq")), buckets)


def ingest(store: Store, uploads: DataFrame) -> Store:
    """The store after the uploads (schema.UPLOAD plus upload_id, host_id and received_at).

    Taking the same uploads again changes nothing but ``last_seen``; rows without a place are left out (response() counts them).
    """
    buckets = new_buckets(uploads)
    return replace(
        store,
        hosts=hosts_after(store.hosts, uploads, buckets),
        buckets=upsert_buckets(store.buckets, buckets.select(*store.buckets.columns, "seq")),
        sessions=upsert_sessions(store.sessions, new_sessions(uploads).select(*store.sessions.columns, "seq")),
        accounts=accounts_after(store.accounts, normalized_accounts(uploaded(uploads, "accounts")), buckets),
    )


def response(stored: DataFrame, uploads: DataFrame, placed: DataFrame | None = None) -> DataFrame:
    """One row: ingested, protected and dropped buckets, ingested and dropped sessions, and the unknown sources of buckets, as first seen.

    ``stored`` are the buckets before the uploads (the touched days suffice). A row that is sent again counts as ingested; a protected one counts as protected
    only. A row without a place counts as dropped. Of unknown names, which clients may invent, the first MOST_UNKNOWN are listed. ``placed`` are the placed_buckets() where
    they are kept already; they are read several times.
    """
    rows, raw_sessions = placed_buckets(uploads) if placed is None else placed, normalized_sessions(uploaded(uploads, "sessions"))
    taken = rows.where("host_id is not null").select(*BUCKET_KEY, *_tokens(stored), "seq")
    kept = protected_rows(stored.select(*BUCKET_KEY, *_tokens(stored)), taken)
    known = F.coalesce(F.col("source").isin(*SOURCES), F.lit(False))
    first = unknown_of(rows).orderBy("seq").limit(MOST_UNKNOWN)
    parts = [
        kept.agg(F.count_if(~F.col("protected")).alias("buckets"), F.count_if("protected").alias("protected")),
        rows.agg(F.count_if(F.col("host_id").isNull()).alias("dropped_buckets")),
        raw_sessions.agg(F.count_if(known).alias("sessions"), F.count_if(~known).alias("dropped_sessions")),
        first.agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "source"))), lambda x: x["source"]).alias("unknown_sources")),
    ]
    one = parts[0].withColumn("one", F.lit(1))
    for part in parts[1:]:
        one = one.join(part.withColumn("one", F.lit(1)), "one")  # one row each
    return one.drop("one")


def _tokens(buckets: DataFrame) -> list[str]:
    return [c for c in buckets.columns if c not in BUCKET_KEY and c not in ("day", "total")]


def touched_days(batch: DataFrame) -> DataFrame:
    return batch.select(F.to_date("bucket_start").alias("day")).distinct()


def refreshed_rollups(rollups: DataFrame, buckets: DataFrame, batch: DataFrame) -> DataFrame:
    """Rollups after an upsert: the touched days are added up anew, the others stay. No drift, and doing it twice is doing it once."""
    from .scans import daily_rollups

    days = touched_days(batch)
    again = daily_rollups(buckets.join(days, F.to_date("bucket_start") == F.col("day"), "left_semi"))
    return rollups.join(days, "day", "left_anti").unionByName(again.select(*rollups.columns))
