"""Hosts, tokens, enrolment and accounts: small tables, changed by predicates and anti joins."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import instant

JOIN_SECONDS, MOST_PENDING, MOST_TRIES, TRY_SECONDS = 600, 32, 10, 600
STALE_DAYS = 7


def tokens_with_hosts(tokens: DataFrame, hosts: DataFrame) -> DataFrame:
    return tokens.join(hosts.select("host_id", "hostname", "last_seen"), "host_id").orderBy(F.desc("created_at"), "token_hash")


def hosts_by_last_seen(hosts: DataFrame) -> DataFrame:
    """Hosts as listed, with ``place`` from 1: the one seen last first, those never seen last. Hosts are machines and accounts, few whatever the usage."""
    order = Window.orderBy(F.desc_nulls_last("last_seen"), "host_id")
    return hosts.withColumn("place", F.row_number().over(order)).orderBy("place")


def authorised_host(tokens: DataFrame, hashed: str) -> DataFrame:
    """(host_id) of a token that is not revoked; no rows otherwise."""
    return tokens.where((F.col("token_hash") == hashed) & F.col("revoked_at").isNull()).select("host_id")


def add_token(tokens: DataFrame, hosts: DataFrame, token: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables with a new token; its host is added unless it is there."""
    host = token.select("host_id", F.lit("").alias("hostname"), F.col("created_at").alias("last_seen")).join(hosts, "host_id", "left_anti")
    return tokens.unionByName(token.select(*tokens.columns)), hosts.unionByName(host, allowMissingColumns=True)


def revoke_token(tokens: DataFrame, hashed: str, now: dt.datetime) -> DataFrame:
    hit = (F.col("token_hash") == hashed) & F.col("revoked_at").isNull()
    return tokens.withColumn("revoked_at", F.when(hit, instant(now)).otherwise(F.col("revoked_at")))


def deletable(hosts: DataFrame, tokens: DataFrame, host_id: str) -> str:
    """``ok``, ``account`` (belongs to an account), ``missing``, or ``active`` (a token is not revoked)."""
    if host_id.startswith("acct:"):
        return "account"
    if hosts.where(F.col("host_id") == host_id).isEmpty():
        return "missing"
    return "ok" if tokens.where((F.col("host_id") == host_id) & F.col("revoked_at").isNull()).isEmpty() else "active"


def without_host(tables: dict[str, DataFrame], host_id: str) -> dict[str, DataFrame]:
    """Every table without the host's rows."""
    return {name: t.where(~F.col("host_id").eqNullSafe(F.lit(host_id))) for name, t in tables.items()}


def set_archived(accounts: DataFrame, account_hash: str, at: dt.datetime | None) -> DataFrame:
    """Archives (keeping an earlier mark) or, without a time, restores an account."""
    mark = F.lit(None).cast("timestamp") if at is None else F.coalesce("archived_at", instant(at))
    return accounts.withColumn("archived_at", F.when(F.col("account_hash") == account_hash, mark).otherwise(F.col("archived_at")))


def listed_accounts(accounts: DataFrame, now: dt.datetime, stale_days: int = STALE_DAYS) -> DataFrame:
    """Accounts by label, with ``place`` from 1, ``stale`` (an unknown time is not stale) and ``active`` (neither archived nor stale). Accounts are few."""
    old = F.coalesce(F.col("fetched_at") < instant(now - dt.timedelta(days=stale_days)), F.lit(False))
    rows = accounts.withColumn("stale", old).withColumn("active", F.col("archived_at").isNull() & ~F.col("stale"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.lower("label"), "account_hash"))).orderBy("place")


def pending_joins(requests: DataFrame, now: dt.datetime) -> DataFrame:
    return requests.where((F.col("status") == "pending") & (F.col("expires_at") > instant(now))).orderBy("created_at", "join_id")


def may_ask(requests: DataFrame, now: dt.datetime) -> bool:
    return pending_joins(requests, now).count() < MOST_PENDING


def decide_join(requests: DataFrame, join_id: str, status: str, now: dt.datetime, token: str | None = None, token_hash: str | None = None) -> DataFrame:
    """Approves (with a token) or denies a request that is pending and in time; others stay."""
    hit = (F.col("join_id") == join_id) & (F.col("status") == "pending") & (F.col("expires_at") > instant(now))
    values = {"status": F.lit(status), "token": F.lit(token).cast("string"), "token_hash": F.lit(token_hash).cast("string")}
    return requests.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def claim_join(requests: DataFrame, join_id: str, claim_hash: str, now: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """(answer, requests after): an approved token is handed out once."""
    own = (F.col("join_id") == join_id) & (F.col("claim_hash") == claim_hash)
    hit = own & (F.col("status") == "approved") & (F.col("expires_at") > instant(now))
    answer = requests.where(own).select("status", F.when(hit, F.col("token")).alias("token"))
    after = {"status": F.when(hit, F.lit("claimed")).otherwise(F.col("status")), "token": F.when(~hit, F.col("token"))}
    return answer, requests.withColumns(after)


def expire_joins(requests: DataFrame, tokens: DataFrame, now: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """Requests past their time expire; the token of one that was approved but never claimed is revoked."""
    late = F.col("status").isin("pending", "approved") & (F.col("expires_at") <= instant(now))
    lost = requests.where(late & (F.col("status") == "approved")).select("token_hash", F.lit(True).alias("lost")).where("token_hash is not null").distinct()
    revoked = F.when(F.col("lost") & F.col("revoked_at").isNull(), instant(now)).otherwise(F.col("revoked_at"))
    after = {"status": F.when(late, F.lit("expired")).otherwise(F.col("status")), "token": F.when(~late, F.col("token"))}
    return requests.withColumns(after), tokens.join(lost, "token_hash", "left").withColumn("revoked_at", revoked).select(*tokens.columns)


def tries_before(tries: DataFrame, seconds: int = TRY_SECONDS, most: int = MOST_TRIES) -> DataFrame:
    """Tries (ip, at) with how many the address made in the ``seconds`` up to it, and whether that is too many."""
    span = Window.partitionBy("ip").orderBy(F.unix_seconds("at")).rangeBetween(-(seconds - 1), 0)
    return tries.withColumn("recent", F.count("*").over(span)).withColumn("refused", F.col("recent") > most)


def guarded_sessions(live: DataFrame, locked: DataFrame, pending: DataFrame, now: dt.datetime, seconds: int = 600) -> DataFrame:
    """Live login sessions (account_hash, session_id) to revoke: not among the locked ones, and not asked for within ``seconds``.

    An account without any locked session is not guarded.
    """
    keys = ["account_hash", "session_id"]
    fresh = pending.where(F.col("asked_at") > instant(now - dt.timedelta(seconds=seconds)))
    guarded = live.join(locked.select("account_hash").distinct(), "account_hash", "left_semi")
    return guarded.join(locked, keys, "left_anti").join(fresh, keys, "left_anti")


def new_unknown_types(seen: DataFrame, log: DataFrame) -> DataFrame:
    """Sessions of an unknown type that the log has not named yet, once each."""
    named = log.where("kind = 'unknown_type'").select("session_id")
    return seen.where("kind = 'unknown_type'").dropDuplicates(["session_id"]).join(named, "session_id", "left_anti")


def selected_jobs(jobs: DataFrame, destinations: DataFrame) -> DataFrame:
    """(destination, full): asked for by name, or scheduled where the destination is not blocked; full if any of its jobs is."""
    rows = jobs.join(destinations, "destination")
    go = F.col("explicit") | (F.col("scheduled") & ~F.col("blocked"))
    return rows.where(go).groupBy("destination").agg(F.bool_or("full").alias("full"))


def merged_config(new: DataFrame, old: DataFrame) -> DataFrame:
    """New destinations; a blank token keeps the old one."""
    kept = old.select("destination", F.col("token").alias("old_token"))
    return new.join(kept, "destination", "left").withColumn("token", F.coalesce(F.nullif(F.trim("token"), F.lit("")), "old_token")).drop("old_token")


def known_accounts(stored: DataFrame, login: DataFrame) -> DataFrame:
    """Stored accounts and the current login, one row per account."""
    return stored.join(login.withColumn("is_login", F.lit(True)), "account_hash", "full_outer").fillna(False, ["is_login"])


def next_checks(accounts: DataFrame, now_s: int, most_s: int = 60) -> DataFrame:
    """One row: when to look again (epoch second), ``most_s`` from now at the latest."""
    due = F.min(F.col("checked_s") + F.col("period_s"))
    return accounts.agg(F.least(F.coalesce(due, F.lit(now_s + most_s)), F.lit(now_s + most_s)).alias("next_s"))


def retry_delay(level: Column, jitter: Column) -> Column:
    """Seconds to wait after failures: 30, 60, ... up to 960, and up to 10 more."""
    return 30 * F.pow(F.lit(2), F.least(level, F.lit(5))) + F.least(jitter, F.lit(10))


def locked_sessions(before: DataFrame, more: DataFrame) -> DataFrame:
    """(account_hash, session_id): what was locked and what is locked now, each once; accounts that are not known get nothing."""
    known = more.join(before.select("account_hash").distinct(), "account_hash", "left_semi")
    return before.select("account_hash", "session_id").unionByName(known.select("account_hash", "session_id")).where("session_id is not null").distinct()


def still_pending(pending: DataFrame, live: DataFrame) -> DataFrame:
    """Sessions that were asked for and are still live."""
    return pending.join(live.select("account_hash", "session_id"), ["account_hash", "session_id"], "left_semi")


def account_name(stored_mail: Column, mail: Column, account_hash: Column) -> Column:
    """What to call an account: the mail address that was stored, that of its login, else eight digits of its hash."""
    return F.coalesce(F.nullif(F.trim(stored_mail), F.lit("")), F.nullif(F.trim(mail), F.lit("")), F.substring(account_hash, 1, 8))
