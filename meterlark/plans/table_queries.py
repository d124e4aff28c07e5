"""Queries over control tables, names, prices and logs, made from the test tables, with the same in SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import text_count, variant_count
from ..functions.text import clamped_or_unknown, first_filled, host_id_of_token, last_path_part, repository_name, utc_offset
from ..functions.times import UTC, export_time, log_time, since_time
from ..operators import changes, control, upserts, views
from ..operators.pricing import PARTS, imported_prices, keep_prices, layered_prices, model_count, price_index, prices_from_json
from ..operators.usage import active_seconds, client_key, content_hash, first_of_each_account, normalized_accounts, normalized_buckets, normalized_sessions, storage_host, with_session
from ..schema import HOST, TOKENS
from ..session import new_folder
from ..sources.base import SourceAdapter, collect_all
from ..sources.claude import ClaudeLogs, without_sessions
from ..sources.codex import CodexLogs
from ..sources.events import SQL_USAGE, read_usage
from ..sources.incremental import LogStore
from ..sources.pi import PiLogs
from ..sources.usage_export import UsageExport
from ..streaming.delivery import Answer, Batch, Journal, Refused, deliver
from ..streaming.tables import windowed_usage
from ..versions import VersionedTable
from .usage_queries import buckets_of, query, sessions_of, usage

NOW = dt.datetime(2024, 1, 20, 12, 0, tzinfo=UTC)
SQL_NOW = "TIMESTAMP '2024-01-20 12:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp")).withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))


SQL_EVENTS = "ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"

# Sessions


@query("""WITH e AS (SELECT conv_id::VARCHAR AS session_id, turn, role, make_timestamp((1704067200 + conv_id % 1000 * 86400 + turn * (turn + 20)) * 1000000) AS moment FROM conversations),
t AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY session_id ORDER BY moment, turn ROWS UNBOUNDED PRECEDING) AS n FROM e),
s AS (SELECT session_id, n, floor((epoch_us(max(moment)) - epoch_us(min(moment))) / 1000000)::BIGINT AS s FROM t WHERE role <> 'user' AND n > 0 GROUP BY ALL)
SELECT 'chat' AS source, session_id, sum(s)::BIGINT AS active_seconds FROM s GROUP BY session_id""")
def conversations_active_seconds(spark, sf_dir):
    """Conversations as sessions: a turn every few seconds, each later one after a longer pause."""
    at = F.timestamp_seconds(1704067200 + F.col("conv_id") % 1000 * 86400 + F.col("turn") * (F.col("turn") + 20))
    rows = table(spark, sf_dir, "conversations").select(F.lit("chat").alias("source"), F.col("conv_id").cast("string").alias("session_id"), "role", at.alias("at"), F.col("turn").alias("seq"))
    return active_seconds(rows)


@query("""WITH e AS (SELECT user_id // 3 AS session_id, event_id AS turn, CASE WHEN event_type = 'click' THEN 'user' ELSE 'assistant' END AS role, ts AS moment FROM events),
t AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY session_id ORDER BY moment, turn ROWS UNBOUNDED PRECEDING) AS n FROM e),
s AS (SELECT session_id, n, floor((epoch_us(max(moment)) - epoch_us(min(moment))) / 1000000)::BIGINT AS s FROM t WHERE role <> 'user' AND n > 0 GROUP BY ALL)
SELECT 'events' AS source, session_id::VARCHAR AS session_id, sum(s)::BIGINT AS active_seconds FROM s GROUP BY session_id""", "sessions_active_seconds")
def sessions_active_seconds(spark, sf_dir):
    """Three users' events to a session, clicks as the user's part."""
    role = F.when(F.col("event_type") == "click", F.lit("user")).otherwise(F.lit("assistant"))
    rows = events(spark, sf_dir).select(F.lit("events").alias("source"), F.floor(F.col("user_id") / 3).cast("string").alias("session_id"), role.alias("role"), "at", F.col("event_id").alias("seq"))
    return active_seconds(rows)


@query(f"WITH {SQL_USAGE} SELECT DISTINCT session_id FROM entries WHERE source = 'pi' AND session_id NOT IN (SELECT session_id FROM entries WHERE source = 'codex')", "anti_join_transcripts")
def anti_join_transcripts(spark, sf_dir):
    rows = usage(spark, sf_dir).select("source", "session_id")
    return without_sessions(rows.where("source = 'pi'").select("session_id").distinct(), rows.where("source = 'codex'"))


# Hosts, tokens, accounts


def _event_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = lambda n, text: F.when(F.col("event_id") % n == 0, F.concat(F.lit(text), F.col("event_id")))
    return events(spark, sf_dir).select(
        F.concat(F.lit("host"), F.col("user_id") % 7).alias("host_id"), F.concat(F.lit("m"), F.col("event_id") % 3).alias("hostname"), F.col("at").alias("last_seen"),
        some(40, "v").alias("agent_version"), some(50, "z").alias("timezone"), F.col("event_id").alias("seq"),
    )


@query("""SELECT 'host' || (user_id % 7) AS host_id, 'm' || arg_max(event_id % 3, event_id) AS hostname, epoch_us(arg_max(ts, event_id)) AS seen_us,
  'v' || max(event_id) FILTER (WHERE event_id % 40 = 0) AS agent_version, 'z' || max(event_id) FILTER (WHERE event_id % 50 = 0) AS timezone FROM events GROUP BY 1""")
def hosts_keep_known_fields(spark, sf_dir):
    """Stored after the first rows, then brought up to date by the others: a field that is not given keeps what was there."""
    rows = _event_hosts(spark, sf_dir)
    stored = upserts.upsert_hosts(spark.createDataFrame([], HOST), rows.where("seq < 600"))
    return upserts.upsert_hosts(stored, rows.where("seq >= 600")).select("host_id", "hostname", F.unix_micros("last_seen").alias("seen_us"), "agent_version", "timezone")


_ACCOUNTS = "a AS (SELECT substr(sha256('acct-' || i), 1, 32) AS account_hash, make_timestamp(2024, (1 + i)::INT, 10, 0, 0, 0) AS mark FROM range(2) t(i))"


def _accounts(spark: SparkSession) -> DataFrame:
    mark = F.make_timestamp(F.lit(2024), (F.col("id") + 1).cast("int"), F.lit(10), F.lit(0), F.lit(0), F.lit(0))
    return spark.range(0, 2, 1, 1).select(F.substring(F.sha2(F.concat(F.lit("acct-"), F.col("id")), 256), 1, 32).alias("account_hash"), F.concat(F.lit("Label"), "id").alias("label"), mark.alias("archived_at"), mark.alias("fetched_at"))


@query(f"""WITH {SQL_USAGE}, {_ACCOUNTS} SELECT account_hash, CASE WHEN (SELECT max(bucket_start) FROM buckets WHERE host_id = 'acct:' || account_hash) > mark THEN NULL ELSE epoch(mark)::BIGINT END AS archived_s FROM a""")
def unarchived_by_usage(spark, sf_dir):
    """One account has usage after it was archived, one was archived after all usage."""
    return upserts.unarchived(_accounts(spark), buckets_of(spark, sf_dir)).select("account_hash", F.unix_seconds("archived_at").alias("archived_s"))


_OWNERS = """o AS (SELECT c_custkey AS k, substr(sha256(c_name), 1, 32) AS account_hash, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE lower(c_name) END || (c_custkey % 3) AS label,
  CASE WHEN c_custkey % 5 = 0 THEN TIMESTAMP '2024-01-10' END AS archived, CASE WHEN c_custkey % 11 <> 0 THEN {now} - to_days((c_custkey % 15)::INT) END AS fetched FROM customer)"""


def _owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An account for each customer: some archived, some not fetched for days, some never."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.substring(F.sha2("c_name", 256), 1, 32).alias("account_hash"), F.concat(F.when(k % 2 == 0, F.upper("c_name")).otherwise(F.lower("c_name")), k % 3).alias("label"),
        F.when(k % 5 == 0, F.lit(dt.datetime(2024, 1, 10, tzinfo=UTC))).alias("archived_at"), F.when(k % 11 != 0, F.lit(NOW) - F.make_dt_interval(days=(k % 15).cast("int"))).alias("fetched_at"), "c_custkey",
    )


@query(f"""WITH {_OWNERS.format(now=SQL_NOW)}, b AS (SELECT *, coalesce(fetched < {SQL_NOW} - INTERVAL 7 DAY, false) AS stale FROM o)
SELECT account_hash, stale, archived IS NULL AND NOT stale AS active, row_number() OVER (ORDER BY lower(label), account_hash)::INTEGER AS place FROM b""")
def listed_accounts(spark, sf_dir):
    return control.listed_accounts(_owners(spark, sf_dir), NOW).select("account_hash", "stale", "active", "place")


@query(f"""WITH {_OWNERS.format(now=SQL_NOW)} SELECT account_hash, epoch(CASE WHEN k IN (5, 6) THEN coalesce(archived, {SQL_NOW}) ELSE archived END)::BIGINT AS archived_s, epoch(CASE WHEN k = 5 THEN NULL WHEN k = 6 THEN coalesce(archived, {SQL_NOW}) ELSE archived END)::BIGINT AS restored_s FROM o""")
def archived_and_restored(spark, sf_dir):
    """Two accounts are archived, one of them again, which keeps the earlier mark; then that one is restored."""
    rows = _owners(spark, sf_dir)
    first, second = (rows.where(F.col("c_custkey") == k).first().account_hash for k in (5, 6))
    both = control.set_archived(control.set_archived(rows, first, NOW), second, NOW)
    after = control.set_archived(both, first, None)
    seconds = lambda df, name: df.select("account_hash", F.unix_seconds("archived_at").alias(name))
    return seconds(both, "archived_s").join(seconds(after, "restored_s"), "account_hash")


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate").cast("timestamp"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("token_hash"), F.col("o_custkey").cast("string").alias("host_id"), F.col("o_orderdate").cast("timestamp").alias("created_at"), gone.alias("revoked_at"))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("host_id"), F.col("c_name").alias("hostname"), F.lit(None).cast("timestamp").alias("last_seen"))


@query("""SELECT host_id, hostname FROM (SELECT c_custkey::VARCHAR AS host_id, c_name AS hostname FROM customer UNION ALL
  SELECT DISTINCT (o_custkey * 2)::VARCHAR, '' FROM orders WHERE o_orderkey % 100 = 0 AND o_custkey * 2 NOT IN (SELECT c_custkey FROM customer))""")
def hosts_of_new_tokens(spark, sf_dir):
    """A token's host is added unless it is there."""
    tokens = _tokens(spark, sf_dir)
    new = tokens.where("cast(token_hash as bigint) % 100 = 0").withColumn("host_id", (F.col("host_id").cast("bigint") * 2).cast("string"))
    return control.add_token(tokens, _customers(spark, sf_dir), new.dropDuplicates(["host_id"]))[1].select("host_id", "hostname")


@query(f"""SELECT o_orderkey::VARCHAR AS token_hash, epoch(CASE WHEN o_orderstatus = 'F' THEN o_orderdate WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders WHERE o_orderstatus <> 'F') THEN {SQL_NOW} END)::BIGINT AS revoked_s FROM orders""")
def revoked_tokens(spark, sf_dir):
    tokens = _tokens(spark, sf_dir)
    one = tokens.where("revoked_at is null").agg(F.min(F.col("token_hash").cast("bigint"))).first()[0]
    return control.revoke_token(tokens, str(one), NOW).select("token_hash", F.unix_seconds("revoked_at").alias("revoked_s"))


@query("""WITH o AS (SELECT min(o_custkey) AS c FROM orders) SELECT 'tokens' AS tbl, count(*) AS n FROM orders, o WHERE o_custkey <> c UNION ALL SELECT 'hosts', count(*) FROM customer, o WHERE c_custkey <> c""")
def tables_without_a_host(spark, sf_dir):
    tables = {"tokens": _tokens(spark, sf_dir), "hosts": _customers(spark, sf_dir)}
    one = tables["tokens"].agg(F.min(F.col("host_id").cast("bigint"))).first()[0]
    left = control.without_host(tables, str(one))
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "n") for name, t in left.items()]
    return counts[0].unionByName(counts[1])


@query("SELECT o_custkey::VARCHAR AS host_id FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey = (SELECT max(o_orderkey) FROM orders WHERE o_orderstatus <> 'F')")
def authorised_host(spark, sf_dir):
    tokens = _tokens(spark, sf_dir)
    one = tokens.where("revoked_at is null").agg(F.max(F.col("token_hash").cast("bigint"))).first()[0]
    return control.authorised_host(tokens, str(one))


@query("""WITH h AS (SELECT c_custkey::VARCHAR AS host_id, c_name AS hostname, CASE WHEN c_custkey % 7 <> 0 THEN TIMESTAMP '2024-01-01' + to_hours(((c_custkey * 37) % 101)::BIGINT) END AS seen FROM customer)
SELECT host_id, hostname, row_number() OVER (ORDER BY seen DESC NULLS LAST, host_id)::INTEGER AS place FROM h""")
def hosts_by_last_seen(spark, sf_dir):
    """Machines with the time they were last seen, some never, and the place that each one has in the list."""
    hours = ((F.col("host_id").cast("bigint") * 37) % 101).cast("int")
    seen = F.when(F.col("host_id").cast("bigint") % 7 != 0, F.lit(dt.datetime(2024, 1, 1, tzinfo=UTC)) + F.make_dt_interval(hours=hours))
    return control.hosts_by_last_seen(_customers(spark, sf_dir).withColumn("last_seen", seen)).select("host_id", "hostname", "place")


@query(f"""SELECT 'j' || o_orderkey AS join_id FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 3 = 0""")
def pending_joins(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    late = F.when(F.col("o_orderkey") % 3 == 0, F.lit(NOW + dt.timedelta(seconds=1))).otherwise(F.lit(NOW))
    requests = rows.select(F.concat(F.lit("j"), "o_orderkey").alias("join_id"), F.when(F.col("o_orderstatus") == "O", F.lit("pending")).otherwise(F.lit("denied")).alias("status"), late.alias("expires_at"), F.col("o_orderdate").alias("created_at"))
    return control.pending_joins(requests, NOW).select("join_id")


@query("""WITH s AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error') SELECT user_id::VARCHAR AS session_id FROM s WHERE user_id % 3 <> 0""")
def new_unknown_types(spark, sf_dir):
    kinds = events(spark, sf_dir).select(F.col("user_id").cast("string").alias("session_id"), F.when(F.col("event_type") == "error", F.lit("unknown_type")).otherwise(F.lit("other")).alias("kind"))
    return control.new_unknown_types(kinds, kinds.where("cast(session_id as bigint) % 3 = 0").distinct()).select("session_id")


_JOBS = "j AS (SELECT 'd' || (o_custkey % 40) AS destination, o_orderstatus = 'P' AS explicit, o_orderstatus = 'O' AS scheduled, o_orderkey % 5 = 0 AS \"full\", o_custkey % 40 % 4 = 0 AS blocked FROM orders)"


@query(f"WITH {_JOBS} SELECT destination, bool_or(\"full\") AS \"full\" FROM j WHERE explicit OR (scheduled AND NOT blocked) GROUP BY destination")
def selected_jobs(spark, sf_dir):
    k = F.col("o_custkey") % 40
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("d"), k).alias("destination"), (F.col("o_orderstatus") == "P").alias("explicit"), (F.col("o_orderstatus") == "O").alias("scheduled"), (F.col("o_orderkey") % 5 == 0).alias("full"), (k % 4 == 0).alias("blocked"))
    return control.selected_jobs(rows.drop("blocked"), rows.select("destination", "blocked").distinct())


@query("SELECT c_custkey::VARCHAR AS destination, CASE WHEN c_custkey % 3 = 0 THEN 'new' || c_custkey WHEN c_custkey % 2 = 0 THEN c_name END AS token FROM customer")
def merged_config(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    new = rows.select(F.col("c_custkey").cast("string").alias("destination"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("new"), "c_custkey")).otherwise(F.lit(" ")).alias("token"))
    old = rows.where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("destination"), F.col("c_name").alias("token"))
    return control.merged_config(new, old)


@query("SELECT c_custkey::VARCHAR AS account_hash, c_custkey % 2 = 1 AS is_login FROM customer WHERE c_custkey % 4 <> 2")
def known_accounts(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("account_hash"), "c_custkey")
    both = control.known_accounts(rows.where("c_custkey % 4 in (0, 3)").select("account_hash"), rows.where("c_custkey % 2 = 1").select("account_hash"))
    return both.select("account_hash", "is_login")


@query("SELECT least(min(1704067200 + c_custkey * 10 + 30 + c_nationkey % 5), 1704067200 + 60)::BIGINT AS next_s FROM customer")
def next_checks(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select((1704067200 + F.col("c_custkey") * 10).alias("checked_s"), (30 + F.col("c_nationkey") % 5).alias("period_s"))
    return control.next_checks(rows, 1704067200).select(F.col("next_s").cast("bigint").alias("next_s"))


@query("SELECT event_id, (30 * pow(2, least(user_id % 9, 5)) + least(event_id % 15, 10))::DOUBLE AS seconds FROM events")
def retry_delays(spark, sf_dir):
    rows = events(spark, sf_dir)
    return rows.select("event_id", control.retry_delay(F.col("user_id") % 9, F.col("event_id") % 15).cast("double").alias("seconds"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 50")
def last_events(spark, sf_dir):
    return changes.last_events(events(spark, sf_dir), "user_id", F.struct("at", "event_id")).select("user_id", "event_id")


@query("SELECT arg_min(c_name, c_custkey) AS label, c_nationkey::VARCHAR AS account_hash FROM customer GROUP BY c_nationkey")
def first_accounts(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("account_hash"), F.col("c_name").alias("label"), "c_custkey")
    return first_of_each_account(rows, "c_custkey").select("label", "account_hash")


@query(f"WITH {SQL_USAGE} SELECT seq, CASE WHEN source <> 'cursor' THEN 'machine' WHEN seq % 4 <> 0 THEN 'acct:' || substr(sha256('x'), 1, 32) END AS host FROM entries")
def storage_hosts(spark, sf_dir):
    hashed = F.when(F.col("seq") % 4 != 0, F.substring(F.sha2(F.lit("x"), 256), 1, 32)).otherwise(F.lit("none"))
    return usage(spark, sf_dir).select("seq", storage_host(F.lit("machine"), F.col("source"), hashed).alias("host"))


# Pages


@query(f"""WITH {SQL_USAGE}, g AS (SELECT host_id AS key, sum(total)::BIGINT AS total FROM buckets GROUP BY 1) SELECT key, total, coalesce(n_name, key) AS label FROM g LEFT JOIN nation ON key = 'host' || n_nationkey AND n_nationkey % 2 = 0""")
def labelled_hosts(spark, sf_dir):
    groups = buckets_of(spark, sf_dir).groupBy(F.col("host_id").alias("key")).agg(F.sum("total").alias("total"))
    names = table(spark, sf_dir, "nation").select(F.concat(F.lit("host"), "n_nationkey").alias("host_id"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.lit(" ")).alias("hostname"))
    return views.with_host_names(groups, names)


@query(f"""WITH {SQL_USAGE}, s AS (SELECT source, session_id, min(moment) AS first_at FROM entries GROUP BY ALL) SELECT source, session_id, epoch_us(first_at + INTERVAL 3 HOUR + INTERVAL 30 MINUTE) AS local_us FROM s""")
def local_session_starts(spark, sf_dir):
    hosts = spark.createDataFrame([("host", "+03:30")], "host_id string, timezone string")
    return views.sessions_with_zones(sessions_of(spark, sf_dir), hosts).select("source", "session_id", F.unix_micros("local_first_at").alias("local_us"))


@query("SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 40")
def third_page(spark, sf_dir):
    """A page of a list: twenty rows are what it shows."""
    return views.page_of(table(spark, sf_dir, "part"), 2, 20, F.desc("p_retailprice"), "p_partkey").select("p_partkey")


@query("""WITH b AS (SELECT DISTINCT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS bin_s FROM events) SELECT bin_s, greatest(bin_s, 1704100000) AS from_s, least(bin_s + 3600, 1705000000) AS to_s FROM b""")
def bin_windows(spark, sf_dir):
    bins = events(spark, sf_dir).select((F.floor(F.unix_seconds("at") / 3600) * 3600).alias("bin_s")).distinct()
    out = views.bin_window(bins, 3600, 1704100000, 1705000000)
    return out.select("bin_s", F.col("from_s").cast("bigint").alias("from_s"), F.col("to_s").cast("bigint").alias("to_s"))


# Names and numbers


@query(f"""WITH {SQL_EVENTS} SELECT event_id, greatest(round(CASE WHEN event_id % 4 = 3 THEN 0 ELSE value * 1000 END)::BIGINT, 0) AS in_text, CASE event_id % 3 WHEN 0 THEN k WHEN 1 THEN greatest(k - 50, 0) ELSE 0 END AS in_json FROM ev""")
def tolerant_counts(spark, sf_dir):
    rows = events(spark, sf_dir)
    cell = F.when(F.col("event_id") % 4 == 3, F.lit("n/a")).otherwise(F.concat(F.lit(" "), F.format_number(F.round(F.col("value") * 1000), 0)))
    doc = F.when(F.col("event_id") % 3 == 0, F.format_string('{"n": "%d"}', "k")).when(F.col("event_id") % 3 == 1, F.format_string('{"n": %d}', F.col("k") - 50)).otherwise(F.lit('{"n": true}'))
    return rows.select("event_id", text_count(cell).alias("in_text"), variant_count(F.try_parse_json(doc), "$.n").alias("in_json"))


@query("""SELECT event_id, epoch_us(CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('millisecond', ts) WHEN 2 THEN date_trunc('second', ts) END) AS log_us,
  epoch_us(CASE event_id % 3 WHEN 0 THEN date_trunc('minute', ts) - INTERVAL 2 HOUR WHEN 1 THEN date_trunc('second', ts) END) AS export_us, CASE WHEN event_id % 2 = 0 THEN epoch(date_trunc('day', ts))::BIGINT END AS since_s FROM events""")
def tolerant_times(spark, sf_dir):
    rows, n = events(spark, sf_dir), F.col("event_id")
    log = F.when(n % 4 == 0, F.unix_seconds("at").cast("string")).when(n % 4 == 1, F.unix_millis("at").cast("string")).when(n % 4 == 2, F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.lit("yesterday"))
    export = F.when(n % 3 == 0, F.date_format("at", "yyyy-MM-dd HH:mm")).when(n % 3 == 1, F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.lit("soon"))
    since = F.when(n % 2 == 0, F.date_format("at", "yyyy-MM-dd")).otherwise(F.date_format("at", "yyyy-MM-dd HH:mm"))
    return rows.select("event_id", F.unix_micros(log_time(log)).alias("log_us"), F.unix_micros(export_time(export, "Africa/Cairo")).alias("export_us"), F.unix_seconds(since_time(since)).alias("since_s"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'unknown' ELSE substr(p_name, 1, 9) END AS name, 'b' || p_size AS folder, 'r' || p_size AS repository, substr(sha256(p_name), 1, 32) AS host,
  CASE WHEN p_size % 20 <= 14 THEN '+' || lpad((p_size % 20)::VARCHAR, 2, '0') || ':30' END AS utc_offset, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_type END AS filled FROM part""")
def folded_names(spark, sf_dir):
    rows = table(spark, sf_dir, "part")
    two = F.lpad((F.col("p_size") % 20).cast("string"), 2, "0")
    return rows.select(
        "p_partkey", clamped_or_unknown(F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit("  "), "p_name")), 9).alias("name"),
        last_path_part(F.concat(F.lit("C:\\a/b"), F.col("p_size"), F.lit("//"))).alias("folder"), repository_name(F.concat(F.lit("git@x.test:me/r"), F.col("p_size"), F.lit(".git"))).alias("repository"),
        host_id_of_token(F.col("p_name")).alias("host"), utc_offset(F.concat(F.lit(" +"), two, F.lit(":30"))).alias("utc_offset"),
        first_filled(F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(F.lit(" ")), F.col("p_type")).alias("filled"),
    )


@query(f"""WITH {SQL_USAGE} SELECT seq, CASE WHEN seq % 7 = 0 THEN 'unknown' ELSE model END AS model, greatest(input - 500, 0) AS input, greatest(input - 500, 0) + output + cache_read + cache_creation + reasoning AS total FROM entries""")
def normalised_buckets(spark, sf_dir):
    rows = usage(spark, sf_dir).withColumn("bucket_start", F.col("at")).withColumns({"model": F.when(F.col("seq") % 7 == 0, F.lit(" ")).otherwise(F.concat(F.col("model"), F.lit(" "))), "input": F.col("input") - 500})
    return normalized_buckets(rows).select("seq", "model", "input", "total")


# Prices


def _price_texts(spark: SparkSession, sf_dir: str, factor: int, condensed: bool, when: str = "true") -> DataFrame:
    """The parts table as price tables in JSON, one text for each 500 parts."""
    price = F.format_string("%.2f", F.col("p_retailprice") * factor)
    entry = F.concat(F.lit('"m'), "p_partkey", F.lit('": {"input": '), price, F.lit(', "output": 2}')) if condensed else F.concat(F.lit('"m'), "p_partkey", F.lit('": {"input_cost_per_token": '), price, F.lit("}"))
    rows = table(spark, sf_dir, "part").where(when)
    body = rows.groupBy(F.expr("p_partkey div 500")).agg(F.array_join(F.sort_array(F.collect_list(entry)), ", ").alias("b"))
    whole = F.concat(F.lit('{"updated_at": "2024-01-02T00:00:00Z", "models": {'), "b", F.lit("}}")) if condensed else F.concat(F.lit("{"), "b", F.lit("}"))
    return body.select(whole.alias("value"))


@query("""SELECT 'm' || p_partkey AS key, round(p_retailprice * CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 4 END, 2) AS input, CASE WHEN p_partkey % 2 = 0 THEN 2.0 ELSE 0.0 END::DOUBLE AS output FROM part""")
def layered_price_tables(spark, sf_dir):
    """A cache of half of the parts in one form over a snapshot of all in the other."""
    rows = prices_from_json(_price_texts(spark, sf_dir, 2, True, "p_partkey % 2 = 0"), "cache").unionByName(prices_from_json(_price_texts(spark, sf_dir, 4, False), "snapshot"))
    return layered_prices(rows).select("key", "input", "output")


@query("SELECT count(*) AS models FROM part")
def price_table_size(spark, sf_dir):
    return model_count(prices_from_json(_price_texts(spark, sf_dir, 2, True), "cache"))


@query("""SELECT lower(p_brand) AS slug, min(p_retailprice) AS input FROM part GROUP BY 1""")
def price_slugs(spark, sf_dir):
    """Keys that name a provider rank behind plain ones; here each brand has one plain key and one behind a provider."""
    plain = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("key")).agg(F.min("p_retailprice").alias("input"))
    vendor = plain.select(F.concat(F.lit("openai/"), "key").alias("key"), (F.col("input") * 3).alias("input"))
    book = plain.unionByName(vendor).withColumns({p: F.lit(None).cast("double") for p in PARTS if p != "input"})
    return price_index(book).select("slug", F.col("price.input").alias("input"))


# Logs: events written as the lines that a tool writes, and read back


def _claude_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usage(spark, sf_dir).where("source = 'claude-code'")
    used = F.struct(F.col("input").alias("input_tokens"), F.col("output").alias("output_tokens"), F.col("cache_read").alias("cache_read_input_tokens"), F.col("cache_creation").alias("cache_creation_input_tokens"))
    message = F.struct(F.concat(F.lit("m"), "seq").alias("id"), F.col("model").alias("model"), used.alias("usage"))
    line = F.struct(F.lit("assistant").alias("type"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.concat(F.lit("/home/"), "project").alias("cwd"), message.alias("message"))
    return rows.select("project", "seq", F.to_json(line).alias("line"))


def _codex_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usage(spark, sf_dir).where("source = 'codex'")
    last = F.struct((F.col("input") + F.col("cache_read")).alias("input_tokens"), F.col("cache_read").alias("cached_input_tokens"), (F.col("output") + F.col("reasoning")).alias("output_tokens"), F.col("reasoning").alias("reasoning_output_tokens"))
    info = F.struct(F.col("model").alias("model"), last.alias("last_token_usage"))
    line = F.struct(F.lit("event_msg").alias("type"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.struct(F.lit("token_count").alias("type"), info.alias("info")).alias("payload"))
    return rows.select("project", "seq", F.to_json(line).alias("line"))


def _pi_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usage(spark, sf_dir).where("source = 'pi'")
    used = F.struct("input", (F.col("output") + F.col("reasoning")).alias("output"), F.col("cache_read").alias("cacheRead"), F.col("cache_creation").alias("cacheWrite"), "reasoning")
    line = F.struct(F.lit("message").alias("type"), F.concat(F.lit("e"), "seq").alias("id"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.struct(F.lit("assistant").alias("role"), F.col("model").alias("model"), used.alias("usage")).alias("message"))
    header = F.concat(F.lit('{"type": "session", "version": 3, "id": "'), "project", F.lit('", "cwd": "/w/'), "project", F.lit('"}'))
    return rows.select("project", "seq", F.to_json(line).alias("line")).unionByName(rows.select("project", F.lit(-1).cast("bigint").alias("seq"), header.alias("line")).distinct())


def _written(lines: DataFrame, folder: str) -> str:
    """Files ``<folder>/<project>/part-*.jsonl``, one a project with a name of its own, lines in the order of ``seq``."""
    plain = {"extension": "jsonl", "sep": "\x01", "quote": "", "escapeQuotes": "false", "header": "false", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    number = F.coalesce(F.regexp_extract("project", r"(\d+)", 1).try_cast("int"), F.lit(0))
    dealt = lines.withColumn("dir", F.col("project")).repartitionById(16, F.pmod(number, F.lit(16)).cast("int")).sortWithinPartitions("dir", "seq")
    dealt.select("line", "dir").write.options(**plain).partitionBy("dir").csv(folder)
    return folder


def _read_back(spark: SparkSession, adapter: SourceAdapter, folder: str) -> DataFrame:
    entries = adapter.read(spark, [folder]).entries
    return entries.groupBy("source", "model", "project").agg(F.count("*").alias("calls"), *[F.sum(c).alias(c) for c in TOKENS])


def _sql_logs(source: str, counts: tuple[str, ...], project: str = "project") -> str:
    sums = ", ".join(f"sum({c})::BIGINT AS {c}" if c in counts else f"0::BIGINT AS {c}" for c in TOKENS)
    return f"WITH {SQL_USAGE} SELECT source, model, {project} AS project, count(*) AS calls, {sums} FROM entries WHERE source = '{source}' AND {' + '.join(counts)} > 0 GROUP BY ALL"


@query(_sql_logs("claude-code", ("input", "output", "cache_read", "cache_creation")))
def claude_logs(spark, sf_dir):
    folder = new_folder(spark, "logs-a")
    _written(_claude_lines(spark, sf_dir), f"{folder}/projects")
    return _read_back(spark, ClaudeLogs(), folder)


@query(_sql_logs("codex", ("input", "output", "cache_read", "reasoning"), "'unknown'"))
def codex_logs(spark, sf_dir):
    return _read_back(spark, CodexLogs(), _written(_codex_lines(spark, sf_dir), new_folder(spark, "logs-b")))


@query(f"""WITH {SQL_USAGE}, e AS (
  SELECT project, seq, last_value(CASE WHEN seq % 3 = 0 THEN model END IGNORE NULLS) OVER (PARTITION BY project ORDER BY seq) AS model, input + cache_read AS a, output + reasoning AS b, cache_read AS c, reasoning AS d,
    count(*) FILTER (WHERE seq % 11 = 0) OVER (PARTITION BY project ORDER BY seq) AS life FROM entries WHERE source = 'codex'
), t AS (SELECT project, seq, model, sum(a) OVER w AS a, sum(b) OVER w AS b, sum(c) OVER w AS c, sum(d) OVER w AS d FROM e WINDOW w AS (PARTITION BY project, life ORDER BY seq)
), l AS (SELECT *, a + b AS s, lag(a) OVER p AS pa, lag(b) OVER p AS pb, lag(c) OVER p AS pc, lag(d) OVER p AS pd, lag(a + b) OVER p AS ps FROM t WINDOW p AS (PARTITION BY project ORDER BY seq)
), f AS (SELECT *, pa IS NULL OR a < pa OR b < pb OR c < pc OR d < pd AS anew FROM l WHERE NOT coalesce(s > 0 AND s = ps, false)
), u AS (SELECT project, model, CASE WHEN anew THEN a ELSE a - pa END AS a, CASE WHEN anew THEN b ELSE b - pb END AS b, CASE WHEN anew THEN c ELSE c - pc END AS c, CASE WHEN anew THEN d ELSE d - pd END AS d FROM f
), n AS (SELECT project, coalesce(model, 'unknown') AS model, greatest(a - c, 0) AS input, greatest(b - d, 0) AS output, c, d FROM u)
SELECT 'codex' AS source, model, project, count(*) AS calls, sum(input)::BIGINT AS input, sum(output)::BIGINT AS output, sum(c)::BIGINT AS cache_read, 0::BIGINT AS cache_creation, sum(d)::BIGINT AS reasoning
FROM n WHERE input + output + c + d > 0 GROUP BY ALL""")
def codex_totals(spark, sf_dir):
    """Logs with a header, models told by turns, running totals that begin anew now and then, and lines that repeat the total before."""
    rows = usage(spark, sf_dir).where("source = 'codex'").select("project", "seq", "model", "at", (F.col("input") + F.col("cache_read")).alias("a"), (F.col("output") + F.col("reasoning")).alias("b"), F.col("cache_read").alias("c"), F.col("reasoning").alias("d"))
    so_far = Window.partitionBy("project").orderBy("seq")
    rows = rows.withColumn("life", F.count_if(F.col("seq") % 11 == 0).over(so_far))
    life = Window.partitionBy("project", "life").orderBy("seq")
    a, b, c, d = (F.sum(x).over(life) for x in "abcd")
    total = F.struct(a.alias("input_tokens"), b.alias("output_tokens"), c.alias("cached_input_tokens"), d.alias("reasoning_output_tokens"), (a + b).alias("total_tokens"))
    stamp = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp")
    counts = F.to_json(F.struct(F.lit("event_msg").alias("type"), stamp, F.struct(F.lit("token_count").alias("type"), F.struct(total.alias("total_token_usage")).alias("info")).alias("payload")))
    turn = F.to_json(F.struct(F.lit("turn_context").alias("type"), stamp, F.struct("model").alias("payload")))
    header = F.to_json(F.struct(F.lit("session_meta").alias("type"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"), F.struct(F.col("project").alias("id"), F.concat(F.lit("/w/"), "project").alias("cwd")).alias("payload")))
    said = rows.select("project", "seq", counts.alias("counts"), turn.alias("turn"))
    line = lambda when, place, text: said.where(when).select("project", (F.col("seq") * 4 + place).alias("seq"), F.col(text).alias("line"))
    lines = line("seq % 3 = 0", 0, "turn").unionByName(line("true", 1, "counts")).unionByName(line("seq % 7 = 0", 2, "counts"))
    lines = lines.unionByName(rows.select("project").distinct().select("project", F.lit(-1).cast("bigint").alias("seq"), header.alias("line")))
    return _read_back(spark, CodexLogs(), _written(lines, new_folder(spark, "logs-f")))


@query(_sql_logs("pi", ("input", "output", "cache_read", "cache_creation", "reasoning")))
def pi_logs(spark, sf_dir):
    return _read_back(spark, PiLogs(), _written(_pi_lines(spark, sf_dir), new_folder(spark, "logs-c")))


@query(f"""WITH {SQL_USAGE}, e AS (SELECT project, seq % 3 AS third FROM entries WHERE source = 'claude-code'), f AS (SELECT project, count(*) FILTER (WHERE third < 2) AS a, count(*) FILTER (WHERE third = 2) AS b FROM e GROUP BY ALL)
SELECT (SELECT count(*) FROM e) AS lines, (SELECT count(*) FROM f WHERE a > 0 AND b = 0) AS unchanged, (SELECT count(*) FROM f WHERE a > 0 AND b > 0) AS resumed, (SELECT count(*) FROM f WHERE a = 0) AS parsed, 0::BIGINT AS gone,
  (SELECT count(*) FROM e WHERE third = 2) AS read, (SELECT count(*) FROM f) AS unchanged_after""")
def incremental_logs(spark, sf_dir):
    """Two thirds of the events are there at first, then each project's file grows by the others: the tails alone are read. A third look finds nothing new and opens no file."""
    folder, store = new_folder(spark, "logs-d"), LogStore(spark, new_folder(spark, "log-store"))
    late = (F.col("seq") % 3 == 2).cast("int")
    rows = usage(spark, sf_dir).where("source = 'claude-code'").select("project", (late * (1 << 40) + F.col("seq")).alias("seq"), F.format_string('{"n": %d}', "seq").alias("line"))
    _one_file_each(spark, _written(rows.where(f"seq < {1 << 40}"), new_folder(spark, "logs-d1")), folder)
    store.refresh([folder])
    _one_file_each(spark, _written(rows, new_folder(spark, "logs-d2")), folder)  # the same lines first, then the new ones
    second = store.refresh([folder])
    third = store.refresh([folder])
    counts = {"unchanged": second.unchanged, "resumed": second.resumed, "parsed": second.parsed, "gone": second.gone, "read": second.read, "unchanged_after": third.unchanged}
    return third.lines.agg(F.count("*").alias("lines")).select("lines", *[F.lit(v).cast("bigint").alias(c) for c, v in counts.items()])


def _one_file_each(spark: SparkSession, written: str, folder: str) -> None:
    """Moves what _written() has made to ``<folder>/<project>.jsonl``, in place of what is there unless it has the same size."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    files = path(written).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path(folder))
    for project in files.listStatus(path(written)):
        if project.isDirectory():
            part = next(p for p in files.listStatus(project.getPath()) if p.getPath().getName().startswith("part-"))
            to = path(f"{folder}/{project.getPath().getName()}.jsonl")
            if not (files.exists(to) and files.getFileStatus(to).getLen() == part.getLen()):
                files.delete(to, False)
                files.rename(part.getPath(), to)


@query(f"""WITH {SQL_USAGE} SELECT * FROM (VALUES ('claude-code', true), ('codex', false), ('pi', true)) t(source, ok) JOIN (SELECT 'claude-code' AS source, count(*) AS entries FROM entries WHERE source = 'claude-code' AND input + output + cache_read + cache_creation > 0 UNION ALL SELECT 'codex', 0 UNION ALL SELECT 'pi', 0) USING (source)""")
def source_report(spark, sf_dir):
    """One source reads, one has files of which nothing can be parsed, one has no folder."""
    folder = new_folder(spark, "logs-e")
    _written(_claude_lines(spark, sf_dir), f"{folder}/c/projects")
    _written(table(spark, sf_dir, "nation").select(F.lit("x").alias("project"), F.col("n_nationkey").alias("seq"), F.col("n_name").alias("line")), f"{folder}/broken")
    found = collect_all(spark, [(ClaudeLogs(), [f"{folder}/c"]), (CodexLogs(), [f"{folder}/broken"]), (PiLogs(), [f"{folder}/none"])], f"{folder}/out")
    return found[1].select("source", "ok", "entries")


@query(f"""WITH {SQL_USAGE} SELECT source, model, count(*) AS calls, sum(input)::BIGINT AS input, sum(output)::BIGINT AS output, sum(cache_read)::BIGINT AS cache_read, sum(cache_creation)::BIGINT AS cache_creation
FROM entries WHERE source = 'cursor' AND input + output + cache_read + cache_creation > 0 AND epoch(date_trunc('minute', moment)) >= 1704700000 GROUP BY ALL""")
def usage_exports(spark, sf_dir):
    """Events as a usage export in CSV, columns in another order and counts with separators, from a time on."""
    rows = usage(spark, sf_dir).where("source = 'cursor'")
    number = lambda c: F.format_number(F.col(c), 0)
    cells = rows.select(number("output").alias("Output Tokens"), F.col("model").alias("Model"), number("cache_read").alias("Cache Read"), number("input").alias("Input (w/o Cache Write)"), number("cache_creation").alias("Input (w/ Cache Write)"), F.date_format("at", "yyyy-MM-dd HH:mm").alias("Date"))
    folder = new_folder(spark, "exports")
    cells.write.csv(folder, header=True)
    entries = UsageExport(since=1704700000).read(spark, [folder]).entries
    return entries.groupBy("source", "model").agg(F.count("*").alias("calls"), *[F.sum(c).alias(c) for c in ("input", "output", "cache_read", "cache_creation")])


@query(f"WITH {SQL_USAGE} SELECT source, model, project, epoch(bucket_start)::BIGINT AS bucket_s, sum(input)::BIGINT AS input, sum(output)::BIGINT AS output FROM buckets GROUP BY ALL")
def streamed_half_hours(spark, sf_dir):
    """A running aggregate of the events as a stream; each micro-batch's table is a new version."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    kept = VersionedTable(spark, new_folder(spark, "half-hours"), "source STRING, model STRING, project STRING, bucket_start TIMESTAMP, input BIGINT, output BIGINT")
    rows = windowed_usage(read_usage(spark, sf_dir, stream)).select("source", "model", "project", "bucket_start", "input", "output")
    writer = rows.writeStream.outputMode("complete").foreachBatch(lambda batch, _: kept.write(batch) and None).option("checkpointLocation", new_folder(spark, "half-hours-state"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return kept.read().select("source", "model", "project", F.unix_seconds("bucket_start").alias("bucket_s"), "input", "output")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'unknown' ELSE c_name END AS project, greatest(floor(c_acctbal)::BIGINT, 0) AS total, substr(repeat(c_name, 9), 1, 64) AS session_hash FROM customer""")
def normalised_sessions(spark, sf_dir):
    counts = ("duration_seconds", "active_seconds", "message_count", "user_message_count", "input", "output", "cache_read")
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", F.lit(" codex ").alias("source"), F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit(" "), "c_name")).alias("project"), F.repeat("c_name", F.lit(9)).alias("session_hash"),
        F.floor("c_acctbal").cast("bigint").alias("total"), *[F.lit(-1).cast("bigint").alias(c) for c in counts],
    )
    return normalized_sessions(rows).where("source = 'codex' and duration_seconds + input = 0").select("c_custkey", "project", "total", "session_hash")


@query("SELECT substr(repeat(c_name, 9), 1, 64) AS account_hash, substr(repeat(c_name, 30), 1, 200) AS label FROM customer")
def normalised_accounts(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.repeat("c_name", F.lit(9)).alias("account_hash"), F.repeat("c_name", F.lit(30)).alias("label"))
    return normalized_accounts(rows)


@query("SELECT 'm' || p_partkey AS key, round(p_retailprice * 4, 2) AS input, 'cache' AS layer FROM part")
def kept_prices(spark, sf_dir):
    """A price table written as a cache and read back."""
    folder = new_folder(spark, "price-cache")
    keep_prices(prices_from_json(_price_texts(spark, sf_dir, 4, False), "snapshot"), folder, "2024-01-02T00:00:00Z")
    return imported_prices(spark, folder, "cache").select("key", "input", "layer")


_LOCKS = "live AS (SELECT DISTINCT 'a' || (user_id % 9) AS account_hash, 's' || user_id AS session_id, user_id FROM events)"


@query(f"WITH {_LOCKS} SELECT account_hash, session_id FROM live WHERE user_id % 2 = 0 OR (user_id % 3 = 0 AND account_hash IN (SELECT account_hash FROM live WHERE user_id % 2 = 0))")
def locked_sessions(spark, sf_dir):
    live = _live_sessions(spark, sf_dir)
    return control.locked_sessions(live.where("user_id % 2 = 0"), live.where("user_id % 3 = 0"))


@query(f"WITH {_LOCKS} SELECT account_hash, session_id FROM live WHERE user_id % 6 = 0")
def still_pending(spark, sf_dir):
    live = _live_sessions(spark, sf_dir)
    return control.still_pending(live.where("user_id % 2 = 0").select("account_hash", "session_id"), live.where("user_id % 3 = 0"))


def _live_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(F.concat(F.lit("a"), F.col("user_id") % 9).alias("account_hash"), F.concat(F.lit("s"), "user_id").alias("session_id"), "user_id").distinct()


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN c_mktsegment ELSE substr(sha256(c_name), 1, 8) END AS name, CASE c_custkey % 3 WHEN 0 THEN '30 min' WHEN 1 THEN '6 h' ELSE '2 d' END AS bin FROM customer""")
def account_and_bin_names(spark, sf_dir):
    rows, k = table(spark, sf_dir, "customer"), F.col("c_custkey") % 3
    stored, mail = F.when(k == 0, F.concat(F.col("c_name"), F.lit(" "))).otherwise(F.lit(" ")), F.when(k == 1, F.col("c_mktsegment"))
    return rows.select("c_custkey", control.account_name(stored, mail, F.sha2("c_name", 256)).alias("name"), views.bin_name(F.when(k == 0, 1800).when(k == 1, 21600).otherwise(172800)).alias("bin"))


@query(f"WITH {SQL_USAGE} SELECT model AS key, sum(total)::BIGINT AS total FROM buckets GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4")
def top_models(spark, sf_dir):
    """A report of four rows."""
    return views.top_models(buckets_of(spark, sf_dir).groupBy(F.col("model").alias("key")).agg(F.sum("total").alias("total")), 4)


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'own' || event_id ELSE 'file' || (user_id % 5) END AS session_id FROM events")
def sessions_filled_in(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "user_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("own"), "event_id")).when(F.col("event_id") % 3 == 1, F.lit("")).alias("session_id"))
    return with_session(rows, F.concat(F.lit("file"), F.col("user_id") % 5)).select("event_id", "session_id")


@query("""SELECT 'j' || o_orderkey AS join_id, CASE WHEN o_orderkey = m THEN 'claimed' ELSE 'pending' END AS status, o_orderkey = m AS answered FROM orders, (SELECT min(o_orderkey) AS m FROM orders)""")
def joins_decided_and_claimed(spark, sf_dir):
    """One request is approved and its token handed out once; the others stay."""
    rows = table(spark, sf_dir, "orders")
    one = f"j{rows.agg(F.min('o_orderkey')).first()[0]}"
    requests = rows.select(
        F.concat(F.lit("j"), "o_orderkey").alias("join_id"), F.lit("c").alias("claim_hash"), F.lit("pending").alias("status"), F.lit(NOW + dt.timedelta(seconds=60)).alias("expires_at"),
        F.lit(None).cast("string").alias("token"), F.lit(None).cast("string").alias("token_hash"),
    )
    answer, after = control.claim_join(control.decide_join(requests, one, "approved", NOW, "secret", "hash"), one, "c", NOW)
    given = answer.where("token = 'secret'").select(F.lit(one).alias("join_id"), F.lit(True).alias("answered"))
    return after.join(given, "join_id", "left").select("join_id", "status", F.coalesce("answered", F.lit(False)).alias("answered"))


@query(f"""WITH {SQL_USAGE}, k AS (SELECT concat_ws('|', source, model, project, strftime(bucket_start, '%Y-%m-%dT%H:%M:%SZ'), host_id) AS key, source FROM buckets), t AS (SELECT count(*) AS n, count(*) FILTER (WHERE source <> 'codex') AS known FROM k)
SELECT destination, round, CASE WHEN destination = 'down' THEN 0 WHEN round = 1 THEN CASE WHEN destination = 'breaks' THEN least(n, 200) ELSE n END WHEN destination = 'first' THEN 0 WHEN destination = 'choosy' THEN n - known ELSE greatest(n - 200, 0) END AS sent,
  NOT (destination = 'down' OR destination = 'breaks' AND round = 1 AND n > 200) AS ok, CASE WHEN destination = 'down' THEN 'retryable' WHEN destination = 'breaks' AND round = 1 AND n > 200 THEN 'auth' END AS error_kind
FROM t, (VALUES ('first'), ('choosy'), ('breaks'), ('down')) d(destination), (VALUES (1), (2)) r(round)""")
def sent_to_all(spark, sf_dir):
    """Two rounds to four destinations: one takes all, one does not know a source, one refuses the token after two batches of its first round, one cannot be reached."""
    rows = buckets_of(spark, sf_dir).select(F.lit("bucket").alias("kind"), client_key("host_id").alias("key"), content_hash().alias("hash"), "source", F.lit("").alias("body"))
    journal = Journal(spark, new_folder(spark, "sent"))

    def refused_once(batch: Batch) -> Answer:
        if batch.number == 2:
            raise Refused(401)
        return Answer()

    def down(batch: Batch) -> Answer:
        raise ConnectionError("no route")

    to = {"first": lambda batch: Answer(), "choosy": lambda batch: Answer(unknown=["codex"]), "down": down}
    breaks = {1: refused_once, 2: lambda batch: Answer()}
    found = [deliver(rows, journal, {**to, "breaks": breaks[n]}, wait=lambda s: None, on_executors=True).withColumn("round", F.lit(n)) for n in (1, 2)]
    return found[0].unionByName(found[1]).select("destination", "round", F.col("changed_buckets").alias("sent"), "ok", "error_kind")
