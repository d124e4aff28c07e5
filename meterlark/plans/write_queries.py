"""Queries that write or decide: upserts, counters, changes, log folds, control tables and streams, with the same in SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import UTC
from ..operators import changes, control, upserts, views
from ..operators.folds import hour_chunk
from ..operators.upserts import BUCKET_KEY, Store
from ..operators.usage import carried_forward, client_key, content_hash, counter_rises, hide_projects, largest_of_each, regrouped, usage_buckets
from ..schema import ACCOUNT, BUCKET, HOST, SESSION, TOKENS
from ..session import new_folder
from ..sources.events import SQL_USAGE, read_usage
from ..store import SnapshotStore
from ..streaming.tables import BucketTable, keep_rows
from .usage_queries import ORACLES, QUERIES, buckets_of, query, sessions_of, usage  # noqa: F401

_KEY = "host_id, source, model, project, bucket_start"
_NUM = "input, output, cache_read, cache_creation, reasoning, total"
#: Every event as a snapshot of its host's, tool's and day's bucket, so that many snapshots meet in one key.
SQL_SNAPS = f"""{SQL_USAGE}, snaps AS (
  SELECT host_id, source, 'm' AS model, 'p' AS project, date_trunc('day', moment) AS bucket_start, input, output, cache_read, cache_creation, reasoning, input + output + cache_read + cache_creation + reasoning AS total, seq FROM entries
)"""


def snapshots(rows: DataFrame) -> DataFrame:
    whole = sum((F.col(c) for c in TOKENS), F.lit(0).cast("bigint"))
    return rows.select("host_id", "source", F.lit("m").alias("model"), F.lit("p").alias("project"), F.date_trunc("day", "at").alias("bucket_start"), *TOKENS, whole.alias("total"), "seq")


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("host_id", "source", F.unix_seconds("bucket_start").alias("bucket_s"), *TOKENS, "total")


_SHOWN = f"SELECT host_id, source, epoch(bucket_start)::BIGINT AS bucket_s, {_NUM}"


@query(f"""WITH {SQL_SNAPS}, stored AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY total DESC, seq DESC) AS rn FROM snaps WHERE seq % 2 = 0) WHERE rn = 1),
merged AS (SELECT * REPLACE (-1 AS seq) FROM stored UNION ALL SELECT * FROM snaps WHERE seq % 2 = 1)
{_SHOWN} FROM (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY total DESC, seq DESC) AS rn FROM merged) WHERE rn = 1""")
def live_window_upsert(spark: SparkSession, sf_dir: str):
    rows = snapshots(usage(spark, sf_dir))
    stored = upserts.upsert_buckets(spark.createDataFrame([], BUCKET), rows.where("seq % 2 = 0"))
    return _shown(upserts.upsert_buckets(stored, rows.where("seq % 2 = 1")))


@query(f"""WITH {SQL_SNAPS}, day AS (SELECT strftime(bucket_start, '%Y-%m-%d') AS day, host_id, source, model, project, {", ".join(f"sum({c})::BIGINT AS {c}" for c in _NUM.split(", "))}
  FROM (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY total DESC, seq DESC) AS rn FROM snaps) WHERE rn = 1 GROUP BY ALL) SELECT * FROM day""")
def refreshed_rollup(spark: SparkSession, sf_dir: str):
    """Rollups of the even snapshots, brought up to date after the odd ones."""
    from ..operators.scans import daily_rollups

    rows = snapshots(usage(spark, sf_dir))
    odd = rows.where("seq % 2 = 1")
    # The same order in both steps, so that one pass over all snapshots says the same.
    stored = upserts.upsert_buckets(spark.createDataFrame([], BUCKET), rows.where("seq % 2 = 0"))
    after = upserts.upsert_buckets(spark.createDataFrame([], BUCKET), rows)
    out = upserts.refreshed_rollups(daily_rollups(stored), after, odd)
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


_MYSTERY = "CASE WHEN source <> 'pi' THEN source WHEN seq % 3 = 0 THEN 'a-tool' ELSE 'mystery-tool' END"
SQL_UPLOADS = f"""{SQL_USAGE}, sent AS (
  SELECT seq // 20 AS upload_id, seq, {_MYSTERY} AS source, CASE WHEN source <> 'cursor' THEN 'host' || (seq // 20 % 7) WHEN seq % 5 <> 0 THEN host_id END AS host_id, 'p' || (seq % 3) AS project, date_trunc('day', moment) AS bucket_start,
    input + output + cache_read + cache_creation + reasoning AS total FROM entries
), kept AS (
  SELECT *, max(total) OVER (PARTITION BY host_id, source, project, bucket_start ORDER BY upload_id, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM sent WHERE source NOT LIKE '%-tool' AND host_id IS NOT NULL
)"""


def uploads_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty events to an upload; a fifth of the sources is unknown, and a fifth of the accounts have no valid hash."""
    rows = usage(spark, sf_dir)
    source = F.when(F.col("source") != "pi", F.col("source")).when(F.col("seq") % 3 == 0, F.lit("a-tool")).otherwise(F.lit("mystery-tool"))
    account = F.when(F.col("source") != "cursor", F.lit("")).when(F.col("seq") % 5 == 0, F.lit("no hash")).otherwise(F.expr("substring(host_id, 6)"))
    bucket = F.struct(
        source.alias("source"), F.lit("m").alias("model"), F.concat(F.lit("p"), F.col("seq") % 3).alias("project"), F.date_trunc("day", "at").alias("bucket_start"),
        account.alias("account_hash"), F.when(account != "", F.concat(F.lit("user"), F.col("seq") % 2, F.when(F.col("seq") % 3 == 0, F.lit("@x.test")).otherwise(F.lit("")))).otherwise(F.lit("")).alias("account_label"), *TOKENS,
    )
    one = rows.withColumn("upload_id", F.floor(F.col("seq") / 20)).groupBy("upload_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", bucket.alias("b")))), lambda x: x.b).alias("buckets"), F.max("at").alias("received_at"))
    session = "struct<source:string,project:string,session_hash:string,first_at:timestamp,last_at:timestamp,duration_seconds:bigint,active_seconds:bigint,message_count:bigint,user_message_count:bigint,input:bigint,output:bigint,cache_read:bigint,total:bigint>"
    return one.select(
        "upload_id", F.concat(F.lit("host"), F.col("upload_id") % 7).alias("host_id"), "received_at", F.concat(F.lit("machine"), F.col("upload_id") % 7).alias("hostname"),
        F.when(F.col("upload_id") % 2 == 0, F.lit("1.0")).alias("agent_version"), F.lit(None).cast("string").alias("timezone"), "buckets",
        F.array().cast(f"array<{session}>").alias("sessions"), F.array().cast(f"array<{ACCOUNT.simpleString()}>").alias("accounts"),
    )


def empty_store(spark: SparkSession) -> Store:
    return Store(*[spark.createDataFrame([], s) for s in (HOST, BUCKET, SESSION, ACCOUNT)])


@query(f"""WITH {SQL_UPLOADS} SELECT (SELECT count(*) FROM kept WHERE coalesce(before, -1) <= total) AS buckets, (SELECT count(*) FROM kept WHERE before > total) AS protected,
  (SELECT count(*) FROM sent WHERE source LIKE '%-tool' OR host_id IS NULL) AS dropped_buckets, 0::BIGINT AS sessions, 0::BIGINT AS dropped_sessions,
  (SELECT string_agg(source, '|' ORDER BY first) FROM (SELECT source, min(seq) AS first FROM sent WHERE source LIKE '%-tool' GROUP BY source)) AS unknown_sources""")
def ingest_counters(spark: SparkSession, sf_dir: str):
    answer = upserts.response(empty_store(spark).buckets, uploads_of(spark, sf_dir))
    return answer.withColumn("unknown_sources", F.array_join("unknown_sources", "|"))


@query(f"""WITH {SQL_UPLOADS} SELECT host_id, source, project, epoch(bucket_start)::BIGINT AS bucket_s, max(total)::BIGINT AS total FROM kept GROUP BY ALL""")
def ingest_uploads(spark: SparkSession, sf_dir: str):
    after = upserts.ingest(empty_store(spark), uploads_of(spark, sf_dir))
    return after.buckets.select("host_id", "source", "project", F.unix_seconds("bucket_start").alias("bucket_s"), "total")


_STORED = f"""WITH {SQL_UPLOADS}, received AS (SELECT seq // 20 AS upload_id, max(moment) AS u FROM entries GROUP BY ALL), b AS (SELECT host_id, source, project, bucket_start, max(total) AS total FROM kept GROUP BY ALL)"""


@query(f"""{_STORED} SELECT 'bucket' AS kind, host_id, source, project, epoch(bucket_start)::BIGINT AS at_s, total::BIGINT AS total FROM b
UNION ALL SELECT 'rollup', host_id, source, project, epoch(date_trunc('day', bucket_start))::BIGINT, sum(total)::BIGINT FROM b GROUP BY ALL
UNION ALL SELECT 'host', host_id, NULL, NULL, epoch(date_trunc('second', arg_max(u, {{'half': upload_id % 2, 'id': upload_id}})))::BIGINT, NULL FROM (SELECT *, 'host' || (upload_id % 7) AS host_id FROM received) GROUP BY host_id
UNION ALL SELECT 'host', host_id, NULL, NULL, epoch(date_trunc('second', max(u)))::BIGINT, NULL FROM (SELECT host_id, u FROM kept JOIN received USING (upload_id) WHERE source = 'cursor' QUALIFY upload_id % 2 = max(upload_id % 2) OVER (PARTITION BY host_id)) GROUP BY host_id""")
def stored_versions(spark: SparkSession, sf_dir: str):
    """Uploads of two halves as two versions of kept tables, the second half sent twice; between the two a writer dies before its version is in force."""
    store, uploads = SnapshotStore(spark, new_folder(spark, "store")), uploads_of(spark, sf_dir).checkpoint()
    store.ingest(uploads.where("upload_id % 2 = 0"))
    store.stage(store.begin(), uploads.where("upload_id % 2 = 1"))
    store.ingest(uploads.where("upload_id % 2 = 1"))
    at, _ = store.ingest(uploads.where("upload_id % 2 = 1"))
    key = ["host_id", "source", "project"]
    buckets = at.read("buckets").select(F.lit("bucket").alias("kind"), *key, F.unix_seconds("bucket_start").alias("at_s"), "total")
    rollups = at.read("rollups").select(F.lit("rollup").alias("kind"), *key, F.unix_seconds(F.col("day").cast("timestamp")).alias("at_s"), "total")
    none = F.lit(None).cast("string")
    hosts = at.read("hosts").select(F.lit("host").alias("kind"), "host_id", none.alias("source"), none.alias("project"), F.unix_seconds("last_seen").alias("at_s"), F.lit(None).cast("bigint").alias("total"))
    return buckets.unionByName(rollups).unionByName(hosts)


_LABEL = "'user' || (seq % 2) || CASE WHEN seq % 3 = 0 THEN '@x.test' ELSE '' END"


@query(f"""WITH {SQL_USAGE}, l AS (SELECT host_id, seq, {_LABEL} AS label FROM entries WHERE source = 'cursor' AND seq % 5 <> 0)
SELECT host_id, coalesce(arg_max(label, seq) FILTER (WHERE label LIKE '%@%'), arg_min(label, seq) FILTER (WHERE label <> '')) AS hostname FROM l GROUP BY host_id""")
def host_label_precedence(spark: SparkSession, sf_dir: str):
    after = upserts.ingest(empty_store(spark), uploads_of(spark, sf_dir))
    return after.hosts.where(F.col("host_id").startswith("acct:")).select("host_id", "hostname")


@query(f"""WITH {SQL_USAGE}, s AS (SELECT host_id, source, 'h' || (seq % 50) AS session_hash, total, seq FROM (SELECT *, input + output + cache_read + cache_creation + reasoning AS total FROM entries))
SELECT host_id, source, session_hash, arg_max(total, seq)::BIGINT AS total FROM s GROUP BY ALL""")
def last_writer_sessions(spark: SparkSession, sf_dir: str):
    rows = snapshots(usage(spark, sf_dir)).select("host_id", "source", F.concat(F.lit("h"), F.col("seq") % 50).alias("session_hash"), "total", "seq")
    stored = upserts.upsert_sessions(rows.drop("seq").limit(0), rows.where("seq < 5000"))
    return upserts.upsert_sessions(stored, rows.where("seq >= 5000"))


@query("""WITH s AS (SELECT 'a' || (user_id % 40) AS account_hash, date_trunc('hour', ts) AS moment, event_id AS seq, floor(value)::BIGINT AS used FROM events)
SELECT account_hash, epoch(max(moment))::BIGINT AS fetched_s, arg_max(used, {'a': moment, 's': seq}) AS used_cents FROM s GROUP BY account_hash""")
def newest_snapshot(spark: SparkSession, sf_dir: str):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.concat(F.lit("a"), F.col("user_id") % 40).alias("account_hash"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("fetched_at"),
        F.floor("value").alias("used_cents"), F.col("event_id").alias("seq"), F.lit(None).cast("timestamp").alias("archived_at"),
    )
    got = upserts.upsert_accounts(rows.drop("seq").limit(0), rows)
    return got.select("account_hash", F.unix_seconds("fetched_at").alias("fetched_s"), "used_cents")


_HASH = "substr(sha256(concat_ws(chr(0), input::VARCHAR, output::VARCHAR, cache_read::VARCHAR, cache_creation::VARCHAR, reasoning::VARCHAR, total::VARCHAR)), 1, 16)"
SQL_KEYED = f"""{SQL_USAGE}, keyed AS (SELECT concat_ws('|', source, model, project, strftime(bucket_start, '%Y-%m-%dT%H:%M:%SZ'), host_id) AS key, {_HASH} AS hash, source, total FROM buckets)"""


def keyed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets_of(spark, sf_dir).withColumns({"key": client_key("host_id"), "hash": content_hash()})


def _state(rows: DataFrame) -> DataFrame:
    return rows.where("total % 3 < 2").select("key", F.when(F.col("total") % 3 == 0, F.col("hash")).otherwise(F.lit("old")).alias("hash"))


@query(f"WITH {SQL_KEYED} SELECT key, hash FROM keyed WHERE total % 3 <> 0")
def cdc_changed_rows(spark: SparkSession, sf_dir: str):
    rows = keyed_rows(spark, sf_dir)
    return changes.changed_rows(rows, _state(rows)).select("key", "hash")


@query(f"WITH {SQL_KEYED} SELECT key, hash FROM keyed WHERE (total % 3 <> 0 AND source <> 'codex') OR total % 3 = 0 UNION ALL SELECT key, 'old' FROM keyed WHERE total % 3 = 1 AND source = 'codex'")
def cdc_acknowledged(spark: SparkSession, sf_dir: str):
    rows = keyed_rows(spark, sf_dir)
    state = _state(rows)
    return changes.acknowledged(state, changes.changed_rows(rows, state), ["codex"])


@query(f"""WITH {SQL_KEYED}, a AS (SELECT *, substr(sha256('acct-0'), 1, 32) AS a0, substr(sha256('acct-1'), 1, 32) AS a1 FROM keyed)
SELECT key, hash FROM a WHERE CASE WHEN source = 'codex' THEN true WHEN source = 'cursor' THEN CASE WHEN ends_with(key, a0) THEN total % 2 = 0 ELSE ends_with(key, a1) END ELSE total % 2 = 0 END""")
def cdc_prune_live(spark: SparkSession, sf_dir: str):
    """One source could not be read, and one of its accounts failed; one account is not asked any more."""
    rows = keyed_rows(spark, sf_dir)
    a0, a1 = (F.concat(F.lit("acct:"), F.substring(F.sha2(F.lit(f"acct-{k}"), 256), 1, 32)) for k in (0, 1))
    none = F.array().cast("array<string>")
    names = spark.createDataFrame([("claude-code", True, False), ("codex", False, False), ("grok", True, False), ("pi", True, False), ("cursor", True, True)], "source string, ok boolean, by_account boolean")
    sources = names.withColumns({"attempted": F.when(F.col("by_account"), F.array(a0, a1)).otherwise(none), "succeeded": F.when(F.col("by_account"), F.array(a0)).otherwise(none)})
    return changes.pruned(rows.select("key", "hash"), rows.where("total % 2 = 0"), sources)


@query(f"WITH {SQL_KEYED}, n AS (SELECT key, row_number() OVER (PARTITION BY source ORDER BY substr(md5(key), 1, 2), key) AS rn FROM keyed) SELECT key, ((rn - 1) // 100)::BIGINT AS batch FROM n")
def batch_assignment(spark: SparkSession, sf_dir: str):
    return changes.batches(keyed_rows(spark, sf_dir), changes.BATCH_BUCKETS, ("source",), "key").select("key", "batch")


@query("""WITH e AS (SELECT event_id, user_id, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS a, floor(value)::BIGINT AS b FROM events),
l AS (SELECT *, a + b AS t, lag(a) OVER w AS pa, lag(b) OVER w AS pb, lag(a + b) OVER w AS pt FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CASE WHEN pt IS NULL OR a < pa OR b < pb THEN a ELSE a - pa END AS delta_a, CASE WHEN pt IS NULL OR a < pa OR b < pb THEN b ELSE b - pb END AS delta_b
FROM l WHERE NOT coalesce(t = pt AND t > 0, false)""")
def delta_from_cumulative(spark: SparkSession, sf_dir: str):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", F.get_json_object("props", "$.k").cast("bigint").alias("a"), F.floor("value").alias("b"))
    rises = counter_rises(rows.select("*", F.struct("a", "b").alias("counters"), (F.col("a") + F.col("b")).alias("t")), "counters", "t", ["user_id"], ["ts", "event_id"], hour_chunk("ts"))
    return rises.where("not repeated").select("event_id", F.col("rise.a").alias("delta_a"), F.col("rise.b").alias("delta_b"))


@query("""WITH e AS (SELECT event_id, user_id, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
m AS (SELECT *, CASE WHEN k % 3 = 0 OR k % 7 = 0 THEN NULL ELSE 'm' || k END AS model FROM e)
SELECT event_id, coalesce(last_value(model IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 'unknown') AS model FROM m""")
def carry_forward_model(spark: SparkSession, sf_dir: str):
    k = F.get_json_object("props", "$.k").cast("int")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", F.when(k % 3 == 0, F.lit(" ")).when(k % 7 == 0, F.lit("<synthetic>")).otherwise(F.concat(F.lit("m"), k)).alias("model"))
    return carried_forward(rows, "model", ["user_id"], ["ts", "event_id"], "unknown", ignore=("<synthetic>",), chunk=hour_chunk("ts")).select("event_id", "model")


@query(f"""WITH {SQL_USAGE}, c AS (SELECT seq, CASE WHEN output % 100 = 0 THEN NULL ELSE session_id || output END AS call, input FROM entries)
SELECT seq, call, input FROM (SELECT *, row_number() OVER (PARTITION BY call ORDER BY input DESC, seq) AS rn FROM c) WHERE rn = 1 OR call IS NULL""")
def keep_largest_dedupe(spark: SparkSession, sf_dir: str):
    rows = usage(spark, sf_dir).select("seq", F.when(F.col("output") % 100 != 0, F.concat("session_id", "output")).alias("call"), "input")
    return largest_of_each(rows, "call", F.col("input"), ["seq"])


@query(f"""WITH {SQL_USAGE} SELECT host_id, source, model, 'unknown' AS project, epoch(bucket_start)::BIGINT AS bucket_s, {", ".join(f"sum({c})::BIGINT AS {c}" for c in _NUM.split(", "))} FROM buckets GROUP BY ALL""")
def hide_projects_mask(spark: SparkSession, sf_dir: str):
    rows = regrouped(hide_projects(buckets_of(spark, sf_dir)), *BUCKET_KEY)
    return rows.withColumn("bucket_s", F.unix_seconds("bucket_start")).drop("bucket_start")


@query("""SELECT event_id, count(*) OVER w AS recent, count(*) OVER w > 10 AS refused FROM (SELECT event_id, 'ip' || (user_id % 20) AS ip, epoch(date_trunc('second', ts))::BIGINT AS s FROM events)
WINDOW w AS (PARTITION BY ip ORDER BY s RANGE BETWEEN 599 PRECEDING AND CURRENT ROW)""")
def rate_limit_sliding(spark: SparkSession, sf_dir: str):
    tries = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.concat(F.lit("ip"), F.col("user_id") % 20).alias("ip"), F.col("ts").cast("timestamp").alias("at"))
    return control.tries_before(tries).select("event_id", "recent", "refused")


@query(f"""WITH {SQL_USAGE}, c AS (SELECT 'acct:' || substr(sha256('acct-' || i), 1, 32) AS host_id, make_timestamp(2024, 1, 20 + i, 9, 30, 0) AS e FROM range(3) t(i))
SELECT substr(host_id, 6) AS account_hash, sum(total)::BIGINT AS lifetime, coalesce(sum(total) FILTER (WHERE bucket_start >= e - INTERVAL 1 MONTH AND bucket_start < e), 0)::BIGINT AS in_cycle FROM buckets JOIN c USING (host_id) GROUP BY host_id""")
def billing_cycle_window(spark: SparkSession, sf_dir: str):
    ends = spark.range(0, 3, 1, 1).select(F.substring(F.sha2(F.concat(F.lit("acct-"), F.col("id")), 256), 1, 32).alias("account_hash"), F.make_timestamp(F.lit(2024), F.lit(1), (F.col("id") + 20).cast("int"), F.lit(9), F.lit(30), F.lit(0)).alias("cycle_end"))
    return views.cycle_totals(buckets_of(spark, sf_dir), views.billing_cycles(ends))


@query("""SELECT o_orderkey AS token, c_name AS hostname, o_custkey AS host FROM orders JOIN customer ON o_custkey = c_custkey""")
def tokens_join_hosts(spark: SparkSession, sf_dir: str):
    tokens = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("token_hash"), F.col("o_custkey").alias("host_id"), F.col("o_orderdate").alias("created_at"))
    hosts = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("bigint").alias("host_id"), F.col("c_name").alias("hostname"), F.lit(None).cast("timestamp").alias("last_seen"))
    return control.tokens_with_hosts(tokens, hosts).select(F.col("token_hash").alias("token"), "hostname", F.col("host_id").alias("host"))


@query("""SELECT DISTINCT 'acct' || (user_id % 9) AS account_hash, 'sess' || user_id AS session_id FROM events
WHERE user_id % 9 IN (SELECT user_id % 9 FROM events WHERE user_id % 5 = 0 AND user_id % 9 <> 8) AND user_id % 5 <> 0 AND user_id % 7 <> 0""")
def guard_plan(spark: SparkSession, sf_dir: str):
    """Login sessions to revoke: accounts without a locked session are left alone, and so are those asked for lately."""
    live = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("acct"), F.col("user_id") % 9).alias("account_hash"), F.concat(F.lit("sess"), "user_id").alias("session_id"), "user_id").distinct()
    locked = live.where("user_id % 5 = 0 and user_id % 9 <> 8").select("account_hash", "session_id")
    now = dt.datetime(2024, 2, 1, tzinfo=UTC)
    asked = F.when(F.col("user_id") % 7 == 0, F.lit(now - dt.timedelta(seconds=300))).otherwise(F.lit(now - dt.timedelta(seconds=900)))
    return control.guarded_sessions(live.select("account_hash", "session_id"), locked, live.select("account_hash", "session_id", asked.alias("asked_at")), now)


@query("""WITH e AS (SELECT event_id % 100 AS j, min(event_type) AS kind FROM events GROUP BY 1)
SELECT 'j' || j AS join_id, CASE WHEN j % 2 = 0 THEN 'expired' WHEN j % 3 = 0 THEN 'approved' ELSE 'pending' END AS status, j % 2 = 0 AND j % 3 = 0 AS revoked FROM e""")
def join_expiry(spark: SparkSession, sf_dir: str):
    now = dt.datetime(2024, 2, 1, tzinfo=UTC)
    j = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("event_id") % 100).alias("j")).distinct()
    late = F.when(F.col("j") % 2 == 0, F.lit(now - dt.timedelta(seconds=1))).otherwise(F.lit(now + dt.timedelta(seconds=60)))
    requests = j.select(F.concat(F.lit("j"), "j").alias("join_id"), F.when(F.col("j") % 3 == 0, F.lit("approved")).otherwise(F.lit("pending")).alias("status"), late.alias("expires_at"), F.concat(F.lit("t"), "j").alias("token"), F.concat(F.lit("t"), "j").alias("token_hash"))
    tokens = requests.select("token_hash", F.lit(None).cast("timestamp").alias("revoked_at"))
    after, tokens = control.expire_joins(requests, tokens, now)
    return after.join(tokens, "token_hash").select("join_id", "status", F.col("revoked_at").isNotNull().alias("revoked"))


@query("""SELECT sum(event_id % 5)::BIGINT AS ingested, sum(user_id % 3)::BIGINT AS sessions, sum(event_id % 2)::BIGINT AS protected, sum(event_id % 5 + user_id % 3)::BIGINT AS changed,
  bool_and(event_type <> 'error') AS all_ok, bool_or(event_type = 'error' AND event_id % 2 = 0) AS retry FROM events""")
def sync_totals(spark: SparkSession, sf_dir: str):
    bad = F.col("event_type") == "error"
    results = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        (F.col("event_id") % 5).alias("ingested"), (F.col("user_id") % 3).alias("sessions"), (F.col("event_id") % 2).alias("protected"), (F.col("event_id") % 5).alias("changed_buckets"), (F.col("user_id") % 3).alias("changed_sessions"),
        (~bad).alias("ok"), F.when(bad, F.when(F.col("event_id") % 2 == 0, F.lit("retryable")).otherwise(F.lit("fatal"))).alias("error_kind"),
    )
    return changes.sync_report(results)


@query(f"""WITH {SQL_SNAPS} {_SHOWN} FROM (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY total DESC, seq DESC) AS rn FROM snaps) WHERE rn = 1""")
def streaming_upsert(spark: SparkSession, sf_dir: str):
    """The events as a stream, upserted batch by batch into a table in the shared folder."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    table = BucketTable(spark, new_folder(spark, "stream-table"))
    keep_rows(snapshots(read_usage(spark, sf_dir, stream)), table, new_folder(spark, "stream-state")).awaitTermination()
    return _shown(table.read())


@query(f"""WITH {SQL_USAGE} SELECT source, model, project, epoch(bucket_start)::BIGINT AS bucket_s, sum(input)::BIGINT AS input, sum(total)::BIGINT AS total FROM buckets GROUP BY ALL""")
def collector_buckets(spark: SparkSession, sf_dir: str):
    """What a collector of all hosts would send."""
    rows = usage_buckets(usage(spark, sf_dir))
    return rows.select("source", "model", "project", F.unix_seconds("bucket_start").alias("bucket_s"), "input", "total")
