"""Queries over streams with state by key and timers, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_folder
from ..streaming.timed import changed_stream, finished_joins, revocations
from .usage_queries import query
from .write_queries import SQL_KEYED, keyed_rows

DAY = 86_400


def finished(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """What a stream has emitted when it has read all there is; a further call with the same folders goes on from there."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("at", F.date_trunc("second", F.col("ts").cast("timestamp"))).withWatermark("at", "1 hour")


@query(f"WITH {SQL_KEYED} SELECT key, hash FROM keyed WHERE total % 3 <> 0 UNION ALL SELECT key, hash || 'x' FROM keyed WHERE total % 2 = 0")
def changed_stream_restarted(spark: SparkSession, sf_dir: str):
    """Changed rows against what was sent before; then the stream is started again with half of the keys changed and all of them sent once more."""
    landing, out, checkpoint = (new_folder(spark, f"changed-{n}") for n in ("landing", "out", "state"))
    keyed_rows(spark, sf_dir).select(F.lit("home").alias("destination"), "key", "hash", "total", F.lit(0).cast("bigint").alias("seq")).write.parquet(landing)
    rows = spark.read.parquet(landing)
    before = rows.where("total % 3 < 2").select("destination", "key", F.when(F.col("total") % 3 == 0, F.col("hash")).otherwise(F.lit("old")).alias("hash"))
    stream = changed_stream(spark.readStream.schema(rows.schema).parquet(landing), before)
    finished(stream, out, checkpoint)
    again = rows.withColumns({"hash": F.concat("hash", F.when(F.col("total") % 2 == 0, F.lit("x")).otherwise(F.lit(""))), "seq": F.lit(1).cast("bigint")})
    again.write.mode("append").parquet(landing)
    return finished(stream, out, checkpoint).select("key", "hash")


@query(f"""WITH e AS (SELECT 'j' || user_id || '-' || (epoch(date_trunc('second', ts))::BIGINT // {3 * DAY}) AS join_id, epoch(date_trunc('second', ts))::BIGINT AS t, 't' || event_id AS token,
  CASE event_type WHEN 'click' THEN 'asked' WHEN 'purchase' THEN 'approved' WHEN 'signup' THEN 'denied' WHEN 'error' THEN 'claimed' END AS kind FROM events),
a AS (SELECT join_id, min(t) AS asked FROM e WHERE kind = 'asked' GROUP BY join_id HAVING min(t) + {DAY} <= (SELECT max(t) - 3600 FROM e)),
l AS (SELECT * FROM e JOIN a USING (join_id) WHERE t >= asked AND t < asked + {DAY}),
d AS (SELECT join_id, min(t) AS decided, arg_min(kind, {{'t': t, 'k': kind, 'x': token}}) AS decision, arg_min(token, {{'t': t, 'k': kind, 'x': token}}) AS token FROM l WHERE kind IN ('approved', 'denied') GROUP BY join_id),
c AS (SELECT join_id, decision, d.token, bool_or(l.kind = 'claimed' AND l.t >= decided) AS claimed FROM d JOIN l USING (join_id) GROUP BY ALL)
SELECT join_id, CASE WHEN decision = 'denied' THEN 'denied' WHEN claimed AND decision = 'approved' THEN 'claimed' ELSE 'expired' END AS status, CASE WHEN decision = 'approved' AND NOT claimed THEN token END AS revoke_token
FROM a LEFT JOIN c USING (join_id)""")
def timed_joins(spark: SparkSession, sf_dir: str):
    """Events as steps of join requests, one a user and three days, with a day's time; requests whose time the watermark has not reached are still open."""
    kind = F.when(F.col("event_type") == "click", "asked").when(F.col("event_type") == "purchase", "approved").when(F.col("event_type") == "signup", "denied").when(F.col("event_type") == "error", "claimed")
    part = F.floor(F.unix_seconds("at") / (3 * DAY))
    rows = _events(spark, sf_dir).select(F.concat(F.lit("j"), "user_id", F.lit("-"), part).alias("join_id"), kind.alias("kind"), "at", F.concat(F.lit("t"), "event_id").alias("token_hash"))
    return finished(finished_joins(rows, DAY, by_clock=False), new_folder(spark, "joins-out"), new_folder(spark, "joins-state"))


@query("""WITH RECURSIVE s AS (SELECT DISTINCT user_id % 15 AS u, epoch(date_trunc('second', ts))::BIGINT AS t FROM events),
n AS (SELECT u, t, min(t) OVER (PARTITION BY u ORDER BY t RANGE BETWEEN 3600 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM s),
r AS (SELECT u, min(t) AS t FROM s GROUP BY u UNION ALL SELECT n.u, n.next FROM r JOIN n USING (u, t) WHERE n.next IS NOT NULL)
SELECT 'acct' || (u % 4) AS account_hash, 'sess' || u AS session_id, t AS asked_s FROM r""")
def timed_revocations(spark: SparkSession, sf_dir: str):
    """Events as sightings of fifteen sessions, each asked for at most once an hour."""
    u = F.col("user_id") % 15
    rows = _events(spark, sf_dir).select(F.concat(F.lit("acct"), u % 4).alias("account_hash"), F.concat(F.lit("sess"), u).alias("session_id"), "at")
    got = finished(revocations(rows, 3600, by_clock=False), new_folder(spark, "revocations-out"), new_folder(spark, "revocations-state"))
    return got.select("account_hash", "session_id", F.unix_seconds("asked_at").alias("asked_s"))
