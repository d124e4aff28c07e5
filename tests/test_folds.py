"""Folds that are cut into chunks, against plain windows, and how they spread one long key over tasks."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from meterlark.operators.folds import last_seen, line_chunk, running_count
from meterlark.operators.usage import active_seconds, carried_forward, counter_rises
from pyspark.sql import Window
from pyspark.sql import functions as F

T0 = dt.datetime(2026, 1, 15)


def rows(spark, n=400, seed=1):
    rng = random.Random(seed)
    data = [(rng.choice("aab"), k, rng.choice([None, None, f"v{k}"]), rng.randrange(5) if rng.random() < 0.7 else None, rng.random() < 0.3) for k in range(n)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "key string, n bigint, v string, c bigint, flag boolean").repartition(5)


@pytest.mark.parametrize("size", [1, 3, 50, 10_000])
def test_chunks_change_nothing(spark, size):
    df, chunk = rows(spark), F.expr(f"n div {size}")
    order = Window.partitionBy("key").orderBy("n")
    for current in (False, True):
        upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow if current else -1)
        want = df.withColumns({"lv": F.last("v", ignorenulls=True).over(upto), "lc": F.last("c", ignorenulls=True).over(upto)})
        got = last_seen(df, {"v": "lv", "c": "lc"}, ["key"], ["n"], chunk, current)
        assert got.columns == want.columns and sorted(got.collect(), key=repr) == sorted(want.collect(), key=repr)
    want = df.withColumn("m", F.sum(F.col("flag").cast("bigint")).over(order))
    assert sorted(running_count(df, F.col("flag"), "m", ["key"], ["n"], chunk).collect(), key=repr) == sorted(want.collect(), key=repr)


def test_empty_rows_and_nulls(spark):
    df = rows(spark)
    assert last_seen(df.limit(0), {"v": "lv"}, ["key"], ["n"], F.col("n")).count() == 0
    late = df.withColumn("n", F.when(F.col("n") % 2 == 0, F.col("n")))
    assert last_seen(late, {"v": "lv"}, ["key"], ["n"], F.expr("n div 3")).count() == df.count()


@pytest.mark.parametrize("size", [1, 2, 100])
def test_counters_rise_repeat_and_begin_anew(spark, size):
    said = [(5, 1, 6), (7, 1, 8), (7, 1, 8), None, (7, 1, 8), (9, 4, 13), (2, 1, 3), (2, 1, 3), (0, 0, 0), (0, 0, 0), (4, 0, 4)]
    data = [("f", k, x and (x[0], x[1]), x and x[2]) for k, x in enumerate(said)] + [("g", 0, (3, 3), None), ("g", 1, (4, 5), None)]
    df = spark.createDataFrame(data, "path string, line_no bigint, counters struct<a bigint, b bigint>, t bigint").repartition(3)
    got = {(r.path, r.line_no): (r.rise and tuple(r.rise), r.repeated) for r in counter_rises(df, "counters", "t", ["path"], ["line_no"], F.expr(f"line_no div {size}")).collect()}
    want = [((5, 1), False), ((2, 0), False), ((0, 0), True), (None, False), ((0, 0), True), ((2, 3), False), ((2, 1), False), ((0, 0), True), ((0, 0), False), ((0, 0), False), ((4, 0), False)]
    assert got == {("f", k): w for k, w in enumerate(want)} | {("g", 0): ((3, 3), False), ("g", 1): ((1, 2), False)}


def test_one_long_session_is_spread_over_tasks(spark):
    """All events in one session, half a year of them: no task of the fold has more than a small multiple of the median."""
    n = 120_000
    events = spark.range(n).select(F.lit("s").alias("source"), F.lit("one").alias("session_id"), F.when(F.col("id") % 9 == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), (F.lit(T0) + F.make_dt_interval(secs=F.col("id") * 120)).alias("at"), F.col("id").alias("seq"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(kept, ("16", "false", "-1")):
            spark.conf.set(k, v)
        counted = running_count(events, F.col("role") == "user", "turn", ["source", "session_id"], ["at", "seq"], F.floor(F.unix_timestamp("at") / 3600))
        sizes = sorted(r["count"] for r in counted.groupBy(F.spark_partition_id()).count().collect())
        assert sum(sizes) == n and sizes[-1] <= 2 * sizes[len(sizes) // 2]
        lines = events.select(F.col("source").alias("path"), (F.col("seq") * 9).alias("line_no"), F.when(F.col("seq") % 5000 == 0, F.col("seq").cast("string")).alias("model"))
        filled = carried_forward(lines, "model", ["path"], ["line_no"], "none")
        sizes = sorted(r["count"] for r in filled.groupBy(F.spark_partition_id()).count().collect())
        assert sizes[-1] <= 3 * n / len(sizes) and filled.where("cast(model as bigint) <> line_no div 9 div 5000 * 5000").count() == 0
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert active_seconds(events).first().active_seconds == sum((min(8, n - 1 - k) - 1) * 120 for k in range(0, n, 9) if k + 1 < n)
    assert line_chunk() is not None
