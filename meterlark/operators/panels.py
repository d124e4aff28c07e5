"""The dashboard's questions: totals, series, breakdowns, distributions, activity, sessions and filter options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import share_of
from ..functions.text import display_model
from ..functions.times import series_grid
from .pricing import PARTS, priced
from .scans import NUMBERS, Filter, instant, scan_buckets, scan_days, step_of_day
from .usage import sums

#: Dimensions of a breakdown; any other name means the source.
DIMENSIONS = {"model": "model", "project": "project", "host": "host_id"}
MOST_SESSIONS, USUAL_SESSIONS = 500, 100
SERIES_PARTS = ("input", "output", "cache_read", "cache_creation")


def _money(cost: Column) -> Column:
    return F.coalesce(F.sum(cost), F.lit(0.0))


def costed(rows: DataFrame, index: DataFrame, *keys: str) -> DataFrame:
    """Sums by ``keys`` and billed model, with price and cost. Cost is linear in tokens, so rows are added up before any price is looked at."""
    return priced(rows.groupBy(*keys, "billed_model").agg(*sums(*NUMBERS)), index)


def summary(buckets: DataFrame, rollups: DataFrame | None, index: DataFrame, f: Filter) -> DataFrame:
    """One row: token sums, cost, the share of tokens that has a price, the cache hit share, hosts and sources seen."""
    rows = costed(scan_days(buckets, rollups, f), index, "host_id", "source")
    whole = rows.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in NUMBERS],
        _money(F.col("cost")).alias("cost_usd"),
        F.coalesce(F.sum(F.when(F.col("price").isNotNull(), F.col("total"))), F.lit(0)).alias("priced_tokens"),
        F.count_distinct("host_id").alias("hosts"),
        F.count_distinct("source").alias("sources"),
    )
    asked = F.col("input") + F.col("cache_read") + F.col("cache_creation")
    return whole.withColumns({"cost_coverage": share_of(F.col("priced_tokens"), F.col("total"), 1.0), "cache_hit_share": share_of(F.col("cache_read"), asked, 0.0)})


def session_totals(sessions: DataFrame, f: Filter) -> DataFrame:
    rows = _session_rows(sessions, f)
    seconds = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("duration_seconds", "active_seconds", "message_count", "user_message_count")]
    return rows.agg(F.count("*").alias("sessions"), *seconds)


def series(spark: SparkSession, buckets: DataFrame, rollups: DataFrame | None, index: DataFrame, f: Filter, most: int = 1024) -> DataFrame:
    """A row per bin of the grid, empty bins included: ``bin_s`` (epoch second of its start), tokens and cost."""
    step, first, count = series_grid(f.start, f.end, most)
    grid = spark.range(first, first + step * count, step, 1).withColumnRenamed("id", "bin_s")
    if step_of_day(step):
        rows = scan_days(buckets, rollups, f).withColumn("at", F.unix_seconds(F.col("day").cast("timestamp")))
    else:
        rows = scan_buckets(buckets, f).withColumn("at", F.unix_seconds("bucket_start"))
    bins = rows.withColumn("bin_s", F.floor(F.col("at") / step) * step)
    filled = costed(bins, index, "bin_s").groupBy("bin_s").agg(*sums("total", *SERIES_PARTS), _money(F.col("cost")).alias("cost_usd"))
    return grid.join(filled, "bin_s", "left").fillna(0)  # the grid has at most ``most`` rows


def grouped(rows: DataFrame, *keys: Column | str) -> DataFrame:
    """Tokens, cost and the one price that all priced rows of a group share (null where they differ)."""
    price = F.when(F.count_distinct("price") == 1, F.any_value("price", True))
    groups = rows.groupBy(*keys).agg(*sums(*NUMBERS), _money(F.col("cost")).alias("cost_usd"), price.alias("price"))
    return groups.select("*", *[F.col(f"price.{p}").alias(f"price_{p}") for p in PARTS]).drop("price")


def with_shares(groups: DataFrame, *within: str) -> DataFrame:
    """Token and cost shares of all groups (of those with the same ``within``). There are as many rows as groups."""
    whole = Window.partitionBy(*(within or [F.lit(1)]))
    return groups.withColumns({"share": share_of(F.col("total"), F.sum("total").over(whole), 0.0), "cost_share": share_of(F.col("cost_usd"), F.sum("cost_usd").over(whole), 0.0)})


def breakdown(buckets: DataFrame, rollups: DataFrame | None, index: DataFrame, f: Filter, by: str = "source") -> DataFrame:
    """Groups of one dimension, most tokens first, then by key."""
    key = DIMENSIONS.get(by, "source")
    rows = scan_days(buckets, rollups, f).withColumn("key", F.col(key))
    return with_shares(grouped(costed(rows, index, "key"), "key")).orderBy(F.desc("total"), "key")


def distributions(buckets: DataFrame, rollups: DataFrame | None, index: DataFrame, f: Filter) -> DataFrame:
    """The four breakdowns (``dimension``, ``key``) from one scan, by grouping sets."""
    dims = ["host_id", "source", "model", "project"]
    first = costed(scan_days(buckets, rollups, f), index, *dims)
    price = F.when(F.count_distinct("price") == 1, F.any_value("price", True))
    sets = first.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims]).agg(
        *sums(*NUMBERS), _money(F.col("cost")).alias("cost_usd"), price.alias("price"), F.grouping_id(*dims).alias("gid")
    )
    name = F.when(F.col("gid") == 7, "host").when(F.col("gid") == 11, "source").when(F.col("gid") == 13, "model").otherwise("project")
    key = F.when(F.col("gid") == 7, F.col("host_id")).when(F.col("gid") == 11, F.col("source")).when(F.col("gid") == 13, F.col("model")).otherwise(F.col("project"))
    rows = sets.select(name.alias("dimension"), key.alias("key"), *NUMBERS, "cost_usd", *[F.col(f"price.{p}").alias(f"price_{p}") for p in PARTS])
    return with_shares(rows, "dimension").orderBy("dimension", F.desc("total"), "key")


def activity(spark: SparkSession, buckets: DataFrame, f: Filter) -> DataFrame:
    """168 rows: tokens by weekday (0 is Sunday) and hour, UTC."""
    rows = scan_buckets(buckets, f)
    cells = rows.groupBy((F.dayofweek("bucket_start") - 1).alias("weekday"), F.hour("bucket_start").alias("hour")).agg(*sums("total"))
    grid = spark.range(0, 168, 1, 1).select(F.floor(F.col("id") / 24).cast("int").alias("weekday"), (F.col("id") % 24).cast("int").alias("hour"))
    return grid.join(cells, ["weekday", "hour"], "left").fillna(0)


def _session_rows(sessions: DataFrame, f: Filter) -> DataFrame:
    rows = sessions.where((F.col("last_at") >= instant(f.start)) & (F.col("last_at") < instant(f.end)))
    rows = f.where(rows)  # sessions have no model
    return rows.withColumn("project", F.lit("unknown")) if f.hide_projects else rows


def latest_sessions(sessions: DataFrame, f: Filter, limit: int = USUAL_SESSIONS) -> DataFrame:
    """The sessions that ended last: a top-k report of 1 to 500 rows."""
    order = [F.desc("last_at"), "host_id", "source", "session_hash"]
    return _session_rows(sessions, f).orderBy(*order).limit(min(max(limit, 1), MOST_SESSIONS))


def filter_options(buckets: DataFrame, hide_projects: bool = False) -> DataFrame:
    """One row with the sorted sources, display names and projects that there are."""
    project = F.sort_array(F.collect_set("project"))
    names = buckets.select("source", "model", "project").distinct().withColumn("model", display_model(F.col("model")))
    return names.agg(
        F.sort_array(F.collect_set("source")).alias("sources"), F.sort_array(F.collect_set("model")).alias("models"),
        (F.array().cast("array<string>") if hide_projects else project).alias("projects"),
    )
