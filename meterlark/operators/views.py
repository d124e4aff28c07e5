"""What a page makes of the answers: a small ring chart, shifted grids, labels, pages, and billing cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import month_before, shifted_cell


def top_and_other(groups: DataFrame, key: str = "key", value: str = "total", top: int = 7, other: str = "other") -> DataFrame:
    """The ``top`` largest groups and one row for all others, where there are more than ``top`` + 1."""
    rows = Window.partitionBy(F.lit(1))  # one row per group of a breakdown
    nth = F.row_number().over(rows.orderBy(F.desc(value), key))
    ranked = groups.select(F.col(key).alias("key"), F.col(value).alias("value"), nth.alias("nth"), F.count("*").over(rows).alias("n"))
    rest = (F.col("n") > top + 1) & (F.col("nth") > top)
    return ranked.withColumn("key", F.when(rest, F.lit(other)).otherwise(F.col("key"))).groupBy("key").agg(F.sum("value").alias("value"))


def shifted_activity(cells: DataFrame, offset_hours: int) -> DataFrame:
    """The weekly grid as a zone that is whole hours away sees it."""
    cell = shifted_cell(F.col("weekday"), F.col("hour"), offset_hours)
    return cells.withColumn("cell", cell).select(F.floor(F.col("cell") / 24).cast("int").alias("weekday"), (F.col("cell") % 24).cast("int").alias("hour"), "total")


def with_host_names(rows: DataFrame, hosts: DataFrame, key: str = "key") -> DataFrame:
    """``label``: the host's name, the key itself where there is none."""
    names = hosts.select(F.col("host_id").alias(key), F.nullif(F.trim("hostname"), F.lit("")).alias("hostname"))
    return rows.join(names, key, "left").withColumn("label", F.coalesce("hostname", key)).drop("hostname")


def sessions_with_zones(sessions: DataFrame, hosts: DataFrame) -> DataFrame:
    """Sessions with their host's UTC offset and their start as its clock showed it."""
    rows = sessions.join(hosts.select("host_id", "timezone"), "host_id", "left")
    return rows.withColumn("local_first_at", F.from_utc_timestamp("first_at", F.coalesce("timezone", F.lit("+00:00"))))


def page_of(rows: DataFrame, page: int, size: int, *order: Column | str) -> DataFrame:
    """Page ``page`` (from 0) of a list."""
    return rows.orderBy(*order).offset(page * size).limit(size)


def billing_cycles(accounts: DataFrame) -> DataFrame:
    """(account_hash, cycle_start, cycle_end): the month up to the end that the plan states."""
    return accounts.select("account_hash", month_before(F.col("cycle_end")).alias("cycle_start"), "cycle_end")


def cycle_totals(buckets: DataFrame, cycles: DataFrame) -> DataFrame:
    """(account_hash, lifetime, in_cycle): tokens of each account's usage, and those of the current cycle."""
    usage = buckets.where(F.col("host_id").startswith("acct:")).withColumn("account_hash", F.expr("substring(host_id, 6)"))
    inside = (F.col("bucket_start") >= F.col("cycle_start")) & (F.col("bucket_start") < F.col("cycle_end"))
    totals = usage.join(cycles, "account_hash").groupBy("account_hash")
    return totals.agg(F.sum("total").alias("lifetime"), F.coalesce(F.sum(F.when(inside, F.col("total"))), F.lit(0)).alias("in_cycle"))


def bin_window(bins: DataFrame, step: int, start_s: int, end_s: int) -> DataFrame:
    """What part of the asked window each bin (bin_s) covers, in epoch seconds."""
    return bins.withColumns({"from_s": F.greatest("bin_s", F.lit(start_s)), "to_s": F.least(F.col("bin_s") + step, F.lit(end_s))})


def bin_name(seconds: Column) -> Column:
    """A bin's width in minutes below an hour, in hours below a day, else in days: ``30 min``, ``3 h``, ``2 d``."""
    count = lambda unit: (seconds / unit).cast("bigint")
    return F.when(seconds < 3600, F.concat(count(60), F.lit(" min"))).when(seconds < 86400, F.concat(count(3600), F.lit(" h"))).otherwise(F.concat(count(86400), F.lit(" d")))


def top_models(groups: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` groups with most tokens, a report of that many rows."""
    return groups.orderBy(F.desc("total"), "key").limit(n)
