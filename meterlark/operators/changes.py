"""What a collector still has to send: changed rows, batches, acknowledgements, and the pruning of what it remembers.

``state`` is (key, hash): the content last acknowledged for each key. There is one per destination.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import running_count

#: Rows of an upload at most (fixed values).
BATCH_BUCKETS, BATCH_SESSIONS = 100, 500


def changed_rows(rows: DataFrame, state: DataFrame, full: bool = False) -> DataFrame:
    """Rows (with key, hash) whose content is not what the state holds for the key; all of them if ``full``."""
    return rows if full else rows.join(state.select("key", "hash"), ["key", "hash"], "left_anti")


def batches(rows: DataFrame, size: Column | int, per: tuple[str, ...], key: str) -> DataFrame:
    """``batch``: which upload of at most ``size`` rows a row goes with, by a slice of the key's md5 and then the key; each ``per`` is numbered apart, and no task numbers all of its rows."""
    sliced = rows.withColumn("slice", F.conv(F.substring(F.md5(F.col(key).cast("binary")), 1, 2), 16, 10).cast("int"))
    numbered = running_count(sliced, F.lit(True), "nth", list(per), ["slice", key], F.col("slice"))
    size = F.lit(size) if isinstance(size, int) else size
    return numbered.withColumn("batch", F.floor((F.col("nth") - 1) / size).cast("bigint")).drop("nth", "slice")


def acknowledged(state: DataFrame, sent: DataFrame, unknown_sources: list[str], sessions: bool = False) -> DataFrame:
    """State after a successful upload. Buckets of sources that the other side does not know stay unsent; protected ones are settled."""
    done = sent if sessions else sent.where(~F.col("source").isin(*unknown_sources)) if unknown_sources else sent
    fresh = done.groupBy("key").agg(F.max("hash").alias("hash"))
    return state.join(fresh, "key", "left_anti").unionByName(fresh.select(*state.columns))


def pruned(state: DataFrame, live: DataFrame, sources: DataFrame) -> DataFrame:
    """State without the keys that are gone.

    ``sources`` is (source, ok, by_account, attempted, succeeded), the last two sets of account hashes; a key begins with
    its source and ends, for usage of an account, with the account. A source that could not be read keeps all.
    Of accounts, those read keep what is live, those that failed keep all, the others go.
    """
    alive = state.join(live.select("key").distinct().withColumn("alive", F.lit(True)), "key", "left")
    known = alive.withColumn("source", F.substring_index("key", "|", 1)).join(sources, "source", "left")
    account = F.element_at(F.split("key", r"\|"), -1)
    is_live = F.coalesce("alive", F.lit(False))
    by_account = F.when(F.array_contains("succeeded", account), is_live).otherwise(F.coalesce(F.array_contains("attempted", account), F.lit(False)))
    keep = F.when(~F.coalesce("ok", F.lit(False)), True).when(F.col("by_account"), by_account).otherwise(is_live)
    return known.where(keep).select(*state.columns)


def last_events(events: DataFrame, per: str, order: Column, most: int = 50) -> DataFrame:
    """The newest ``most`` events of each account's log, which is a ring of that many."""
    nth = F.row_number().over(Window.partitionBy(per).orderBy(order.desc()))
    return events.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")


def sync_report(results: DataFrame) -> DataFrame:
    """One row over all destinations' results: what was taken, protected and changed, whether all went well, whether to try again."""
    whole = lambda *columns: F.coalesce(F.sum(sum((F.col(c) for c in columns), F.lit(0))), F.lit(0))
    return results.agg(
        whole("ingested").alias("ingested"), whole("sessions").alias("sessions"), whole("protected").alias("protected"), whole("changed_buckets", "changed_sessions").alias("changed"),
        F.coalesce(F.bool_and("ok"), F.lit(True)).alias("all_ok"), F.coalesce(F.bool_or(F.col("error_kind") == "retryable"), F.lit(False)).alias("retry"),
    )
