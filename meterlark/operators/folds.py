"""Folds over rows in order that no single task has to walk: what was last seen before a row, and running counts.

A fold over a session or a file looks like a window over it, and a window puts all of it into one task. Here the order is cut into chunks by a rule that
rises with it (some thousands of lines, an hour of time), and a fold is three steps: inside each chunk, a window; for each chunk, a summary that
joins with that of the chunk after it (the last value, the sum); over the summaries of one key, few rows in place of many, a window that gives each chunk what
came before it. A long session is so spread over as many tasks as it has chunks.

Keys are never null. A null in what orders the rows goes with the first chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "fold_chunk"
#: Lines of a chunk of a file.
CHUNK_LINES = 16_384


def line_chunk(line_no: str = "line_no") -> Column:
    return F.expr(f"{line_no} div {CHUNK_LINES}")


def hour_chunk(at: str = "at") -> Column:
    return F.floor(F.unix_timestamp(F.col(at).cast("timestamp")) / 3600)


def _earlier(rows: DataFrame, keys: list[str], summary: dict[str, Column], fold) -> DataFrame:
    """A row per key and chunk: each summary folded over the chunks before it."""
    ends = rows.groupBy(*keys, CHUNK).agg(*[s.alias(name) for name, s in summary.items()])
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    return ends.select(*keys, CHUNK, *[fold(F.col(name)).over(before).alias(name) for name in summary])


def last_seen(rows: DataFrame, columns: dict[str, str], keys: list[str], order: list[str], chunk: Column, current: bool = False) -> DataFrame:
    """Adds for each column (name: new name) the last value that is not null of the rows before, in the order; with ``current`` the row's own counts as well."""
    rows = rows.withColumn(CHUNK, F.coalesce(chunk.cast("bigint"), F.lit(-(1 << 62))))
    # Of rows without a value max_by() sees none.
    summary = {f"fold_{new}": F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))) for c, new in columns.items()}
    earlier = _earlier(rows, keys, summary, lambda x: F.last(x, ignorenulls=True))
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow if current else -1)
    found = rows.withColumns({new: F.last(c, ignorenulls=True).over(inside) for c, new in columns.items()}).join(earlier, [*keys, CHUNK])
    return found.withColumns({new: F.coalesce(new, f"fold_{new}") for new in columns.values()}).drop(CHUNK, *summary)


def running_count(rows: DataFrame, counted: Column, name: str, keys: list[str], order: list[str], chunk: Column) -> DataFrame:
    """Adds how many rows up to each one, itself included, are ``counted``."""
    rows = rows.withColumns({CHUNK: F.coalesce(chunk.cast("bigint"), F.lit(-(1 << 62))), "fold_one": F.coalesce(counted.cast("bigint"), F.lit(0))})
    earlier = _earlier(rows, keys, {"fold_sum": F.sum("fold_one")}, F.sum)
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn(name, F.sum("fold_one").over(inside)).join(earlier, [*keys, CHUNK])
    return found.withColumn(name, F.col(name) + F.coalesce("fold_sum", F.lit(0))).drop(CHUNK, "fold_one", "fold_sum")
