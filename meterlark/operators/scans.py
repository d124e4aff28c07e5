"""The filter of all panels and the scans below them: facts, rollups, and both stitched together."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import display_model
from ..functions.times import DAY, UTC, day_start, next_day
from ..schema import TOKENS
from .usage import sums

#: A window longer than this reads whole days from the rollups.
ROLLUP_AFTER = dt.timedelta(days=2)
KEYS = ("host_id", "source", "model", "project")
NUMBERS = (*TOKENS, "total")


def split_list(text: str | None) -> tuple[str, ...]:
    """A comma-separated parameter as values; blanks are left out."""
    return tuple(x.strip() for x in (text or "").split(",") if x.strip())


@dataclass(frozen=True)
class Filter:
    """[start, end) and optional values of host, sources, models (display names) and projects; empty means all."""

    start: dt.datetime
    end: dt.datetime
    host: str | None = None
    sources: tuple[str, ...] = ()
    models: tuple[str, ...] = ()
    projects: tuple[str, ...] = ()
    hide_projects: bool = False

    @classmethod
    def of(cls, start: dt.datetime | None = None, end: dt.datetime | None = None, host: str | None = None, source: str = "", model: str = "", project: str = "", hide_projects: bool = False) -> Filter:
        """From request parameters: the last seven days unless told otherwise; ``all`` and blank hosts mean every host."""
        end = end or dt.datetime.now(UTC)
        own = None if (host or "").strip() in ("", "all") else host
        return cls(start or end - dt.timedelta(days=7), end, own, split_list(source), split_list(model), split_list(project), hide_projects)

    def where(self, rows: DataFrame) -> DataFrame:
        """Predicates on stored columns; all reach the scan."""
        if self.host:
            rows = rows.where(F.col("host_id") == self.host)
        if self.sources:
            rows = rows.where(F.col("source").isin(*self.sources))
        if self.projects and not self.hide_projects:
            rows = rows.where(F.col("project").isin(*self.projects))
        return rows

    def shown(self, rows: DataFrame) -> DataFrame:
        """Display names, the filter on them, and masked projects. The billed name stays for the price."""
        rows = rows.withColumn("billed_model", F.col("model")).withColumn("model", display_model(F.col("model")))
        if self.models:
            wanted = [F.lower(display_model(F.lit(m))) for m in self.models]
            rows = rows.where(F.lower("model").isin(*wanted))
        return rows.withColumn("project", F.lit("unknown")) if self.hide_projects else rows


def instant(t: dt.datetime) -> Column:
    return F.lit(t if t.tzinfo else t.replace(tzinfo=UTC))


def scan_buckets(buckets: DataFrame, f: Filter, start: dt.datetime | None = None, end: dt.datetime | None = None) -> DataFrame:
    """Half-hour facts of the window, with ``bucket_start``. A ``day`` partition column is pruned as well."""
    a, b = start or f.start, end or f.end
    rows = buckets.where((F.col("bucket_start") >= instant(a)) & (F.col("bucket_start") < instant(b)))
    if "day" in buckets.columns:
        rows = rows.where(F.col("day").between(F.lit(a.date()), F.lit(b.date())))
    return f.shown(f.where(rows).select(*KEYS, "bucket_start", *NUMBERS))


def daily_rollups(buckets: DataFrame) -> DataFrame:
    """Sums by UTC day and key."""
    return buckets.groupBy(F.to_date("bucket_start").alias("day"), *KEYS).agg(*sums(*NUMBERS))


def scan_rollups(rollups: DataFrame, f: Filter, first: dt.date, end: dt.date) -> DataFrame:
    rows = rollups.where((F.col("day") >= F.lit(first)) & (F.col("day") < F.lit(end)))
    return f.shown(f.where(rows).select(*KEYS, "day", *NUMBERS))


def scan_days(buckets: DataFrame, rollups: DataFrame | None, f: Filter) -> DataFrame:
    """Rows with ``day``: whole days from the rollups and the edges from the facts, or facts alone for short windows."""
    by_day = lambda rows: rows.withColumn("day", F.to_date("bucket_start")).drop("bucket_start")
    if rollups is None or f.end - f.start <= ROLLUP_AFTER:
        return by_day(scan_buckets(buckets, f))
    first, last = next_day(f.start), day_start(f.end)
    if first >= last:
        return by_day(scan_buckets(buckets, f))
    rows = scan_rollups(rollups, f, first.date(), last.date())
    if f.start < first:
        rows = rows.unionByName(by_day(scan_buckets(buckets, f, end=first)))
    if last < f.end:
        rows = rows.unionByName(by_day(scan_buckets(buckets, f, start=last)))
    return rows


def step_of_day(step: int) -> bool:
    return step >= DAY and step % DAY == 0
