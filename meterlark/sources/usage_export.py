"""Usage exports of an account as CSV. Columns are found by name, whatever their order."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import text_count
from ..functions.times import export_time
from ..schema import EVENT
from .base import SourceAdapter, Usage, as_entries

NAME = "cursor"
#: Header names (fixed values).
DATE, MODEL = "Date", "Model"
COUNTS = {"cache_creation": "Input (w/ Cache Write)", "input": "Input (w/o Cache Write)", "cache_read": "Cache Read", "output": "Output Tokens"}


class UsageExport(SourceAdapter):
    """Rows with a date, a model and a count above 0. Missing count columns are 0; a file without date or model is an error.

    Times without a zone are in ``zone``; rows before ``since`` (epoch second) are left out. Exports have no sessions.
    """

    name = NAME
    glob = "*.csv"

    def __init__(self, zone: str = "UTC", since: int | None = None):
        self.zone, self.since = zone, since

    def read(self, spark: SparkSession, roots: list[str]) -> Usage:
        rows = spark.read.csv(roots, header=True, quote='"', escape='"', multiLine=True, recursiveFileLookup=True, pathGlobFilter="*.csv", enforceSchema=False)
        named = {c.strip().lstrip("﻿"): c for c in rows.columns}
        missing = {DATE, MODEL} - named.keys()
        if missing:
            raise ValueError(f"columns not found: {', '.join(sorted(missing))}")
        cell = lambda name: F.col(f"`{named[name]}`") if name in named else F.lit(None).cast("string")
        found = rows.select(
            F.lit(NAME).alias("source"), F.trim(cell(MODEL)).alias("model"), F.lit("unknown").alias("project"), F.lit("").alias("session_id"),
            export_time(cell(DATE), self.zone).alias("at"), *[text_count(cell(n)).alias(c) for c, n in COUNTS.items()], F.lit(0).alias("reasoning"),
        ).where("at is not null and model <> '' and input + output + cache_read + cache_creation > 0")
        if self.since is not None:
            found = found.where(F.unix_seconds("at") >= self.since)
        return Usage(as_entries(found), spark.createDataFrame([], EVENT))
