"""Session logs whose first line is a header; entries have ids, and one may be written again with fuller usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_filled, last_path_part
from .base import SourceAdapter, Usage, as_entries, as_events, best_copy, count_at, listed_files, parsed_lines, present_at, text_at, time_at

NAME = "pi"
ROLES = ("user", "assistant", "toolResult")
SUMMARIES = ("compaction", "branch_summary")


class PiLogs(SourceAdapter):
    """A line counts once its end is written. An entry keeps its first event and its largest usage.

    Files without a valid header (version 1 to 3, an id) are left out; those with a parent session give events alone.
    """

    name = NAME

    def read(self, spark: SparkSession, roots: list[str]) -> Usage:
        raw = self.lines(spark, roots).where("complete")
        lines = parsed_lines(raw)
        headers = self._headers(raw, lines)
        chosen = best_copy(listed_files(spark, roots).join(headers, "path"), "session_id").drop("size", "mtime")
        rows = self._records(lines.join(chosen, "path").where(F.col("line_no") > F.col("header_line")).withColumn("source", F.lit(NAME)))
        events = rows.where("role is not null").groupBy("path", "key").agg(F.min_by(F.struct("session_id", "source", "project", "role", "at", F.col("line_no").alias("seq")), "line_no").alias("e"))
        used = rows.where("score > 0").groupBy("path", "key").agg(F.max_by(F.struct("*"), F.struct("score", -F.col("line_no"))).alias("e"))
        return Usage(as_entries(used.select("e.*")), as_events(events.select("e.*")))

    @staticmethod
    def _headers(raw: DataFrame, lines: DataFrame) -> DataFrame:
        """(path, session_id, project, version, replay, header_line); the header must be the first line that is not blank."""
        first = raw.groupBy("path").agg(F.min("line_no").alias("line_no"))
        version = F.when(present_at("doc", "$.version"), F.try_variant_get("doc", "$.version", "bigint")).otherwise(F.lit(1))
        parent = F.try_variant_get("doc", "$.parentSession", "variant")
        name = text_at("doc", "$.parentSession")
        replay = F.when(parent.isNull() | F.is_variant_null(parent), F.lit(False)).when(name.isNotNull(), F.trim(name) != "").otherwise(F.lit(True))
        rows = lines.join(first, ["path", "line_no"]).where(text_at("doc", "$.type") == "session")
        rows = rows.select(
            "path", F.col("line_no").alias("header_line"), F.nullif(F.trim(text_at("doc", "$.id")), F.lit("")).alias("session_id"), version.alias("version"), replay.alias("replay"),
            F.coalesce(last_path_part(text_at("doc", "$.cwd")), F.lit("unknown")).alias("project"),
        )
        return rows.where("session_id is not null and version between 1 and 3")

    @staticmethod
    def _records(rows: DataFrame) -> DataFrame:
        kind, role = text_at("doc", "$.type"), text_at("doc", "$.message.role")
        key = F.coalesce(F.nullif(F.trim(text_at("doc", "$.id")), F.lit("")), F.when(F.col("version") == 1, F.concat(F.lit("@"), F.col("line_no"))))
        at = F.coalesce(time_at("doc", "$.timestamp"), F.timestamp_millis(F.try_variant_get("doc", "$.message.timestamp", "bigint")))
        rows = rows.withColumns({"kind": kind, "key": key, "at": at, "role": F.when(kind == "message", role)}).where("key is not null and at is not null")
        rows = rows.where(((F.col("kind") == "message") & F.col("role").isin(*ROLES)) | F.col("kind").isin(*SUMMARIES))
        counted = (F.col("role") == "assistant") & ~F.coalesce(text_at("doc", "$.message.provider") == "cursor-agent", F.lit(False)) & ~F.coalesce(text_at("doc", "$.message.stopReason") == "pending", F.lit(False))
        own = F.when(F.col("kind") == "message", F.when(counted, F.try_variant_get("doc", "$.message.usage", "variant"))).otherwise(F.try_variant_get("doc", "$.usage", "variant"))
        model = F.when(F.col("kind") == "message", first_filled(text_at("doc", "$.message.responseModel"), text_at("doc", "$.message.model")))
        rows = rows.withColumns({"u": F.when(~F.col("replay"), own), "model": F.coalesce(model, F.lit("unknown"))})
        rows = rows.withColumns({c: count_at("u", f"$.{name}") for c, name in {"input": "input", "output": "output", "cache_read": "cacheRead", "cache_creation": "cacheWrite", "reasoning": "reasoning"}.items()})
        rows = rows.withColumn("score", F.col("input") + F.col("output") + F.col("cache_read") + F.col("cache_creation")).withColumn("reasoning", F.least("reasoning", "output"))
        return rows.withColumn("output", F.col("output") - F.col("reasoning")).drop("doc", "u")
