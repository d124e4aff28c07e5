"""Session logs under ``projects/<folder>/`` and ``transcripts/`` of each root."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import dashed_path_part, last_path_part
from ..operators.usage import carried_forward, largest_of_each
from .base import SourceAdapter, Usage, as_entries, as_events, best_copy, count_at, file_stem, listed_files, parsed_lines, text_at, time_at

NAME, UNKNOWN_MODEL, SYNTHETIC = "claude-code", "claude-unknown", "<synthetic>"
EVENT_TYPES = ("user", "assistant", "tool_use", "tool_result")


def without_sessions(files: DataFrame, others: DataFrame) -> DataFrame:
    """Files of sessions (session_id) that the others do not have."""
    return files.join(others.select("session_id"), "session_id", "left_anti")


class ClaudeLogs(SourceAdapter):
    """Usage from assistant lines with a usage object; every call counts once, with its largest numbers.

    A session's project is the last part of the first ``cwd`` in its file, else of the folder's name. Transcripts give
    events alone, and only for sessions that have no project log.
    """

    name = NAME

    def read(self, spark: SparkSession, roots: list[str]) -> Usage:
        files = listed_files(spark, roots).withColumn("session_id", file_stem("path"))
        folder = F.regexp_extract("path", r"/projects/([^/]+)/", 1)
        projects = best_copy(files.where(folder != ""), "session_id").withColumn("fallback", F.coalesce(dashed_path_part(folder), F.lit("unknown")))
        transcripts = best_copy(files.where(F.col("path").rlike("/transcripts/")), "session_id").withColumn("fallback", F.lit("unknown"))
        transcripts = without_sessions(transcripts, projects)
        raw = self.lines(spark, roots)
        lines = self._lines(raw, projects)
        return Usage(as_entries(self._entries(lines)), as_events(self._events(lines).unionByName(self._events(self._lines(raw, transcripts)))))

    @staticmethod
    def _lines(raw: DataFrame, files: DataFrame) -> DataFrame:
        """Lines of the chosen files with their session and project."""
        lines = parsed_lines(raw.join(files.select("path", "session_id", "fallback"), "path"))
        cwd = F.when(F.trim(text_at("doc", "$.cwd")) != "", text_at("doc", "$.cwd"))
        # The first of each file is a minimum, made before the shuffle; no window over a file.
        firsts = lines.groupBy("path").agg(F.min_by(cwd, F.when(cwd.isNotNull(), F.col("line_no"))).alias("first"))
        lines, first = lines.join(firsts, "path"), F.col("first")
        project = F.when(first.isNull(), F.col("fallback")).otherwise(F.coalesce(last_path_part(first), F.lit("unknown")))
        return lines.withColumns({"project": project, "at": time_at("doc", "$.timestamp"), "type": text_at("doc", "$.type"), "source": F.lit(NAME)}).where("at is not null").drop("first")

    @staticmethod
    def _events(lines: DataFrame) -> DataFrame:
        role = F.when(F.col("type") == "user", F.lit("user")).otherwise(F.lit("assistant"))
        return lines.where(F.col("type").isin(*EVENT_TYPES)).select("session_id", "source", "project", role.alias("role"), "at", F.col("line_no").alias("seq"))

    @staticmethod
    def _entries(lines: DataFrame) -> DataFrame:
        usage = "$.message.usage"
        split = count_at("doc", f"{usage}.cache_creation.ephemeral_5m_input_tokens") + count_at("doc", f"{usage}.cache_creation.ephemeral_1h_input_tokens")
        calls = lines.where((F.col("type") == "assistant") & F.try_variant_get("doc", usage, "variant").isNotNull()).withColumns({
            "model": F.trim(text_at("doc", "$.message.model")),
            "input": count_at("doc", f"{usage}.input_tokens"),
            "output": count_at("doc", f"{usage}.output_tokens"),
            "cache_read": count_at("doc", f"{usage}.cache_read_input_tokens"),
            "cache_creation": F.greatest(count_at("doc", f"{usage}.cache_creation_input_tokens"), split),
            "reasoning": F.lit(0),
        })
        calls = carried_forward(calls, "model", ["path"], ["line_no"], UNKNOWN_MODEL, ignore=(SYNTHETIC,))
        message, request = F.trim(F.coalesce(text_at("doc", "$.message.id"), F.lit(""))), F.trim(F.coalesce(text_at("doc", "$.requestId"), F.lit("")))
        call = F.when((message != "") | (request != ""), F.concat(F.lit("call:"), message, F.lit("\0"), request)).otherwise(F.nullif(text_at("doc", "$.uuid"), F.lit("")))
        score = F.col("input") + F.col("output") + F.col("cache_read") + F.col("cache_creation")
        scored = calls.withColumns({"call": call, "score": score}).where("score > 0").drop("doc")
        return largest_of_each(scored, "call", F.col("score"), ["session_id", "line_no"])
