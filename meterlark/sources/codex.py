"""Rollout logs under ``sessions/`` and ``archived_sessions/``: a header, turns with a model, and running token counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import last_path_part, repository_name
from ..operators.folds import last_seen, line_chunk
from ..operators.usage import counter_rises
from .base import SourceAdapter, Usage, as_entries, as_events, best_copy, count_at, listed_files, parsed_lines, present_at, text_at, time_at

NAME = "codex"
COUNTERS = ("input_tokens", "output_tokens", "cached", "reasoning_output_tokens")


def _counters(path: str) -> Column:
    """The four counters at a path, null where nothing is there."""
    cached = F.when(present_at("doc", f"{path}.cached_input_tokens"), count_at("doc", f"{path}.cached_input_tokens")).otherwise(count_at("doc", f"{path}.cache_read_input_tokens"))
    fields = [cached.alias(c) if c == "cached" else count_at("doc", f"{path}.{c}").alias(c) for c in COUNTERS]
    return F.when(present_at("doc", path), F.struct(*fields))


class CodexLogs(SourceAdapter):
    """Usage is what a line says of the last call, else the rise of the running total since the line before it.

    A line that repeats a running total above 0 is no call. A fall of any counter is a reset: the total itself counts.
    The first header of a file names session and project; forks and sub-agents repeat usage of others and give events alone.
    """

    name = NAME

    def read(self, spark: SparkSession, roots: list[str]) -> Usage:
        lines = parsed_lines(self.lines(spark, roots))
        lines = lines.withColumns({"type": F.coalesce(text_at("doc", "$.type"), F.lit("")), "at": time_at("doc", "$.timestamp")})
        headers = self._headers(lines)
        files = listed_files(spark, roots).join(headers, "path", "left").withColumn("session_id", F.coalesce("session_id", "path"))
        chosen = best_copy(files, "session_id").select("path", "session_id", F.coalesce("project", F.lit("unknown")).alias("project"), F.coalesce("replay", F.lit(False)).alias("replay"))
        own = lines.join(chosen, "path").withColumn("source", F.lit(NAME))
        return Usage(as_entries(self._entries(own)), as_events(self._events(own)))

    @staticmethod
    def _headers(lines: DataFrame) -> DataFrame:
        """(path, session_id, project, replay) from the first header line of each file."""
        meta = lines.where((F.col("type") == "session_meta") & present_at("doc", "$.payload"))
        url, cwd = text_at("doc", "$.payload.git.repository_url"), text_at("doc", "$.payload.cwd")
        project = F.coalesce(F.when(url.contains("/"), repository_name(url)), last_path_part(cwd), F.lit("unknown"))
        child = (F.coalesce(text_at("doc", "$.payload.thread_source") == "subagent", F.lit(False))) | F.coalesce(text_at("doc", "$.payload.source") == "subagent", F.lit(False))
        child = child | present_at("doc", "$.payload.source.subagent") | present_at("doc", "$.payload.parent_thread_id")
        replay = child | text_at("doc", "$.payload.forked_from_id").isNotNull()
        fields = F.struct(text_at("doc", "$.payload.id").alias("session_id"), project.alias("project"), replay.alias("replay"))
        return meta.groupBy("path").agg(F.min_by(fields, "line_no").alias("h")).select("path", "h.*")

    @staticmethod
    def _events(lines: DataFrame) -> DataFrame:
        role = F.when(F.col("type").isin("turn_context", "session_meta"), F.lit("user")).otherwise(F.lit("assistant"))
        seen = lines.where(F.col("at").isNotNull() & ~(F.col("replay") & (F.col("type") == "session_meta")))
        return seen.select("session_id", "source", "project", role.alias("role"), "at", F.col("line_no").alias("seq"))

    @staticmethod
    def _entries(lines: DataFrame) -> DataFrame:
        info = "$.payload.info"
        total_path = f"{info}.total_token_usage"
        counts = (F.col("type") == "event_msg") & (text_at("doc", "$.payload.type") == "token_count") & present_at("doc", info)
        turn = F.when(F.col("type") == "turn_context", F.nullif(text_at("doc", "$.payload.model"), F.lit("")))
        rows = lines.where("not replay").withColumns({
            "counts": F.coalesce(counts, F.lit(False)), "turn": turn, "last": F.when(counts, _counters(f"{info}.last_token_usage")), "total": F.when(counts, _counters(total_path)),
            "sum": F.when(counts & present_at("doc", f"{total_path}.total_tokens"), count_at("doc", f"{total_path}.total_tokens")),
            "said": F.coalesce(text_at("doc", f"{info}.model"), text_at("doc", "$.payload.model")),
        }).where("counts or turn is not null").drop("doc")
        rows = last_seen(rows, {"turn": "turn_model"}, ["path"], ["line_no"], line_chunk(), current=True).where("counts")
        rows = counter_rises(rows, "total", "sum", ["path"], ["line_no"])
        rows = rows.withColumn("u", F.coalesce("last", "rise")).where(~F.col("repeated") & F.col("u").isNotNull() & F.col("at").isNotNull())
        # A blank model of the call keeps the payload's from being asked.
        model = F.coalesce(F.nullif("said", F.lit("")), "turn_model", F.lit("unknown"))
        return rows.withColumns({
            "model": model,
            "input": F.greatest(F.col("u.input_tokens") - F.col("u.cached"), F.lit(0)),
            "output": F.greatest(F.col("u.output_tokens") - F.col("u.reasoning_output_tokens"), F.lit(0)),
            "cache_read": F.col("u.cached"), "cache_creation": F.lit(0), "reasoning": F.col("u.reasoning_output_tokens"),
        }).where("input + output + cache_read + reasoning > 0")
