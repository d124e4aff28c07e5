"""Session folders ``<folder>/<session>/`` with summary.json, updates.jsonl and, as a fallback, events.jsonl."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import decoded_path_part, last_path_part
from .base import SourceAdapter, Usage, as_entries, as_events, count_at, numbered_lines, present_at, text_at, time_at, whole_files

NAME = "grok"
COUNTS = {"input": "inputTokens", "cache_read": "cachedReadTokens", "output": "outputTokens", "reasoning": "reasoningTokens", "cache_creation": "cacheCreationTokens"}


class GrokLogs(SourceAdapter):
    """Usage from completed turns, by model where the turn says so. Sub-agents' usage is their parent's, so they give events alone.

    Events come from the updates; a session without any takes them from events.jsonl, else from its summary.
    """

    name = NAME
    glob = "summary.json"

    def read(self, spark: SparkSession, roots: list[str]) -> Usage:
        by_folder = lambda glob: whole_files(spark, roots, glob).withColumns({"dir": F.regexp_extract("path", "^(.*)/[^/]+$", 1)})
        summaries = by_folder("summary.json").select("dir", F.try_parse_json("text").alias("doc"))
        updates, fallback = self._lines(by_folder("updates.jsonl")), self._lines(by_folder("events.jsonl"))
        sessions = self._sessions(updates.select("dir").distinct().join(summaries, "dir", "full_outer"))
        facts = sessions.drop("doc")
        turns = updates.withColumn("kind", text_at("doc", "$.params.update.sessionUpdate")).withColumn("at", time_at("doc", "$.timestamp")).where("at is not null").join(facts, "dir")
        role = F.when(F.col("kind") == "user_message_chunk", F.lit("user")).when(F.col("kind").isin("agent_message_chunk", "turn_completed"), F.lit("assistant"))
        first = self._events(turns.withColumn("role", role))
        role = F.when(F.col("kind") == "turn_started", F.lit("user")).when(F.col("kind").isin("turn_ended", "first_token"), F.lit("assistant"))
        others = fallback.withColumns({"kind": text_at("doc", "$.type"), "at": F.coalesce(time_at("doc", "$.ts"), time_at("doc", "$.timestamp"))}).where("at is not null")
        second = self._events(others.join(facts, "dir").join(first.select("dir").distinct(), "dir", "left_anti").withColumn("role", role))
        third = self._summary_events(sessions.join(first.select("dir").unionByName(second.select("dir")).distinct(), "dir", "left_anti"))
        return Usage(as_entries(self._entries(turns.where("not child"))), as_events(first.unionByName(second).unionByName(third)))

    @staticmethod
    def _lines(files: DataFrame) -> DataFrame:
        return numbered_lines(files).withColumn("dir", F.regexp_extract("path", "^(.*)/[^/]+$", 1))

    @staticmethod
    def _sessions(rows: DataFrame) -> DataFrame:
        folder = decoded_path_part(F.regexp_extract("dir", "([^/]+)/[^/]+$", 1))
        cwd = F.when(present_at("doc", "$.info.cwd"), text_at("doc", "$.info.cwd")).otherwise(text_at("doc", "$.git_root_dir"))
        return rows.select(
            "dir", "doc", F.lit(NAME).alias("source"), F.regexp_extract("dir", "([^/]+)$", 1).alias("session_id"),
            F.when(cwd.isNotNull(), F.coalesce(last_path_part(cwd), F.lit("unknown"))).otherwise(F.coalesce(folder, F.lit("unknown"))).alias("project"),
            F.coalesce(text_at("doc", "$.current_model_id"), F.lit("unknown")).alias("usual_model"),
            F.coalesce(text_at("doc", "$.session_kind") == "subagent", F.lit(False)).alias("child"),
        )

    @staticmethod
    def _events(rows: DataFrame) -> DataFrame:
        return rows.where("role is not null").select("dir", "session_id", "source", "project", "role", "at", F.col("line_no").alias("seq"))

    @staticmethod
    def _summary_events(sessions: DataFrame) -> DataFrame:
        ended = F.when(present_at("doc", "$.updated_at"), time_at("doc", "$.updated_at")).otherwise(time_at("doc", "$.last_active_at"))
        both = F.array(F.struct(F.lit("user").alias("role"), time_at("doc", "$.created_at").alias("at"), F.lit(0).alias("seq")), F.struct(F.lit("assistant").alias("role"), ended.alias("at"), F.lit(1).alias("seq")))
        return sessions.select("dir", "session_id", "source", "project", F.inline(both)).where("at is not null")

    @staticmethod
    def _entries(turns: DataFrame) -> DataFrame:
        usage = "$.params.update.usage"
        by_model = F.try_variant_get("doc", f"{usage}.modelUsage", "map<string,variant>")
        whole = F.create_map(F.col("usual_model"), F.try_variant_get("doc", usage, "variant"))
        done = turns.where((F.col("kind") == "turn_completed") & present_at("doc", usage))
        rows = done.withColumn("m", F.when(F.size(by_model) > 0, by_model).otherwise(whole)).select("session_id", "source", "project", "at", F.explode("m").alias("model", "u"))
        rows = rows.withColumns({"model": F.coalesce(F.nullif("model", F.lit("")), F.lit("unknown")), **{c: count_at("u", f"$.{name}") for c, name in COUNTS.items()}})
        rows = rows.withColumns({"input": F.greatest(F.col("input") - F.col("cache_read"), F.lit(0)), "output": F.greatest(F.col("output") - F.col("reasoning"), F.lit(0))})
        return rows.where("input + output + cache_read + reasoning + cache_creation > 0")
