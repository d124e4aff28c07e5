"""Where a home folder keeps each tool's logs. Settings are passed in (such as os.environ), so a job says whose they are."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession

from .base import roots_of

#: Settings that name a folder, and the folders under the home where none is set (fixed values).
SETTINGS = {"claude-code": "CLAUDE_CONFIG_DIR", "codex": "CODEX_HOME", "grok": "GROK_HOME", "pi": "PI_CODING_AGENT_SESSION_DIR"}
PI_AGENT = "PI_CODING_AGENT_DIR"
FOLDERS = {"claude-code": ".claude", "codex": ".codex", "grok": ".grok/sessions", "pi": ".pi/agent/sessions"}
CLAUDE_LIKE, CLAUDE_PARTS = ".claude-*", ("projects", "transcripts")


def at_home(folder: str, home: str) -> str:
    """A folder with ``~`` written out and without slashes at its end."""
    plain = folder.strip().rstrip("/\\")
    if plain == "~":
        return home
    return f"{home}/{plain[2:]}" if plain[:2] in ("~/", "~\\") else plain


def log_roots(spark: SparkSession, source: str, home: str, settings: Mapping[str, str], extra: tuple[str, ...] = ()) -> list[str]:
    """The folders of a source that are there, each once. A setting replaces the usual folder, but for the first source, where it is added to it."""
    named = at_home(settings.get(SETTINGS[source], ""), home)
    usual = f"{home}/{FOLDERS[source]}"
    if source == "claude-code":
        found = [usual, *[named] * bool(named), *_folders_with_logs(spark, home)]
    elif source == "pi":
        agent = at_home(settings.get(PI_AGENT, ""), home)
        found = [named or (f"{agent}/sessions" if agent else usual)]
    else:
        found = [(f"{named}/sessions" if source == "grok" else named) if named else usual]
    return roots_of(spark, [*found, *extra])


def _folders_with_logs(spark: SparkSession, home: str) -> list[str]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(home).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    like = [str(s.getPath().toString()) for s in files.globStatus(path(f"{home}/{CLAUDE_LIKE}")) or []]
    return [f for f in like if any(files.exists(path(f"{f}/{part}")) for part in CLAUDE_PARTS)]
