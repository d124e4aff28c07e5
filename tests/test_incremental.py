"""Logs read only where they changed, versioned tables, and sources that fail while they run."""

from __future__ import annotations

import datetime as dt
import json
import os
import threading

import pytest
from meterlark.functions.times import first_of_month, since_time
from meterlark.operators.pricing import imported_prices, keep_prices, model_count, read_prices
from meterlark.operators import control, views
from meterlark.operators.usage import first_of_each_account, normalized_accounts, normalized_sessions, with_session
from meterlark.sources.base import collect_all, roots_of
from meterlark.sources.claude import ClaudeLogs
from meterlark.sources.codex import CodexLogs
from meterlark.sources.incremental import LogStore
from meterlark.sources.pi import PiLogs
from meterlark.sources.ranges import GrownLines, lines_between
from meterlark.sources.roots import log_roots
from meterlark.versions import VersionedTable
from pyspark.sql import functions as F
from test_sources import call, write


def stamp(path, second):
    os.utime(path, (1_700_000_000 + second, 1_700_000_000 + second))


def rows_of(lines):
    shown = lines.select("path", "line_no", F.to_json("doc").alias("doc"), "complete").collect()
    return sorted(((r.path.rsplit("/", 1)[-1], r.line_no, r.doc, r.complete) for r in shown), key=repr)


def fresh(spark, root, tmp_path, n):
    return rows_of(LogStore(spark, str(tmp_path / f"fresh{n}")).refresh([str(root)]).lines)


def test_refreshes_read_only_what_changed(spark, tmp_path):
    root = tmp_path / "logs"
    write(root / "a.jsonl", ["{}", "", '{"n": 1}'])
    write(root / "b.jsonl", ['{"b": "é"}'])
    write(root / "c.jsonl", ["{}"], end="")
    for name in "abc":
        stamp(root / f"{name}.jsonl", 0)
    store = LogStore(spark, str(tmp_path / "store"))
    first = store.refresh([str(root)])
    assert (first.unchanged, first.resumed, first.parsed, first.gone) == (0, 0, 3, 0)
    assert rows_of(first.lines) == [("a.jsonl", 0, "{}", True), ("a.jsonl", 2, '{"n":1}', True), ("b.jsonl", 0, '{"b":"é"}', True), ("c.jsonl", 0, "{}", False)]
    # Nothing changed: no file is read and no line is written.
    again = store.refresh([str(root)])
    assert (again.unchanged, again.resumed, again.parsed, again.gone) == (3, 0, 0, 0) and rows_of(again.lines) == rows_of(first.lines)
    assert again.read == 0 and len([f for f in os.listdir(tmp_path / "store" / "format-2-json" / "lines") if f.startswith("refresh")]) == 1
    # a has grown, b has another beginning, c had an open last line.
    with open(root / "a.jsonl", "a") as f:
        f.write('{"n": 2}\n{"n": 3')
    write(root / "b.jsonl", ['{"x": "é"}', "{}"])
    with open(root / "c.jsonl", "a") as f:
        f.write("\n{}\n")
    for name in "abc":
        stamp(root / f"{name}.jsonl", 5)
    third = store.refresh([str(root)])
    assert (third.unchanged, third.resumed, third.parsed, third.gone) == (0, 1, 2, 0)
    assert rows_of(third.lines) == fresh(spark, root, tmp_path, 3)
    assert third.read == 5  # the whole line that was added to a, and the two of b and of c
    assert ("a.jsonl", 3, '{"n":2}', True) in rows_of(third.lines) and ("a.jsonl", 4, None, False) in rows_of(third.lines)
    # The open line is finished: the prefix did not end in a line feed, so the file is parsed as a whole. b goes, c is older than before.
    with open(root / "a.jsonl", "a") as f:
        f.write("}\n")
    stamp(root / "a.jsonl", 9)
    os.remove(root / "b.jsonl")
    write(root / "c.jsonl", ["{}", "{}", "{}", "{}"])
    stamp(root / "c.jsonl", 1)
    last = store.refresh([str(root)])
    assert (last.unchanged, last.resumed, last.parsed, last.gone) == (0, 0, 2, 1)
    assert rows_of(last.lines) == fresh(spark, root, tmp_path, 4)
    # Another format remembers nothing.
    assert LogStore(spark, str(tmp_path / "store"), version=3).refresh([str(root)]).parsed == 2
    assert LogStore(spark, str(tmp_path / "store"), parser="other").refresh([str(root)]).parsed == 2


def test_sources_over_a_store_give_the_same(spark, tmp_path):
    root = tmp_path / "logs"
    write(root / "projects" / "-home-u-demo" / "s1.jsonl", [{"type": "user", "timestamp": "2026-01-15T10:00:00Z", "cwd": "/home/u/demo"}, call("a", "r", 1, input_tokens=5, output_tokens=3)])
    stamp(root / "projects" / "-home-u-demo" / "s1.jsonl", 0)
    source = ClaudeLogs().over(LogStore(spark, str(tmp_path / "store")))
    see = lambda usage: (sorted(map(str, usage.entries.collect())), sorted(map(str, usage.events.collect())))
    assert see(source.read(spark, [str(root)])) == see(ClaudeLogs().read(spark, [str(root)]))
    with open(root / "projects" / "-home-u-demo" / "s1.jsonl", "a") as f:
        f.write(json.dumps(call("a", "r", 4, input_tokens=50, output_tokens=3)) + "\n" + json.dumps(call("b", "r", 5, input_tokens=1)) + "\n")
    after = see(source.read(spark, [str(root)]))
    assert after == see(ClaudeLogs().read(spark, [str(root)])) and len(after[0]) == 2


def test_a_source_that_fails_does_not_stop_the_others(spark, tmp_path):
    write(tmp_path / "c" / "projects" / "-x" / "s.jsonl", [call("a", "r", 1, input_tokens=5)])
    write(tmp_path / "p" / "s.jsonl", ["not json", "neither"])

    class Broken(CodexLogs):
        def read(self, spark, roots):
            usage = super().read(spark, roots)
            return type(usage)(usage.entries, usage.events.withColumn("seq", F.raise_error(F.lit("a broken file")).cast("bigint")))

    write(tmp_path / "x" / "s.jsonl", [{"type": "session_meta", "timestamp": "2026-01-15T10:00:00Z", "payload": {"id": "q"}}])
    usage, report = collect_all(spark, [(ClaudeLogs(), [str(tmp_path / "c")]), (PiLogs(), [str(tmp_path / "p")]), (Broken(), [str(tmp_path / "x")]), (CodexLogs(), [str(tmp_path / "none")])], str(tmp_path / "out"))
    assert usage.entries.count() == 1
    assert [(r.source, r.ok, r.files, r.entries) for r in report.collect()] == [("claude-code", True, 1, 1), ("pi", False, 1, 0), ("codex", False, 0, 0), ("codex", True, 0, 0)]


def test_sources_overlap_up_to_the_limit(spark, tmp_path):
    write(tmp_path / "c" / "projects" / "-x" / "s.jsonl", [call("a", "r", 1, input_tokens=5)])
    lock, inside, most = threading.Lock(), 0, []

    class Slow(ClaudeLogs):
        def __init__(self, name, both):
            self.name, self.both = name, both

        def read(self, spark, roots):
            nonlocal inside
            with lock:
                inside += 1
                most.append(inside)
            if self.both:
                self.both.wait(60)  # passes only once two are here
            try:
                if self.name == "s1":
                    raise ValueError("no such log")
                return super().read(spark, roots)
            finally:
                with lock:
                    inside -= 1

    for limit, both in ((2, threading.Barrier(2)), (1, None)):
        most.clear()
        usage, report = collect_all(spark, [(Slow(f"s{k}", both), [str(tmp_path / "c")]) for k in range(4)], str(tmp_path / f"out{limit}"), at_once=limit)
        assert [(r.source, r.ok, r.entries) for r in report.collect()] == [("s0", True, 1), ("s1", False, 0), ("s2", True, 1), ("s3", True, 1)]
        assert max(most) == limit and usage.entries.count() == 3


def test_roots_count_once(spark, tmp_path):
    (tmp_path / "a" / "in").mkdir(parents=True)
    (tmp_path / "link").symlink_to(tmp_path / "a")
    (tmp_path / "ab").mkdir()
    real = os.path.realpath(tmp_path)
    assert roots_of(spark, [str(tmp_path / d) for d in ("a", "link", "a/in", "ab", "none", "a/../a")]) == [f"file://{real}/a", f"file://{real}/ab"]


def test_versions(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "a bigint")
    assert table.read().count() == 0
    assert [table.write(spark.range(n).withColumnRenamed("id", "a")) for n in (1, 2, 3)] == [1, 2, 3]
    table.write(table.read().union(table.read()))
    assert table.read().count() == 6 and table.versions() == [3, 4]
    with pytest.raises(Exception, match="broken"):
        table.write(table.read().withColumn("a", F.raise_error(F.lit("broken")).cast("bigint")))
    assert table.read().count() == 6  # the version before stays in force
    assert table.write(spark.range(1).withColumnRenamed("id", "a")) == 5 and table.read().count() == 1


def test_prices_kept_and_imported(spark, tmp_path):
    (tmp_path / "raw.json").write_text('{"m": {"input_cost_per_token": 1e-6}, "n": {"output_cost_per_token": 2e-6}}')
    rows = imported_prices(spark, str(tmp_path / "raw.json"))
    keep_prices(rows, str(tmp_path / "kept"), "2026-01-01T00:00:00Z")
    back = read_prices(spark, str(tmp_path / "kept"), "cache").collect()
    assert sorted((r.key, r.input, r.output, r.layer, r.updated_at) for r in back) == [("m", 1e-6, 0.0, "cache", "2026-01-01T00:00:00Z"), ("n", 0.0, 2e-6, "cache", "2026-01-01T00:00:00Z")]
    assert model_count(rows).first().models == 2
    (tmp_path / "empty.json").write_text('{"models": {}}')
    with pytest.raises(ValueError, match="no prices"):
        imported_prices(spark, str(tmp_path / "empty.json"))


def test_normalisation(spark):
    rows = spark.createDataFrame([(" s ", "", "h" * 80, -1, 5, 6, 7, 8, 9, 10, None)], "source string, project string, session_hash string, duration_seconds bigint, active_seconds bigint, message_count bigint, user_message_count bigint, input bigint, output bigint, cache_read bigint, total bigint")
    assert tuple(normalized_sessions(rows).first()) == ("s", "unknown", "h" * 64, 0, 5, 6, 7, 8, 9, 10, 0)
    accounts = spark.createDataFrame([(" a ", "x" * 300, 2), ("a", "y", 1)], "account_hash string, label string, seq int")
    assert normalized_accounts(accounts).first().label == "x" * 200
    assert [r.label for r in first_of_each_account(normalized_accounts(accounts), "seq").collect()] == ["y"]


def test_since(spark):
    rows = spark.createDataFrame([("2026-01-02",), ("2026-01-02T03:00:00+01:00",), ("2026-01-02T03:00",), ("soon",), (None,)], "s string")
    got = [r.t for r in rows.select(since_time(F.col("s")).alias("t")).collect()]
    assert got == [dt.datetime(2026, 1, 2), dt.datetime(2026, 1, 2, 2), None, None, None]
    assert first_of_month(dt.date(2026, 3, 9), dt.date(2026, 3, 20)) == dt.date(2026, 3, 1)
    assert first_of_month(dt.date(2026, 5, 9), dt.date(2026, 3, 20)) == dt.date(2026, 3, 20)


def test_roots_of_a_home(spark, tmp_path):
    home = os.path.realpath(tmp_path)
    for d in (".claude/projects", ".claude-work/projects", ".claude-none", ".codex", "other/sessions", "set", ".pi/agent/sessions", "pi/sessions"):
        (tmp_path / d).mkdir(parents=True)
    roots = lambda source, settings=None, extra=(): [r.removeprefix(f"file://{home}/") for r in log_roots(spark, source, home, settings or {}, extra)]
    assert roots("claude-code") == [".claude", ".claude-work"] and roots("claude-code", {"CLAUDE_CONFIG_DIR": "~/set/"}) == [".claude", "set", ".claude-work"]
    assert roots("codex") == [".codex"] and roots("codex", {"CODEX_HOME": "~/set"}, (f"{home}/.codex",)) == ["set", ".codex"]
    assert roots("grok") == [] and roots("grok", {"GROK_HOME": f"{home}/other"}) == ["other/sessions"]
    assert roots("pi") == [".pi/agent/sessions"] and roots("pi", {"PI_CODING_AGENT_DIR": "~/pi"}) == ["pi/sessions"]
    assert roots("pi", {"PI_CODING_AGENT_DIR": "~/pi", "PI_CODING_AGENT_SESSION_DIR": "~/set"}) == ["set"]


def test_small_tables(spark):
    frame = lambda rows: spark.createDataFrame(rows, "account_hash string, session_id string")
    locked = control.locked_sessions(frame([("a", "1"), ("b", None)]), frame([("a", "1"), ("a", "2"), ("c", "3"), ("b", "4")]))
    assert sorted(map(tuple, locked.collect())) == [("a", "1"), ("a", "2"), ("b", "4")]
    assert control.still_pending(frame([("a", "1"), ("a", "2")]), frame([("a", "2")])).first().session_id == "2"
    names = spark.createDataFrame([(" x@y ", "z", "h" * 32), (" ", "z", "h" * 32), (None, "", "0123456789")], "a string, b string, c string")
    assert [r.n for r in names.select(control.account_name(F.col("a"), F.col("b"), F.col("c")).alias("n")).collect()] == ["x@y", "z", "01234567"]
    assert [r.n for r in spark.createDataFrame([(1800,), (10800,), (172800,)], "s bigint").select(views.bin_name(F.col("s")).alias("n")).collect()] == ["30 min", "3 h", "2 d"]
    groups = spark.createDataFrame([(f"k{n}", n) for n in range(20)], "key string, total bigint")
    assert [r.total for r in views.top_models(groups).collect()] == list(range(19, 9, -1))
    entries = spark.createDataFrame([("", "p"), ("own", "p"), (None, "q")], "session_id string, path string")
    assert [r.session_id for r in with_session(entries, F.col("path")).collect()] == ["p", "own", "q"]


def test_ranges_give_each_line_once(tmp_path):
    body = b"".join(b"x" * (k % 7) + b"\n" for k in range(60)) + b"\n\nlast"
    (tmp_path / "f").write_bytes(body)
    want, at = [], 0
    for line in body.split(b"\n"):
        want.append((at, line, at + len(line) < len(body)))
        at += len(line) + 1
    for step in (1, 2, 3, 7, 50, 1000):
        with open(tmp_path / "f", "rb") as f:
            got = [x for start in range(0, len(body), step) for x in lines_between(f, start, min(start + step, len(body)))]
        assert got == want, step


def test_a_large_file_is_read_in_ranges(spark, tmp_path):
    """Numbers of lines are those of one pass, whatever the ranges; a tail is read alone, and blank and broken lines count."""
    root = tmp_path / "logs"
    write(root / "a b%.jsonl", [f'{{"n": {k}}}' if k % 5 else ["", "broken"][k % 2] for k in range(400)])
    stamp(root / "a b%.jsonl", 0)
    store = LogStore(spark, str(tmp_path / "store"), range_bytes=100)
    first = store.refresh([str(root)])
    assert first.read == 400 and rows_of(first.lines) == fresh(spark, root, tmp_path, 1)
    assert {r.line_no for r in first.lines.collect()} == {k for k in range(400) if k % 10}
    with open(root / "a b%.jsonl", "a") as f:
        f.write('\n{"n": 401}\n')
    stamp(root / "a b%.jsonl", 5)
    second = store.refresh([str(root)])
    assert (second.resumed, second.read) == (1, 2) and rows_of(second.lines) == fresh(spark, root, tmp_path, 2)
    assert ("a b%.jsonl", 401, '{"n":401}', True) in rows_of(second.lines)


def test_a_rewritten_file_does_not_grow_the_store(spark, tmp_path):
    root, store = tmp_path / "logs", LogStore(spark, str(tmp_path / "store"), merge_after=3)
    write(root / "kept.jsonl", ['{"k": 1}'])
    stamp(root / "kept.jsonl", 0)
    for k in range(9):
        write(root / "a.jsonl", [f'{{"n": {k}}}'] * 3)
        stamp(root / "a.jsonl", k)
        now = store.refresh([str(root)])
        assert rows_of(now.lines) == [*[("a.jsonl", i, f'{{"n":{k}}}', True) for i in range(3)], ("kept.jsonl", 0, '{"k":1}', True)]
        assert len([f for f in os.listdir(tmp_path / "store" / "format-2-json" / "lines") if f.startswith("refresh")]) <= 4


def test_a_stream_of_grown_lines(spark, tmp_path):
    """An unfinished line waits, a restart reads nothing again, and a large file is read in ranges."""
    root = tmp_path / "logs"
    spark.dataSource.register(GrownLines)
    seen = []

    def step():
        rows = spark.readStream.format("grown_lines").option("root", str(root)).option("range", "20").load()
        query = rows.writeStream.foreachBatch(lambda batch, _: seen.append(sorted((r.path.rsplit("/", 1)[-1], r.at, r.line) for r in batch.collect()))).option("checkpointLocation", str(tmp_path / "check")).trigger(once=True).start()
        query.awaitTermination()

    write(root / "a.jsonl", [f"line {k}" for k in range(9)])
    write(root / "deep" / "b.jsonl", ["one", "tw"], end="")
    write(root / "c.txt", ["not a log"])
    step()
    assert seen[-1] == [*[("a.jsonl", 7 * k, f"line {k}") for k in range(9)], ("b.jsonl", 0, "one")]
    step()
    assert len(seen) == 1 or seen[-1] == []
    with open(root / "deep" / "b.jsonl", "a") as f:
        f.write("o\nthree\n")
    step()
    assert seen[-1] == [("b.jsonl", 4, "two"), ("b.jsonl", 8, "three")]
