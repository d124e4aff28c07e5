"""Logs built here, with the totals that each format's rules give."""

from __future__ import annotations

import json

import pytest
from meterlark.functions.text import host_id_of_token
from meterlark.operators.usage import usage_buckets, usage_sessions
from meterlark.sources.account_pages import account_of, account_snapshots
from meterlark.sources.base import read_all
from meterlark.sources.claude import ClaudeLogs
from meterlark.sources.codex import CodexLogs
from meterlark.sources.grok import GrokLogs
from meterlark.sources.pi import PiLogs
from meterlark.sources.usage_export import UsageExport
from pyspark.sql import functions as F


def write(path, lines, end="\n"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + end)


def totals(usage):
    r = usage.entries.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input", "output", "cache_read", "cache_creation", "reasoning")]).first()
    return tuple(r)


def call(mid, rid, minute, model="m-1", **usage):
    return {"type": "assistant", "timestamp": f"2026-01-15T10:{minute:02d}:00Z", "requestId": rid, "message": {"id": mid, "model": model, "usage": usage}}


def test_claude(spark, tmp_path):
    log = tmp_path / "projects" / "-home-u-demo" / "s1.jsonl"
    write(log, [
        {"type": "user", "timestamp": "2026-01-15T10:00:00Z", "cwd": "/home/u/demo"},
        call("a", "r", 1, input_tokens=5, output_tokens=3),
        call("a", "r", 2, input_tokens=10, output_tokens=30, cache_read_input_tokens=250, cache_creation_input_tokens=40, cache_creation={"ephemeral_5m_input_tokens": 60, "ephemeral_1h_input_tokens": 40}),
        call("b", "r", 3, model="<synthetic>", input_tokens="5", output_tokens=3.0),
        call("z", "r", 4, input_tokens=0),
        "not json", "",
        {"type": "user", "timestamp": "2026-01-15T10:05:00Z"},
    ])
    write(tmp_path / "projects" / "-old" / "s1.jsonl", [call("q", "q", 1, input_tokens=999)])  # a smaller copy of the session
    write(tmp_path / "transcripts" / "s1.jsonl", [{"type": "user", "timestamp": "2026-01-15T09:00:00Z"}])
    write(tmp_path / "transcripts" / "s2.jsonl", [{"type": "user", "timestamp": "2026-01-15T09:00:00Z"}, call("x", "x", 1, input_tokens=7)])
    got = ClaudeLogs().read(spark, [str(tmp_path)])
    assert totals(got) == (15, 33, 250, 100, 0)
    assert {(r.model, r.project) for r in got.entries.collect()} == {("m-1", "demo")}
    assert sorted((r.session_id, r.role) for r in got.events.collect()) == [("s1", "assistant")] * 4 + [("s1", "user")] * 2 + [("s2", "assistant"), ("s2", "user")]


def count(minute, last=None, total=None, **info):
    return {"type": "event_msg", "timestamp": f"2026-01-15T10:{minute:02d}:00Z", "payload": {"type": "token_count", "info": {**({"last_token_usage": last} if last is not None else {}), **({"total_token_usage": total} if total else {}), **info}}}


def tokens(i, o, c=0, r=0):
    return {"input_tokens": i, "output_tokens": o, "cached_input_tokens": c, "reasoning_output_tokens": r, "total_tokens": i + o}


def meta(sid, **more):
    return {"type": "session_meta", "timestamp": "2026-01-15T10:00:00Z", "payload": {"id": sid, "cwd": "/x/demo", **more}}


def test_codex(spark, tmp_path):
    write(tmp_path / "sessions" / "a.jsonl", [
        meta("A", git={"repository_url": "git@host.test:me/tool.git"}),
        {"type": "turn_context", "timestamp": "2026-01-15T10:00:01Z", "payload": {"model": "gpt-x"}},
        count(1, last=tokens(100, 20, 60, 5), total=tokens(100, 20, 60, 5)),
        count(2, last=tokens(100, 20, 60, 5), total=tokens(100, 20, 60, 5)),  # the same running total: a repeat
        count(3, total=tokens(180, 45, 100, 15)),  # a rise of 80, 25, 40, 10
        count(4, total=tokens(10, 5)),  # a reset
        {"type": "event_msg", "timestamp": "2026-01-15T10:05:00Z", "payload": {"type": "token_count", "info": {"last_token_usage": None, "total_token_usage": tokens(90, 50)}}},  # an explicit null is no rise
    ])
    write(tmp_path / "archived_sessions" / "fork.jsonl", [meta("B", forked_from_id="A"), count(1, last=tokens(7, 7))])
    write(tmp_path / "sessions" / "child.jsonl", [meta("C", source={"subagent": {}}), count(1, last=tokens(7, 7))])
    got = CodexLogs().read(spark, [str(tmp_path)])
    assert totals(got) == (40 + 40 + 10, 15 + 15 + 5, 60 + 40, 0, 5 + 10)
    assert {(r.model, r.project, r.session_id) for r in got.entries.collect()} == {("gpt-x", "tool", "A")}
    roles = sorted((r.session_id, r.role) for r in got.events.collect())
    assert roles == [("A", "assistant")] * 5 + [("A", "user")] * 2 + [("B", "assistant"), ("C", "assistant")]


def test_codex_against_a_direct_fold(spark, tmp_path):
    import random

    rng, want = random.Random(4), 0
    for k in range(30):
        total, before, seen, lines = None, None, None, [meta(f"S{k}")]
        for n in range(rng.randint(1, 15)):
            t = tokens(*(rng.randint(0, 30) for _ in range(4))) if total is None or rng.random() < 0.3 else {x: v + rng.randint(0, 9) * (rng.random() < 0.6) for x, v in total.items()}
            last = tokens(*(rng.randint(0, 9) for _ in range(4))) if rng.random() < 0.4 else None
            lines.append(count(n, last=last, total=t))
            parts = ("input_tokens", "output_tokens", "cached_input_tokens", "reasoning_output_tokens")
            use = last or (t if before is None or any(t[p] < before[p] for p in parts) else {p: t[p] - before[p] for p in parts})
            repeat = seen is not None and t["total_tokens"] > 0 and seen == t["total_tokens"]
            total, before, seen = t, t, t["total_tokens"]
            if not repeat:
                want += max(use["input_tokens"] - use["cached_input_tokens"], 0) + max(use["output_tokens"] - use["reasoning_output_tokens"], 0) + use["cached_input_tokens"] + use["reasoning_output_tokens"]
        write(tmp_path / "sessions" / f"{k}.jsonl", lines)
    assert sum(totals(CodexLogs().read(spark, [str(tmp_path)]))) == want


def turn(minute, kind, usage=None):
    return {"timestamp": f"2026-01-15T10:{minute:02d}:00Z", "params": {"update": {"sessionUpdate": kind, **({"usage": usage} if usage else {})}}}


def test_grok(spark, tmp_path):
    one = {"inputTokens": 700, "cachedReadTokens": 300, "outputTokens": 60, "reasoningTokens": 15, "cacheCreationTokens": 50}
    two = {"inputTokens": 300, "cachedReadTokens": 100, "outputTokens": 20, "reasoningTokens": 5, "cacheCreationTokens": 0}
    a = tmp_path / "%2Fhome%2Fu%2Fde+mo" / "g1"
    write(a / "summary.json", [{"current_model_id": "usual"}])
    write(a / "updates.jsonl", [turn(0, "user_message_chunk"), turn(1, "turn_completed", {"modelUsage": {"ma": one}}), turn(2, "turn_completed", two)])
    b = tmp_path / "%2Fx" / "g2"
    write(b / "summary.json", [{"session_kind": "subagent", "info": {"cwd": "/y/zed"}, "created_at": "2026-01-15T10:00:00Z", "last_active_at": 1768471200}])
    write(b / "updates.jsonl", [{"timestamp": "2026-01-15T10:00:00Z"}])
    c = tmp_path / "%2Fx" / "g3"
    write(c / "summary.json", [{}])
    write(c / "events.jsonl", [{"ts": 1768471200000, "type": "turn_started"}, {"timestamp": "2026-01-15T10:01:00Z", "type": "turn_ended"}])
    got = GrokLogs().read(spark, [str(tmp_path)])
    assert totals(got) == (600, 60, 400, 50, 20)
    assert {(r.model, r.project) for r in got.entries.collect()} == {("ma", "de+mo"), ("usual", "de+mo")}
    found = sorted((r.session_id, r.project, r.role) for r in got.events.collect())
    assert found == [("g1", "de+mo", "assistant")] * 2 + [("g1", "de+mo", "user"), ("g2", "zed", "assistant"), ("g2", "zed", "user"), ("g3", "x", "assistant"), ("g3", "x", "user")]


def message(mid, minute, role="assistant", usage=None, **more):
    return {"type": "message", "id": mid, "timestamp": f"2026-01-15T10:{minute:02d}:00Z", "message": {"role": role, **({"usage": usage} if usage else {}), **more}}


def test_pi(spark, tmp_path):
    head = {"type": "session", "version": 3, "id": "P", "cwd": "/h/demo"}
    write(tmp_path / "p.jsonl", [
        "", head, message("u", 0, "user"),
        message("a", 1, usage={"input": 10, "output": 5}, model="m", responseModel="m-real"),
        message("a", 2, usage={"input": 100, "output": 50, "cacheRead": 7, "cacheWrite": 3, "reasoning": 20}, responseModel="m-real"),
        message("b", 3, usage={"input": -5, "output": 5, "reasoning": 99}),
        message("c", 4, usage={"input": 9}, provider="cursor-agent"), message("d", 5, usage={"input": 9}, stopReason="pending"), message("e", 6, "system"),
        {"type": "compaction", "id": "k", "timestamp": "2026-01-15T10:07:00Z", "usage": {"input": 1}}, "broken {",
    ])
    with open(tmp_path / "p.jsonl", "a") as f:
        f.write(json.dumps(message("tail", 9, usage={"input": 1000})))  # its line has no end yet
    write(tmp_path / "fork.jsonl", [{**head, "id": "F", "parentSession": "P"}, message("u", 0, "user"), message("a", 1, usage={"input": 5})])
    write(tmp_path / "bad.jsonl", [message("u", 0, "user"), head])
    write(tmp_path / "new.jsonl", [{**head, "id": "N", "version": 4}, message("a", 1, usage={"input": 5})])
    got = PiLogs().read(spark, [str(tmp_path)])
    assert totals(got) == (101, 30, 7, 3, 25)
    assert {(r.model, r.input) for r in got.entries.collect()} == {("m-real", 100), ("unknown", 0), ("unknown", 1)}
    assert sorted((r.session_id, r.role) for r in got.events.collect()) == [("F", "assistant"), ("F", "user")] + [("P", "assistant")] * 4 + [("P", "user")]


def test_usage_export(spark, tmp_path):
    (tmp_path / "e.csv").write_text(
        "﻿Date,Kind,Model,Input (w/ Cache Write),Input (w/o Cache Write),Cache Read,Output Tokens,Cost\n"
        '"January 15, 2026, 10:00 AM",Included,"a,b",100,15,250,33,Included\n2026-01-15T11:00:00Z,Included,m,0,"1,080",0,20,$1.23\n2026-01-15,x,m,0,0,0,0,0\nnever,x,m,1,1,1,1,0\n2026-01-16,x,,1,1,1,1,0\n'
    )
    got = UsageExport().read(spark, [str(tmp_path)])
    assert totals(got) == (1095, 53, 250, 100, 0)
    assert UsageExport(zone="Asia/Tokyo").read(spark, [str(tmp_path)]).entries.where("model = 'a,b'").select(F.unix_seconds("at")).first()[0] == 1768438800
    (tmp_path / "e.csv").write_text("Kind,Model\nx,y\n")
    usage, errors = read_all(spark, [(UsageExport(), [str(tmp_path)]), (PiLogs(), [str(tmp_path / "missing")])])
    assert usage.entries.count() == 0 and set(errors) == {"cursor", "pi"}


def test_all_sources_give_buckets_and_sessions(spark, tmp_path):
    write(tmp_path / "c" / "projects" / "-demo" / "s1.jsonl", [{"type": "user", "timestamp": "2026-01-15T10:10:00Z"}, call("a", "r", 29, input_tokens=5), call("b", "r", 31, input_tokens=6)])
    write(tmp_path / "p" / "p.jsonl", [{"type": "session", "id": "P"}, message("a", 1, usage={"input": 4})])
    usage, errors = read_all(spark, [(ClaudeLogs(), [str(tmp_path / "c")]), (PiLogs(), [str(tmp_path / "p")])])
    assert not errors
    assert sorted((r.source, r.bucket_start.minute, r.total) for r in usage_buckets(usage.entries).collect()) == [("claude-code", 0, 5), ("claude-code", 30, 6), ("pi", 0, 4)]
    rows = {r.source: r for r in usage_sessions(usage.events, usage.entries).collect()}
    assert (rows["claude-code"].duration_seconds, rows["claude-code"].active_seconds, rows["claude-code"].message_count, rows["claude-code"].input) == (21 * 60, 120, 3, 11)
    assert (rows["pi"].active_seconds, rows["pi"].user_message_count) == (0, 0)


def test_account_pages(spark):
    plan = {"membershipType": " ", "membership_type": "pro", "billingCycleEnd": "2026-02-01T00:00:00Z", "autoModelSelectedDisplayMessage": "used 41.5% of it", "individualUsage": {"plan": {"used": 2000, "apiPercentUsed": 12.5, "breakdown": {"bonus": 300}}}}
    rows = spark.createDataFrame([("h", "me", json.dumps(plan), '{"usagePercent": 7}'), ("i", "you", "no json", None)], "account_hash string, label string, value string, bot_value string").withColumn("fetched_at", F.current_timestamp())
    a, b = account_snapshots(rows).orderBy("account_hash").collect()
    assert (a.membership, a.api_percent, a.auto_percent, a.bot_percent, a.used_cents, str(a.cycle_end)) == ("pro", 12.5, 41.5, 7.0, 2300, "2026-02-01 00:00:00")
    assert b.used_cents is None and b.membership is None


def test_token_claims(spark):
    import base64

    body = base64.urlsafe_b64encode(json.dumps({"sub": "auth|1", "email": "a@b.test", "exp": 1768471200}).encode()).decode().rstrip("=")
    row = spark.createDataFrame([(f"x.{body}.y",), ("nothing",)], "t string").select(account_of(F.col("t")).alias("a"), host_id_of_token(F.col("t")).alias("h")).collect()
    assert row[0].a.subject == "auth|1" and row[0].a.mail == "a@b.test" and row[1].a.subject is None and len(row[0].h) == 32


if __name__ == "__main__":
    pytest.main([__file__])


def _above_generate(rows, *names):
    """Which of the functions a plan works out above the step that makes rows of a list, so once for each row."""
    lines = rows._jdf.queryExecution().optimizedPlan().toString().split("\n")
    first = min(k for k, line in enumerate(lines) if "Generate" in line)
    return [n for n in names if any(n in line for line in lines[:first])]


def test_a_file_is_split_and_a_price_text_read_once_not_for_each_row(spark, tmp_path):
    from meterlark.operators.pricing import prices_from_json
    from meterlark.sources.base import raw_lines

    (tmp_path / "a.txt").write_text("x")
    texts = spark.read.text(str(tmp_path), wholetext=True)
    lines = raw_lines(texts.selectExpr("'p' as path", "value as text"))
    assert _above_generate(lines, "split(", "size(") == []
    book = prices_from_json(texts, "cache")
    assert _above_generate(book, "MapType") == []


def test_a_line_is_parsed_once_whatever_is_asked_of_it(spark, tmp_path):
    from meterlark.sources.base import parsed_lines, raw_lines, text_at

    (tmp_path / "a.txt").write_text("x")
    lines = parsed_lines(raw_lines(spark.read.text(str(tmp_path), wholetext=True).selectExpr("'p' as path", "value as text")))
    asked = lines.where(text_at("doc", "$.type").isin("a", "b") & text_at("doc", "$.id").isNotNull())
    assert asked._jdf.queryExecution().optimizedPlan().toString().count("parseJson") <= 1
