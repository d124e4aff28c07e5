"""Rounds at the ticks of the clock: what is due, retries, requests, and queries that catch up."""

from __future__ import annotations

import threading

from meterlark.functions.times import next_tick
from meterlark.session import new_folder
from meterlark.streaming.delivery import Answer, Journal, Refused, deliver
from meterlark.streaming.runner import POLL, Result, Round, Runner, Schedule, Tier, caught_up, delivered

FIVE, THIRTY = 300, 1800


def schedule(*destinations, **options):
    return Schedule([Tier("logs", FIVE, ("codex", "pi")), Tier("accounts", THIRTY, ("cursor",))], list(destinations), **options)


class Clock:
    def __init__(self, now):
        self.now = now

    def __call__(self):
        return self.now


def fine(todo):
    return [Result(name, True) for name in todo.destinations]


def test_ticks_are_multiples_of_the_period():
    assert [next_tick(3800, FIVE), next_tick(3900, FIVE), next_tick(5399, THIRTY), next_tick(5400, THIRTY)] == [3900, 4200, 5400, 7200]
    tier = Tier("logs", FIVE, ())
    assert tier.due(3800)
    tier.settled(3800)
    assert not tier.due(3899.9) and tier.due(3900)


def test_a_retry_leaves_the_ticks_alone_and_never_passes_one():
    tier = Tier("logs", FIVE, (), last=3800)
    tier.failed(3810, jitter=4)
    assert (tier.last, tier.retry_at) == (3800, 3844)
    assert not tier.due(3843) and tier.due(3844)
    tier.failed(3844, jitter=99)
    assert tier.retry_at == 3900  # 3844 + 60 + 10 would be past the tick
    short = Tier("s", 10, (), last=3800)
    short.failed(3801, 0)
    assert short.retry_at == 3810
    hour = Tier("h", 3600 * 24, ())
    waits = []
    for _ in range(8):
        hour.failed(0, 0)
        waits.append(hour.retry_at)
    assert waits == [30, 60, 120, 240, 480, 960, 960, 960]
    hour.settled(100)
    assert (hour.last, hour.retry_at, hour.failures) == (100, None, 0)


def test_rounds_take_the_tiers_that_are_due():
    clock, rounds = Clock(3800), []
    runner = Runner(schedule("a"), lambda todo: rounds.append(todo) or fine(todo), clock)
    assert runner.step() == 100  # both at the start; the logs are due again at 3900
    clock.now = 3850
    assert runner.step() == 50 and len(rounds) == 1
    clock.now = 3900
    runner.step()
    clock.now = 5400
    runner.step()
    assert [r.sources for r in rounds] == [("codex", "pi", "cursor"), ("codex", "pi"), ("codex", "pi", "cursor")]


def test_requests_reach_blocked_destinations_and_all_sources():
    plan = schedule("a", "b", "c", blocked={"a"})
    plan.take(3800)
    for tier in plan.tiers:
        tier.settled(3800)
    plan.asked = [("b", True), ("a", False)]
    todo, tiers = plan.take(3810)
    assert todo == Round(("codex", "pi", "cursor"), {"a": False, "b": True}) and len(tiers) == 2
    plan.asked = [("b", True)]
    todo, _ = plan.take(3900)  # due as well: c goes along, a stays blocked
    assert todo.destinations == {"b": True, "c": False}
    plan.asked = [(None, False)]
    assert plan.take(3901)[0].destinations == {"a": False, "b": False, "c": False}


def test_failures_by_kind():
    clock, kinds = Clock(3800), {"a": None, "b": "retryable"}
    runner = Runner(schedule("a", "b"), lambda todo: [Result(n, kinds[n] is None, kinds[n], kinds[n]) for n in todo.destinations], clock, jitter=lambda: 0)
    assert runner.step() == 30 and runner.last_error == "b: retryable"
    clock.now, kinds["b"] = 3830, "fatal"
    assert runner.step() == 70  # waits for the tick
    clock.now, kinds["b"] = 3900, "auth"
    runner.step()
    assert runner.schedule.blocked == {"b"}
    clock.now, kinds["b"] = 4200, None
    runner.step()
    assert runner.schedule.blocked == {"b"} and runner.last_error is None  # not asked again by itself
    runner.ask("b")
    runner.step()
    assert runner.schedule.blocked == set()


def test_a_round_that_breaks_does_not_end_the_runner():
    clock, errors = Clock(3800), [ConnectionError("away"), ValueError("wrong"), None]

    def work(todo):
        error = errors.pop(0)
        if error:
            raise error
        return fine(todo)

    runner = Runner(schedule("a"), work, clock, jitter=lambda: 0)
    assert runner.step() == 30 and runner.last_error == "away"
    clock.now = 3830
    assert runner.step() == 70 and runner.last_error == "wrong"
    clock.now = 3900
    runner.step()
    assert runner.last_error is None and not errors


def test_nobody_to_send_to():
    clock = Clock(3800)
    runner = Runner(schedule(), fine, clock)
    assert runner.step() == 100 and runner.schedule.tiers[0].last == 3800
    runner = Runner(schedule("a", waiting={"a"}), fine, clock)
    assert runner.step() == POLL
    assert Schedule([], []).wait(0) == POLL


def test_requests_wake_the_loop():
    asked = threading.Event()

    def work(todo):
        if todo.destinations == {"a": True}:
            asked.set()
        return fine(todo)

    runner = Runner(schedule("a"), work, Clock(3800))
    runner.step()  # nothing is due before the next tick, which the clock never reaches
    loop = threading.Thread(target=runner.run)
    loop.start()
    runner.ask("a", full=True)
    assert asked.wait(30)
    runner.stop()
    loop.join(30)
    assert not loop.is_alive()


def test_queries_that_catch_up(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id bigint").parquet(str(tmp_path / "in"))

    def start(name, rows):
        return rows.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-at")).trigger(availableNow=True).start()

    broken = stream.selectExpr("id div (id - id) AS id") if spark.conf.get("spark.sql.ansi.enabled") == "true" else stream.selectExpr("raise_error('x') AS id")
    queries = [("broken", lambda: start("broken", broken)), ("good", lambda: start("good", stream)), ("none", lambda: 1 / 0)]
    assert [(r.name, r.ok) for r in sorted(caught_up(queries), key=lambda r: r.name)] == [("broken", False), ("good", True), ("none", False)]
    assert spark.read.parquet(str(tmp_path / "good")).count() == 5
    spark.range(3).write.mode("append").parquet(str(tmp_path / "in"))
    assert all(r.ok for r in caught_up(queries[1:2])) and spark.read.parquet(str(tmp_path / "good")).count() == 8


def test_rounds_of_delivery(spark):
    """A destination that is away for one round gets what it lacks at the retry, the other one nothing twice."""
    rows = spark.createDataFrame([("bucket", f"b{k}", "1", "codex", "") for k in range(3)], "kind string, key string, hash string, source string, body string")
    journal, got, away = Journal(spark, new_folder(spark, "journal")), {"a": [], "b": []}, [Refused(503)]

    def send(batch):
        if batch.destination == "b" and away:
            raise away[0]
        got[batch.destination] += [r.key for r in batch.buckets]
        return Answer(ingested=len(batch.buckets))

    clock = Clock(3800)
    runner = Runner(schedule("a", "b"), lambda todo: delivered(deliver(rows, journal, {n: send for n in todo.destinations}, wait=lambda s: None)), clock, jitter=lambda: 0)
    assert runner.step() == 30
    away.clear()
    clock.now = 3830
    assert runner.step() == 70
    assert {k: sorted(v) for k, v in got.items()} == {"a": ["b0", "b1", "b2"], "b": ["b0", "b1", "b2"]}
