"""Rounds of work at the ticks of the clock.

Sources are collected in tiers, each with a period of its own; a tier is due at the multiples of its period (5 minutes: at :00, :05 and so on), and at once when
the runner starts. A round collects all sources of the tiers that are due and brings them to all destinations together. When a destination fails in a way
that may pass, the tiers of that round are tried again before their next tick, later each time; any other failure waits for the tick. A destination that does
not take its token is left out of due rounds until a round that was asked for reaches it.

The work itself is Spark's: streaming queries that end once they have caught up (``caught_up``), or a delivery (streaming.delivery.deliver). What was
done is remembered by their checkpoints and journals, so a runner that dies loses the times of its ticks and nothing else.
"""

from __future__ import annotations

import random
import threading
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql.streaming import StreamingQuery

from ..functions.times import next_tick
from .delivery import error_kind

FIRST_RETRY, MOST_DOUBLINGS, MOST_JITTER = 30, 5, 10
#: Seconds between looks while a destination has not let the sender in yet.
POLL = 2


@dataclass
class Tier:
    """Sources with one period. ``last`` is when they were last settled, ``retry_at`` when a failed round is tried again."""

    name: str
    period: int
    sources: tuple[str, ...]
    last: float | None = None
    retry_at: float | None = None
    failures: int = 0

    def next_at(self) -> float | None:
        """When it is due; None if it is now, as nothing was settled yet."""
        if self.retry_at is not None:
            return self.retry_at
        return None if self.last is None else next_tick(int(self.last), self.period)

    def due(self, now: float) -> bool:
        at = self.next_at()
        return at is None or now >= at

    def settled(self, now: float) -> None:
        self.last, self.retry_at, self.failures = now, None, 0

    def failed(self, now: float, jitter: float) -> None:
        """Tries again after 30 s, 60 s, ... up to 960 s, and ``jitter``; at the next tick at the latest. The clock of the ticks stays."""
        delay = FIRST_RETRY * 2 ** min(self.failures, MOST_DOUBLINGS) + min(jitter, MOST_JITTER)
        self.retry_at = now + min(delay, max(1.0, next_tick(int(now), self.period) - now))
        self.failures += 1


@dataclass(frozen=True)
class Round:
    """What one round does: which sources, and to which destinations, each with whether everything is sent anew."""

    sources: tuple[str, ...]
    destinations: dict[str, bool]


@dataclass(frozen=True)
class Result:
    """How it went for one destination or query; ``kind`` as streaming.delivery.error_kind() says it."""

    name: str
    ok: bool
    kind: str | None = None
    error: str | None = None


@dataclass
class Schedule:
    """Which round is next. Holds no clock: every question brings its time."""

    tiers: list[Tier]
    destinations: list[str]
    blocked: set[str] = field(default_factory=set)
    #: Destinations that have not let the sender in: they get nothing yet.
    waiting: set[str] = field(default_factory=set)
    asked: list[tuple[str | None, bool]] = field(default_factory=list)

    def take(self, now: float) -> tuple[Round | None, list[Tier]]:
        """The round to do now, if any, and the tiers that it settles. What was asked for is taken off.

        A request covers all sources, and the destinations that it names or all of them, blocked ones too; due tiers add the destinations that are not blocked.
        """
        asked, self.asked = self.asked, []
        tiers = list(self.tiers) if asked else [t for t in self.tiers if t.due(now)]
        scheduled = any(t.due(now) for t in tiers)
        chosen = {}
        for name in self.destinations:
            own = [full for wanted, full in asked if wanted in (None, name)]
            if name not in self.waiting and (own or (scheduled and name not in self.blocked)):
                chosen[name] = any(own)
        if not chosen:  # nobody to send to: wait for the next tick
            for tier in tiers:
                tier.settled(now)
            return None, []
        return Round(tuple(dict.fromkeys(s for t in tiers for s in t.sources)), chosen), tiers

    def settle(self, tiers: Iterable[Tier], results: Iterable[Result], now: float, jitter: float = 0.0) -> None:
        results = list(results)
        for r in results:
            if r.kind == "auth":
                self.blocked.add(r.name)
            elif r.ok:
                self.blocked.discard(r.name)
        again = any(not r.ok and r.kind == "retryable" for r in results)
        for tier in tiers:
            if again:
                tier.failed(now, jitter)
            else:
                tier.settled(now)

    def wait(self, now: float) -> float:
        """Seconds until there may be something to do; at least one."""
        left = [1.0 if t.next_at() is None else t.next_at() - now for t in self.tiers] + [float(POLL)] * bool(self.waiting)
        return max(1.0, min(left)) if left else float(POLL)


class Runner:
    """Does the rounds of a schedule, one at a time, until it is stopped. ``clock`` and ``jitter`` are for tests."""

    def __init__(self, schedule: Schedule, work: Callable[[Round], Iterable[Result]], clock: Callable[[], float] = time.time, jitter: Callable[[], float] = lambda: random.uniform(0, MOST_JITTER)):
        self.schedule, self.work, self.clock, self.jitter = schedule, work, clock, jitter
        self.last_error: str | None = None
        self._wake, self._stopped = threading.Condition(), False

    def ask(self, destination: str | None = None, full: bool = False) -> None:
        """Asks for a round now, to one destination or all of them."""
        with self._wake:
            self.schedule.asked.append((destination, full))
            self._wake.notify()

    def stop(self) -> None:
        """Ends run() after the round that it is doing."""
        with self._wake:
            self._stopped = True
            self._wake.notify()

    def step(self) -> float:
        """Does what is due and says how long to wait. Work that fails as a whole waits for the next tick, or is tried again if its error may pass."""
        with self._wake:
            todo, tiers = self.schedule.take(self.clock())
        if todo is not None:
            try:
                results = list(self.work(todo))
            except Exception as e:  # noqa: BLE001  a round that fails must not end the runner
                kind = error_kind(e)  # nobody in particular refused a token
                results = [Result("", False, "fatal" if kind == "auth" else kind, str(e).split("\n")[0])]
            with self._wake:
                self.last_error = "; ".join(f"{r.name}: {r.error}".removeprefix(": ") for r in results if not r.ok) or None
                self.schedule.settle(tiers, results, self.clock(), self.jitter())
        with self._wake:
            return self.schedule.wait(self.clock())

    def run(self) -> None:
        while True:
            left = self.step()
            with self._wake:
                if not self._stopped and not self.schedule.asked:
                    self._wake.wait(left)
                if self._stopped:
                    return


def caught_up(queries: Iterable[tuple[str, Callable[[], StreamingQuery]]]) -> list[Result]:
    """Starts queries that end by themselves (availableNow) together and waits for all; one that fails does not stop the others, and goes on from its checkpoint next time."""
    started, results = [], {}
    for name, start in queries:
        try:
            started.append((name, start()))
            results[name] = Result(name, True)
        except Exception as e:  # noqa: BLE001
            results[name] = Result(name, False, error_kind(e), str(e).split("\n")[0])
    for name, query in started:
        try:
            query.awaitTermination()
        except Exception as e:  # noqa: BLE001
            results[name] = Result(name, False, error_kind(e), str(e).split("\n")[0])
    return list(results.values())


def delivered(report) -> list[Result]:
    """The results of streaming.delivery.deliver(), a row per destination."""
    return [Result(r.destination, r.ok, r.error_kind, r.error) for r in report.select("destination", "ok", "error_kind", "error").collect()]
