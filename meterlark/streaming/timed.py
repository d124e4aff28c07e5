"""State by key with timers: content that changed since it was last sent, join requests that run out, and login sessions asked for again.

The state lives in Spark's state store, split by key and kept in the query's checkpoint, so a restart or a lost executor goes on from the last finished
micro-batch. Rows of a key may come in any order within a micro-batch. With ``by_clock`` timers follow the clock of the machines, and fire without any new row;
without it they follow the watermark, which ``rows`` must then have on ``at``; what is not after the watermark when it comes
is dropped by Spark, and results depend on the rows alone. Instants count by the millisecond.
What is kept for a key is one value, or the distinct events of one request within its time; both go when their timer fires.

Each reading or writing of the state is a call from Python to the JVM, so contents and requests are kept in PAGES pages by a hash of their key: a micro-batch reads and writes a page once,
whatever the number of its keys. A checkpoint belongs to one number of pages, and those from before there were pages are not read.

These streams need the RocksDB provider of the state store, which ``keep_state`` sets for the session.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.control import JOIN_SECONDS

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT = "join_id:string,at_ms:bigint,kind:string,token_hash:string"
#: Events of one request in memory before those beyond its time are dropped.
PRUNE_AT = 10_000
#: Pages of a stream's state; they bound its calls for a micro-batch.
PAGES = 4096


def keep_state(spark: SparkSession) -> None:
    if spark.conf.get(PROVIDER, None) != ROCKS:
        spark.conf.set(PROVIDER, ROCKS)


def _timed(rows: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, by_clock: bool) -> DataFrame:
    keep_state(rows.sparkSession)
    return rows.groupBy(*keys).transformWithState(processor, schema, "append", "ProcessingTime" if by_clock else "EventTime")


def page_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PAGES)).alias("page")


class _Changed(StatefulProcessor):
    def init(self, handle) -> None:
        self.sent = handle.getValueState("sent", "keys array<string>, hashes array<string>")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.sent.update((list(initialState["keys"]), list(initialState["hashes"])))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last: dict = {}
        for r in rows:
            new = (r.seq is not None, r.seq or 0, r.hash or ""), r.hash
            if r.key not in last or new[0] > last[r.key][0]:
                last[r.key] = new
        page = self.sent.get()
        held = dict(zip(page[0], page[1])) if page is not None else {}
        changed = {k: h for k, (_, h) in last.items() if held.get(k) is None or held[k] != h}
        if changed:
            held.update(changed)
            self.sent.update((list(held), list(held.values())))
        for k, h in changed.items():
            yield Row(destination=key[0], key=k, hash=h)

    def close(self) -> None:
        pass


def changed_stream(rows: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """(destination, key, hash) of a stream (destination, key, hash, seq) whenever a key's content is not what was last emitted for it at that destination.

    ``state`` (destination, key, hash), one row a key, is what was sent before the stream's first start. Of several rows of a key in a micro-batch that with
    the greatest ``seq`` counts, then the greatest hash; a null ``seq`` is least. A null hash never equals another. The sink must be idempotent: a micro-batch whose
    sending failed comes again with the state before it.
    """
    keep_state(rows.sparkSession)
    keys = ["destination", "key"]
    # A page of what was sent is one row, as it is one value of the state.
    begun = None
    if state is not None:
        pages = state.groupBy("destination", page_of("key")).agg(F.collect_list(F.struct("key", "hash")).alias("sent"))
        begun = pages.select("destination", "page", F.col("sent.key").alias("keys"), F.col("sent.hash").alias("hashes")).groupBy("destination", "page")
    return rows.select(*keys, "hash", "seq", page_of("key")).groupBy("destination", "page").transformWithState(_Changed(), "destination string, key string, hash string", "append", "None", begun)


def outcome(events: set, span_ms: int) -> tuple[str, str | None] | None:
    """(status, token to revoke) of a request from its (at_ms, kind, token_hash): the first decision in time, then the first claim in time of an approved one. None if nobody asked."""
    order = sorted(events, key=lambda e: (e[0], e[1], e[2] or ""))
    asked = next((e[0] for e in order if e[1] == "asked"), None)
    if asked is None:
        return None
    live = [e for e in order if asked <= e[0] < asked + span_ms]
    decided = next((e for e in live if e[1] in ("approved", "denied")), None)
    if decided is None:
        return "expired", None
    if decided[1] == "denied":
        return "denied", None
    return ("claimed", None) if any(e[1] == "claimed" and e[0] >= decided[0] for e in live) else ("expired", decided[2])


class _Requests(StatefulProcessor):
    def __init__(self, seconds: int, by_clock: bool = True):
        self.span, self.by_clock = seconds * 1000, by_clock

    def init(self, handle) -> None:
        self.handle = handle
        self.events = handle.getValueState("events", f"events array<struct<{EVENT}>>")

    def _begun(self, events: set) -> int:
        return min((e[0] for e in events if e[1] == "asked"), default=min(e[0] for e in events))

    def _needed(self, events: set) -> set:
        if not any(e[1] == "asked" for e in events):
            return events
        end = self._begun(events) + self.span
        return {e for e in events if e[0] < end}

    def _held(self) -> dict[str, set]:
        held: dict[str, set] = {}
        for e in (self.events.get() or ((),))[0]:
            held.setdefault(e[0], set()).add((e[1], e[2], e[3]))
        return held

    def _keep(self, held: dict[str, set]) -> None:
        """Puts a page's requests in the state, with a timer for the one that ends first."""
        if not held:
            return self.events.clear()
        self.events.update(([(name, *e) for name, events in held.items() for e in sorted(events, key=lambda e: (e[0], e[1], e[2] or ""))],))
        first = min(self._begun(events) for events in held.values()) + self.span
        old = list(self.handle.listTimers())
        for other in old:
            if other != first:
                self.handle.deleteTimer(other)
        if first not in old:
            self.handle.registerTimer(first)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held, at = self._held(), {}
        for r in rows:
            events = held.setdefault(r.join_id, set())
            events.add((r.at_ms, r.kind, r.token_hash))
            if len(events) > at.setdefault(r.join_id, PRUNE_AT):
                held[r.join_id] = self._needed(events)
                at[r.join_id] = len(held[r.join_id]) + PRUNE_AT
        for name in at:
            held[name] = self._needed(held[name])
        self._keep(held)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs() if self.by_clock else timerValues.getCurrentWatermarkInMs()
        now, held, over = max(now, expiredTimerInfo.getExpiryTimeInMs()), self._held(), []
        for name in [n for n, events in held.items() if self._begun(events) + self.span <= now]:
            found = outcome(held.pop(name), self.span)
            if found is not None:
                over.append(Row(join_id=name, status=found[0], revoke_token=found[1]))
        self._keep(held)
        return iter(over)

    def close(self) -> None:
        pass


def finished_joins(rows: DataFrame, seconds: int = JOIN_SECONDS, by_clock: bool = True) -> DataFrame:
    """(join_id, status, revoke_token), one row a request when its ``seconds`` are over, from a stream (join_id, kind, at, token_hash) with kinds asked, approved, denied and claimed.

    A request begins when it is first asked for. ``claimed``: approved, and claimed at or after that; ``denied``: denied before it was approved; else ``expired``, with the token
    of one that was approved in vain, to be revoked. What comes before the asking or after the end changes nothing; at one instant kinds count in the order of their names, then
    the least token. Rows without id, kind or instant, and requests that nobody asked for, are dropped.
    """
    kept = rows.where("join_id is not null and kind in ('asked', 'approved', 'denied', 'claimed') and at is not null")
    kept = kept.select("join_id", "kind", "at", F.unix_millis("at").alias("at_ms"), "token_hash", page_of("join_id"))
    return _timed(kept, ["page"], _Requests(seconds, by_clock), "join_id string, status string, revoke_token string", by_clock)


class _Asked(StatefulProcessor):
    def __init__(self, seconds: int):
        self.span = seconds * 1000

    def init(self, handle) -> None:
        self.handle = handle
        self.asked = handle.getValueState("asked", "at_ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.asked.get()
        last = now = before[0] if before is not None else None
        for at in sorted({r.at_ms for r in rows}):
            if now is None or at >= now + self.span:
                now = at
                yield Row(account_hash=key[0], session_id=key[1], asked_ms=at)
        if now != last:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.asked.update((now,))
            self.handle.registerTimer(now + self.span)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.asked.clear()
        return iter(())

    def close(self) -> None:
        pass


def revocations(sightings: DataFrame, seconds: int = JOIN_SECONDS, by_clock: bool = True) -> DataFrame:
    """(account_hash, session_id, asked_at): which login sessions to revoke, from a stream (account_hash, session_id, at) of those seen live that may not be.

    A session is asked for when it is seen and was not asked for within ``seconds`` before. A sighting older than the last asking changes nothing. Rows without
    account, session or instant are dropped. A micro-batch's sightings of one session are held as their distinct milliseconds.
    """
    kept = sightings.where("account_hash is not null and session_id is not null and at is not null")
    kept = kept.select("account_hash", "session_id", "at", F.unix_millis("at").alias("at_ms"))
    asked = _timed(kept, ["account_hash", "session_id"], _Asked(seconds), "account_hash string, session_id string, asked_ms bigint", by_clock)
    return asked.select("account_hash", "session_id", F.timestamp_millis("asked_ms").alias("asked_at"))
