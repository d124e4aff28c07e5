"""Streams with state by key and timers: order, restarts, timers that fire alone, and keys with many rows."""

from __future__ import annotations

import datetime as dt
import itertools
import time

import pytest
from meterlark.plans.stream_queries import finished
from meterlark.session import new_folder
from meterlark.streaming.timed import _Requests, changed_stream, finished_joins, outcome, revocations
from pyspark.sql import functions as F

JOINS, SEEN, ROWS = "join_id string, kind string, at timestamp, token_hash string", "account_hash string, session_id string, at timestamp", "destination string, key string, hash string, seq bigint"
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


class Landing:
    def __init__(self, spark, schema):
        self.spark, self.schema, self.path = spark, schema, new_folder(spark, "landing")
        spark.createDataFrame([], schema).write.parquet(self.path)
        self.out, self.state = new_folder(spark, "out"), new_folder(spark, "state")

    def put(self, *rows):
        self.spark.createDataFrame(list(rows), self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(self.schema).parquet(self.path)

    def late(self):
        return self.stream().withWatermark("at", "10 seconds")

    def got(self, stream):
        return sorted((tuple(r) for r in finished(stream, self.out, self.state).collect()), key=repr)


def test_only_changes_are_sent_and_a_restart_goes_on(spark):
    land = Landing(spark, ROWS)
    state = spark.createDataFrame([("d", "kept", "1"), ("d", "old", "1"), ("e", "new", "1")], "destination string, key string, hash string")
    stream = lambda: changed_stream(land.stream(), state)
    land.put(("d", "kept", "1", 0), ("d", "old", "2", 0), ("d", "new", "1", 0), ("d", "twice", "b", 2), ("d", "twice", "c", 1), ("d", "twice", "z", None), ("d", None, "1", 0), ("e", "new", "1", 0))
    first = [("d", "new", "1"), ("d", "old", "2"), ("d", "twice", "b"), ("d", None, "1")]
    assert land.got(stream()) == first
    land.put(("d", "kept", "1", 1), ("d", "old", "1", 1), ("d", "new", "1", 1), ("d", "twice", "b", 3), ("d", None, "1", 1))
    assert land.got(stream()) == sorted([*first, ("d", "old", "1")], key=repr)
    assert land.got(stream()) == sorted([*first, ("d", "old", "1")], key=repr)


def test_a_null_hash_equals_nothing_and_an_empty_stream_sends_nothing(spark):
    land = Landing(spark, ROWS)
    assert land.got(changed_stream(land.stream())) == []
    land.put(("d", "k", None, 0))
    land.got(changed_stream(land.stream()))
    land.put(("d", "k", None, 1))
    assert land.got(changed_stream(land.stream())) == [("d", "k", None)] * 2


def test_a_batch_whose_sending_failed_comes_again(spark):
    land, sent, fail = Landing(spark, ROWS), [], [True]

    def send(batch, number):
        rows = [r.key for r in batch.collect()]
        if fail[0]:
            raise ConnectionError("down")
        sent.append(sorted(rows))

    def run():
        changed_stream(land.stream()).writeStream.foreachBatch(send).option("checkpointLocation", land.state).trigger(availableNow=True).start().awaitTermination()

    land.put(("d", "a", "1", 0), ("d", "b", "1", 0))
    with pytest.raises(Exception, match="down"):
        run()
    fail[0] = False
    run()
    land.put(("d", "a", "1", 1), ("d", "b", "2", 1))
    run()
    assert [s for s in sent if s] == [["a", "b"], ["b"]]


def test_outcomes():
    def says(*events):
        found = {outcome(set(order), 600_000) for order in itertools.permutations([(s * 1000, kind, token) for s, kind, token in events])}
        assert len(found) == 1
        return found.pop()

    assert says((0, "asked", None)) == ("expired", None)
    assert says((0, "asked", None), (5, "approved", "t")) == ("expired", "t")
    assert says((0, "asked", None), (5, "approved", "t"), (599, "claimed", None)) == ("claimed", None)
    assert says((0, "asked", None), (5, "approved", "t"), (600, "claimed", None)) == ("expired", "t")
    assert says((0, "asked", None), (600, "approved", "t")) == ("expired", None)
    assert says((0, "asked", None), (5, "denied", None), (6, "approved", "t"), (7, "claimed", None)) == ("denied", None)
    assert says((0, "asked", None), (4, "claimed", None), (5, "approved", "t")) == ("expired", "t")
    assert says((9, "approved", "t"), (10, "asked", None)) == ("expired", None)
    assert says((9, "approved", "t")) is None
    assert says((0, "asked", None), (5, "approved", "u"), (5, "approved", "t")) == ("expired", "t")


def test_joins_end_when_the_watermark_passes_whatever_the_order(spark):
    land = Landing(spark, JOINS)
    land.put(("a", "approved", at(5), "ta"), ("b", "asked", at(0), None), ("x", "other", at(1), None), (None, "asked", at(1), None), ("n", "asked", None, None), ("late", "approved", at(1), "t"))
    assert land.got(finished_joins(land.late(), by_clock=False)) == []
    # The watermark follows ten seconds behind: second 604 after this batch.
    land.put(("a", "asked", at(5), None), ("b", "denied", at(9), None), ("c", "asked", at(614), None), ("c", "approved", at(614), "tc"))
    assert land.got(finished_joins(land.late(), by_clock=False)) == [("b", "denied", None)]
    land.put(("c", "claimed", at(700), None), ("d", "asked", at(700), None), ("d", "asked", at(700), None))
    assert land.got(finished_joins(land.late(), by_clock=False)) == [("a", "expired", "ta"), ("b", "denied", None)]
    land.put(("z", "asked", at(9000), None))
    assert land.got(finished_joins(land.late(), by_clock=False)) == [("a", "expired", "ta"), ("b", "denied", None), ("c", "claimed", None), ("d", "expired", None)]


def test_a_request_runs_out_by_the_clock_without_a_new_row(spark):
    land, name = Landing(spark, JOINS), "joins_by_clock"
    land.put(("a", "asked", dt.datetime.now(dt.timezone.utc), None), ("a", "approved", dt.datetime.now(dt.timezone.utc) + dt.timedelta(seconds=1), "t"))
    running = finished_joins(land.stream(), seconds=15).writeStream.format("memory").queryName(name).option("checkpointLocation", land.state).start()
    try:
        began = time.time()
        while spark.table(name).isEmpty() and time.time() - began < 60:
            time.sleep(0.5)
        assert [tuple(r) for r in spark.table(name).collect()] == [("a", "expired", "t")]
    finally:
        running.stop()


def test_one_request_with_very_many_rows(spark):
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("j"), F.col("id") % 2000)).alias("join_id"), F.when(F.col("id") < 2500, "asked").otherwise("claimed").alias("kind"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.floor(F.col("id") / 4)).alias("at"), F.lit(None).cast("string").alias("token_hash"),
    )
    land = Landing(spark, JOINS)
    rows.coalesce(1).write.mode("append").parquet(land.path)
    land.put(("z", "asked", at(10**6), None))
    got = land.got(finished_joins(land.late(), by_clock=False))
    asked = {r.join_id for r in rows.where("kind = 'asked'").select("join_id").distinct().collect()}
    assert "hot" in asked and got == sorted(((j, "expired", None) for j in asked), key=repr)


def test_events_beyond_the_time_of_a_request_are_not_kept():
    events = {(0, "asked", None), (599_999, "claimed", None), (600_000, "claimed", None), (-1, "approved", "t")}
    assert _Requests(600)._needed(events) == events - {(600_000, "claimed", None)}
    assert _Requests(600)._needed({(9 * 10**9, "claimed", None), (0, "denied", None)}) == {(9 * 10**9, "claimed", None), (0, "denied", None)}


def test_sessions_are_asked_for_again_after_their_time(spark):
    land = Landing(spark, SEEN)
    stream = lambda: revocations(land.late(), by_clock=False).select("account_hash", "session_id", F.unix_seconds("asked_at") - int(START.timestamp()))
    land.put(("a", "s", at(700)), ("a", "s", at(0)), ("a", "s", at(599)), ("a", "s", at(600)), ("b", "s", at(700)), ("a", None, at(0)), (None, "s", at(0)), ("a", "s", None))
    assert land.got(stream()) == [("a", "s", 0), ("a", "s", 600), ("b", "s", 700)]
    land.put(("a", "s", at(1199)), ("b", "s", at(1300)), ("b", "s", at(1300)))
    assert land.got(stream()) == [("a", "s", 0), ("a", "s", 600), ("b", "s", 1300), ("b", "s", 700)]
    land.put(("a", "s", at(1400)), ("b", "s", at(1899)))
    assert land.got(stream()) == [("a", "s", 0), ("a", "s", 1400), ("a", "s", 600), ("b", "s", 1300), ("b", "s", 700)]


class _Counted:
    """A value of the state and the timers of one page, with the number of calls."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def listTimers(self):
        self.calls += 1
        return list(self.timers)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


def test_a_page_of_the_state_is_read_and_written_once_whatever_its_keys():
    from types import SimpleNamespace as Of

    from meterlark.streaming.timed import _Changed

    page, sent = _Counted(), _Changed()
    sent.init(page)
    rows = lambda text: [Of(key=f"k{k}", seq=0, hash=text if k % 2 else "same") for k in range(1000)]
    assert len(list(sent.handleInputRows(("d", 1), iter(rows("a")), None))) == 1000 and page.calls == 2
    assert {r.key for r in sent.handleInputRows(("d", 1), iter(rows("b")), None)} == {f"k{k}" for k in range(1, 1000, 2)} and page.calls == 4
    assert list(sent.handleInputRows(("d", 1), iter(rows("b")), None)) == [] and page.calls == 5

    page, asked = _Counted(), _Requests(600, by_clock=False)
    asked.init(page)
    list(asked.handleInputRows((1,), iter([Of(join_id=f"j{k}", at_ms=k * 1000, kind="asked", token_hash=None) for k in range(1000)]), None))
    assert page.calls == 4 and page.timers == {600_000}
    # The timer of the one that ends first ends all that are over, and the next one gets the timer.
    page.timers.clear()
    over = asked.handleExpiredTimer((1,), Of(getCurrentWatermarkInMs=lambda: 700_000), Of(getExpiryTimeInMs=lambda: 600_000))
    assert sorted(int(r.join_id[1:]) for r in over) == list(range(101)) and page.timers == {701_000}
    assert len(list(asked.handleExpiredTimer((1,), Of(getCurrentWatermarkInMs=lambda: 10**9), Of(getExpiryTimeInMs=lambda: 701_000)))) == 899 and page.value is None
