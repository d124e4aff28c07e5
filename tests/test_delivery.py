"""Rounds of delivery: batches, acknowledgements, failures, and a driver that dies."""

from __future__ import annotations

import math

import pytest
from meterlark.operators.changes import sync_report
from meterlark.session import new_folder
from meterlark.store import Conflict
from meterlark.streaming import delivery
from meterlark.streaming.delivery import Answer, Journal, Refused, deliver, error_kind

SCHEMA = "kind string, key string, hash string, source string, body string"


def rows(spark, buckets=250, sessions=1200, version="1"):
    data = [("bucket", f"codex|b{k}", version, "codex" if k % 5 else "odd", f"{k}") for k in range(buckets)] + [("session", f"s{k}", version, "codex", "") for k in range(sessions)]
    return spark.createDataFrame(data, SCHEMA).repartition(4)


class Taker:
    """A destination that keeps what it is sent and fails as it is told: {number of the call: error}."""

    def __init__(self, errors=None, unknown=()):
        self.calls, self.batches, self.errors, self.unknown = 0, [], errors or {}, list(unknown)

    def __call__(self, batch):
        self.calls += 1
        if self.calls in self.errors:
            raise self.errors[self.calls]
        self.batches.append(batch)
        return Answer(ingested=len(batch.buckets), sessions=len(batch.sessions), unknown=self.unknown)

    def keys(self):
        return sorted(r.key for b in self.batches for r in [*b.buckets, *b.sessions])


def quietly(*args, **options):
    return {r.destination: r for r in deliver(*args, wait=lambda s: None, **options).collect()}


def test_batches_hold_buckets_and_sessions_and_snapshots_go_first(spark):
    taker, journal = Taker(), Journal(spark, new_folder(spark, "journal"))
    snapshots = spark.createDataFrame([("a", 1)], "account_hash string, cents int")
    report = quietly(rows(spark), journal, {"x y/z": taker}, snapshots=snapshots)["x y/z"]
    assert [(b.number, len(b.buckets), len(b.sessions), len(b.snapshots)) for b in taker.batches] == [(0, 100, 500, 1), (1, 100, 500, 0), (2, 50, 200, 0)]
    assert len(set(taker.keys())) == 1450 and (report.changed_buckets, report.changed_sessions, report.ok, report.ingested, report.sessions) == (250, 1200, True, 250, 1200)
    assert journal.state().count() == 1450
    # Nothing changed: an empty batch tells that the sender lives. A new content is sent alone; all of it if it is asked for.
    quietly(rows(spark), journal, {"x y/z": taker})
    assert (taker.batches[-1].number, taker.batches[-1].buckets, taker.batches[-1].sessions) == (0, [], [])
    taker.batches.clear()
    quietly(rows(spark, 1, 0, "2").unionByName(rows(spark, 3, 0)), journal, {"x y/z": taker}, full=())
    assert taker.keys() == ["codex|b0"]
    taker.batches.clear()
    quietly(rows(spark, 3, 0), journal, {"x y/z": taker}, full=("x y/z",))
    assert len(taker.keys()) == 3


def test_a_failure_at_batch_k_repeats_from_batch_k(spark):
    journal = Journal(spark, new_folder(spark, "journal"))
    takers = {"ok": Taker(), "auth": Taker({2: Refused(401)}), "bad": Taker({1: Refused(404)}), "slow": Taker({2: Refused(503), 3: ConnectionError("x")}), "down": Taker({k: TimeoutError() for k in range(1, 9)})}
    report = quietly(rows(spark, 250, 0), journal, takers)
    assert {k: (r.ok, r.error_kind, r.changed_buckets) for k, r in report.items()} == {"ok": (True, None, 250), "auth": (False, "auth", 100), "bad": (False, "fatal", 0), "slow": (True, None, 250), "down": (False, "retryable", 0)}
    assert {k: t.calls for k, t in takers.items()} == {"ok": 3, "auth": 2, "bad": 1, "slow": 5, "down": 3}
    again = {k: Taker() for k in takers}
    quietly(rows(spark, 250, 0), journal, again)
    assert {k: len(t.keys()) for k, t in again.items()} == {"ok": 0, "auth": 150, "bad": 250, "slow": 0, "down": 250}
    assert not set(again["auth"].keys()) & set(takers["auth"].keys())
    total = sync_report(deliver(rows(spark, 2, 0), journal, {"down": Taker({k: OSError("x") for k in range(9)})}, full=("down",))).first()
    assert (total.all_ok, total.retry) == (False, False)


def test_unknown_sources_stay_unsent(spark):
    journal, taker = Journal(spark, new_folder(spark, "journal")), Taker(unknown=["odd"])
    for _ in range(2):
        quietly(rows(spark, 50, 3), journal, {"d": taker})
    assert [(len(b.buckets), len(b.sessions)) for b in taker.batches] == [(50, 3), (10, 0)]


@pytest.mark.parametrize("dies_at", ["plan", "send", "acknowledge", "close"])
def test_a_driver_that_dies(spark, monkeypatch, dies_at):
    """What was answered and acknowledged is not sent again; the rest is."""

    class Dead(BaseException):
        pass

    journal, taker = Journal(spark, new_folder(spark, "journal")), Taker()
    with monkeypatch.context() as m:
        if dies_at == "send":
            taker.errors = {2: Dead()}
        elif dies_at == "acknowledge":
            real = Journal.acknowledge

            def acknowledge(self, number, name, batch, unknown):
                if batch == 1:
                    raise Dead
                real(self, number, name, batch, unknown)

            m.setattr(Journal, "acknowledge", acknowledge)
        else:
            m.setattr(Journal, dies_at, lambda *a: (_ for _ in ()).throw(Dead()))
        with pytest.raises(Dead):
            quietly(rows(spark, 250, 0), journal, {"d": taker})
    sent = {"plan": 0, "send": 100, "acknowledge": 200, "close": 250}[dies_at]
    assert len(taker.keys()) == sent
    later = Taker()
    quietly(rows(spark, 250, 0), Journal(spark, journal.root), {"d": later})
    assert len(later.keys()) == {"plan": 250, "send": 150, "acknowledge": 150, "close": 0}[dies_at]
    assert journal.state().count() == 250 and journal.open_rounds() == []


def test_rounds_are_merged(spark, monkeypatch):
    monkeypatch.setattr(delivery, "MERGE_AFTER", 3)
    journal = Journal(spark, new_folder(spark, "journal"))
    for k in range(5):
        quietly(rows(spark, 2, 1, str(k)), journal, {"d": Taker()})
        assert sorted((r.key, r.hash) for r in journal.state().collect()) == [("codex|b0", str(k)), ("codex|b1", str(k)), ("s0", str(k))]
    assert journal._complete("state", "base=") == [3]
    journal.replace(journal.state().where("kind = 'session'"))
    assert journal.state().count() == 1
    taker = Taker()
    quietly(rows(spark, 2, 1, "4"), journal, {"d": taker})
    assert taker.keys() == ["codex|b0", "codex|b1"] and journal.state().count() == 3


def test_the_facts_are_read_once_for_all_destinations(spark, tmp_path):
    path = str(tmp_path / "facts")
    rows(spark, 20, 20).write.parquet(path)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    journal, takers = Journal(spark, new_folder(spark, "journal")), {f"d{k}": Taker() for k in range(3)}
    quietly(spark.read.parquet(path).mapInArrow(counted, SCHEMA), journal, takers)
    assert seen.value == 40 and all(len(t.keys()) == 40 for t in takers.values())


def test_kinds_of_errors_and_records(spark):
    kinds = {401: "auth", 403: "auth", 408: "retryable", 429: "retryable", 500: "retryable", 503: "retryable", 400: "fatal", 404: "fatal", 413: "fatal"}
    assert {s: error_kind(Refused(s)) for s in kinds} == kinds and error_kind(ValueError()) == "fatal" and error_kind(TimeoutError()) == "retryable"
    journal = Journal(spark, new_folder(spark, "journal"))
    journal.acknowledge(1, "d", 0, [])
    with pytest.raises(Conflict):
        journal.acknowledge(1, "d", 0, [])
    waits = []
    deliver(rows(spark, 1, 0), Journal(spark, new_folder(spark, "journal")), {"d": Taker({1: TimeoutError(), 2: TimeoutError()})}, wait=waits.append)
    assert waits == [0.4, 0.8] and math.isclose(sum(waits), 1.2)


def test_tasks_send_in_lanes(spark, monkeypatch):
    """The first batches in order, the others in lanes: one file of records a lane, and a round after a failure sends what is missing alone."""
    monkeypatch.setattr(delivery, "BATCH_BUCKETS", 2)
    monkeypatch.setattr(delivery, "FIRST_BATCHES", 3)
    monkeypatch.setattr(delivery, "LANE_BATCHES", 10)

    def at(number):
        def send(batch):
            if batch.number == number:
                raise Refused(401)
            return Answer(ingested=len(batch.buckets), sessions=len(batch.sessions), unknown=["odd"])

        return send

    def down(batch):
        raise ConnectionError("no route")

    journal = Journal(spark, new_folder(spark, "journal"))
    report = quietly(rows(spark, 100, 7), journal, {"all": at(None), "x y/z": at(1), "late": at(5), "down": down}, on_executors=True)
    # Batches 3 to 49 go in the lanes 3, 13, 23, 33 and 43; batch 5 ends the first of these alone.
    assert {k: (r.ok, r.error_kind, r.changed_buckets, r.changed_sessions, r.ingested) for k, r in report.items()} == {"all": (True, None, 100, 7, 100), "x y/z": (False, "auth", 2, 7, 2), "late": (False, "auth", 84, 7, 84), "down": (False, "retryable", 0, 0, 0)}
    folders = delivery.names_in(spark, f"{journal.root}/rounds/1/acks")
    assert len(folders) == 6 + 1 + 6 and all(len(delivery.names_in(spark, f"{journal.root}/rounds/1/acks/{f}", "")) <= 2 for f in folders)
    again = quietly(rows(spark, 100, 7), journal, {k: at(None) for k in report}, on_executors=True)
    # The 20 of an unknown source stay unsent wherever they were taken.
    sent = {r.destination: r.n for r in journal.spark.read.schema(delivery.PLAN).parquet(f"{journal.root}/rounds/2/plan").selectExpr("destination", "size(rows) as n").groupBy("destination").agg({"n": "sum"}).toDF("destination", "n").collect()}
    assert sent == {k: again[k].changed_buckets + again[k].changed_sessions for k in again} and sent["all"] == 20 and sent["down"] == 107
    # Nothing to send: the sender is told to live, by a task as well.
    assert quietly(rows(spark, 0, 1), journal, {"all": down, "late": at(0)}, on_executors=True)["all"].error_kind == "retryable"


def test_a_lane_that_runs_again_skips_its_records(spark, tmp_path):
    seen = []

    def send(batch):
        seen.append(batch.number)
        return Answer(ingested=1)

    first = delivery._Lane(f"file:{tmp_path}/acks", "d", 0, send, 1, lambda s: None)
    for k in range(3):
        first.take(k, [], [])
    with open(next((tmp_path / "acks" / "d-from-0").iterdir()), "ab") as file:  # the task dies while it writes
        file.write(b'{"destination": "d", "ba')
    second = delivery._Lane(f"file:{tmp_path}/acks", "d", 0, send, 1, lambda s: None)
    for k in range(5):
        second.take(k, [], [])
    assert seen == [0, 1, 2, 3, 4] and second.close()[1] == 5
    journal = Journal(spark, str(tmp_path / "journal"))
    (tmp_path / "journal" / "rounds" / "1").mkdir(parents=True)
    (tmp_path / "acks").rename(tmp_path / "journal" / "rounds" / "1" / "acks")
    assert sorted(r.batch for r in journal.acknowledged(1).collect()) == [0, 1, 2, 3, 4]
