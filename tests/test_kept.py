"""The store of kept tables: versions, crashes, conflicts, and what a write touches."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from meterlark import store as kept_store
from meterlark.engine import Engine
from meterlark.operators import upserts
from meterlark.operators.pricing import prices_from_json
from meterlark.operators.scans import Filter, daily_rollups
from meterlark.plans.write_queries import empty_store
from meterlark.schema import UPLOAD
from meterlark.session import new_folder
from meterlark.store import Conflict, SnapshotStore
from pyspark.sql import functions as F

T0 = dt.datetime(2026, 1, 15, 10, 0)
TABLES = ("buckets", "rollups", "sessions", "hosts", "accounts")
ACCOUNT_HASH = "ab" * 16


def uploads(spark, *bodies):
    """Uploads of (host, buckets, sessions, accounts); a bucket is (source, day, minute, total, account), a session (hash, messages), an account (hash, cents)."""
    rows = []
    for k, (host, buckets, sessions, accounts) in enumerate(bodies):
        body = {
            "hostname": host.upper(),
            "buckets": [{"source": s, "model": "m", "project": "p", "bucket_start": d and f"2026-01-{d:02d}T10:{m:02d}:00", "input": n, "account_hash": a, "account_label": "me@x.test"} for s, d, m, n, a in buckets],
            "sessions": [{"source": "codex", "project": "p", "session_hash": h, "message_count": n, "first_at": "2026-01-15T10:00:00", "last_at": "2026-01-15T11:00:00"} for h, n in sessions],
            "accounts": [{"account_hash": h, "label": "l", "used_cents": c, "fetched_at": "2026-01-15T10:00:00"} for h, c in accounts],
        }
        rows.append((k, host, T0, json.dumps(body)))
    df = spark.createDataFrame(rows, "upload_id bigint, host_id string, received_at timestamp, body string")
    return df.select("upload_id", "host_id", "received_at", F.from_json("body", UPLOAD.simpleString()).alias("u")).select("upload_id", "host_id", "received_at", "u.*")


def first(spark):
    return uploads(spark, ("one", [("codex", 15, 0, 5, ""), ("codex", 16, 0, 7, ""), ("cursor", 15, 0, 9, ACCOUNT_HASH)], [("s1", 1), ("s2", 2)], [(ACCOUNT_HASH, 3)]))


def second(spark):
    return uploads(spark, ("two", [("codex", 15, 0, 1, ""), ("codex", 17, 0, 2, "")], [("s1", 9)], []), ("one", [("codex", 15, 0, 8, "")], [("s1", 4)], [(ACCOUNT_HASH, 6), ("no hash", 1)]))


def rows_of(snapshot):
    return {t: sorted(map(repr, map(tuple, snapshot.read(t).collect()))) for t in TABLES}


def test_versions_agree_with_the_lazy_tables(spark):
    store = SnapshotStore(spark, new_folder(spark, "kept"))
    lazy = empty_store(spark)
    for batch in (first(spark), second(spark), second(spark)):
        at, answer = store.ingest(batch)
        assert answer.first() == upserts.response(lazy.buckets, batch).first()
        lazy = upserts.ingest(lazy, batch)
        assert rows_of(at)["buckets"] == sorted(map(repr, map(tuple, lazy.buckets.collect())))
        assert rows_of(at)["rollups"] == sorted(map(repr, map(tuple, daily_rollups(lazy.buckets).select(*at.read("rollups").columns).collect())))
        for t in ("sessions", "hosts", "accounts"):
            assert rows_of(at)[t] == sorted(map(repr, map(tuple, getattr(lazy, t).collect()))), t
    assert store.versions() == [1, 2, 3] and rows_of(store.open(2)) == rows_of(store.open(3))


@pytest.mark.parametrize("step", [*range(1, 6), "manifest"])
def test_a_write_that_dies_changes_nothing(spark, step, monkeypatch):
    """After each of the five tables, and before the manifest is in force."""
    store = SnapshotStore(spark, new_folder(spark, "kept"))
    old = rows_of(store.ingest(first(spark))[0])
    whole = SnapshotStore(spark, new_folder(spark, "kept"))
    whole.ingest(first(spark))
    want = rows_of(whole.ingest(second(spark))[0])
    put, n = kept_store.Write.put, 0

    def dies(self, *args):
        nonlocal n
        n += 1
        out = put(self, *args)
        if n == step:
            raise OSError("the driver is gone")
        return out

    with monkeypatch.context() as m:
        m.setattr(kept_store.Write, "put", dies)
        if step == "manifest":
            m.setattr(SnapshotStore, "_create", lambda *a: (_ for _ in ()).throw(OSError("the driver is gone")))
        with pytest.raises(OSError):
            store.ingest(second(spark))
    assert store.versions() == [1] and rows_of(store.open()) == old
    assert rows_of(store.ingest(second(spark))[0]) == want
    gone = store.vacuum(keep=1, older_than=0)
    assert len(gone) == 1 and rows_of(store.open()) == want


def test_readers_keep_their_version_and_writers_conflict(spark):
    store = SnapshotStore(spark, new_folder(spark, "kept"))
    one, _ = store.ingest(first(spark))
    before = rows_of(one)
    late = store.begin()
    store.ingest(second(spark))
    assert rows_of(one) == before
    store.stage(late, second(spark))
    with pytest.raises(Conflict):
        store.commit(late)
    assert store.versions() == [1, 2]
    tried = []

    class Racing(SnapshotStore):
        def stage(self, write, batch):
            if not tried:  # another writer comes first
                tried.append(1)
                store.ingest(first(spark))
            return super().stage(write, batch)

    at, _ = Racing(spark, store.root).ingest(second(spark))
    assert at.version == 4 and rows_of(at)["buckets"] == rows_of(store.open(2))["buckets"]


def test_a_write_touches_its_days_alone(spark):
    store = SnapshotStore(spark, new_folder(spark, "kept"))
    one, _ = store.ingest(first(spark))
    two, _ = store.ingest(second(spark))
    for table in ("buckets", "rollups"):
        assert one.folders[table]["2026-01-16"] == two.folders[table]["2026-01-16"]
        assert one.folders[table]["2026-01-15"] != two.folders[table]["2026-01-15"]
        assert set(two.folders[table]) == {"2026-01-15", "2026-01-16", "2026-01-17"}
    day = two.days("buckets", dt.datetime(2026, 1, 17), dt.datetime(2026, 1, 18))
    assert all("part=2026-01-17" in f for f in day.inputFiles()) and day.count() == 1
    empty, answer = store.ingest(uploads(spark, ("one", [], [], [])))
    assert rows_of(empty)["buckets"] == rows_of(two)["buckets"] and answer.first().buckets == 0


def test_rows_without_a_place_are_dropped_and_counted(spark):
    store = SnapshotStore(spark, new_folder(spark, "kept"))
    batch = uploads(
        spark,
        ("m1", [("zzz", 15, 0, 1, ""), ("cursor", 15, 0, 2, "no hash"), ("cursor", 15, 0, 3, None), ("codex", None, 0, 4, ""), ("aaa", 15, 0, 5, "")], [], []),
        ("m1", [("zzz", 15, 0, 1, ""), ("cursor", 15, 0, 2, ACCOUNT_HASH), (None, 15, 0, 2, "")], [], []),
    )
    at, answer = store.ingest(batch)
    assert [(r.host_id, r.source, r.total) for r in at.read("buckets").collect()] == [(f"acct:{ACCOUNT_HASH}", "cursor", 2)]
    answer = answer.first()
    assert (answer.buckets, answer.dropped_buckets) == (1, 7)
    assert answer.unknown_sources[:2] == ["zzz", "aaa"]
    assert [r.source for r in upserts.unknown_sources(batch).orderBy("seq").collect()] == answer.unknown_sources


def test_an_engine_over_kept_tables(spark):
    store = SnapshotStore(spark, new_folder(spark, "kept"))
    prices = prices_from_json(spark.createDataFrame([('{"m": {"input_cost_per_token": 0.5}}',)], "value string"), "snapshot")
    engine = Engine.over(spark, store, prices)
    f = Filter(dt.datetime(2026, 1, 10, tzinfo=dt.timezone.utc), dt.datetime(2026, 1, 20, tzinfo=dt.timezone.utc))
    assert engine.summary(f).first().total == 0
    after, _ = engine.ingest(first(spark))
    assert (after.summary(f).first().total, after.summary(f).first().cost_usd, engine.summary(f).first().total) == (21, 10.5, 0)
    again, _ = after.ingest(second(spark))
    assert again.summary(f).first().total == 27 and engine.refreshed().summary(f).first().total == 27
    short = Filter(dt.datetime(2026, 1, 17, tzinfo=dt.timezone.utc), dt.datetime(2026, 1, 18, tzinfo=dt.timezone.utc))
    assert again.summary(short).first().total == 2
    archived = again.with_archived(ACCOUNT_HASH, dt.datetime(2026, 1, 20, tzinfo=dt.timezone.utc))
    assert archived.store.accounts.first().archived_at == dt.datetime(2026, 1, 20)
    tokens = spark.createDataFrame([("t", "two", "p", None, T0, T0)], "token_hash string, host_id string, prefix string, label string, created_at timestamp, revoked_at timestamp")
    left, kept = archived.without_host("two", tokens)
    assert left.summary(f).first().total == 24 and kept.count() == 0
