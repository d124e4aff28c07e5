"""Upserts, uploads, changes, control tables, pages and streams."""

from __future__ import annotations

import datetime as dt
import itertools
import json
import random

import pytest
from meterlark.engine import Engine
from meterlark.functions import times
from meterlark.functions.numbers import text_count, variant_count
from meterlark.functions.text import session_type_code, utc_offset
from meterlark.operators import changes, control, upserts, views
from meterlark.operators.pricing import layered_prices, price_index, priced, priced_rows, prices_from_json, resolved_prices, with_price
from meterlark.operators.scans import Filter, daily_rollups, scan_days
from meterlark.operators.upserts import Store
from meterlark.plans import catalog
from meterlark.plans.write_queries import empty_store
from meterlark.schema import ACCOUNT, BUCKET, HOST, JOIN_REQUEST, TOKEN, UPLOAD
from meterlark.session import new_folder
from meterlark.streaming.tables import BucketTable, keep_uploads, upload_stream, windowed_usage
from oracle import SF
from pyspark.sql import functions as F

T0 = dt.datetime(2026, 1, 15, 10, 0)
NAMES = [f.name for f in BUCKET.fields]


def bucket(host="h", minute=0, total=1, model="m", source="codex", project="p", day=15):
    at = dt.datetime(2026, 1, day, 10, minute)
    return (host, source, model, project, at, total, 0, 0, 0, 0, total)


def frame(spark, rows, seq=True):
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "host_id string, source string, model string, project string, bucket_start timestamp, input bigint, output bigint, cache_read bigint, cache_creation bigint, reasoning bigint, total bigint, seq bigint")
    return df if seq else df.drop("seq")


def state_of(df):
    return sorted(tuple(r) for r in df.select(*NAMES).collect())


def test_any_order_of_different_snapshots_gives_one_state(spark):
    rows = [bucket(total=n) for n in (3, 9, 5)]
    empty = spark.createDataFrame([], BUCKET)
    for order in itertools.permutations(rows):
        assert state_of(upserts.upsert_buckets(empty, frame(spark, order))) == [bucket(total=9)]
    once = upserts.upsert_buckets(empty, frame(spark, rows))
    assert state_of(upserts.upsert_buckets(once, frame(spark, rows))) == state_of(once)


def upload(spark, *uploads):
    """Uploads of (host, buckets, label); each bucket is (source, minute, total, account)."""
    rows = []
    for k, (host, buckets, label) in enumerate(uploads):
        cells = [{"source": s, "model": " ", "project": "\tp ", "bucket_start": f"2026-01-15T10:{m:02d}:09", "account_hash": a, "account_label": label, "input": n, "output": -5} for s, m, n, a in buckets]
        rows.append((k, host, T0, json.dumps({"hostname": host.upper(), "agent_version": "1" if k == 0 else None, "buckets": cells})))
    df = spark.createDataFrame(rows, "upload_id bigint, host_id string, received_at timestamp, body string")
    parsed = df.select("upload_id", "host_id", "received_at", F.from_json("body", UPLOAD.simpleString()).alias("u")).select("upload_id", "host_id", "received_at", "u.*")
    return parsed.withColumns({c: F.coalesce(c, F.array().cast(UPLOAD[c].dataType)) for c in ("sessions", "accounts")})


def test_uploads(spark):
    acct = "ab" * 16
    ups = upload(spark, ("one", [("codex", 0, 5, ""), ("codex", 29, 3, ""), ("cursor", 0, 7, acct), ("odd", 0, 9, "")], "me"), ("two", [("cursor", 0, 7, acct), ("codex", 31, 1, "")], "me@x.test"), ("one", [("codex", 0, 2, "")], ""))
    store = empty_store(spark)
    after = upserts.ingest(store, ups)
    got = {(r.host_id, r.source, r.bucket_start.minute): (r.input, r.output, r.total, r.model, r.project) for r in after.buckets.collect()}
    assert got == {("one", "codex", 0): (5, 0, 5, "unknown", "p"), ("two", "codex", 30): (1, 0, 1, "unknown", "p"), (f"acct:{acct}", "cursor", 0): (7, 0, 7, "unknown", "p")}
    assert {(r.host_id, r.hostname, r.agent_version) for r in after.hosts.collect()} == {("one", "ONE", "1"), ("two", "TWO", None), (f"acct:{acct}", "me@x.test", None)}
    answer = upserts.response(store.buckets, ups).first()
    assert (answer.buckets, answer.protected, answer.dropped_buckets, answer.unknown_sources) == (4, 2, 1, ["odd"])
    again = upserts.ingest(after, ups)
    assert state_of(again.buckets) == state_of(after.buckets)


def test_accounts(spark):
    def row(h, label, cents, hour, archived=None):
        return (h, label, "pro", 1.0, 2.0, None, cents, None, None, T0 + dt.timedelta(hours=hour), archived)

    stored = spark.createDataFrame([row("a", "old", 1, 0, T0), row("b", "old", 1, 5, T0)], ACCOUNT)
    batch = spark.createDataFrame([(*row("a", "new", 2, 1), 0), (*row("a", "tie", 3, 1), 1), (*row("b", "late", 9, 1), 2)], ACCOUNT.simpleString().removesuffix(">") + ",seq:bigint>")
    got = {r.account_hash: (r.label, r.used_cents, r.archived_at) for r in upserts.upsert_accounts(stored, batch).collect()}
    assert got == {"a": ("tie", 3, T0), "b": ("old", 1, T0)}
    used = frame(spark, [bucket(host="acct:a", minute=30, source="cursor"), bucket(host="acct:b", source="cursor")], seq=False)
    assert {r.account_hash: r.archived_at for r in upserts.unarchived(stored, used).collect()} == {"a": None, "b": T0}
    shown = control.listed_accounts(stored, (T0 + dt.timedelta(days=7, hours=2)).replace(tzinfo=dt.timezone.utc)).collect()
    assert [(r.account_hash, r.stale) for r in shown] == [("a", True), ("b", False)]


def test_whole_days_and_edges_add_up(spark):
    rows = [(*bucket(host=f"h{k % 3}", minute=k % 60, total=k, day=1 + k % 28)[:4], dt.datetime(2026, 1, 1 + k % 28, k % 24, k % 2 * 30), k, 0, 0, 0, 0, k) for k in range(400)]
    facts = frame(spark, rows, seq=False).cache()
    rollups = daily_rollups(facts)
    for a, b in (((3, 0, 0), (20, 0, 0)), ((3, 12, 17), (20, 0, 0)), ((3, 0, 0), (20, 9, 47)), ((3, 12, 17), (20, 9, 47)), ((3, 1, 0), (5, 1, 0)), ((3, 1, 0), (5, 1, 1)), ((3, 1, 0), (3, 2, 0))):
        f = Filter(*[dt.datetime(2026, 1, d, h, m, tzinfo=dt.timezone.utc) for d, h, m in (a, b)])
        total = lambda df: df.agg(F.sum("total")).first()[0]
        assert total(scan_days(facts, rollups, f)) == total(scan_days(facts, None, f))
    plan = scan_days(facts, rollups, f)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan


def test_series_grid():
    at = lambda d: dt.datetime(2026, 3, 1, tzinfo=dt.timezone.utc) - dt.timedelta(days=d)
    assert [times.series_grid(at(d), at(0))[2] for d in (1, 7, 30, 90)] == [48, 336, 720, 720]
    assert times.series_grid(at(0), at(0))[2] == 0
    for days, minutes, shift in itertools.product((1, 3, 100, 700, 3000), (0, 1, 29, 31), (0, 7)):
        start = at(days) + dt.timedelta(minutes=shift)
        step, first, n = times.series_grid(start, at(0) + dt.timedelta(minutes=minutes))
        assert 0 < n <= 1024 and first % step == 0 and first <= start.timestamp() < first + step


def test_prices(spark):
    raw = {"azure/gpt-q": {"input_cost_per_token": 1.0, "cache_read_input_token_cost": 0.5}, "gpt-q": {"output_cost_per_token": 2.0, "input_cost_per_token_cache_hit": 0.25}, "none": {"max_tokens": 5}, "text": "x"}
    docs = lambda x: spark.createDataFrame([(json.dumps(x),)], "value string")
    rows = prices_from_json(docs(raw), "snapshot")
    assert {r.key: (r.input, r.output, r.cache_read) for r in rows.collect()} == {"azure/gpt-q": (1.0, 0.0, 0.5), "gpt-q": (0.0, 2.0, 0.25)}
    assert price_index(layered_prices(rows)).first().price.output == 2.0  # the plain key wins
    condensed = lambda v, at: {"updated_at": at, "models": {"m": {"input": v, "output": v}}}

    def price(cache_at, *more):
        layers = prices_from_json(docs(condensed(1.0, "2026-01-02")), "snapshot").unionByName(prices_from_json(docs(condensed(2.0, cache_at)), "cache")).unionByName(prices_from_json(docs(condensed(9.0, None)), "gap"))
        for m in more:
            layers = layers.unionByName(prices_from_json(docs(condensed(m, None)), "override"))
        return layered_prices(layers).first().input

    assert [price("2026-01-01"), price("2026-01-02"), price(None), price("2026-01-01", 5.0)] == [1.0, 2.0, 2.0, 5.0]
    assert prices_from_json(spark.createDataFrame([("no json",), ("{}",)], "value string"), "cache").count() == 0
    assert resolved_prices(spark.createDataFrame([(None,), ("",)], "model string"), price_index(layered_prices(rows))).where("price is not null").count() == 0


def test_names_resolve_alike_by_map_and_by_join(spark):
    rng = random.Random(4)
    keys = {"".join(rng.choice(["gpt", "-", "a", "5", "x/", "openai/", "composer-2", "-fast", "-build"]) for _ in range(rng.randint(1, 4))) for _ in range(300)}
    book = spark.createDataFrame([(k, float(n), None, None, None, None) for n, k in enumerate(sorted(keys))], "key string, input double, output double, cache_read double, cache_write double, reasoning double")
    index = price_index(book)
    names = {"".join(rng.choice(["gpt", "-", "a", "5", "X/", "openai/", "composer-2", "-high", "-fast", "-build", "q"]) for _ in range(rng.randint(0, 5))) for _ in range(400)}
    models = spark.createDataFrame([(n,) for n in sorted(names)] + [(None,), ("",), ("é",)], "model string")
    by_map = {r.model: r.price and r.price.input for r in with_price(models.where("model is not null"), index, "model").collect()}
    by_join = {r.model: r.price and r.price.input for r in resolved_prices(models, index).collect()}
    assert by_join == by_map and len({v for v in by_join.values()}) > 30
    rows = models.withColumnRenamed("model", "billed_model").withColumns({c: F.lit(2) for c in ("input", "output", "cache_read", "cache_creation", "reasoning")})
    assert sorted(map(str, priced_rows(rows, index).select("billed_model", "cost").collect())) == sorted(map(str, priced(rows, index).select("billed_model", "cost").collect()))


def test_a_large_book_is_joined_and_refused_as_a_map(spark):
    book = spark.range(30_000).select(F.concat(F.lit("m"), "id").alias("slug"), F.struct(F.col("id").cast("double").alias("input")).alias("price"))
    names = spark.createDataFrame([("m7-thinking",), ("M29999",), ("m2999",), ("zzz",)], "model string")
    assert {r.model: r.price and r.price.input for r in resolved_prices(names, book).collect()} == {"m7-thinking": 7.0, "M29999": 29999.0, "m2999": 2999.0, "zzz": None}
    with pytest.raises(Exception, match="has to be small"):
        with_price(names, book, "model").collect()


def test_tolerant_counts(spark):
    cases = {"5": 5, "5.5": 6, '"7"': 7, '"x"': 0, "true": 0, "null": 0, "-3": 0, "9007199254740993": 9007199254740993, "{}": 0}
    rows = spark.createDataFrame([(k,) for k in cases], "j string").select("j", variant_count(F.parse_json(F.concat(F.lit('{"v":'), "j", F.lit("}"))), "$.v").alias("n"))
    assert {r.j: r.n for r in rows.collect()} == cases
    cells = {"1,234": 1234, " 2.5 ": 3, "": 0, "x": 0, None: 0}
    rows = spark.createDataFrame([(k,) for k in cells], "s string").select("s", text_count(F.col("s")).alias("n"))
    assert {r.s: r.n for r in rows.collect()} == cells
    zones = {"+08:00": "+08:00", " -14:59 ": "-14:59", "+15:00": None, "+08:60": None, "UTC": None}
    rows = spark.createDataFrame([(k,) for k in zones], "s string").select("s", utc_offset(F.col("s")).alias("z"))
    assert {r.s: r.z for r in rows.collect()} == zones


def test_hosts_tokens_and_joins(spark):
    now = T0.replace(tzinfo=dt.timezone.utc)
    tokens = spark.createDataFrame([("t1", "h1", "p", None, T0, None), ("t2", "h2", "p", None, T0, T0)], TOKEN)
    hosts = spark.createDataFrame([("h1", "one", T0, None, None), ("h2", "two", T0, None, None), ("acct:x", "", T0, None, None)], HOST)
    assert [control.deletable(hosts, tokens, h) for h in ("h1", "h2", "nope", "acct:x")] == ["active", "ok", "missing", "account"]
    assert control.authorised_host(tokens, "t1").first().host_id == "h1" and control.authorised_host(tokens, "t2").isEmpty()
    assert control.authorised_host(control.revoke_token(tokens, "t1", now), "t1").isEmpty()
    left = control.without_host({"hosts": hosts, "tokens": tokens}, "h2")
    assert left["hosts"].count() == 2 and left["tokens"].count() == 1
    more, seen = control.add_token(tokens, hosts, tokens.where("host_id = 'h1'").withColumn("host_id", F.lit("h9")))
    assert more.count() == 3 and seen.count() == 4
    req = spark.createDataFrame([("j", "c", "n", "ip", "pending", T0, T0 + dt.timedelta(seconds=600), None, None)], JOIN_REQUEST)
    assert control.may_ask(req, now)
    req = control.decide_join(req, "j", "approved", now, "secret", "t1")
    answer, after = control.claim_join(req, "j", "c", now)
    assert tuple(answer.first()) == ("approved", "secret") and after.first().status == "claimed"
    assert tuple(control.claim_join(after, "j", "c", now)[0].first()) == ("claimed", None)
    assert control.claim_join(req, "j", "wrong", now)[0].isEmpty()
    late, revoked = control.expire_joins(req, tokens, now + dt.timedelta(seconds=600))
    assert late.first().status == "expired" and revoked.where("revoked_at is null").isEmpty()


def test_logs_keep_their_newest_events(spark):
    log = spark.createDataFrame([("a", k) for k in range(70)], "account string, n int")
    assert changes.last_events(log, "account", F.col("n")).agg(F.min("n"), F.count("*")).first() == (20, 50)


def test_upload_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def land(k, total, minute):
        cell = {"source": "codex", "model": "m", "project": "p", "bucket_start": f"2026-01-{15 + k % 2}T10:{minute}:00", "input": total}
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"upload_id": k, "host_id": "h", "received_at": "2026-01-15T11:00:00", "buckets": [cell]}) + "\n")

    table = BucketTable(spark, new_folder(spark, "table"))
    check = new_folder(spark, "check")
    for k, (total, minute) in enumerate([(5, "00"), (7, "10"), (3, "29"), (9, "31")]):
        land(k, total, minute)
        keep_uploads(upload_stream(spark, str(tmp_path / "in")), table, check).awaitTermination()
    got = sorted((r.bucket_start.day, r.bucket_start.minute, r.total) for r in table.read().collect())
    assert got == [(15, 0, 5), (16, 0, 7), (16, 30, 9)]
    before = state_of(table.read())
    table.upsert(frame(spark, [bucket(host="h", total=5)]))
    assert state_of(table.read()) == before


def test_windowed_usage_stream(spark, tmp_path):
    rows = [("codex", "m", "p", "s", f"2026-01-15T10:{k:02d}:00", k, 0, 0, 0, 0) for k in range(0, 60, 10)]
    names = "source model project session_id at input output cache_read cache_creation reasoning".split()
    (tmp_path / "a.json").write_text("\n".join(json.dumps(dict(zip(names, r))) for r in rows))
    entries = spark.readStream.schema("source string, model string, project string, session_id string, at timestamp, input bigint, output bigint, cache_read bigint, cache_creation bigint, reasoning bigint").json(str(tmp_path))
    q = windowed_usage(entries).writeStream.outputMode("update").format("memory").queryName("windowed").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.bucket_start.minute, r.input) for r in spark.table("windowed").collect()) == [(0, 30), (30, 120)]


def test_engine_answers(spark):
    facts = frame(spark, [bucket(total=10, model="made-up"), bucket(minute=30, total=30, model="other", project="q")], seq=False)
    e = Engine(spark, Store(spark.createDataFrame([], HOST), facts, spark.createDataFrame([], "host_id string, source string, project string, session_hash string, last_at timestamp, duration_seconds bigint, active_seconds bigint, message_count bigint, user_message_count bigint"), spark.createDataFrame([], ACCOUNT)), prices_from_json(spark.createDataFrame([('{"made-up": {"input_cost_per_token": 0.5}}',)], "value string"), "snapshot")).with_rollups()
    f = Filter(dt.datetime(2026, 1, 15, tzinfo=dt.timezone.utc), dt.datetime(2026, 1, 16, tzinfo=dt.timezone.utc))
    s = e.summary(f).first()
    assert (s.total, s.cost_usd, s.cost_coverage, s.hosts) == (40, 5.0, 0.25, 1)
    assert [(r.key, r.share) for r in e.breakdown(f, "model").collect()] == [("other", 0.75), ("made-up", 0.25)]
    assert e.series(f).count() == 48 and e.series(f).agg(F.sum("total")).first()[0] == 40
    assert e.activity(f).count() == 168 and e.distributions(f).count() == 6 and e.session_totals(f).first().sessions == 0
    assert e.filters().first().projects == ["p", "q"] and e.filters(hide_projects=True).first().projects == []
    assert e.sessions(f).count() == 0 and e.hosts().count() == 0
    quiet = Filter(dt.datetime(2020, 1, 1, tzinfo=dt.timezone.utc), dt.datetime(2020, 1, 9, tzinfo=dt.timezone.utc))
    assert tuple(e.summary(quiet).first()[c] for c in ("total", "cost_usd", "cost_coverage", "cache_hit_share")) == (0, 0.0, 1.0, 0.0)


def test_pages(spark):
    groups = spark.createDataFrame([(f"k{n}", n) for n in range(1, 11)], "key string, total bigint")
    assert {r.key: r.value for r in views.top_and_other(groups).collect()}["other"] == 1 + 2 + 3
    assert views.top_and_other(groups.limit(8)).count() == 8
    assert [r.key for r in views.page_of(groups, 1, 3, F.desc("total")).collect()] == ["k7", "k6", "k5"]
    bins = views.bin_window(spark.range(0, 300, 100).withColumnRenamed("id", "bin_s"), 100, 30, 250).orderBy("bin_s").collect()
    assert [(r.from_s, r.to_s) for r in bins] == [(30, 100), (100, 200), (200, 250)]
    kinds = spark.createDataFrame([("SESSION_TYPE_WEB",), ("other",), (None,)], "k string").select(session_type_code(F.col("k")).alias("c")).collect()
    assert [r.c for r in kinds] == [1, None, None]
    ends = spark.createDataFrame([("a", dt.datetime(2026, 3, 31, 7, 30))], "account_hash string, cycle_end timestamp")
    assert views.billing_cycles(ends).first().cycle_start == dt.datetime(2026, 2, 28, 7, 30)


def test_small_functions():
    assert times.interval_seconds("5m") == 300 and times.next_tick(600, 300) == 900
    with pytest.raises(ValueError):
        times.interval_seconds("5s")
    assert times.preset_window("7d", T0) == (T0 - dt.timedelta(days=7), T0) and times.covered_days(dt.date(2026, 1, 1), dt.date(2026, 1, 3)) == 3


def test_filters_reach_the_scan(spark):
    """The other day's folder is not even listed; host and source go to Parquet."""
    table = BucketTable(spark, new_folder(spark, "pruned"))
    table.upsert(frame(spark, [bucket(total=1), bucket(total=2, day=20)]))
    f = Filter.of(dt.datetime(2026, 1, 14, tzinfo=dt.timezone.utc), dt.datetime(2026, 1, 16, tzinfo=dt.timezone.utc), host="h", source="codex")
    days = table.store.open().days("buckets", f.start, f.end)
    assert all("part=2026-01-15" in name for name in days.inputFiles())
    plan = scan_days(days, None, f)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.split("\n") if "FileScan" in line)
    assert "PushedFilters: [IsNotNull(bucket_start), IsNotNull(host_id), IsNotNull(source), GreaterThanOrEqual(bucket_start" in scan
    assert scan_days(days, None, f).count() == 1 and table.read().count() == 2


@pytest.mark.parametrize("name,tables", [("summary_totals", 3), ("breakdown_source", 3), ("distributions_grouping_sets", 3), ("series_halfhour_dense", 1), ("series_by_day", 2)])
def test_panels_read_each_table_once(spark, name, tables):
    """The rollups, and the facts of the window's first and last day; prices and names bring no other scan."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == tables


def test_a_write_places_the_rows_of_uploads_once(spark, monkeypatch):
    from meterlark.operators import upserts
    from meterlark.plans.write_queries import uploads_of
    from meterlark.session import new_folder
    from meterlark.store import SnapshotStore

    asked, real = [], upserts.placed_buckets
    monkeypatch.setattr(upserts, "placed_buckets", lambda uploads: asked.append(1) or real(uploads))
    store, uploads = SnapshotStore(spark, new_folder(spark, "placed")), uploads_of(spark, "/root/testdata/sf0.001").where("upload_id < 20")
    _, answer = store.ingest(uploads)
    assert len(asked) == 1
    assert answer.collect() == upserts.response(spark.createDataFrame([], upserts.uploaded(uploads, "buckets").limit(0).schema).select("host_id", "source", "model", "project", "bucket_start", *[c for c in ("input", "output", "cache_read", "cache_creation", "reasoning")]), uploads).collect()
