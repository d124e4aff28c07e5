"""Sends what destinations do not have yet: planned in one pass over the facts, in numbered batches, each acknowledged by a record of its own.

A journal is a folder::

    rounds/7/plan                 one row a batch: destination, batch, rows
    rounds/7/acks/<name>-<n>.json what a destination answered to batch n; created whole or not at all
    rounds/7/acks/<name>-from-<n>/ the same of a lane that begins with batch n, a line a batch, written by the task that sends it
    state/round=7                 what round 7 has settled; with it the round is closed
    state/base=7                  the same of all rounds up to 7, merged

A round is planned, its batches are sent and acknowledged one by one, and it is closed: what was acknowledged goes to the state. A driver that dies leaves an open
round; the next one closes it by its acknowledgements first, so a batch that was answered is not sent again, and the batch in flight is. Nothing of the state is
rewritten by a round; MERGE_AFTER rounds are merged into a base.

The driver sends where the senders live in it. Senders that can travel are called by tasks (``on_executors``): the first FIRST_BATCHES of each destination in order, and then, of
destinations that took these, the others in lanes of LANE_BATCHES, side by side and each in order. An error that stays ends its lane, so no batch goes to a destination that is down but
the first of its lanes, and a task holds one batch. A task that runs again skips what its lane's records have.

Batch k holds the k-th BATCH_BUCKETS buckets and the k-th BATCH_SESSIONS sessions; account snapshots go with batch 0 alone. A destination without changes gets an empty batch 0, by
which it knows that the sender lives.
"""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import groupby
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators.changes import BATCH_BUCKETS, BATCH_SESSIONS, batches
from ..session import shared_folder
from ..sources.ranges import opened
from ..store import create_file, names_in

# Task functions travel with the job, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE = "destination string, kind string, key string, hash string"
PLAN = "destination string, batch bigint, rows array<struct<kind:string,key:string,hash:string,source:string,body:string>>"
MERGE_AFTER = 16
TRIES, FIRST_WAIT = 3, 0.4
#: Batches of a destination that are sent in order before the others go side by side, and those of a lane.
FIRST_BATCHES, LANE_BATCHES = 10, 200
LANES = "destination string, ingested bigint, sessions bigint, protected bigint, changed_buckets bigint, changed_sessions bigint, error_kind string, error string, batch bigint"
REPORT = "destination string, ingested bigint, sessions bigint, protected bigint, changed_buckets bigint, changed_sessions bigint, ok boolean, error_kind string, error string"


class Refused(Exception):
    """A destination answered with an HTTP status that is no success."""

    def __init__(self, status: int, text: str = ""):
        super().__init__(f"HTTP {status}: {text}")
        self.status = status


def error_kind(error: Exception) -> str:
    """``auth`` (the token is not taken), ``retryable`` (no connection, no sensible answer, or a status that may pass) or ``fatal``."""
    if isinstance(error, Refused):
        return "auth" if error.status in (401, 403) else "retryable" if error.status in (408, 429) or error.status >= 500 else "fatal"
    return "retryable" if isinstance(error, (ConnectionError, TimeoutError, json.JSONDecodeError)) else "fatal"


@dataclass(frozen=True)
class Batch:
    destination: str
    number: int
    buckets: list[Row]
    sessions: list[Row]
    snapshots: list[Row]


@dataclass(frozen=True)
class Answer:
    """What a destination says of a batch. Buckets of ``unknown`` sources stay unsent; protected ones are settled."""

    ingested: int = 0
    sessions: int = 0
    protected: int = 0
    unknown: list[str] = field(default_factory=list)


Send = Callable[[Batch], Answer]


class Journal:
    """What each destination has acknowledged, in a folder that the executors reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _complete(self, folder: str, prefix: str) -> list[int]:
        found = [int(n) for n in names_in(self.spark, f"{self.root}/{folder}", prefix) if n.isdigit()]
        at = {"rounds": "{}/plan"}.get(folder, prefix + "{}")
        return sorted(n for n in found if "_SUCCESS" in names_in(self.spark, f"{self.root}/{folder}/{at.format(n)}"))

    def state(self) -> DataFrame:
        """(destination, kind, key, hash): the content last acknowledged."""
        bases, rounds = self._complete("state", "base="), self._complete("state", "round=")
        base = bases[-1] if bases else 0
        folders = [f"{self.root}/state/base={base}"] * bool(base) + [f"{self.root}/state/round={n}" for n in rounds if n > base]
        if not folders:
            return self.spark.createDataFrame([], STATE)
        rows = self.spark.read.schema(STATE + ", nth bigint").parquet(*folders)
        return rows.groupBy("destination", "kind", "key").agg(F.max_by("hash", "nth").alias("hash"))

    def open_rounds(self) -> list[int]:
        closed = set(self._complete("state", "round="))
        bases = self._complete("state", "base=")
        return [n for n in self._complete("rounds", "") if n not in closed and n > (bases[-1] if bases else 0)]

    def plan(self, rows: DataFrame, destinations: list[str], full: tuple[str, ...] = ()) -> int:
        """Stores the batches of a new round: the rows (kind, key, hash, source, body) whose content a destination has not acknowledged, or all of them if it is in ``full``. Rows are read once for all destinations."""
        sent = self.state().groupBy("kind", "key").agg(F.map_from_entries(F.collect_list(F.struct("destination", "hash"))).alias("sent"))
        names = F.array(*[F.struct(F.lit(d).alias("name"), F.lit(d in full).alias("full")) for d in destinations])
        wanted = F.filter(names, lambda d: d["full"] | ~F.coalesce(F.try_element_at("sent", d["name"]) == F.col("hash"), F.lit(False)))
        todo = rows.select("kind", "key", "hash", "source", "body").join(sent, ["kind", "key"], "left").select("kind", "key", "hash", "source", "body", F.explode(F.transform(wanted, lambda d: d["name"])).alias("destination"))
        shared_folder(self.spark)
        todo = todo.checkpoint()
        size = F.when(F.col("kind") == "session", F.lit(BATCH_SESSIONS)).otherwise(F.lit(BATCH_BUCKETS))
        numbered = batches(todo, size, ("destination", "kind"), "key")
        number = max([0, *map(int, filter(str.isdigit, names_in(self.spark, f"{self.root}/rounds"))), *self._complete("state", "base=")]) + 1
        # A batch has at most BATCH_BUCKETS + BATCH_SESSIONS rows.
        numbered.groupBy("destination", "batch").agg(F.sort_array(F.collect_list(F.struct("kind", "key", "hash", "source", "body"))).alias("rows")).write.parquet(f"{self.root}/rounds/{number}/plan")
        return number

    def planned(self, number: int, destination: str) -> DataFrame:
        return self.spark.read.schema(PLAN).parquet(f"{self.root}/rounds/{number}/plan").where(F.col("destination") == destination).orderBy("batch")

    def acknowledge(self, number: int, destination: str, batch: int, unknown: list[str]) -> None:
        record = {"destination": destination, "batch": batch, "unknown": unknown}
        create_file(self.spark, f"{self.root}/rounds/{number}/acks/{quote(destination, safe='')}-{batch}.json", json.dumps(record))

    def acknowledged(self, number: int) -> DataFrame:
        folder, schema = f"{self.root}/rounds/{number}/acks", "destination string, batch bigint, unknown array<string>"
        there = any(n.endswith(".json") or "-from-" in n for n in names_in(self.spark, folder))
        if not there:
            return self.spark.createDataFrame([], schema)
        # A line that a dying task left unfinished is no record; a batch may have two, of a task that ran twice.
        return self.spark.read.schema(schema).json(folder, pathGlobFilter="*.json", recursiveFileLookup=True).where("batch is not null").dropDuplicates(["destination", "batch"])

    def close(self, number: int) -> None:
        """Puts what was acknowledged in the state. Closing a round again after a failure gives the same."""
        plan = self.spark.read.schema(PLAN).parquet(f"{self.root}/rounds/{number}/plan")
        settled = plan.join(self.acknowledged(number), ["destination", "batch"]).select("destination", "unknown", F.inline("rows"))
        settled = settled.where((F.col("kind") == "session") | ~F.array_contains("unknown", F.col("source")))
        settled.select("destination", "kind", "key", "hash", F.lit(number).cast("bigint").alias("nth")).write.mode("overwrite").parquet(f"{self.root}/state/round={number}")
        if len([n for n in self._complete("state", "round=") if n > max([0, *self._complete("state", "base=")])]) >= MERGE_AFTER:
            self.replace(self.state(), number)

    def replace(self, state: DataFrame, number: int | None = None) -> None:
        """Makes ``state`` the base after the newest closed round, such as one without the keys that are gone (operators.changes.pruned)."""
        number = number or max([0, *self._complete("state", "round="), *self._complete("state", "base=")])
        base = number if number not in self._complete("state", "base=") else number + 1
        state.select(*[c.split()[0] for c in STATE.split(", ")]).withColumn("nth", F.lit(base).cast("bigint")).write.mode("overwrite").parquet(f"{self.root}/state/base={base}")


def _tried(send: Send, batch: Batch, tries: int, wait: Callable[[float], None]) -> Answer:
    for k in range(tries):
        try:
            return send(batch)
        except Exception as e:
            if error_kind(e) != "retryable" or k + 1 == tries:
                raise
        wait(FIRST_WAIT * 2**k)
    raise ValueError("tries has to be at least 1")


def _send_round(journal: Journal, number: int, name: str, send: Send, snapshots: list[Row], tries: int, wait: Callable[[float], None]) -> tuple:
    done, n = {"ingested": 0, "sessions": 0, "protected": 0, "buckets": 0, "changed": 0}, 0
    error = kind = None
    try:
        for row in _batches(journal.planned(number, name)):
            rows = row.rows if row else []
            batch = Batch(name, row.batch if row else 0, [r for r in rows if r.kind != "session"], [r for r in rows if r.kind == "session"], snapshots if n == 0 else [])
            answer = _tried(send, batch, tries, wait)
            if row:
                journal.acknowledge(number, name, row.batch, answer.unknown)
            n += 1
            for key, more in (("ingested", answer.ingested), ("sessions", answer.sessions), ("protected", answer.protected), ("buckets", len(batch.buckets)), ("changed", len(batch.sessions))):
                done[key] += more
    except Exception as e:  # noqa: BLE001  one destination must not stop the others
        error, kind = str(e).split("\n")[0], error_kind(e)
    return name, done["ingested"], done["sessions"], done["protected"], done["buckets"], done["changed"], error is None, kind, error


def _batches(plan: DataFrame) -> Iterator[Row | None]:
    """A batch at a time (the driver holds one partition of the plan), or None once if there is none."""
    some = False
    for row in plan.toLocalIterator():
        some = True
        yield row
    if not some:
        yield None


class _Lane:
    """Sends batches of one destination in order, from a task, with a record of each in a file of its own."""

    def __init__(self, acks: str, name: str, first: int, send: Send, tries: int, wait: Callable[[float], None]):
        self.name, self.send, self.tries, self.wait = name, send, tries, wait
        self.system, top = opened(acks)
        self.folder = f"{top}/{quote(name, safe='')}-from-{first}"
        self.done = {"ingested": 0, "sessions": 0, "protected": 0, "buckets": 0, "changed": 0}
        self.error: Exception | None = None
        self.failed: int | None = None
        self.out = None
        self.known = {r["batch"]: r for r in self._records()}

    def _records(self) -> Iterator[dict]:
        for info in self.system.get_file_info(fs.FileSelector(self.folder, allow_not_found=True)):
            with self.system.open_input_stream(info.path) as file:
                for line in file.read().split(b"\n")[:-1]:
                    yield json.loads(line)

    def _record(self, batch: Batch, answer: Answer) -> None:
        if self.out is None:
            self.system.create_dir(self.folder, recursive=True)
            self.out = self.system.open_output_stream(f"{self.folder}/{os.urandom(8).hex()}.json")
        counts = {"ingested": answer.ingested, "sessions": answer.sessions, "protected": answer.protected, "buckets": len(batch.buckets), "changed": len(batch.sessions)}
        self.out.write(json.dumps({"destination": self.name, "batch": batch.number, "unknown": answer.unknown, "counts": counts}).encode() + b"\n")
        self.out.flush()
        self._count(counts)

    def _count(self, counts: dict[str, int]) -> None:
        for key, more in counts.items():
            self.done[key] += more

    def take(self, number: int | None, rows: list[Row], snapshots: list[Row]) -> None:
        """Sends a batch, or an empty one where ``number`` is None; nothing after an error that stayed."""
        if self.error is not None:
            return
        if number in self.known:
            return self._count(self.known[number]["counts"])
        batch = Batch(self.name, number or 0, [r for r in rows if r.kind != "session"], [r for r in rows if r.kind == "session"], snapshots)
        try:
            answer = _tried(self.send, batch, self.tries, self.wait)
        except Exception as e:  # noqa: BLE001  one destination must not stop the others
            self.error, self.failed = e, batch.number
            return
        if number is None:
            self._count({"ingested": answer.ingested, "sessions": answer.sessions, "protected": answer.protected})
        else:
            self._record(batch, answer)

    def close(self) -> tuple:
        if self.out is not None:
            self.out.close()
        e = self.error
        return self.name, *self.done.values(), error_kind(e) if e else None, str(e).split("\n")[0] if e else None, self.failed


_ROW = Row("kind", "key", "hash", "source", "body")


def _send_lanes(batches: DataFrame, acks: str, destinations: dict[str, Send], snapshots: list[Row], tries: int, wait: Callable[[float], None]) -> list[Row]:
    """A row for each lane of (destination, lane, batch, rows), which has each lane in one task, in order of its batches."""
    columns = ["destination", "lane", "batch", *_ROW]
    flat = batches.select("destination", "lane", "batch", F.inline_outer("rows"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for part in parts for row in zip(*[part.column(c).to_pylist() for c in columns]))
        lane, out = None, []
        for (name, first, number), some in groupby(rows, key=lambda row: row[:3]):
            if lane is None or lane[0] != (name, first):
                out += [lane[1].close()] if lane else []
                lane = (name, first), _Lane(acks, name, first, destinations[name], tries, wait)
            lane[1].take(number, [_ROW(*row[3:]) for row in some] if number is not None else [], snapshots if not number else [])
        out += [lane[1].close()] if lane else []
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k in (0, 6, 7) else pa.int64()) for k, c in enumerate(zip(*out))] if out else [pa.array([], pa.string() if k in (0, 6, 7) else pa.int64()) for k in range(9)], names=[c.split()[0] for c in LANES.split(", ")])

    return flat.mapInArrow(run, LANES).collect()  # one row a lane


def _send_by_tasks(journal: Journal, number: int, destinations: dict[str, Send], snapshots: list[Row], tries: int, wait: Callable[[float], None]) -> list[tuple]:
    """The batches of a round, sent by tasks; a row of REPORT for each destination."""
    spark, names, acks = journal.spark, list(destinations), f"{journal.root}/rounds/{number}/acks"
    plan = spark.read.schema(PLAN).parquet(f"{journal.root}/rounds/{number}/plan")
    most = {r.destination: r.most for r in plan.groupBy("destination").agg(F.max("batch").alias("most")).collect()}  # one row a destination
    asked = spark.createDataFrame(list(enumerate(names)), "nth int, destination string").join(plan.where(F.col("batch") < FIRST_BATCHES), "destination", "left")
    asked = asked.withColumn("lane", F.lit(0).cast("bigint")).repartitionById(len(names), "nth").sortWithinPartitions("destination", "batch")
    lanes = _send_lanes(asked, acks, destinations, snapshots, tries, wait)
    others = [r.destination for r in lanes if r.error is None and most.get(r.destination, 0) >= FIRST_BATCHES]
    if others:
        lane = F.expr(f"(batch - {FIRST_BATCHES}) div {LANE_BATCHES} * {LANE_BATCHES} + {FIRST_BATCHES}")
        rest = plan.where(F.col("destination").isin(others) & (F.col("batch") >= FIRST_BATCHES)).withColumn("lane", lane)
        lanes += _send_lanes(rest.repartition("destination", "lane").sortWithinPartitions("destination", "lane", "batch"), acks, destinations, snapshots, tries, wait)
    results = []
    for name in names:
        own = [r for r in lanes if r.destination == name]
        first = min((r for r in own if r.error_kind is not None), key=lambda r: r.batch, default=None)
        results.append((name, *[sum(r[k] for r in own) for k in range(1, 6)], first is None, first and first.error_kind, first and first.error))
    return results


def deliver(rows: DataFrame, journal: Journal, destinations: dict[str, Send], full: tuple[str, ...] = (), snapshots: DataFrame | None = None, tries: int = TRIES, at_once: int = 4, wait: Callable[[float], None] = time.sleep, on_executors: bool = False) -> DataFrame:
    """One round: rows are kind (``bucket`` or ``session``), key, hash, source and body. A row per destination, as operators.changes.sync_report() takes them.

    A batch is tried ``tries`` times where the error may pass; an error that stays ends the round for its destination alone, and what it had acknowledged counts.
    With ``on_executors`` tasks call the senders, copies of them that travel with the job; use it for many batches. An error beyond the first batches ends its lane alone.
    """
    for number in journal.open_rounds():
        journal.close(number)
    number = journal.plan(rows, list(destinations), full)
    few = snapshots.collect() if snapshots is not None else []  # one row an account
    if on_executors:
        results = _send_by_tasks(journal, number, destinations, few, tries, wait)
    else:
        with ThreadPoolExecutor(max(1, min(at_once, len(destinations)))) as pool:
            waiting = [pool.submit(_send_round, journal, number, name, send, few, tries, wait) for name, send in destinations.items()]
            results = [w.result() for w in waiting]
    journal.close(number)
    return journal.spark.createDataFrame(results, REPORT)
