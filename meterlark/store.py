"""Kept tables that change together: each commit is a new version of all of them, put in force by one atomic step.

A store is a folder::

    manifests/000000000007.json     which folder holds each part of each table, as of version 7
    data/<write>/<table>/part=.../  files of one write; never changed once they are there

A write puts the parts it touches into a folder of its own and then creates the next version's manifest under a name that must not be there yet. Until then
readers see the version before it, whole; from then on the new one, whole. A writer that dies earlier leaves files that no manifest names. Two
writers on one version: the second to create the manifest gets a Conflict and has changed nothing. A reader keeps the version that it opened.

Buckets and rollups have a part for each UTC day, so a write reads and rewrites the days it touches; sessions have one for each of SESSION_PARTS slices of
their hash; hosts and accounts, of which there are few, are one part each. A manifest has a line for each part: ten years of days are some hundred kB.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import time
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import upserts
from .operators.scans import daily_rollups
from .operators.upserts import Store
from .operators.usage import normalized_accounts
from .schema import ACCOUNT, BUCKET, HOST, SESSION
from .session import shared_folder

SESSION_PARTS = 64
NUMBERS = [f.name for f in BUCKET.fields if f.name not in upserts.BUCKET_KEY]
#: The columns of each table.
SCHEMAS = {
    "buckets": ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in BUCKET.fields),
    "rollups": "day date, host_id string, source string, model string, project string, " + ", ".join(f"{c} bigint" for c in NUMBERS),
    "sessions": ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SESSION.fields),
    "hosts": ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in HOST.fields),
    "accounts": ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ACCOUNT.fields),
}


def part_of(table: str) -> Column:
    """The part of a row, as text."""
    if table == "buckets":
        return F.date_format("bucket_start", "yyyy-MM-dd")
    if table == "rollups":
        return F.date_format("day", "yyyy-MM-dd")
    if table == "sessions":
        return F.pmod(F.hash("session_hash"), F.lit(SESSION_PARTS)).cast("string")
    return F.lit("all")


class Conflict(Exception):
    """Another writer has put this version in force; what was to be written rests on the one before it."""


@dataclass(frozen=True)
class Snapshot:
    """One version of all tables. Its files stay until vacuum() finds the version too old."""

    spark: SparkSession
    root: str
    version: int
    folders: dict[str, dict[str, str]]  # by table and part

    def read(self, table: str, parts: list[str] | None = None) -> DataFrame:
        """A table, or the parts of it that are named; other parts are not listed, opened or read."""
        held = self.folders.get(table, {})
        chosen = [held[p] for p in sorted(held) if parts is None or p in set(parts)]
        if not chosen:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(*[f"{self.root}/{folder}" for folder in chosen])

    def days(self, table: str, start: dt.datetime, end: dt.datetime) -> DataFrame:
        """The days of buckets or rollups that a window touches."""
        a, b = start.date().isoformat(), end.date().isoformat()
        return self.read(table, [p for p in self.folders.get(table, {}) if a <= p <= b])

    def store(self) -> Store:
        return Store(*[self.read(t) for t in ("hosts", "buckets", "sessions", "accounts")])


@dataclass
class Write:
    """Parts that are being written on top of a snapshot."""

    base: Snapshot
    name: str = field(default_factory=lambda: os.urandom(8).hex())
    changed: dict[str, dict[str, str | None]] = field(default_factory=dict)

    def put(self, table: str, rows: DataFrame, parts: list[str]) -> DataFrame:
        """Replaces the named parts of a table by ``rows``, all of which belong to them; gives the written rows. A part without rows goes."""
        folder = f"data/{self.name}/{table}"
        rows.withColumn("part", part_of(table)).hint("rebalance", "part").write.partitionBy("part").parquet(f"{self.base.root}/{folder}")
        written = {p: f"{folder}/part={p}" for p in names_in(self.base.spark, f"{self.base.root}/{folder}", "part=")}
        self.changed[table] = {p: written.get(p) for p in parts} | written
        return Snapshot(self.base.spark, self.base.root, -1, {table: written}).read(table)


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, folder: str, prefix: str = "") -> list[str]:
    """Names in a folder that begin with a prefix, without it."""
    files, at = _files(spark, folder), _path(spark, folder)
    names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
    return sorted(n.removeprefix(prefix) for n in names if n.startswith(prefix))


def create_file(spark: SparkSession, path: str, text: str) -> None:
    """Creates a file whole or not at all; Conflict if it is there."""
    jvm, files = spark.sparkContext._jvm, _files(spark, path)
    folder, name = path.rsplit("/", 1)
    draft = _path(spark, f"{folder}/.{name}.{os.urandom(8).hex()}")
    out = files.create(draft, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
    try:
        context.rename(draft, _path(spark, path), options)  # fails where the target is there
    except Py4JJavaError as e:
        files.delete(draft, False)
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            raise Conflict(path) from e
        raise


class SnapshotStore:
    """Buckets, rollups, sessions, hosts and accounts in a folder that all executors reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in names_in(self.spark, f"{self.root}/manifests") if n.endswith(".json")]

    def open(self, version: int | None = None) -> Snapshot:
        """The newest version or the one that is asked for. Version 0 is empty."""
        found = self.versions()
        version = (found[-1] if found else 0) if version is None else version
        if version == 0:
            return Snapshot(self.spark, self.root, 0, {})
        text = "".join(r.value for r in self.spark.read.text(self._manifest(version), wholetext=True).collect())  # one file of one row
        return Snapshot(self.spark, self.root, version, json.loads(text))

    def _manifest(self, version: int) -> str:
        return f"{self.root}/manifests/{version:012d}.json"

    def begin(self, base: Snapshot | None = None) -> Write:
        return Write(base or self.open())

    def commit(self, write: Write) -> Snapshot:
        """Puts a write in force as the version after its base, or raises Conflict."""
        folders = {t: dict(parts) for t, parts in write.base.folders.items()}
        for table, parts in write.changed.items():
            held = folders.setdefault(table, {})
            held.update({p: f for p, f in parts.items() if f})
            for gone in [p for p, f in parts.items() if not f]:
                held.pop(gone, None)
        version = write.base.version + 1
        self._create(self._manifest(version), json.dumps(folders, sort_keys=True))
        return Snapshot(self.spark, self.root, version, folders)

    def _create(self, path: str, text: str) -> None:
        create_file(self.spark, path, text)

    def vacuum(self, keep: int = 2, older_than: float = 86_400.0) -> list[str]:
        """Removes manifests but the newest ``keep``, and writes that none of these name and that are older than ``older_than`` seconds (a writer may be at work on younger ones). Returns the writes that went."""
        found = self.versions()
        live = {folder.split("/")[1] for v in found[-keep:] for parts in self.open(v).folders.values() for folder in parts.values()}
        for version in found[:-keep]:
            _files(self.spark, self.root).delete(_path(self.spark, self._manifest(version)), False)
        gone = []
        for name in names_in(self.spark, f"{self.root}/data"):
            at = _path(self.spark, f"{self.root}/data/{name}")
            age = time.time() - _files(self.spark, self.root).getFileStatus(at).getModificationTime() / 1000
            if name not in live and age >= older_than:
                _files(self.spark, self.root).delete(at, True)
                gone.append(name)
        return gone

    def ingest(self, uploads: DataFrame, tries: int = 3) -> tuple[Snapshot, DataFrame]:
        """Takes uploads (see upserts.ingest) as one version; gives it and the response. On a Conflict the work is done again on the version that won."""
        for attempt in range(tries):
            write = self.begin()
            answer = self.stage(write, uploads)
            try:
                return self.commit(write), answer
            except Conflict:
                if attempt + 1 == tries:
                    raise
        raise ValueError("tries has to be at least 1")

    def stage(self, write: Write, uploads: DataFrame) -> DataFrame:
        """Writes what uploads change, without putting it in force, and gives the response to them."""
        base = write.base
        # Read several times below, and cut from its lineage so that all readings are one.
        shared_folder(self.spark)
        uploads = uploads.checkpoint()
        placed = upserts.placed_buckets(uploads).checkpoint()
        batch = placed.where("host_id is not null").select(*[f.name for f in BUCKET.fields], "account_hash", "account_label", "received_at", "seq")
        sessions = upserts.new_sessions(uploads)
        days = _parts_in(batch, "buckets")
        stored = base.read("buckets", days)
        answer = upserts.response(stored, uploads, placed)
        answer = self.spark.createDataFrame(answer.collect(), answer.schema)  # one row; it rests on the version before
        self._put_buckets(write, stored, batch, days)
        slices = _parts_in(sessions, "sessions")
        if slices:
            kept = base.read("sessions", slices)
            write.put("sessions", upserts.upsert_sessions(kept, sessions.select(*kept.columns, "seq")), slices)
        hosts, accounts = base.read("hosts"), base.read("accounts")
        write.put("hosts", upserts.hosts_after(hosts, uploads, batch), ["all"])
        fresh = normalized_accounts(upserts.uploaded(uploads, "accounts"))
        write.put("accounts", upserts.accounts_after(accounts, fresh, batch), ["all"])
        return answer

    def _put_buckets(self, write: Write, stored: DataFrame, batch: DataFrame, days: list[str]) -> None:
        """The touched days of buckets, and of their rollups, which are added up anew: no drift, and doing it twice is doing it once."""
        if days:
            after = write.put("buckets", upserts.upsert_buckets(stored, batch.select(*stored.columns, "seq")), days)
            write.put("rollups", daily_rollups(after).select(*write.base.read("rollups", []).columns), days)

    def upsert_buckets(self, batch: DataFrame, tries: int = 3) -> Snapshot:
        """Takes rows of schema.BUCKET with ``seq`` as one version. On a Conflict the work is done again on the version that won."""
        for attempt in range(tries):
            write = self.begin()
            days = _parts_in(batch, "buckets")
            self._put_buckets(write, write.base.read("buckets", days), batch, days)
            try:
                return self.commit(write) if days else write.base
            except Conflict:
                if attempt + 1 == tries:
                    raise
        raise ValueError("tries has to be at least 1")

    def replace(self, **tables: DataFrame) -> Snapshot:
        """A version in which whole tables are replaced; what is not named stays."""
        write = self.begin()
        for table, rows in tables.items():
            write.put(table, rows, list(write.base.folders.get(table, {})))
        return self.commit(write)


def _parts_in(rows: DataFrame, table: str) -> list[str]:
    """The parts that rows touch: days of a batch, or slices of a fixed number."""
    return sorted(r.part for r in rows.select(part_of(table).alias("part")).distinct().collect())
