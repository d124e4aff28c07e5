"""Logs read and parsed anew only where they changed.

A store remembers for every file its size, time, how far it was read, and a hash of the bytes before that point; and its lines, parsed. A refresh

* takes the lines of a file whose size and time are the same from the store: it is not opened, and nothing of it is parsed again;
* reads the tail alone of a file that has grown, is not older, ended in a whole line, and still has the same bytes before that point;
* reads any other changed file as a whole, and forgets files that are gone.

Files are read in ranges of bytes (ranges.py), so a large one is read by several tasks and none is held whole. A line's number is the number of the lines of the
ranges before it plus its place in its own, a sum over ranges rather than a window over a file.

Each row carries the number of the refresh that read it, and the state says from which refresh on a file's lines count. The state is a version of its
own, so a refresh that fails changes nothing. Lines that no longer count are merged away after MERGE_AFTER refreshes, so a file that is rewritten again and again
does not grow the store; lines that a refresh gave are to be used before the refresh after the next. A store belongs to one FORMAT and to one ``parser``;
another format or parser starts with nothing remembered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..versions import VersionedTable
from .base import listed_files
from .ranges import RANGE, opened, read_ranges

FORMAT = 2
#: Bytes before the point up to which a file was read that have to be the same for its tail to be parsed alone (a fixed value).
GUARD_BYTES = 4096
#: Refreshes that wrote lines, after which the lines that count are written anew and the others go.
MERGE_AFTER = 16
STATE = "path STRING, size BIGINT, mtime TIMESTAMP, consumed BIGINT, guard STRING, whole BOOLEAN, n_lines BIGINT, since BIGINT"
KEPT = ("size", "mtime", "consumed", "guard", "whole", "n_lines", "since")
LINES = "path STRING, line_no BIGINT, doc VARIANT, complete BOOLEAN, refresh BIGINT"


def probed(files: DataFrame, tasks: int) -> DataFrame:
    """Adds to path, size and consumed: ``before``, the guard at ``consumed`` (null where nothing was read), ``guard``, the one at the end, and ``whole``, whether the file ends in a line feed."""

    def guard(file, upto: int) -> str:
        first = max(0, upto - GUARD_BYTES)
        file.seek(first)
        part = file.read(upto - first)
        return hashlib.sha256(part).hexdigest() + ("+" if part.endswith(b"\n") else "-")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, size, consumed in zip(*[c.to_pylist() for c in batch.columns]):
                system, name = opened(path)
                with system.open_input_file(name) as file:
                    now = guard(file, size)
                    out.append((path, guard(file, consumed) if consumed and consumed <= size else None, now, now.endswith("+")))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) if k != 1 else pa.array(c, pa.string()) for k, c in enumerate(zip(*out))], names=["path", "before", "guard", "whole"])

    return files.select("path", "size", "consumed").repartition(tasks).mapInArrow(run, "path string, before string, guard string, whole boolean")


@dataclass(frozen=True)
class Refreshed:
    """Lines (path, line_no, doc, complete; doc is null where a line is no JSON) of all files, and how many files were taken from the store, read on, read as a whole, and forgotten; ``read`` lines were parsed."""

    lines: DataFrame
    unchanged: int
    resumed: int
    parsed: int
    gone: int
    read: int = 0


class LogStore:
    """What was read of the logs below some roots, in a folder of its own."""

    def __init__(self, spark: SparkSession, path: str, version: int = FORMAT, parser: str = "json", range_bytes: int = RANGE, merge_after: int = MERGE_AFTER):
        self.spark, self.path, self.range_bytes, self.merge_after = spark, f"{path}/format-{version}-{parser}", range_bytes, merge_after
        self.state = VersionedTable(spark, f"{self.path}/state", STATE)

    def _lines(self) -> DataFrame:
        if not self.state.versions():
            return self.spark.createDataFrame([], "path string").select("path", F.lit(0).cast("bigint").alias("line_no"), F.parse_json(F.lit("null")).alias("doc"), F.lit(True).alias("complete"))
        rows = self.spark.read.schema(LINES).parquet(f"{self.path}/lines").where(F.col("refresh") <= self.state.versions()[-1])  # beyond it lies what a failed refresh has left
        known = self.state.read().select("path", "since")
        return rows.join(known, "path").where(F.col("refresh") >= F.col("since")).select("path", "line_no", "doc", "complete")

    def refresh(self, roots: list[str], glob: str = "*.jsonl") -> Refreshed:
        state = self.state.read()
        number = (self.state.versions() or [0])[-1] + 1
        listed = listed_files(self.spark, roots, glob)
        old = state.select("path", *[F.col(c).alias(f"old_{c}") for c in KEPT])
        kind = F.when(F.col("size").isNull(), F.lit("gone")).when((F.col("size") == F.col("old_size")) & (F.col("mtime") == F.col("old_mtime")), F.lit("unchanged")).otherwise(F.lit("changed"))
        met = listed.join(old, "path", "full_outer").withColumn("kind", kind).cache()
        try:
            counts = {r.kind: r for r in met.groupBy("kind").agg(F.count("*").alias("files"), F.sum("size").alias("bytes")).collect()}
            files = lambda k: counts[k].files if k in counts else 0
            if not files("changed") and not files("gone"):
                return Refreshed(self._lines(), files("unchanged"), 0, 0, 0)
            same = met.where("kind = 'unchanged'").select("path", *[F.col(f"old_{c}").alias(c) for c in KEPT])
            fresh = self._read(met.where("kind = 'changed'"), number, files("changed"), counts["changed"].bytes if "changed" in counts else 0)
            done = fresh.agg(F.coalesce(F.count_if("resumed"), F.lit(0)).alias("resumed"), F.coalesce(F.sum("fresh_lines"), F.lit(0)).alias("read")).first()
            self.state.write(same.unionByName(fresh.select("path", *KEPT)))
            fresh.unpersist()
        finally:
            met.unpersist()
        self._merge(number)
        return Refreshed(self._lines(), files("unchanged"), done.resumed, files("changed") - done.resumed, files("gone"), done.read)

    def _read(self, changed: DataFrame, number: int, files: int, size: int) -> DataFrame:
        """Reads what is new of the changed files, keeps it parsed, and gives their new state."""
        folder = f"{self.path}/lines/refresh={number}"
        tasks = max(1, min(self.spark.sparkContext.defaultParallelism, files), 2 * size // self.range_bytes)
        seen = changed.select("path", "size", "mtime", *[f"old_{c}" for c in KEPT])
        met = seen.join(probed(seen.withColumn("consumed", F.col("old_consumed")), min(tasks, files) or 1), "path")
        resumed = F.col("old_whole") & (F.col("size") > F.col("old_consumed")) & (F.col("mtime") >= F.col("old_mtime")) & (F.col("before") == F.col("old_guard"))
        met = met.withColumn("resumed", F.coalesce(resumed, F.lit(False)))
        met = met.withColumns({"from": F.when(F.col("resumed"), F.col("old_consumed")).otherwise(F.lit(0)), "had": F.when(F.col("resumed"), F.col("old_n_lines")).otherwise(F.lit(0))}).cache()
        starts = F.explode(F.sequence(F.col("from"), F.col("size") - 1, F.lit(self.range_bytes)))
        ranges = met.where(F.col("size") > F.col("from")).select("path", "size", starts.alias("start")).withColumn("end", F.least(F.col("start") + self.range_bytes, F.col("size")))
        read_ranges(ranges, tasks).write.mode("overwrite").parquet(f"{self.path}/raw")
        raw = self.spark.read.parquet(f"{self.path}/raw")
        # One row for each range: how many lines the ranges before it have.
        ends = raw.where("line is null").select("path", "start", F.col("nth").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ends = ends.withColumn("before", before).join(met.select("path", "had"), "path")
        lines = raw.where("line is not null").join(ends.select("path", "start", (F.col("before") + F.col("had")).alias("first")), ["path", "start"])
        lines.select("path", (F.col("first") + F.col("nth")).alias("line_no"), F.try_parse_json("line").alias("doc"), "complete").write.mode("overwrite").parquet(folder)
        total = ends.groupBy("path").agg(F.sum("n").alias("fresh_lines"))
        state = met.join(total, "path", "left").withColumn("fresh_lines", F.coalesce("fresh_lines", F.lit(0))).select(
            "path", "size", "mtime", F.col("size").alias("consumed"), "guard", "whole", (F.col("had") + F.col("fresh_lines")).cast("bigint").alias("n_lines"),
            F.when(F.col("resumed"), F.col("old_since")).otherwise(F.lit(number)).cast("bigint").alias("since"), "resumed", "fresh_lines",
        ).cache()
        state.count()
        met.unpersist()
        return state

    def _merge(self, number: int) -> None:
        """Writes the lines that count into one folder, puts a state in force that says so, and removes the other folders."""
        jvm = self.spark.sparkContext._jvm
        top = jvm.org.apache.hadoop.fs.Path(f"{self.path}/lines")
        files = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        folders = [s.getPath() for s in files.listStatus(top) if s.getPath().getName().startswith("refresh=")]
        if len(folders) <= self.merge_after:
            return
        after = number + 1
        self._lines().hint("rebalance", "path").write.mode("overwrite").parquet(f"{self.path}/lines/refresh={after}")
        self.state.write(self.state.read().withColumn("since", F.lit(after).cast("bigint")))
        for folder in folders:
            files.delete(folder, True)
