"""Reading logs: numbered lines of whole files as VARIANT, and the adapter that every source implements.

Without a store (sources.incremental.LogStore, which reads ranges of bytes) a log file is read by one task.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from concurrent.futures import ThreadPoolExecutor
from copy import copy
from dataclasses import dataclass
from functools import reduce
from uuid import uuid4

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import variant_count
from ..functions.times import log_time
from ..schema import ENTRY, EVENT

REPORT = "source string, ok boolean, files bigint, entries bigint, events bigint, error string"


@dataclass(frozen=True)
class Usage:
    """What a source gives: billable calls (schema.ENTRY) and timing events (schema.EVENT)."""

    entries: DataFrame
    events: DataFrame


class SourceAdapter(ABC):
    """A source of usage. Subclasses name themselves and turn folders into entries and events."""

    name: str
    glob = "*.jsonl"
    #: Where lines are taken from if logs are to be read only where they changed (sources.incremental.LogStore).
    store = None

    def over(self, store):
        """The same source over a store of lines."""
        other = copy(self)
        other.store = store
        return other

    def lines(self, spark: SparkSession, roots: list[str]) -> DataFrame:
        """(path, line_no, line, complete): the lines of all files that are not blank; ``complete`` is false for a last one without its end. From a store they come parsed, with ``doc`` in place of the text."""
        return self.store.refresh(roots, self.glob).lines if self.store else raw_lines(whole_files(spark, roots, self.glob))

    @abstractmethod
    def read(self, spark: SparkSession, roots: list[str]) -> Usage: ...


def read_all(spark: SparkSession, sources: list[tuple[SourceAdapter, list[str]]]) -> tuple[Usage, dict[str, str]]:
    """All sources together, and the errors of those whose folders cannot be listed; the others are not held up by them."""
    found, errors = [], {}
    for adapter, roots in sources:
        try:
            found.append(adapter.read(spark, roots))
        except Exception as e:  # noqa: BLE001  one source must not stop the others
            errors[adapter.name] = str(e).split("\n")[0]
    return together(spark, found), errors


def together(spark: SparkSession, found: list[Usage]) -> Usage:
    entries = reduce(DataFrame.unionByName, [u.entries for u in found], spark.createDataFrame([], ENTRY))
    return Usage(entries, reduce(DataFrame.unionByName, [u.events for u in found], spark.createDataFrame([], EVENT)))


def collect_all(spark: SparkSession, sources: list[tuple[SourceAdapter, list[str]]], folder: str, at_once: int = 4) -> tuple[Usage, DataFrame]:
    """Reads each source into tables below ``folder``, up to ``at_once`` of them at a time, so that one that fails while it runs does not stop the others.

    Each runs under a tag and a scheduler pool of its own: a small source gets its share of the executors beside a large one (with spark.scheduler.mode=FAIR), and
    what a failed one has left running is stopped, alone.

    The report has a row per source, in the order given: (source, ok, files, entries, events, error). A source with files of which nothing could be parsed
    is not ok: what a collector remembers of it must stay (operators.changes.pruned).
    """

    def collect(nth: int, adapter: SourceAdapter, roots: list[str]) -> tuple[Usage | None, tuple]:
        tag = f"source-{nth}-{uuid4().hex}"
        files = entries = events = 0
        kept = error = None
        spark.addTag(tag)
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", adapter.name)
        try:
            roots = roots_of(spark, roots)
            if roots:  # nothing to read is no failure
                usage = adapter.read(spark, roots)
                at = f"{folder}/{adapter.name}"
                usage.entries.write.mode("overwrite").parquet(f"{at}/entries")
                usage.events.write.mode("overwrite").parquet(f"{at}/events")
                kept = Usage(spark.read.schema(ENTRY).parquet(f"{at}/entries"), spark.read.schema(EVENT).parquet(f"{at}/events"))
                entries, events, files = kept.entries.count(), kept.events.count(), listed_files(spark, roots, adapter.glob).count()
                if files and not entries and not events:
                    error = "nothing could be parsed"
        except Exception as e:  # noqa: BLE001  one source must not stop the others
            kept, error = None, str(e).split("\n")[0]
            spark.interruptTag(tag)
        finally:
            spark.removeTag(tag)
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)
        return kept, (adapter.name, error is None, files, entries, events, error)

    with ThreadPoolExecutor(max(1, min(at_once, len(sources)))) as pool:
        waiting = [pool.submit(inheritable_thread_target(spark)(collect), n, adapter, roots) for n, (adapter, roots) in enumerate(sources)]
        done = [w.result() for w in waiting]
    return together(spark, [kept for kept, _ in done if kept]), spark.createDataFrame([row for _, row in done], REPORT)


def plain_path() -> Column:
    """The file's path as it is on disk; Spark gives it percent-encoded."""
    return F.try_url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))).alias("path")


def roots_of(spark: SparkSession, roots: list[str]) -> list[str]:
    """The folders that are there, each once: paths are made absolute and links followed, and a folder inside another one is left out."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found: list[str] = []
    for root in roots:
        path = jvm.org.apache.hadoop.fs.Path(root)
        files = path.getFileSystem(conf)
        if not files.exists(path):
            continue
        full = files.resolvePath(path).toUri()
        name = full.toString()
        if full.getScheme() in (None, "file"):
            name = "file://" + jvm.java.nio.file.Paths.get(full.getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)).toRealPath(spark.sparkContext._gateway.new_array(jvm.java.nio.file.LinkOption, 0)).toString()
        if name not in found:
            found.append(name)
    return [r for r in found if not any(r != other and r.startswith(other.rstrip("/") + "/") for other in found)]


def listed_files(spark: SparkSession, roots: list[str], glob: str = "*.jsonl") -> DataFrame:
    """(path, size, mtime) of all files below the folders; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(roots)
    return files.select(plain_path(), F.col("length").alias("size"), F.col("modificationTime").alias("mtime")).distinct()


def whole_files(spark: SparkSession, roots: list[str], glob: str) -> DataFrame:
    """(path, text) of all files below the folders."""
    texts = spark.read.text(roots, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return texts.select(plain_path(), F.col("value").alias("text"))


def raw_lines(files: DataFrame) -> DataFrame:
    # A file is split and its lines are counted once, before they become rows.
    parts = files.select("path", F.split("text", "\n").alias("parts")).select("path", "parts", (F.size("parts") - 1).alias("last"))
    rows = parts.select("path", "last", F.posexplode("parts").alias("line_no", "line")).where("trim(line) <> ''")
    return rows.select("path", F.col("line_no").cast("bigint").alias("line_no"), "line", (F.col("line_no") < F.col("last")).alias("complete"))


def parsed_lines(lines: DataFrame) -> DataFrame:
    """``lines`` with ``doc`` in place of the text; those that are no JSON are left out. Lines that a store has parsed are not parsed again."""
    if "doc" in lines.columns:
        return lines.where("doc is not null").drop("complete")
    # As an array of one: conditions on ``doc`` are not moved below it, where each would parse the line again.
    doc = F.explode(F.array(F.try_parse_json("line"))).alias("doc")
    return lines.select("*", doc).where("doc is not null").drop("line", "complete")


def numbered_lines(files: DataFrame, complete_only: bool = False) -> DataFrame:
    """(path, line_no, doc): the lines that are JSON. Blank and broken lines are skipped; ``complete_only`` leaves out a line without its end."""
    rows = raw_lines(files)
    return parsed_lines(rows.where("complete") if complete_only else rows)


def text_at(doc: Column | str, path: str) -> Column:
    """A string at a path; values that are no strings count as missing."""
    value = F.try_variant_get(doc, path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(doc, path, "string"))


def time_at(doc: Column | str, path: str) -> Column:
    return log_time(F.try_variant_get(doc, path, "string"))


def count_at(doc: Column | str, path: str) -> Column:
    return variant_count(F.col(doc) if isinstance(doc, str) else doc, path)


def present_at(doc: Column | str, path: str) -> Column:
    """Whether there is anything at a path, an explicit null included."""
    return F.try_variant_get(doc, path, "variant").isNotNull()


def file_stem(path: Column | str) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def best_copy(files: DataFrame, key: str) -> DataFrame:
    """Of the copies of one session the largest file, then the newest, then the first by path."""
    order = Window.partitionBy(key).orderBy(F.desc("size"), F.desc("mtime"), "path")
    return files.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def as_entries(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in ENTRY.fields])


def as_events(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in EVENT.fields])
