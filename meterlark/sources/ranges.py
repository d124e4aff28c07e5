"""Lines of byte ranges of files, in batch and as a stream that reads what files have grown by.

A range (path, start, end) gives the lines that begin in it; the last of them may end beyond it. Ranges that follow one another give each line
once, so a large file is read by several tasks, and a task holds BLOCK bytes and a line at a time. Files are opened with pyarrow, whose file
systems are the local one and those it knows by URI (hdfs, s3, gs, abfs).

The stream source ``grown_lines`` remembers for each file how far it was read, always the end of a line: a last line without its end waits. Its
offsets are in the query's checkpoint, so a restart reads nothing twice. A file that is shorter than before is read from its beginning; one that is
rewritten in place is for LogStore, which looks at the bytes.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch
from urllib.parse import quote

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

# Task functions travel with the job, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of a range, and bytes that are read at a time.
RANGE, BLOCK = 64 << 20, 1 << 20
LINES = "path string, start bigint, nth bigint, at bigint, line string, complete boolean"
_LINES = pa.schema([("path", pa.string()), ("start", pa.int64()), ("nth", pa.int64()), ("at", pa.int64()), ("line", pa.string()), ("complete", pa.bool_())])


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path (plain, or a URI that is not percent-encoded) and the path there."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(quote(path, safe=":/@"))


def lines_between(file, start: int, end: int) -> Iterator[tuple[int, bytes, bool]]:
    """(where it begins, line without its end, whether the end is there) of the lines that begin in [start, end)."""
    at = max(0, start - 1)
    file.seek(at)
    rest = b""
    skipping = start > 0  # up to the end of the line that holds the byte before
    while True:
        block = file.read(BLOCK)
        if not block:
            break
        *whole, rest = (rest + block).split(b"\n") if b"\n" in block else (rest + block,)
        for line in whole:
            if skipping:
                skipping = False
            elif at >= end:
                return
            else:
                yield at, line, True
            at += len(line) + 1
        if at >= end and not skipping:
            return
    if rest and not skipping and at < end:
        yield at, rest, False


def read_batches(path: str, start: int, end: int, most: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Batches of LINES; the last row of each range has no line and in ``nth`` the number of ends of lines in it. Bytes that are no UTF-8 become U+FFFD."""
    system, name = opened(path)
    rows: list[tuple] = []
    n = size = 0
    with system.open_input_file(name) as file:
        for at, line, complete in lines_between(file, start, end):
            if line.strip():
                rows.append((path, start, n, at, line.decode("utf-8", "replace"), complete))
                size += len(line)
            n += complete
            if len(rows) >= most or size >= 8 << 20:
                yield _batch(rows)
                rows, size = [], 0
    yield _batch([*rows, (path, start, n, end, None, None)])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _LINES)], schema=_LINES)


def read_ranges(ranges: DataFrame, tasks: int) -> DataFrame:
    """LINES of rows with path, start and end, dealt to ``tasks`` tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, end in zip(*[c.to_pylist() for c in batch.columns]):
                yield from read_batches(path, start, end)

    return ranges.select("path", "start", "end").repartition(tasks, "path", "start").mapInArrow(run, LINES)


def end_of_last_line(file, size: int) -> int:
    """Where the last line feed of the first ``size`` bytes is, plus one; 0 without any. Reads backwards, a block at a time."""
    upto = size
    while upto > 0:
        first = max(0, upto - 65_536)
        file.seek(first)
        found = file.read(upto - first).rfind(b"\n")
        if found >= 0:
            return first + found + 1
        upto = first
    return 0


@dataclass
class FileRange(InputPartition):
    path: str
    start: int
    end: int


class GrownLines(DataSource):
    """``spark.readStream.format("grown_lines").option("root", ...).option("glob", "*.jsonl")``: path, at (where the line begins) and line. Register it with spark.dataSource.register."""

    @classmethod
    def name(cls) -> str:
        return "grown_lines"

    def schema(self) -> str:
        return "path string, at bigint, line string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return GrownReader(self.options["root"], self.options.get("glob", "*.jsonl"), int(self.options.get("range", RANGE)))


class GrownReader(DataSourceStreamReader):
    """Offsets are how far each file is read: {"files": {path: bytes}}."""

    def __init__(self, root: str, glob: str, most: int):
        self.root, self.glob, self.most = root, glob, most

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        system, top = opened(self.root)
        found = {}
        for info in system.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True)):
            if info.is_file and fnmatch(info.base_name, self.glob):
                with system.open_input_file(info.path) as file:
                    found[info.path] = end_of_last_line(file, info.size)
        return {"files": json.dumps(found, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[FileRange]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        out = []
        for path, upto in sorted(after.items()):
            known = before.get(path, 0)
            first = known if known <= upto else 0
            out += [FileRange(path, at, min(at + self.most, upto)) for at in range(first, upto, self.most)]
        return out

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        for batch in read_batches(partition.path, partition.start, partition.end):
            kept = batch.filter(pa.compute.and_kleene(batch.column("line").is_valid(), batch.column("complete")))
            yield pa.RecordBatch.from_arrays([kept.column("path"), kept.column("at"), kept.column("line")], names=["path", "at", "line"])
