"""Suffix-array dedup: removes every byte covered by a string of ``match`` bytes that also starts anywhere else.

Shorter repeats are reported, not removed: every byte covered by a string of ``passage`` bytes (about 50 words) that also starts anywhere else.

1. Anchors. Of the CORE-byte strings inside a window of ``passage`` bytes the one with the smallest hash (the leftmost of equals) is the
   window's anchor. It depends on the window's bytes alone, so equal windows have equal anchors at equal places.
   Windows with the same anchor follow one another; together, and with the bytes that a longer match needs, they are a stretch, a few
   hundred bytes long.
2. Stretches whose anchor's bytes occur once hold no repeat and are left out. Equal stretches (by two independent 64-bit hashes) are folded into one; those
   folded from several are repeats as they stand.
3. All different stretches of an anchor meet, and the column-wise construction (suffix_build.py) gives the order of their suffixes
   and the common prefixes of neighbours, hence every string of either length that occurs twice. A task takes anchors in lots of about LOT bytes.
4. An anchor with more than MOST_STRETCHES different stretches would be one large lot; its windows are counted by their 128-bit
   hashes instead, which spreads them over all tasks.
5. Each document's repeated windows are joined into spans, and its other bytes are kept.

The construction's columns are read and rewritten in order once a round. They live in the task's memory, not in files: a lot is
bounded, and a task must not depend on a machine's own disk.

Defined results: a null text counts as empty; texts shorter than ``match`` keep all bytes. Repeated rows are copies of each
other, so all their windows are repeats. Matches never cross documents. A null id is kept as it is. An empty table gives
an empty result. Columns beyond id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_batches
from .minhash import mixed
from .suffix_build import prefix_sums, repeated_starts, span_hashes

MATCH = 400
PASSAGE = 300
CORE = 100
WIDTH = 100
#: Bytes of stretches that one construction orders at once; a lot is larger only by its last anchor.
LOT = 400_000
MOST_STRETCHES = 4096
#: Bytes of a text that are looked at at once.
PART = 1 << 19
#: Up to so many anchor hashes (8 bytes each) are broadcast to thin the stretches before they are shuffled.
BROADCAST_ANCHORS = 500_000

SECOND = np.uint64(0xD6E8FEB86659FD93)


def text_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def text_mark(data: bytes) -> int:
    """Tells rows with one id and different texts apart; what Spark's xxhash64 gives for the text."""
    return int.from_bytes(xxhash.xxh64_digest(data, 42), "big", signed=True)


def stretches(data: bytes, match: int, passage: int, core: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor code, stretch code, first start, last start) arrays of a text's stretches."""
    total, view = len(data) - passage + 1, memoryview(data)
    for at in range(0, max(0, total), PART):
        n = min(PART, total - at)
        cores, wide = n + passage - core, passage - core + 1
        sums = prefix_sums(np.frombuffer(data, np.uint8, count=n + passage - 1, offset=at))
        places = np.arange(cores)
        codes = span_hashes(sums, places, places + core)
        low = (codes & ~np.uint64((1 << 24) - 1)) | places.astype(np.uint64)
        reach = 1
        while 2 * reach <= wide:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        low = np.minimum(low[:n], low[wide - reach : wide - reach + n])
        anchor = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
        edge = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
        first, last = np.concatenate([[0], edge]), np.concatenate([edge - 1, [n - 1]])
        whole = [xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip((first + at).tolist(), (last + at + match).tolist())]
        yield codes[anchor[first]].view(np.int64), np.array(whole, np.uint64).view(np.int64), first + at, last + at


def together(fn, schema: pa.Schema, rows: int = 50_000):
    """Joins a function's small batches into larger ones."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for out in fn(batch):
            held.append(out)
            n += out.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held, schema).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held, schema).combine_chunks().to_batches()

    return run


def all_stretches(docs: DataFrame, match: int, passage: int, core: int) -> DataFrame:
    """(doc_id, mark, anchor, whole, first, last): every stretch of every text."""
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("anchor", pa.int64()), ("whole", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            data = text_bytes(text)
            mark = text_mark(data)
            for a, w, first, last in stretches(data, match, passage, core):
                n = len(a)
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * n, pa.int64()), pa.array(np.full(n, mark)), pa.array(a), pa.array(w), pa.array(first), pa.array(last)], schema=schema)

    return map_batches(docs, together(run, schema), schema)


def with_rows(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """``docs`` (doc_id, text) with what was found for each different row (doc_id, mark)."""
    marked = docs.withColumn("own_mark", F.xxhash64(F.coalesce("text", F.lit(""))))
    return marked.join(found.withColumnRenamed("doc_id", "own_id"), F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("own_mark") == F.col("mark")), how)


def cut_bytes(docs: DataFrame, wanted: DataFrame, match: int) -> DataFrame:
    """(anchor, whole, kinds, starts, body) for the stretches in ``wanted`` (doc_id, mark, anchor, whole, kinds, first, last)."""
    lists = wanted.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("anchor", "whole", "kinds", "first", "last")).alias("cuts"))
    schema = pa.schema([("anchor", pa.int64()), ("whole", pa.int64()), ("kinds", pa.int64()), ("starts", pa.int64()), ("body", pa.binary())])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for text, cuts in zip(*[c.to_pylist() for c in batch.columns]):
            data = text_bytes(text)
            columns = [*[[c[name] for c in cuts] for name in ("anchor", "whole", "kinds")], [c["last"] - c["first"] + 1 for c in cuts]]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], pa.array([data[c["first"] : c["last"] + match] for c in cuts], pa.binary())], schema=schema)

    return map_batches(with_rows(docs, lists, "inner").select("text", "cuts"), together(run, schema, 5000), schema)


RUN_LIST = "array<struct<a:int,b:int>>"
RUNS = f"anchor bigint, whole bigint, runs {RUN_LIST}, seen {RUN_LIST}"
RUN_ARROW = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def runs_of(flags: np.ndarray) -> list[dict[str, int]]:
    """Stretches of set flags, as first and last."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).view(np.int8)))
    return [{"a": int(a), "b": int(b) - 1} for a, b in zip(edges[::2], edges[1::2])]


def constructed_repeats(bodies: DataFrame, match: int, passage: int, width: int, lot: int) -> DataFrame:
    """(anchor, whole, runs, seen): which starts of each stretch begin a repeat of ``match`` and of ``passage`` bytes, by the column-wise construction."""
    parts = int(bodies.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 2
    dealt = bodies.repartition(parts, "anchor").sortWithinPartitions("anchor", "whole")
    schema = pa.schema([("anchor", pa.int64()), ("whole", pa.int64()), ("runs", RUN_ARROW), ("seen", RUN_ARROW)])

    def settle(keys: list[tuple[int, int]], held: list[bytes], starts: list[int]) -> pa.RecordBatch:
        long, short = repeated_starts(held, (match, passage), width, starts)
        found = [(k, runs_of(a), runs_of(b)) for k, a, b in zip(keys, long, short) if b.any()]
        columns = [[k[0] for k, *_ in found], [k[1] for k, *_ in found], [a for _, a, _ in found], [b for *_, b in found]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held, starts, size = [], [], [], 0
        for batch in batches:
            for anchor, whole, count, body in zip(*[c.to_pylist() for c in batch.columns]):
                if keys and (anchor, whole) == keys[-1]:  # the same, from a repeated row
                    continue
                if size >= lot and anchor != keys[-1][0]:
                    yield settle(keys, held, starts)
                    keys, held, starts, size = [], [], [], 0
                keys.append((anchor, whole))
                held.append(body)
                starts.append(count)
                size += len(body)
        if held:
            yield settle(keys, held, starts)

    return dealt.select("anchor", "whole", "starts", "body").mapInArrow(run, RUNS)


def counted_repeats(bodies: DataFrame, match: int, passage: int, scratch: Scratch) -> DataFrame:
    """The same for the stretches of very common anchors: windows are counted by their hashes."""
    schema = pa.schema([("anchor", pa.int64()), ("whole", pa.int64()), ("long", pa.bool_()), ("start", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            held, limit = part.column(3).to_pylist(), part.column(2).to_numpy()
            data, sizes = np.frombuffer(b"".join(held), np.uint8), np.array([len(b) for b in held])
            sums, second, begins = prefix_sums(data), prefix_sums(mixed_bytes(data)), np.cumsum(sizes) - sizes
            for size in (match, passage):
                counts = np.minimum(np.maximum(sizes - size + 1, 0), limit)
                start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                begin = start + np.repeat(begins, counts)
                h1, h2 = span_hashes(sums, begin, begin + size), span_hashes(second, begin, begin + size)
                keys = [pa.array(np.repeat(part.column(k).to_numpy(), counts)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(np.full(len(start), size == match)), pa.array(start.astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], schema=schema)

    windows = map_batches(bodies.select("anchor", "whole", "starts", "body"), run, schema)
    often = scratch.keep(windows.groupBy("h1", "h2", "long").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2", "long"))
    hits = windows.join(often, ["h1", "h2", "long"])
    starts = lambda test: F.collect_list(F.when(test, F.struct(F.col("start").alias("a"), F.col("start").alias("b"))))
    return hits.groupBy("anchor", "whole").agg(starts(F.col("long")).cast(RUN_LIST).alias("runs"), starts(~F.col("long")).cast(RUN_LIST).alias("seen"))


def mixed_bytes(data: np.ndarray) -> np.ndarray:
    """The bytes under another fixed order, for a second independent hash."""
    order = np.argsort(mixed(np.arange(256, dtype=np.uint64) * SECOND), kind="stable").astype(np.uint8)
    return order[data]


def repeated_windows(docs: DataFrame, match: int, passage: int, core: int, width: int, lot: int, most: int, scratch: Scratch) -> DataFrame:
    """(doc_id, mark, spans, seen): starts of repeats of ``match`` and of ``passage`` bytes in each document, as arrays of (a, b), first and last."""
    every = scratch.keep(all_stretches(docs, match, passage, core))
    twice = scratch.keep(every.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    found = scratch.keep(every.join(F.broadcast(twice) if twice.count() <= BROADCAST_ANCHORS else twice, "anchor"))
    scratch.drop(every, twice)
    least = F.min(F.struct("doc_id", "mark", "first", "last"))
    kinds = scratch.keep(found.groupBy("anchor", "whole").agg(F.count("*").alias("n"), least.alias("at")))
    several = scratch.keep(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    wanted = kinds.join(several, "anchor").select("anchor", "whole", "kinds", "at.*")
    bodies = scratch.keep(cut_bytes(docs, wanted, match))
    built = constructed_repeats(bodies.where(F.col("kinds") <= most).drop("kinds"), match, passage, width, lot)
    if not several.where(F.col("kinds") > most).isEmpty():
        hot = bodies.where(F.col("kinds") > most).dropDuplicates(["anchor", "whole"])
        built = built.unionByName(counted_repeats(hot, match, passage, scratch))
    some = built.withColumn("all", F.lit(False))
    copies = kinds.where("n > 1").select("anchor", "whole")
    none = F.lit(None).cast(RUN_LIST)
    verdicts = copies.select("anchor", "whole", none.alias("runs"), none.alias("seen"), F.lit(True).alias("all")).unionByName(some.join(copies, ["anchor", "whole"], "left_anti"))
    verdicts = scratch.keep(verdicts)
    scratch.drop(bodies, several, kinds)
    hits = found.join(verdicts, ["anchor", "whole"])
    entire = F.array(F.struct(F.col("first").alias("a"), F.col("last").alias("b")))
    shifted = lambda c: F.transform(c, lambda r: F.struct((F.col("first") + r["a"]).alias("a"), (F.col("first") + r["b"]).alias("b")))
    of = lambda c: F.when(F.col("all"), entire).otherwise(shifted(c)).alias(c)
    hits = hits.select("doc_id", "mark", of("runs"), of("seen"))
    # Sets, not lists: rows that repeat an id and text say the same, and are put together before they are shuffled.
    return hits.groupBy("doc_id", "mark").agg(F.flatten(F.collect_set("runs")).alias("spans"), F.flatten(F.collect_set("seen")).alias("seen"))


def covered(spans: list[dict[str, int]] | None, match: int, total: int) -> list[tuple[int, int]]:
    """Maximal covered byte ranges [a, b) of windows of ``match`` bytes given by runs of starts, in a text of ``total`` bytes."""
    out: list[list[int]] = []
    for a, b in sorted((s["a"], min(s["b"] + match, total)) for s in spans or []):
        if b - a < match:  # a stretch that ends too near the text's end for a match
            continue
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, match: int = MATCH, passage: int = PASSAGE, core: int = CORE, width: int = WIDTH, lot: int = LOT, most: int = MOST_STRETCHES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, removed and passages (arrays of [start, end) in bytes), kept (binary)."""
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    scratch = Scratch(docs.sparkSession)
    spans = scratch.keep(repeated_windows(narrow, match, passage, core, width, lot, most, scratch))
    scratch.drop_all_but(spans)
    joined = with_rows(narrow, spans, "left").select("doc_id", "text", "spans", "seen")
    ranges = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("removed", ranges), ("passages", ranges), ("kept", pa.binary())])
    pairs = lambda found: [{"start": a, "end": b} for a, b in found]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for doc_id, text, long, short in zip(*[c.to_pylist() for c in batch.columns]):
            data = text_bytes(text)
            gone = covered(long, match, len(data))
            edges = [0, *(x for ab in gone for x in ab), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])) if gone else data
            rows.append((doc_id, len(data), pairs(gone), pairs(covered(short, passage, len(data))), kept))
            if len(rows) >= 1000:
                yield batch_of(rows)
                rows = []
        yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    return map_batches(joined, run, schema)


def removal_digest(removed: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated (bytes in repeated passages, removed or not) from remove_repeats."""
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return removed.select("doc_id", "n_bytes", total("removed").alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), total("passages").alias("n_repeated"))
