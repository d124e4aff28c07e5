"""Exact dedup: group by a 128-bit content hash, compare bytes inside groups, keep one row of each.

Texts are equal when they are identical after white space (space, tab, LF, VT, FF, CR) is deleted. The row with
the most code points in the original text stays, then the one with the smallest id.

Defined results: a null text counts as empty, so null, empty and blank texts form one group. A null id sorts after
all others. A row repeated with the same id and text counts in ``group_size`` each time, one of its copies stays.
An empty table gives an empty result. Columns beyond id and text are not read. Should different texts share a hash, rows are told
apart by id and text, nulls included, so that each still gives one row and the group of its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, checkpointed, fresh_name, id_arrow, map_batches

#: Up to so many groups of copies (16 bytes of key each) the keys are broadcast to thin the byte comparison's shuffle.
BROADCAST_GROUPS = 500_000


def _mark(whole: bytes) -> int:
    return int.from_bytes(xxhash.xxh64_digest(whole, 42), "big", signed=True)


def _digest(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    points, high, low, sha, mark = [], [], [], [], []
    for text in batch.column(1).to_pylist():
        text = text or ""
        whole = text.encode("utf-8", "surrogatepass")
        body = whole.translate(None, SPACES)
        mark.append(_mark(whole))
        code = xxhash.xxh3_128_digest(body)
        points.append(len(text))
        high.append(int.from_bytes(code[:8], "little", signed=True))
        low.append(int.from_bytes(code[8:], "little", signed=True))
        sha.append(hashlib.sha256(body).hexdigest())
    yield pa.record_batch([batch.column(0), pa.array(points, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(sha, pa.string()), pa.array(mark, pa.int64())], schema=_digest_schema(batch.schema.field(0).type))


def _digest_schema(id_type: pa.DataType) -> pa.Schema:
    return pa.schema([("doc_id", id_type), ("points", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("text_sha256", pa.string()), ("mark", pa.int64())])


def _bodies(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    high, low, marks, bodies = [], [], [], []
    for text in batch.column(1).to_pylist():
        whole = (text or "").encode("utf-8", "surrogatepass")
        body = whole.translate(None, SPACES)
        code = xxhash.xxh3_128_digest(body)
        high.append(int.from_bytes(code[:8], "little", signed=True))
        low.append(int.from_bytes(code[8:], "little", signed=True))
        marks.append(_mark(whole))
        bodies.append(body)
    yield pa.record_batch([batch.column(0), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(marks, pa.int64()), pa.array(bodies, pa.binary())], schema=_body_schema(batch.schema.field(0).type))


def _body_schema(id_type: pa.DataType) -> pa.Schema:
    return pa.schema([("doc_id", id_type), ("h1", pa.int64()), ("h2", pa.int64()), ("mark", pa.int64()), ("body", pa.binary())])


def _groups(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per group: its size and the row that stays."""
    order = F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("mark").alias("mark"))
    return rows.groupBy(*keys).agg(F.sum("copies").alias("group_size"), F.min(order).alias("first"))


def collisions(bodies: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of ``bodies`` whose bytes differ from those of the row that stays in their group.

    The members of a group stream past one row of the other side, so a hot group is split by the skew join.
    """
    kept = F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups
    members = bodies.join(kept.select("h1", "h2", F.col("first.id").alias("keep_id"), F.col("first.mark").alias("keep_mark")), ["h1", "h2"])
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("mark") == F.col("keep_mark"))
    # Written first: Spark splits a hot key of the join below only if its sides come straight from a shuffle.
    keeper = checkpointed(members.where(stays).groupBy("h1", "h2").agg(F.min("body").alias("keep_body")))
    return members.where(~stays).join(keeper, ["h1", "h2"]).where(F.col("body") != F.col("keep_body")).select("doc_id", "h1", "h2", "mark", "body")


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per different row of ``docs``, with how often it is there (copies), its group and whether it is the one that stays.

    ``mark`` is what xxhash64() gives for the text, null taken as empty; with the id it finds the row again.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = id_arrow(narrow)
    digests = map_batches(narrow, _digest, _digest_schema(id_type))
    rows = checkpointed(digests.groupBy("doc_id", "points", "h1", "h2", "text_sha256", "mark").agg(F.count("*").alias("copies")))
    groups = checkpointed(_groups(rows, "h1", "h2"))
    bodies = map_batches(narrow, _bodies, _body_schema(id_type))
    odd = checkpointed(collisions(bodies, groups.where("group_size > 1")))
    keys = ["h1", "h2"]
    if not odd.isEmpty():  # different texts under one hash: those that differ get groups of their own, by their bytes
        own = odd.select(F.col("doc_id").alias("odd_id"), F.col("mark").alias("odd_mark"), F.sha2("body", 256).alias("apart")).distinct()
        same = F.col("doc_id").eqNullSafe(F.col("odd_id")) & (F.col("mark") == F.col("odd_mark"))
        rows = rows.join(own, same, "left").withColumn("apart", F.coalesce("apart", F.lit(""))).drop("odd_id", "odd_mark")
        keys = ["h1", "h2", "apart"]
        groups = _groups(rows, *keys)
    first = (F.col("points") == -F.col("first.less")) & F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("mark") == F.col("first.mark"))
    return rows.join(groups, keys).withColumn("is_first", first)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = decisions(docs, id_col, text_col).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    return rows.select("doc_id", F.col("first.id").alias("keep_id"), "group_size", (F.col("is_first") & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that exact_dedup drops; all columns stay."""
    found = checkpointed(decisions(docs))
    stay_id, stay_mark = fresh_name(docs, "stay_id"), fresh_name(docs, "stay_mark")
    stay = found.where("is_first").select(F.col("doc_id").alias(stay_id), F.col("mark").alias(stay_mark))
    same = F.col("doc_id").eqNullSafe(F.col(stay_id)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(stay_mark))
    kept = docs.join(stay, same, "left_semi")
    return kept if found.where("copies > 1").isEmpty() else kept.dropDuplicates(["doc_id", "text"])
