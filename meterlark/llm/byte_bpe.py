"""Byte-level BPE encoding and decoding with Spark's own functions.

A text is split by a pattern, and each match (word) is encoded by itself: it starts as an array of its bytes, and a fold merges, one
pair a step, the leftmost neighbours whose joined bytes have the lowest rank, until no pair has a rank. The ranks are a literal:
an array of small maps, addressed by the hash of the bytes, so that a lookup does not walk all of them.

Words that occur often are folded once, into a dictionary that every task gets as a literal. It holds the most frequent distinct words of a sample of
SAMPLED_DOCS documents, at most DICTIONARY_WORDS of LONGEST_KNOWN bytes each, so its size does not depend on the input. Any other word is folded where it
stands: the sample changes the time, not the ids. Nothing of the texts is shuffled.

Encoded texts are the bytes of their ids (unsigned 32 bit, little-endian). Decoding takes each id's bytes and concatenates them, a batch of documents at a time.

The pattern's classes of letters, numbers and white space are the library's: where the JVM knows another version of Unicode, the
characters that differ are spelt out.

Defined results: null and empty texts have no ids and decode to no bytes. Repeated rows and rows without id are rows like any other. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import Scratch, fresh_name

#: Words of the dictionary at most, bytes of each at most, and documents from which they are taken.
DICTIONARY_WORDS, LONGEST_KNOWN, SAMPLED_DOCS = 500_000, 64, 30_000
SLOT_BITS = 16


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def check_ranks(ranks: dict[bytes, int]) -> None:
    """Raises ValueError unless the ranks count up from 0 and the 256 bytes are among them."""
    if not all(bytes([b]) in ranks for b in range(256)) or sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks have to be 0, 1, 2 and so on, and to include all single bytes")


# The pattern


@lru_cache(maxsize=1)
def library_classes() -> dict[str, frozenset[int]]:
    """The code points that the tokenizer library takes as letters, numbers and white space."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([b]): b for b in range(256)}
    found = {}
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        ids = tiktoken.Encoding("probe", pat_str=name, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)
        found[name] = frozenset(map(ord, bytes(ids).decode()))
    return found


def spelt(points: list[int]) -> str:
    """Code points as the inside of a character class."""
    out, at = [], 0
    while at < len(points):
        end = at
        while end + 1 < len(points) and points[end + 1] == points[end] + 1:
            end += 1
        out.append(rf"\x{{{points[at]:X}}}-\x{{{points[end]:X}}}")
        at = end + 1
    return "".join(out)


def quickly(points: frozenset[int]) -> str:
    """Code points as the inside of a class that looks ranges beyond ASCII up for characters beyond ASCII only: the JVM tries ranges one by one."""
    far = spelt(sorted(p for p in points if p > 127))
    return spelt(sorted(p for p in points if p < 128)) + (rf"[\x{{80}}-\x{{10FFFF}}&&[{far}]]" if far else "")


_JVM_PATTERNS: dict[str, str] = {}


def jvm_pattern(spark: SparkSession, pattern: str) -> str:
    """``pattern`` for the JVM, with \\p{L}, \\p{N}, \\s and \\S as the tokenizer library takes them."""
    if pattern not in _JVM_PATTERNS:
        classes = library_classes()
        points = spark.range(0x110000).where("id < 55296 or id > 57343")  # all but surrogates
        chars = points.withColumn("char", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32"))
        inside = {r"\s": quickly(classes[r"\s"])}
        for name in (r"\p{L}", r"\p{N}"):
            here = frozenset(chars.where(F.col("char").rlike(f"^{name}$")).toArrow().column("id").to_pylist())
            inside[name] = name + quickly(classes[name] - here) if here <= classes[name] else quickly(classes[name])
        _JVM_PATTERNS[pattern] = in_classes(pattern, inside)
    return _JVM_PATTERNS[pattern]


def in_classes(pattern: str, inside: dict[str, str]) -> str:
    """Replaces the named classes, inside brackets and outside of them."""
    out, at, bracket = [], 0, False
    while at < len(pattern):
        name = next((n for n in (*inside, r"\S") if pattern.startswith(n, at)), None)
        if name == r"\S":
            out.append(f"[^{inside[chr(92) + 's']}]")
        elif name:
            out.append(inside[name] if bracket else f"[{inside[name]}]")
        else:
            name = pattern[at : at + 2] if pattern[at] == "\\" else pattern[at]
            bracket = name == "[" or (bracket and name != "]")
            out.append(name)
        at += len(name)
    return "".join(out)


# Literals


def slotted(rows: DataFrame, key: str, value: Column) -> DataFrame:
    """One row with an array of 2 ** SLOT_BITS maps; a key is in the map of its hash. ``rows`` are bounded."""
    maps = rows.groupBy(slot_of(F.col(key)).alias("slot")).agg(F.map_from_entries(F.collect_list(F.struct(F.col(key), value))).alias("found"))
    every = rows.sparkSession.range(1 << SLOT_BITS).select(F.col("id").cast("int").alias("slot")).join(maps, "slot", "left")
    ordered = F.array_sort(F.collect_list(F.struct("slot", "found")), lambda x, y: x["slot"] - y["slot"])
    return every.agg(F.transform(ordered, lambda x: x["found"]).alias("slots"))


def slot_of(key: Column) -> Column:
    return F.shiftrightunsigned(F.hash(key), 32 - SLOT_BITS)


def found_in(slots: Column, key: Column) -> Column:
    return F.try_element_at(F.get(slots, slot_of(key)), key)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def with_tables(rows: DataFrame, tables: Column, name: str, use) -> DataFrame:
    """``rows`` and ``name``: ``use(tables)``. Tables (scalar subqueries) may not stand inside a higher-order function, so they
    are a column first; it is used once, whereupon Spark puts the tables themselves in its place, and no row carries them."""
    at = fresh_name(rows, "tables")
    return rows.withColumn(at, tables).select(*rows.columns, let(F.col(at), use).alias(name))


# The fold


def merged_once(body: Column, state: Column, ranks: Column) -> Column:
    """The state (starts, pairs) after merging the leftmost pair of the lowest rank; as it is if no pair has one."""
    starts, pairs = state["starts"], state["pairs"]
    rank = lambda at, k: found_in(ranks, F.substring(body, F.get(at, k), F.get(at, k + 2) - F.get(at, k)))  # noqa: E731  of pieces k and k + 1; null beyond the ends

    def at_place(place: Column) -> Column:
        k = place - 2
        left = F.array_remove(starts, F.get(starts, k + 1))
        return let(left, lambda at: F.struct(at.alias("starts"), F.concat(F.slice(pairs, 1, k), F.array(rank(at, k - 1), rank(at, k)), F.slice(pairs, place + 2, F.lit(1 << 30))).alias("pairs")))

    return let(F.array_position(pairs, F.array_min(pairs)).cast("int"), lambda place: F.when(place.isNull(), state).otherwise(at_place(place)))


def folded(word: Column, ranks: Column, quads: Column) -> Column:
    """The packed ids (a string of bytes) of a word that is not empty.

    The state of the fold is where each piece starts (and where the last one ends), and the rank of each piece with the next, between two nulls that stand for the ends.
    """

    def fold(body: Column) -> Column:
        length = F.octet_length(body)
        none = F.lit(None).cast("int")
        # substring() takes 0 for 1, so the null in front is one of its own; the one behind is the last byte with nothing after it.
        pairs = F.transform(F.sequence(F.lit(0), length), lambda i: F.when((i > 0) & (i < length), found_in(ranks, F.substring(body, i, F.lit(2)))).otherwise(none))
        begin = F.struct(F.sequence(F.lit(1), length + 1).alias("starts"), pairs.alias("pairs"))
        done = F.aggregate(F.sequence(F.lit(1), length), begin, lambda state, _: merged_once(body, state, ranks))["starts"]
        return let(done, lambda at: F.array_join(F.transform(F.sequence(F.lit(0), F.size(at) - 2), lambda k: F.get(quads, found_in(ranks, F.substring(body, F.get(at, k), F.get(at, k + 1) - F.get(at, k))))), ""))

    return let(word.cast("binary"), fold)


class ByteBpe:
    """A vocabulary of ranks and a split pattern, as literals of one session."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int] | None = None, pattern: str | None = None):
        ranks = ranks or read_ranks(default_ranks())
        check_ranks(ranks)
        self.pattern = jvm_pattern(spark, pattern or default_pattern())
        self.order = sorted(ranks, key=ranks.__getitem__)
        quads = [rank.to_bytes(4, "little") for rank in range(len(self.order))]
        tokens = spark.createDataFrame(pa.table({"id": pa.array(range(len(quads)), pa.int32()), "piece": pa.array(self.order, pa.binary()), "quad": pa.array(quads, pa.binary())}))
        self.ranks = slotted(tokens, "piece", F.col("id")).scalar()
        # Packed ids are joined as strings, which are bytes to Spark, whether or not they are characters.
        self.quads = tokens.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.col("quad").cast("string").alias("quad")))), lambda x: x["quad"])).scalar()

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), F.lit(0))

    def dictionary(self, docs: DataFrame, most: int, sampled: int) -> DataFrame:
        """(word, packed) of frequent words, at most ``most``. Which ones they are changes no result."""
        n = docs.count()
        texts = docs.select("text") if n <= sampled else docs.select("text").sample(fraction=min(1.0, 1.1 * sampled / n), seed=1).limit(sampled)
        seen = texts.select(F.explode(self.words(F.col("text"))).alias("word")).where(F.octet_length("word") <= LONGEST_KNOWN).groupBy("word").count()
        words = seen.orderBy(F.desc("count"), "word").limit(most).select("word").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")
        tables = F.struct(self.ranks.alias("ranks"), self.quads.alias("quads"))
        return Scratch(docs.sparkSession).keep(with_tables(words, tables, "packed", lambda t: folded(F.col("word"), t["ranks"], t["quads"])))

    def encode(self, docs: DataFrame, dictionary_words: int = DICTIONARY_WORDS, sampled_docs: int = SAMPLED_DOCS) -> DataFrame:
        """doc_id and packed (the bytes of its ids) of each text."""
        known = slotted(self.dictionary(docs, dictionary_words, sampled_docs), "word", F.col("packed")).scalar()
        tables = F.struct(known.alias("known"), self.ranks.alias("ranks"), self.quads.alias("quads"))
        encoded = with_tables(docs.select("doc_id", "text"), tables, "packed", lambda t: F.array_join(F.transform(self.words(F.col("text")), lambda w: F.coalesce(found_in(t["known"], w), folded(w, t["ranks"], t["quads"]))), "").cast("binary"))
        return encoded.drop("text")

    def decode(self, encoded: DataFrame) -> DataFrame:
        """Adds ``decoded``, the bytes of the ids that ``packed`` (not null) holds; other columns are kept. An unknown id is an error."""
        order, at = self.order, encoded.columns.index("packed")
        out = StructType([*encoded.schema.fields, StructField("decoded", BinaryType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces = pa.array(order, pa.large_binary())
            for batch in batches:
                found = batch.column(at).cast(pa.large_binary())
                ends = np.frombuffer(found.buffers()[1], np.int64)[found.offset : found.offset + len(found) + 1]
                ids = np.frombuffer(found.buffers()[2] or b"", np.uint32)[ends[0] // 4 : ends[-1] // 4]
                taken = pieces.take(pa.array(ids))
                cuts = np.frombuffer(taken.buffers()[1], np.int64)[(ends - ends[0]) // 4]
                whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(found), [None, pa.py_buffer(cuts.tobytes()), taken.buffers()[2]])
                yield pa.RecordBatch.from_arrays([*batch.columns, whole.cast(pa.binary())], names=[*batch.schema.names, "decoded"])

        return encoded.mapInArrow(run, out)


def encode_and_decode(docs: DataFrame, ranks: dict[bytes, int] | None = None, pattern: str | None = None, **options) -> DataFrame:
    """doc_id, packed (ids as unsigned 32-bit integers, little-endian) and decoded (the bytes of the ids) of each text."""
    bpe = ByteBpe(docs.sparkSession, ranks, pattern)
    return bpe.decode(bpe.encode(docs, **options))


def token_digest(encoded: DataFrame) -> DataFrame:
    """One row per document with the number of ids and digests of ids and decoded bytes."""
    return encoded.select("doc_id", F.expr("octet_length(packed) div 4").cast("bigint").alias("n_tokens"), F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
