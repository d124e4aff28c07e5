"""Phrase collocation mining: the phrases of two to four words whose words belong together, by language.

Texts are cut into words once: a task numbers the words of about SHARD_WORDS words (a shard) and keeps the numbers in the shared folder. Two passes read them:

1. The keys (64-bit hashes) of words and of pairs of neighbouring words are counted by ranges of keys. Those with at least ``least`` occurrences go to a bitset
   of fixed size (8 MB), as no longer phrase is frequent unless all its words and pairs are. Keys that meet keep more than is needed, never less.
2. Depth-limited count tries (phrase_tries.py) whose paths begin and go on only along words and pairs of the bitset; each is serialised in order and cut into
   ranges of prefixes, and a task per range merges its parts. A walk down to a phrase passes the counts of its
   left parts; a phrase's suffix link leads to the phrase without its first word, a join by equality, and gives the counts of its right parts.

Where the ranges of prefixes begin, and how many there are, is taken from paths at a bounded number of places; that balances tasks and changes no result.
A shard is cut once for all ranges, so time grows with the texts. Everything after the
merge is over phrases with at least ``least`` occurrences. The first ``top`` of each language are ranked among hash slices first, so
that a language with most of the phrases is not sorted by one task.

Defined results: a null text counts as empty, a null language as ``und``. Repeated rows count as often as they occur. Languages without a phrase give no row.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import Scratch
from .phrase_tries import BREAK, FILTER_BITS, KEY_BITS, OF_FIRST, OF_LANG, OF_SECOND, Numbered, Path, Shard, frequent_keys, frequent_nodes, merged, mixed, passes, read_part, word_hashes

MOST_WORDS = 4
SHARD_WORDS = 2_000_000
#: Nodes of all shards that a merging task is meant to get, and words whose keys a counting task is.
RANGE_NODES, RANGE_WORDS = 3_000_000, 4_000_000
#: Places of a shard, and shards, from which the first paths of ranges are taken.
SAMPLED_PATHS, SAMPLED_SHARDS = 500, 400
#: Bytes of texts that are cut into words at once.
CUT_BYTES = 8_000_000
SLICES = 64


def texts_by_lang(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def numbered_shards(rows: DataFrame, depth: int, shard_words: int) -> DataFrame:
    """(size, different, shard, paths): how many words each shard has and how many different ones; the words, numbered; some of their paths."""
    schema = pa.schema([("size", pa.int64()), ("different", pa.int64()), ("shard", pa.binary()), ("paths", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard()

        def flush() -> Iterator[pa.RecordBatch]:
            if shard.size:
                found = shard.numbered()
                shard.clear()
                columns = [[len(found.ids)], [len(found.words)], [found.packed()], [found.sampled_paths(SAMPLED_PATHS, depth)]]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            langs, texts = batch.columns
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            k = 0
            while k < len(texts):
                if shard.size >= shard_words:
                    yield from flush()
                most = min(CUT_BYTES, 6 * (shard_words - shard.size)) + (ends[k - 1] if k else 0)
                n = max(1, int(np.searchsorted(ends, most, "right")) - k)
                shard.add_all(langs.slice(k, n), texts.slice(k, n))
                k += n
        yield from flush()

    return rows.mapInArrow(run, from_arrow_schema(schema))


def range_starts(shards: DataFrame, n: int, size: int, different: int, passing: bytes, tasks: int, range_nodes: int) -> list[Path]:
    """The first path of every range but the first one, from paths of at most SAMPLED_SHARDS of ``n`` shards. Any choice is right, a good one is balanced."""
    if n > SAMPLED_SHARDS:
        shards = shards.sample(fraction=min(1.0, 2 * SAMPLED_SHARDS / n), seed=1).limit(SAMPLED_SHARDS)
    filled, sampled, nodes, found = np.frombuffer(passing, np.uint8), 0, 0, set()
    for row in shards.select("paths").collect():
        paths = [tuple(bytes(p).split(BREAK)) for p in row.paths]
        each = np.asarray([len(p) - 1 for p in paths])
        first = np.cumsum(each) - each
        place = np.arange(each.sum()) - np.repeat(first, each)
        langs, words = np.repeat(word_hashes(p[0] for p in paths) * OF_LANG, each), word_hashes(w for p in paths for w in p[1:])
        alive = passes(filled, mixed(langs + words * OF_FIRST))
        alive[1:] &= passes(filled, mixed(langs[1:] + words[:-1] * OF_FIRST + words[1:] * OF_SECOND)) | (place[1:] == 0)
        there = np.minimum.reduceat(np.where(alive, np.repeat(each, each), place), first)
        sampled += len(paths)
        nodes += int((there - 1).clip(min=0).sum())
        found.update(p[: k + 1] for p, k in zip(paths, there.tolist()))
    nodes = different + nodes * size // max(1, sampled)  # of all shards, as if no phrase came twice in one
    ranges = max(1, -(-nodes // range_nodes), min(tasks, nodes // 100_000))
    ordered = sorted(found)
    return sorted({ordered[k * len(ordered) // ranges] for k in range(1, ranges)}) if ordered else []


def frequent_filter(shards: DataFrame, size: int, tasks: int, least: int, range_words: int) -> bytes:
    """The bitset of words and pairs with at least ``least`` occurrences among ``size`` words."""
    wanted = max(1, -(-size // range_words), min(tasks, size // 100_000))
    bits = min(KEY_BITS, (wanted - 1).bit_length())
    schema = pa.schema([("range", pa.int32()), ("keys", pa.binary()), ("times", pa.binary())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                for starts, keys, times in Numbered.unpacked(data.as_py()).counted_keys(bits, least):
                    columns = [pa.Array.from_buffers(pa.binary(), 1 << bits, [None, pa.py_buffer((starts * c.itemsize).astype(np.int32)), pa.py_buffer(c)]) for c in (keys, times)]
                    parts = pa.record_batch([pa.array(np.arange(1 << bits, dtype=np.int32)), *columns], schema=schema)
                    yield parts.filter(pa.array(np.diff(starts) > 0))

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times = defaultdict(list), defaultdict(list)
        for batch in batches:
            for r, some, often in zip(*batch.columns):
                keys[r.as_py()].append(np.frombuffer(some.as_buffer(), np.uint32))
                times[r.as_py()].append(np.frombuffer(often.as_buffer(), np.uint8 if least < 256 else np.uint32))
        for r in list(keys):
            stretch = frequent_keys(np.concatenate(keys.pop(r)), np.concatenate(times.pop(r)), least, bits)
            yield pa.record_batch([pa.array([r], pa.int32()), pa.array([stretch], pa.binary())], names=["range", "stretch"])

    parts = shards.select("shard").mapInArrow(counted, from_arrow_schema(schema))
    found = parts.repartitionById(1 << bits, "range").mapInArrow(stretches, "range int, stretch binary").collect()  # the bitset, 8 MB at most
    passing, each = bytearray(1 << (FILTER_BITS - 3)), 1 << (FILTER_BITS - 3 - bits)
    for r in found:
        passing[r.range * each : (r.range + 1) * each] = r.stretch
    return bytes(passing)


def shard_parts(shards: DataFrame, starts: list[Path], depth: int, passing: bytes) -> DataFrame:
    """(range, part): the tries of all shards, cut."""
    schema = pa.schema([("range", pa.int32()), ("part", pa.binary())])
    shared = shards.sparkSession.sparkContext.broadcast((passing, starts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled, firsts = np.frombuffer(shared.value[0], np.uint8), shared.value[1]
        for batch in batches:
            for data in batch.column(0):
                parts = Numbered.unpacked(data.as_py()).trie(depth, filled).cut(firsts)
                while some := list(islice(parts, 100)):
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)

    return shards.select("shard").mapInArrow(run, from_arrow_schema(schema))


def by_range(parts: DataFrame, starts: list[Path], schema: pa.Schema, rows_of) -> DataFrame:
    """``rows_of(trie, first path)`` over the merged trie of each range; a task holds one range at a time."""
    dealt = parts.repartitionById(len(starts) + 1, "range").sortWithinPartitions("range")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (row for batch in batches for row in zip(batch.column(0), batch.column(1)))
        for r, rows in groupby(each, key=lambda row: row[0].as_py()):
            trie = merged([read_part(part.as_py()) for _, part in rows])
            yield from rows_of(trie, starts[r - 1] if r else None)

    return dealt.mapInArrow(run, from_arrow_schema(schema))


def counted_phrases(shards: DataFrame, least: int = 30, most_words: int = MOST_WORDS, range_nodes: int = RANGE_NODES, range_words: int = RANGE_WORDS) -> DataFrame:
    """lang, words, a (occurrences), lefts (those of its first word, first two words and so on), n (words of the language), for phrases of up to ``most_words`` words with a >= ``least``."""
    n, size, different = shards.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("different"), F.lit(0))).first()
    tasks = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    passing = frequent_filter(shards, size, tasks, least, range_words)
    starts = range_starts(shards, n, size, different, passing, tasks, range_nodes)
    schema = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("a", pa.int64()), ("lefts", pa.list_(pa.int64())), ("n", pa.int64())])

    def phrases(trie, start) -> Iterator[pa.RecordBatch]:
        found = [(path[0].decode(), [w.decode() for w in path[1:]], counts[-1], counts[1:-1], counts[0]) for path, counts in frequent_nodes(trie, least, start)]
        for k in range(0, len(found), 50_000):
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*found[k : k + 50_000]), schema)], schema=schema)

    return by_range(shard_parts(shards, starts, most_words, passing), starts, schema, phrases)


def exact(column: str) -> Column:
    """A count as a decimal, so that products with it stay exact."""
    return F.col(column).cast("decimal(20,0)")


def with_rights(phrases: DataFrame, most_words: int) -> DataFrame:
    """Adds ``rights``: the occurrences of a phrase without its first word, without its first two words, and so on; follows suffix links from short phrases to long ones."""
    rows = phrases.withColumn("phrase", F.array_join("words", " ")).withColumn("suffix", F.array_join(F.slice("words", 2, most_words), " "))
    level = rows.where(F.size("words") == 1).withColumn("rights", F.array().cast("array<bigint>"))
    out = level
    for m in range(2, most_words + 1):
        link = level.select("lang", F.col("phrase").alias("suffix"), F.concat(F.array("a"), "rights").alias("rights"))
        level = rows.where(F.size("words") == m).join(link, ["lang", "suffix"])
        out = out.unionByName(level)
    return out


def lowest_cut(phrases: DataFrame) -> DataFrame:
    """Adds l, r and score of the cut with the lowest score, of equal ones the one after the fewest words."""
    # Decimals, for products beyond 64 bits; ``div`` of them is the whole part.
    cuts = F.expr(
        "array_min(transform(sequence(1, size(lefts)), k -> struct("
        "(2000000 * cast(a as decimal(20,0))) div (cast(lefts[k - 1] as decimal(20,0)) + cast(rights[k - 1] as decimal(20,0))) as score, k as k, lefts[k - 1] as l, rights[k - 1] as r)))"
    )
    return phrases.withColumn("cut", cuts).select("*", "cut.l", "cut.r", "cut.score").drop("cut")


def not_contained(phrases: DataFrame, most_words: int, share: int) -> DataFrame:
    """Leaves out phrases whose words lie inside a longer one with at least ``share`` hundredths of their occurrences."""
    inside = F.expr(
        "flatten(transform(sequence(2, size(words) - 1), m -> transform(sequence(1, size(words) - m + 1), at -> array_join(slice(words, at, m), ' '))))"
    )
    longer = phrases.where(F.size("words") > 2).select("lang", F.col("a").alias("longer"), F.explode(F.array_distinct(inside)).alias("phrase"))
    most = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    met = phrases.join(most, ["lang", "phrase"], "left")
    return met.where(F.coalesce(100 * exact("longer") < share * exact("a"), F.lit(True))).drop("longer")


def mine_phrases(docs: DataFrame, least: int = 30, top: int = 2000, share: int = 80, most_words: int = MOST_WORDS, shard_words: int = SHARD_WORDS, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first ``top`` phrases of each language; ``least`` is at least 1."""
    scratch = Scratch(docs.sparkSession)
    shards = scratch.keep(numbered_shards(texts_by_lang(docs), most_words, shard_words))
    counted = scratch.keep(counted_phrases(shards, least, most_words, **options).repartition("words"))  # few files in place of one for each range
    scratch.drop(shards)
    found = scratch.keep(lowest_cut(with_rights(counted, most_words).where(F.size("words") >= 2)))
    scratch.drop(counted)
    found = not_contained(found, most_words, share).select("lang", "phrase", "a", "l", "r", "n", "score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    slices = Window.partitionBy("lang", "slice").orderBy(*order)
    best = found.withColumn("slice", F.pmod(F.hash("phrase"), F.lit(SLICES))).withColumn("nth", F.row_number().over(slices)).where(F.col("nth") <= top).drop("nth", "slice")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
