"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Each source gets a target in words. A document's expected copies are target / size of its source; they are
prefix-summed in the source's order, one random offset per source is added, and a document is emitted once for each
integer boundary its stretch of the sum crosses. In a source all documents expect the same number of copies, so the
prefix sum is rate * rank, and it is split: counts by (source, stratum) give each stratum its start, a window inside
a stratum gives the rest. Strata are size class by hash bucket, so that a source or a size that holds a third of all
rows is spread over many window partitions. Sampling in the order of size keeps the words taken near the target.

Targets: sources in code point order (null last) weigh 3, 1, 2, repeating, and share ``total_share`` of all words;
a target stops at ``most`` times the source's size, the excess goes to the others by weight until none is above.

Defined results: a null or blank text has size 0, is ranked like any other and takes 0 words. A null source is a
source. Rows are ranked by id, size and a hash of the text; rows that are the same in these are ranked one after another and may take different
numbers of copies. The result does not depend on the order in which rows come. With no words at all
every target is 0. An empty table gives an empty result. Columns beyond id, text and source are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from .common import WORD, checkpointed, fresh_name

#: Hash buckets of each size class, hex digits of the id's md5; 2 digits are 256 buckets.
BUCKET_DIGITS = 2
WEIGHTS = (3, 1, 2)


def size_class(size: Column) -> Column:
    """Sorts as the size does; sizes that share their leading four bits and their length in bits share a class."""
    bits = F.bin(size)
    return F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.substring(bits, 1, 4))


def unit_hash(text: Column) -> Column:
    """A number in [0, 1) drawn from the md5 of a string."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total_share: float = 1.5, most: float = 2.0) -> DataFrame:
    """From rows with source and source_size, one per source: adds ``target``. Windows run over sources, not documents."""
    every = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source")))
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (((rank - 1) % len(weights)) + 1).cast("int")).cast("double"))
    weighed = weighed.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("words", F.sum("source_size").over(every))
    # Sources fill up in the order of cap / weight: before the level of one is known, those before it are full.
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("words") * F.lit(total_share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    weighed = weighed.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("weight") * F.col("level"))
    # Levels fall after the first source that is not full, so that one's level is the largest of those not full.
    weighed = weighed.withColumn("final", F.max(F.when(~F.col("full"), F.col("level"))).over(every))
    return weighed.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * F.col("final"))).drop("weight", "cap", "words", "level", "full", "final")


def solid_key(column: Column) -> Column:
    """A join and window key without nulls: null has a value of its own."""
    return F.coalesce(F.concat(F.lit("v"), column.cast("string")), F.lit("n"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def text_mark(text: Column) -> Column:
    """A hash of a text: in the order of id, size and this, only rows that are the same in all that counts are tied."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def mix_sources(docs: DataFrame, seed: str = "mix-1", weights: tuple[int, ...] = WEIGHTS, total_share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken."""
    return _mixed(docs.select("doc_id", "source", "text"), seed, weights, total_share, most).drop("mark", "nth")


def _mixed(docs: DataFrame, seed: str = "mix-1", weights: tuple[int, ...] = WEIGHTS, total_share: float = 1.5, most: float = 2.0) -> DataFrame:
    """mix_sources() with ``mark``, the text's hash, and ``nth``, which of the rows of one source, id, size and mark a row is."""
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), text_mark(F.col("text")).alias("mark"), solid_key(F.col("source")).alias("src"))
    # Rows without an id are spread by their texts; rows that are the same in all are one bucket only if they are one document again and again.
    bucket = F.substring(F.md5(F.coalesce(F.concat(F.lit("v"), F.col("doc_id").cast("string")), F.concat(F.lit("n"), "mark"))), 1, BUCKET_DIGITS)
    rows = checkpointed(rows.withColumn("stratum", F.concat(size_class(F.col("size")), bucket)))
    strata = checkpointed(rows.groupBy("src", "source", "stratum").agg(F.count("*").alias("n"), F.sum("size").alias("words")))
    targets = source_targets(strata.groupBy("src", "source").agg(F.sum("n").alias("n_docs"), F.sum("words").alias("source_size")), weights, total_share, most)
    before = Window.partitionBy("src").orderBy("stratum").rowsBetween(Window.unboundedPreceding, -1)
    strata = strata.select("src", "stratum", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")).join(targets.drop("source"), "src")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("src", "stratum").orderBy("doc_id", "size", "mark"))).join(strata, ["src", "stratum"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = unit_hash(F.concat(F.lit(seed + "|"), F.col("src")))
    upto = lambda n: F.floor(n * rate + offset)
    ranked = ranked.withColumn("place", F.col("start") + F.col("rank")).withColumn("copies", (upto(F.col("place")) - upto(F.col("place") - 1)).cast("bigint"))
    nth = F.row_number().over(Window.partitionBy("src", "stratum", "doc_id", "size", "mark").orderBy(F.desc("copies")))
    return ranked.withColumn("nth", nth).select("doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"), "copies", (F.col("copies") * F.col("size")).alias("taken"), "mark", "nth")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as mixed: each row as often as it is taken. Rows that repeat an id are told apart by source and text; of rows that are the same in these, any takes the place of any other."""
    names = [fresh_name(docs, c) for c in ("mix_id", "mix_source", "mix_mark", "mix_nth", "mix_copies", "mix_copy")]
    key, source, mark, nth, times, copy = names
    found = _mixed(docs.select("doc_id", "source", "text"), **options).where("copies > 0")
    copies = found.select(solid_key(F.col("doc_id")).alias(key), solid_key(F.col("source")).alias(source), F.col("mark").alias(mark), F.col("nth").alias(nth), F.col("copies").alias(times))
    same = [key, source, mark]
    numbered = docs.withColumns({key: solid_key(F.col("doc_id")), source: solid_key(F.col("source")), mark: text_mark(F.col("text"))})
    rest = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if not isinstance(docs.schema[c].dataType, (MapType, VariantType))])
    numbered = numbered.withColumn(nth, F.row_number().over(Window.partitionBy(*same).orderBy(rest)))
    taken = numbered.join(copies, [*same, nth])
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("bigint"), times))).select(*docs.columns)
