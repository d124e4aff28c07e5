"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame operations only.

A text's shingles are its runs of SHINGLE words (white space apart, case kept); with fewer words the whole sequence
is the one shingle. A sketch is the K smallest distinct 64-bit hashes (as signed numbers) in ascending order, so
sketches of parts merge by union. Two sketches estimate resemblance and containment, one the number of distinct shingles.

Defined results: a null or blank text has an empty sketch; two empty sketches are alike (1.0), an empty and another
are not (0.0). Repeated rows have equal sketches. Ids order descending, null last, rows of equal id by text
descending; the document after the last is the first, so a lone document follows itself. An empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS

K = 128
SHINGLE = 5
#: Rows in a stretch of the id order, and at most so many stretches; their bounds are one literal in the plan.
STRETCH_ROWS = 2000
MOST_STRETCHES = 10_000


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")


def shingle_hashes(tokens: Column, size: int = SHINGLE) -> Column:
    """Hashes of the runs of ``size`` words, with repeats."""
    n = F.size(tokens)
    run = lambda i: F.xxhash64(*[F.get(tokens, i + j) for j in range(size)])
    short = F.array(F.xxhash64(F.array_join(tokens, " ")))
    return F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), run)).when(n > 0, short).otherwise(F.array().cast("array<bigint>"))


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K, size: int = SHINGLE) -> Column:
    """The sketch of one text."""
    return bottom(F.transform(F.array(words(text)), lambda w: shingle_hashes(w, size))[0], k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts taken together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_sketches(df: DataFrame, keys: list[str], sketch_col: str = "sketch", k: int = K) -> DataFrame:
    """The sketch of each group's parts together. Each task keeps k hashes of a group before rows are shuffled."""
    rows = df.select(*keys, F.explode(sketch_col).alias("h")).distinct()
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("h"))).where(F.col("n") <= k)
    found = first.groupBy(*keys).agg(F.sort_array(F.collect_list("h")).alias(sketch_col))
    return df.select(*keys).distinct().join(found, keys, "left").withColumn(sketch_col, F.coalesce(sketch_col, F.array().cast("array<bigint>")))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated size of the intersection of two shingle sets over that of their union."""
    both = merged(a, b, k)
    common = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(common / F.size(both))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    part = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / part)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of the first that are in the second."""
    j, n, m = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j / (1 + j) * (n + m) / n))


def as_text(a: Column) -> Column:
    return F.array_join(a.cast("array<string>"), ",")


def stretch_of(sid: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds lie below an id, by halving."""
    if not bounds:
        return F.lit(0)
    steps, jump = [], 1
    while jump <= len(bounds):
        steps.insert(0, jump)
        jump *= 2
    table = F.from_json(F.lit(json.dumps(bounds)), "array<bigint>")
    nearer = lambda low, step: F.when(F.get(table, low + step - 1) < sid, low + step).otherwise(low)
    return F.aggregate(F.from_json(F.lit(json.dumps(steps)), "array<int>"), F.lit(0), nearer)


def with_next(docs: DataFrame, stretch_rows: int = STRETCH_ROWS) -> DataFrame:
    """Rows (sid, doc_id, text, stretch, ghost) dealt by stretch of the id order, for a window that looks at the next document.

    In each stretch a ghost, the first document of the following stretch, comes last.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("sid"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = rows.count()
    stretches = max(1, min(MOST_STRETCHES, -(-n // stretch_rows)))
    bounds: list[int] = []
    if stretches > 1:
        shares = [i / stretches for i in range(1, stretches)]
        bounds = sorted(set(rows.agg(F.percentile_approx("sid", shares, 100_000)).first()[0]))
    rows = rows.withColumn("stretch", stretch_of(F.col("sid"), bounds))
    tops = sorted(((r.stretch, r.top) for r in rows.groupBy("stretch").agg(F.max("sid").alias("top")).collect()), reverse=True)  # at most MOST_STRETCHES rows
    pairs = [(tops[(i + 1) % len(tops)][1], tops[i][0]) for i in range(len(tops))]
    edges = docs.sparkSession.createDataFrame(pairs, "sid bigint, target int")
    ghosts = rows.drop("stretch").join(F.broadcast(edges), "sid").select("sid", "doc_id", "text", F.col("target").alias("stretch"), F.lit(True).alias("ghost"))
    return rows.withColumn("ghost", F.lit(False)).unionByName(ghosts)


def fingerprint_edits(docs: DataFrame, k: int = K, size: int = SHINGLE) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how alike it is to that and to the next document.

    The edited text has the last third of the code points replaced by as many (or all) of the next document's first.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = with_next(docs).repartition(parts, "stretch").withColumn("fp", sketch(F.col("text"), k, size))
    order = Window.partitionBy("stretch").orderBy("ghost", F.desc("sid"), F.desc("text"))
    looked = dealt.withColumn("next_text", F.lead("text").over(order)).withColumn("next_fp", F.lead("fp").over(order)).where(~F.col("ghost"))
    n = F.length("text")
    part = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - part), F.substring("next_text", F.lit(1), part))
    looked = looked.select("doc_id", n.cast("bigint").alias("n_chars"), edited.alias("edited"), "fp", "next_fp")
    done = looked.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fp", sketch(F.col("edited"), k, size).alias("edited_fp"), "next_fp")
    return done.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        resemblance(F.col("fp"), F.col("edited_fp"), k).alias("near_edited"), resemblance(F.col("fp"), F.col("next_fp"), k).alias("near_next"),
        distinct_shingles(F.col("fp"), k).alias("shingles"),
    )
