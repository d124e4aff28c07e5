"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, few_parts

MOST_ROUNDS = 60


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _large_star(links: DataFrame, rows: int) -> DataFrame:
    """Links each node's larger neighbours to the smallest of the node and its neighbours."""
    sides = _both_ways(links)
    least = few_parts(sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), rows)
    return few_parts(few_parts(sides.where("v > u").join(least, "u"), rows).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), rows)


def _small_star(links: DataFrame, rows: int) -> DataFrame:
    """Links each node and its smaller neighbours to the smallest of those."""
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = few_parts(down.groupBy("u").agg(F.min("v").alias("m")), rows)
    moved = few_parts(down.join(least, "u"), rows).where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return few_parts(moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), rows)


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its smallest node. No links, no rows.

    Each round is written to the shared folder, and the one before it removed. It ends when a round changes nothing; then
    every node links to its smallest. A round over few links runs in few tasks.
    """
    state = lambda df: tuple(df.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first())
    now = scratch.keep(links.where("a <> b").select("a", "b").distinct())
    before = state(now)
    for _ in range(MOST_ROUNDS):
        large = scratch.keep(_large_star(now, before[0]))
        scratch.drop(now)
        now = scratch.keep(_small_star(large, before[0]))
        scratch.drop(large)
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components not found in {MOST_ROUNDS} rounds")
    smallest = now.groupBy(F.col("b").alias("node")).agg(F.min("b").alias("component"))
    found = scratch.keep(few_parts(now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(smallest), before[0]))
    scratch.drop(now)
    return found
