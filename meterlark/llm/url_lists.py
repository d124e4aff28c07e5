"""URL filters: dated list entries against captures, in DataFrame operations only.

A list is a log of entries (pattern, action, listed_at): a pattern is a host, which also covers its subdomains, or a
host with a path prefix that ends at a slash boundary; the action is add or remove. Each pattern's entries become
validity intervals [from, to), and an as-of join holds every capture against the entries active when it was fetched.

Each capture gives its patterns (host suffixes, host with path prefixes; of a numeric address the whole only), which meet the
intervals by pattern. Lists that are small by a count are broadcast, so that captures are not shuffled before they have hit. Beyond that the join is also by slice:
the list's own span of time is cut into SLICES slices, captures after it count to the last, an interval goes to
each slice it touches. So a pattern's history is spread over many keys, Spark can split a hot one, and no capture's time, however
wrong, makes an interval grow beyond SLICES rows.

Defined results: a capture whose URL is null or has no host, or whose time is null, matches nothing and is not
blocked. Entries with a null pattern, time or unknown action are ignored; at equal times a removal comes after an
addition, and a repeated entry changes nothing. Repeated captures give a row each. Host case is ignored, path case
counts. An empty list blocks nothing. Columns beyond those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Up to so many intervals (under 200 bytes each) are broadcast.
BROADCAST_INTERVALS = 200_000
SLICES = 64
#: A host: an address in brackets, or anything up to a port, path, query or fragment.
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)"
ADDRESS = r"^(\[.*\]|\d{1,3}(\.\d{1,3}){3})$"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and closing dot; null if there is none."""
    found = F.regexp_extract(url, HOST, 1)
    return F.nullif(F.rtrim(F.lower(found), F.lit(".")), F.lit(""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)?", 1)


def url_patterns(url: Column) -> Column:
    """Every pattern that covers a URL: each suffix of the host, and the host with each prefix of the path."""
    labels = F.when(host_of(url).rlike(ADDRESS), F.array(host_of(url))).otherwise(F.split(host_of(url), r"\."))
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    steps = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    numbers = F.when(F.size(steps) > 0, F.sequence(F.lit(1), F.size(steps))).otherwise(F.array().cast("array<int>"))
    prefixes = F.transform(numbers, lambda i: F.concat(host_of(url), F.lit("/"), F.array_join(F.slice(steps, 1, i), "/")))
    return F.when(host_of(url).isNotNull(), F.array_distinct(F.concat(suffixes, prefixes)))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(pattern, valid_from, valid_to): when a pattern is on the list; valid_to is null while it still is."""
    host = F.lower(F.substring_index("pattern", "/", 1))
    rest = F.substring(F.rtrim(F.col("pattern"), F.lit("/")), F.length(host) + 1, F.length("pattern"))
    known = entries.where(F.col("pattern").isNotNull() & F.col("listed_at").isNotNull() & F.col("action").isin("add", "remove"))
    known = known.select(F.concat(host, rest).alias("pattern"), "listed_at", (F.col("action") == "add").alias("adds"))
    states = known.groupBy("pattern", "listed_at").agg(F.min("adds").alias("adds"))
    order = Window.partitionBy("pattern").orderBy("listed_at")
    turns = states.withColumn("was", F.coalesce(F.lag("adds").over(order), F.lit(False))).where(F.col("adds") != F.col("was"))
    turns = turns.withColumn("valid_to", F.lead("listed_at").over(order))
    return turns.where("adds").select("pattern", F.col("listed_at").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, entries: DataFrame, slices: int = SLICES, broadcast_intervals: int = BROADCAST_INTERVALS) -> DataFrame:
    """One row per row of ``captures`` (capture_id, url, fetched_at): adds host, blocked, n_active (patterns that cover
    it and are active) and pattern (the longest of those, the last in order of the equally long)."""
    rows = captures.select("capture_id", "url", F.col("fetched_at").cast("timestamp").alias("fetched_at"))
    wanted = rows.where(F.col("fetched_at").isNotNull()).select("url", "fetched_at", F.explode(url_patterns(F.col("url"))).alias("pattern"))
    lives = validity_intervals(entries.select("pattern", "action", F.col("listed_at").cast("timestamp").alias("listed_at")))
    active = (F.col("fetched_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))
    span = lives.agg(F.count("*").alias("n"), F.unix_seconds(F.min("valid_from")).alias("first"), F.unix_seconds(F.greatest(F.max("valid_from"), F.max("valid_to"))).alias("last")).first()
    if span.n <= broadcast_intervals:
        hits = wanted.join(F.broadcast(lives), "pattern")
    else:
        width = max(1, -(-(span.last - span.first + 1) // slices))
        slice_of = lambda at: F.least(F.floor((F.unix_seconds(at) - span.first) / F.lit(width)), F.lit(slices - 1)).cast("int")
        reach = F.sequence(slice_of(F.col("valid_from")), F.coalesce(slice_of(F.col("valid_to")), F.lit(slices - 1)))
        dated = wanted.withColumn("slice", slice_of(F.col("fetched_at"))).where("slice >= 0")
        hits = dated.join(lives.withColumn("slice", F.explode(reach)), ["pattern", "slice"])
    # A pattern's intervals do not overlap, so a hit is there twice only for a repeated capture.
    hits = hits.where(active).select("url", "fetched_at", "pattern").distinct()
    found = hits.groupBy("url", "fetched_at").agg(F.count("*").alias("n_active"), F.max(F.struct(F.length("pattern").alias("n"), "pattern")).alias("best"))
    joined = rows.join(found, ["url", "fetched_at"], "left")
    return joined.select("capture_id", "url", "fetched_at", host_of(F.col("url")).alias("host"), F.col("n_active").isNotNull().alias("blocked"), F.coalesce("n_active", F.lit(0)).alias("n_active"), F.col("best.pattern").alias("pattern"))
