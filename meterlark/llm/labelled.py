"""Bounded samples of labelled documents, and the held-out rule, for the two classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many training documents of either class, those with the smallest hash of the id.
SAMPLE_PER_CLASS = 2000


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def training_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, per_class: int = SAMPLE_PER_CLASS) -> tuple[list[str], list[int], float]:
    """Whole texts, their labels, and the share of label 1 among all allowed rows. The bound is on rows, no text is cut.

    Rows without a label or an id are left out, as are labels of documents that do not exist.
    """
    usable = labels.where(allowed & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).alias("label"))
    share = usable.agg(F.avg("label")).first()[0]
    share = 0.5 if share is None else share
    order = F.xxhash64("doc_id")
    parts = [usable.where(F.col("label") == k).orderBy(order, "doc_id").limit(per_class) for k in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]).dropDuplicates(["doc_id"]))  # at most 2 * per_class rows of two numbers
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "label", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.groupBy("doc_id").agg(F.first("label").alias("label"), F.max("text").alias("text"))  # an id that is there often counts once
    found = sorted(rows.collect(), key=lambda r: r.doc_id)
    return [r.text for r in found], [r.label for r in found], float(share)
