"""A corpus pipeline: quality filter, exact dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents, and bear further columns of any name and ids of any integer or
decimal type. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meterlark.llm import quality
from meterlark.llm.common import new_folder, remove_folder
from meterlark.llm.exact_dedup import drop_copies
from meterlark.llm.near_dedup import keep_one_of_each
from meterlark.llm.packing import pack_documents
from meterlark.llm.source_mixing import mixed_documents


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (a score under 0.3) go. Null and empty texts are scored like any other; rows that repeat an id and text go or stay together."""
    return quality.keep_quality(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays: the one with the most characters, then the smallest id, null last. Null, empty and blank texts are equal to each other."""
    return drop_copies(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingles of five words and a similarity of 0.8 the one with the smallest id stays. Texts without words and rows without an id stay."""
    return keep_one_of_each(docs, shingle=5, threshold=80)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (not at all, once or twice). A null source is a source; a text without words has size 0 and takes part."""
    return mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document, with its sequence and place. A null or empty text is one piece of one token; repeated rows are packed each on its own."""
    return pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: No SQL: the classifier, the near-duplicate search and the tokenizer have none. tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after another, on documents; each result is written to the shared folder, and removed when the next one is there."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_folder(spark, before)
        before = path
    return docs
