"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text is lower-cased (A-Z) with a space at either end; its features are the n-grams of 4 to 7 characters (code points) that
occur in it, hashed to 2**20 cells. A feature's ratio is the log of the smoothed shares of toxic and clean training documents that
have it; features whose ratio or count says little are left out. A logistic regression then learns a weight for
each scaled feature. It is fitted on a bounded sample of labelled rows (SAMPLE_PER_CLASS of either class), and its
intercept is corrected for the share of toxic rows among all rows it may learn from.

Defined results: null and empty texts get the score of a text without features. Every row gets a score; repeated
rows get equal ones. With no labelled rows, or only one class, every score is that share (0.5 without any rows). A
null id counts as not held out. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import id_arrow
from .labelled import SAMPLE_PER_CLASS, remainder, training_sample

ORDERS = (4, 5, 6, 7)
BITS = 20
MIN_DOCS = 3
MIN_RATIO = 1.0
#: A ratio counts if it is so many times its standard error.
MIN_Z = 2.7
#: Characters hashed at once, so that a very long text needs no more memory than a short one.
STRETCH = 1 << 20


def text_points(text: str | None) -> np.ndarray:
    points = np.frombuffer(f" {text or ''} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where((points >= 65) & (points <= 90), points + np.uint32(32), points)


def cells(data: np.ndarray) -> Iterator[np.ndarray]:
    """The cell of each n-gram, an array for each order."""
    x = data + np.uint32(1)
    h = x
    for n in range(2, max(ORDERS) + 1):
        if len(x) < n:
            return
        h = h[: len(x) - n + 1] * np.uint32(0x01000193) ^ x[n - 1 :] * np.uint32(0x9E3779B1)
        if n in ORDERS:
            yield ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(n)) >> np.uint32(32 - BITS)


def stretches(data: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of a text that overlap by one n-gram."""
    for at in range(0, max(1, len(data) - max(ORDERS) + 1), STRETCH):
        yield data[at : at + STRETCH + max(ORDERS) - 1]


def features(data: np.ndarray, used: np.ndarray) -> np.ndarray:
    """The cells of a text that are in use, each once."""
    found = [c[used[c]] for part in stretches(data) for c in cells(part)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint32)


@dataclass
class Model:
    weights: np.ndarray
    intercept: float

    def score(self, text: str | None, used: np.ndarray) -> float:
        total = self.intercept + float(self.weights[features(text_points(text), used)].sum())
        return 1.0 / (1.0 + float(np.exp(-np.clip(total, -30, 30))))


def fit(texts: list[str], labels: list[int], share: float, passes: int = 200, rate: float = 0.5, penalty: float = 1e-4) -> Model:
    """The classifier for a sample; ``share`` is the share of label 1 where the sample comes from."""
    y = np.asarray(labels, dtype=np.float64)
    size = 1 << BITS
    logit = lambda p: float(np.log(max(p, 1e-6) / max(1 - p, 1e-6)))
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros(size, np.float32), logit(share))
    every = np.ones(size, dtype=bool)
    counts = np.zeros((2, size), dtype=np.int32)
    for text, label in zip(texts, labels):
        counts[label][features(text_points(text), every)] += 1
    n = np.array([(y == 0).sum(), y.sum()])
    ratio = np.log((counts[1] + 0.5) / (n[1] + 1.0)) - np.log((counts[0] + 0.5) / (n[0] + 1.0))
    error = np.sqrt(1.0 / (counts[0] + 0.5) + 1.0 / (counts[1] + 0.5))
    used = (counts.sum(0) >= MIN_DOCS) & (np.abs(ratio) >= np.maximum(MIN_RATIO, MIN_Z * error))
    rows = [features(text_points(t), used) for t in texts]
    index = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    value = ratio[index]
    w, b, seen = np.full(size, 0.01), logit(y.mean()), np.full(size, 1e-8)
    for _ in range(passes):  # full-batch gradient steps with a rate of its own for each feature
        z = b + np.bincount(owner, w[index] * value, minlength=len(rows))
        slope = (1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        grad = np.bincount(index, slope[owner] * value, minlength=size) + penalty * w * used
        seen += grad * grad
        w -= rate * 0.1 * grad / np.sqrt(seen)
        b -= rate * slope.sum()
    return Model((w * ratio * used).astype(np.float32), b + logit(share) - logit(y.mean()))


def train(docs: DataFrame, labels: DataFrame, held_mod: int = 4, held: int = 2, per_class: int = SAMPLE_PER_CLASS, **options) -> Model:
    """The classifier for labelled rows that are not held out; ``options`` go to fit()."""
    allowed = remainder(F.col("doc_id"), held_mod) != held
    return fit(*training_sample(docs, labels, "toxic", allowed, per_class), **options)


def score_toxicity(docs: DataFrame, model: Model, threshold: float = 0.3, held_mod: int = 4, held: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted. One scan, no shuffle."""
    narrow = docs.select("doc_id", "text")
    id_type = id_arrow(narrow)
    schema = pa.schema([("doc_id", id_type), ("score", pa.float64())])
    at = np.flatnonzero(model.weights)
    values, intercept = model.weights[at], model.intercept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(1 << BITS, np.float32)
        weights[at] = values
        used, own = weights != 0, Model(weights, intercept)
        for batch in batches:
            scores = [own.score(t, used) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64())], schema=schema)

    scored = narrow.mapInArrow(run, from_arrow_schema(schema))
    held_out = F.coalesce(remainder(F.col("doc_id"), held_mod) == held, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
