"""Periodic runs: stretches of words that repeat with a period, and texts with the repeats taken out.

Heavy/light lag counting. A stretch with period q is an island of matches at lag q: consecutive places whose words equal those q
places on, at least max(q, least - q) of them. So a lag with fewer matches than that in the whole text holds no run.

1. Matches at each lag are counted: for a frequent (heavy) word by the autocorrelation of its places, computed by FFT and rounded to whole
   numbers; for a rare (light) word by the differences of its pairs of places. The split at about sqrt(n) occurrences bounds either
   part by about n * sqrt(n).
2. Lags with enough matches are scanned for islands, in ascending order. A run with period p is also an island at each multiple of p; its matches
   there are taken off those lags' counts, so that a text of one word that repeats needs one scan, not n / 2.
3. An island that equals an earlier one has that one's smaller period and is no run of its own.

A text is handled in one piece by one task, whatever its length; nothing is shuffled, and rows do not depend on each other.

Defined results: null and empty texts have no words, no runs and an empty collapsed text. Repeated rows and rows without id are rows like any
other. An empty table gives an empty result. Other columns are not read, and ids may have any type.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, id_arrow, map_batches

#: Least number of words of a run.
LEAST_WORDS = 12


def word_numbers(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words."""
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    return np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))


def fft_size(n: int) -> int:
    """The least of 2^k and 3 * 2^k that is not below n."""
    power = 1 << (n - 1).bit_length()
    return power * 3 // 4 if power >= 4 and power * 3 // 4 >= n else power


def lag_matches(ids: np.ndarray, most: int) -> np.ndarray:
    """How many places have the same word ``lag`` places on, for each lag from 0 (left at 0) to ``most``."""
    n = len(ids)
    matches = np.zeros(most + 1, np.int64)
    often = np.bincount(ids)
    heavy = max(16, int(n**0.5))
    places = np.argsort(ids, kind="stable")
    light = places[often[ids[places]] <= heavy]
    words = ids[light]
    for step in range(1, heavy):  # pairs that are ``step`` occurrences apart
        same = np.flatnonzero(words[step:] == words[:-step])
        if not len(same):
            break
        lags = light[same + step] - light[same]
        matches += np.bincount(lags[lags <= most], minlength=most + 1)
    frequent = np.flatnonzero(often > heavy)
    if len(frequent):
        size = fft_size(n + most)
        power = np.zeros(size // 2 + 1)
        for word in frequent:
            there = np.fft.rfft(ids == word, size)
            power += there.real**2 + there.imag**2
        matches += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
    matches[0] = 0
    return matches


def islands(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the stretches of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
    return edges[::2], edges[1::2]


def runs_of(ids: np.ndarray, least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    n = len(ids)
    most = n // 2
    if n < least or most < 1:
        return []
    matches = lag_matches(ids, most)
    lags = np.arange(most + 1)
    needed = np.maximum(lags, least - lags)
    found: dict[tuple[int, int], int] = {}
    for q in np.flatnonzero(matches >= needed).tolist():
        if q == 0 or matches[q] < needed[q]:  # smaller periods account for its matches
            continue
        starts, ends = islands(ids[:-q] == ids[q:])
        long = ends - starts >= needed[q]
        for start, end in zip(starts[long].tolist(), ends[long].tolist()):
            length = end - start + q
            if found.setdefault((start, length), q) == q:
                rest = np.arange(2 * q, min(length, most + 1), q)
                matches[rest] -= length - rest
    return sorted(((start, length, q) for (start, length), q in found.items()), key=lambda r: (r[0], r[2]))


def dropped_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """True for each word that a run contains after the run's first period."""
    marks = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        marks[start + q] += 1
        marks[start + length] -= 1
    return np.cumsum(marks[:n]) > 0


def find_runs(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed: the words without repeats, joined by one space."""
    narrow = docs.select("doc_id", "text")
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("doc_id", id_arrow(narrow)), ("n_words", pa.int64()), ("runs", pa.list_(run)), ("collapsed", pa.string())])

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes, runs, collapsed = [], [], []
        for text in batch.column(1):
            words = (text.as_py() or "").encode().split()  # at space, tab, line feed, vertical tab, form feed and carriage return alone
            found = runs_of(word_numbers(words), least)
            if found:
                gone = dropped_words(len(words), found).tolist()
                words, n = [w for w, g in zip(words, gone) if not g], len(words)
            else:
                n = len(words)
            sizes.append(n)
            runs.append([{"start": s, "length": m, "period": q} for s, m, q in found])
            collapsed.append(b" ".join(words).decode())
        yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(runs, schema.field(2).type), pa.array(collapsed, pa.string())], schema=schema)

    return map_batches(narrow, work, schema)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, a tenth of the documents with a period planted from some word on: word i >= a is word a + (i - a) % p of the original."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("h")).withColumn("g", F.floor(F.col("h") / 10).cast("bigint"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))

    def moved(w: Column) -> Column:
        n = F.size(w).cast("bigint")
        a = F.pmod(F.col("g"), n)
        p = F.floor((n - a) / (F.lit(3) + F.pmod("g", F.lit(8)))).cast("bigint") + 1
        place = F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)))
        return F.when(n > 0, F.array_join(F.transform(place, lambda i: F.get(w, i.cast("int"))), " "))

    # An array of one element gives the words a name, so that they are taken from the text once.
    text = F.when(F.pmod("h", F.lit(10)) == 0, F.get(F.transform(F.array(words), moved), F.lit(0))).otherwise(F.col("text"))
    return rows.select("doc_id", text.alias("text"))


def run_digest(found: DataFrame) -> DataFrame:
    """One row per document: the number of runs, the longest one, and digests of all runs and of the collapsed text."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.p")).alias("period"),
        F.expr("(1000 * best.length) div (-best.p)").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
