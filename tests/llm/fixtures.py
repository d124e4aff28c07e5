"""Small tables with the cases that every operator has to bear, and plain versions to hold results against."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
#: Names that operators use inside.
CLASH = "size rank anchor label score copies mark stratum fp h1 h2 key copy n rep component code items bands piece start length sid stretch ghost src whole kinds gone_id stay_id stay_mark STAY_MARK_ mix_key mix_nth mix_copies mix_copy mark_ keep_id".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def texts() -> list[str | None]:
    base = " ".join(f"word{k} other{k % 7}" for k in range(120))
    long = " ".join(f"long{k % 997} t{k % 13}" for k in range(60_000))
    return [
        None, "", " \t\n", "one", "one two", "ÄÖ ünï 漢字 🎉 text", base, base, base + " tail", base.replace("word5 ", "word5  "), base.upper(), long, long + " end", "x" * 5000,
        "a b c d e f g", "a b c d e f h", "\x0b\x0c" + base, "don't 'll 12 345 !!  \n\n x y", "<|endoftext|> special", "  line", "A" * 399, "B" * 401,
    ]


def edge_rows() -> list[tuple]:
    rows = [(k + 1, t, "en" if k % 3 else None, ("s" + str(k % 3)) if k % 4 else None, None) for k, t in enumerate(texts())]
    rows += [(7, texts()[6], "en", "s2", 1), (7, texts()[6], "en", "s2", 1)]  # rows repeated
    rows += [(None, "no id at all here", None, None, None), (None, texts()[6], None, "s1", 3), (9, "one id, another text", "de", "s0", 2)]
    return rows


def edge_docs(spark: SparkSession, clash: bool = True) -> DataFrame:
    docs = spark.createDataFrame(edge_rows(), SCHEMA).repartition(5)
    return docs.withColumns({c: F.lit("?") for c in CLASH}) if clash else docs


def no_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def table(spark: SparkSession, name: str, sf: str = SF) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lower_ascii(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def shingles(text: str | None, size: int) -> frozenset:
    words = WORDS.findall(lower_ascii(text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1)))


def plain_components(rows: list[tuple], size: int, threshold: int) -> dict[int, int]:
    """The smallest id that each id reaches over links of 100 * intersection >= threshold * union, by trying all pairs."""
    sets = [(i, shingles(t, size)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            if s and t and 100 * len(s & t) >= threshold * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}


def plain_removal(rows: list[tuple], match: int) -> list[tuple]:
    """(id, bytes, removed, spans, kept) by counting every string of ``match`` bytes."""
    bodies = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + match] for _, b in bodies for k in range(len(b) - match + 1))
    out = []
    for i, b in bodies:
        gone = [False] * len(b)
        end = 0
        for k in range(len(b) - match + 1):
            if seen[b[k : k + match]] > 1:
                for x in range(max(k, end), k + match):
                    gone[x] = True
                end = k + match
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def groups_of(rows: list[tuple]) -> dict[str, list[tuple]]:
    by = defaultdict(list)
    for i, t in rows:
        by[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    return by
