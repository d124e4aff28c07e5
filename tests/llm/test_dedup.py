from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from fixtures import SF, edge_docs, edge_rows, groups_of, no_docs, plain_components, plain_removal, shingles, table
from meterlark.llm import queries, suffix_build
from meterlark.llm.common import Scratch
from meterlark.llm.exact_dedup import drop_copies, exact_dedup
from meterlark.llm.graph import connected_components
from meterlark.llm.minhash import band_codes, shingle_set, signature
from meterlark.llm.near_dedup import keep_one_of_each, near_duplicates
from meterlark.llm.suffix_build import repeated_starts
from meterlark.llm.suffix_dedup import removal_digest, remove_repeats
from oracle import compare
from pyspark.sql import functions as F


def test_exact_against_sql(spark):
    assert compare(spark, queries.op5_exact_dedup, queries.ORACLES["op5_exact_dedup"], SF) > 0


def test_exact_on_edge_cases(spark):
    rows = [(i, t) for i, t, *_ in edge_rows()]
    got = exact_dedup(edge_docs(spark)).collect()
    assert len(got) == len(rows)
    order = lambda r: (-len(r[1]), r[0] is None, r[0])
    want = []
    for body, members in groups_of(rows).items():
        first = min(members, key=order)
        sha = hashlib.sha256(body.encode()).hexdigest()
        left = 1
        for i, t in sorted(members, key=order):
            want.append((i, first[0], len(members), bool(left) and (i, len(t)) == (first[0], len(first[1])), sha))
            left = 0 if want[-1][3] else left
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got), key=key) == sorted(want, key=key)
    kept = drop_copies(edge_docs(spark))
    assert kept.columns == edge_docs(spark).columns
    assert kept.count() == len(groups_of(rows))
    assert exact_dedup(no_docs(spark)).count() == 0 and drop_copies(no_docs(spark)).count() == 0


def test_exact_tells_hash_collisions_apart(spark, monkeypatch):
    """With a hash that gives one value for all texts, the byte comparison alone has to find the groups."""
    import types

    from meterlark.llm import exact_dedup as module

    one = types.SimpleNamespace(xxh3_128_digest=lambda body: bytes(16), xxh64_digest=module.xxhash.xxh64_digest)
    texts = [(1, "a b"), (2, "ab"), (3, "c"), (4, "c "), (5, "d"), (6, None), (None, "no id"), (None, "no id, another text"), (7, "twice"), (7, "there"), (7, "the re")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    rows = lambda: sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exact_dedup(docs).collect())
    before = rows()
    assert len(before) == len(texts) and sum(r[3] for r in before) == 8
    monkeypatch.setattr(module, "xxhash", one)
    assert rows() == before


@pytest.mark.parametrize("kind", ["smallint", "int", "decimal(10,0)", "string"])
def test_ids_of_other_types(spark, kind):
    docs = spark.createDataFrame([(k, "a b c" if k < 3 else f"text {k}") for k in range(6)], "doc_id bigint, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    got = exact_dedup(docs)
    assert got.schema["doc_id"].dataType == docs.schema["doc_id"].dataType and got.where("kept").count() == 4
    assert drop_copies(docs).count() == 4 and keep_one_of_each(docs).count() == 4


@pytest.mark.parametrize("size,threshold", [(3, 85), (5, 80)])
def test_near_against_all_pairs(spark, size, threshold):
    rows = [(r.doc_id, r.text) for r in table(spark, "documents").collect()]
    want = plain_components(rows, size, threshold)
    got = near_duplicates(table(spark, "documents"), shingle=size, threshold=threshold).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(shingles(t, size)) for i, t in rows}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert sum(i != c for i, c in want.items()) > 3


def near_copies(n: int, seed: int = 3) -> list[tuple[int, str]]:
    """Chains and clusters of texts around the threshold."""
    rng, out = random.Random(seed), []
    text = [f"w{k}" for k in range(150)]
    for k in range(n):
        if k % 40 == 0:
            text = [f"c{k}w{j}" for j in range(150)]
        elif k % 3 == 0:
            text = list(text)
            text[rng.randrange(150)] = f"x{k}"
        else:
            out.append((k, " ".join(w if rng.random() > 0.008 else f"y{k}" for w in text)))
            continue
        out.append((k, " ".join(text)))
    return out


def test_near_in_many_small_units_and_blocks(spark):
    """Tiny limits make every component and bucket too large for one task, as a huge group would."""
    rows = near_copies(160)
    want = plain_components(rows, 3, 85)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = near_duplicates(docs, shingle=3, threshold=85, unit=4, block=3).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert len(set(want.values())) < len(want)


def test_near_on_edge_cases(spark):
    rows = [(i, t) for i, t, *_ in edge_rows()]
    got = near_duplicates(edge_docs(spark), shingle=3, threshold=85).collect()
    assert len(got) == len(rows)
    want = plain_components(rows, 3, 85)
    # Id 9 has two texts, each with links of its own.
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id not in (None, 9)} == {(i, c) for i, c in want.items() if i != 9}
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert [r.component_id for r in got if r.doc_id in (1, 2, 3)] and all(r.component_id == r.doc_id and r.n_shingles == 0 for r in got if r.doc_id in (1, 2, 3))
    assert near_duplicates(no_docs(spark)).count() == 0
    kept = keep_one_of_each(edge_docs(spark), shingle=3, threshold=85)
    assert kept.columns == edge_docs(spark).columns and {1, 2, 3, 4} <= {r.doc_id for r in kept.select("doc_id").collect()}


def test_min_max_signatures_estimate_resemblance():
    a, b = shingle_set(" ".join(f"w{k}" for k in range(1000)), 3), shingle_set(" ".join(f"w{k}" for k in range(150, 1150)), 3)
    same = (signature(a, 64) == signature(b, 64)).mean()
    true = len(set(a) & set(b)) / len(set(a) | set(b))
    assert abs(same - true) < 0.12
    assert len(band_codes(signature(a, 25))) == 25 and (band_codes(signature(a, 25)) == band_codes(signature(a[::-1], 25))).all()


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)]
    root = {x: x for ab in links for x in ab}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    linked = {x for a, b in links if a != b for x in (a, b)}
    got = connected_components(spark.createDataFrame(links, "a bigint, b bigint"), Scratch(spark)).collect()
    assert {(r.node, r.component) for r in got} == {(x, find(x)) for x in linked} and len(got) == len(linked)


@pytest.mark.parametrize("collide", [False, True])
@pytest.mark.parametrize("width", [1, 4])
def test_construction_against_counting(width, collide, monkeypatch):
    """With a hash that has seven values only, the comparison of bytes alone has to number the symbols."""
    hashes = suffix_build.span_hashes
    if collide:
        monkeypatch.setattr(suffix_build, "span_hashes", lambda *a: hashes(*a) % np.uint64(7))
    rng = random.Random(width)
    for _ in range(40):
        strings = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(0, 5))]
        for match, got in zip((8, 4), repeated_starts(strings, (8, 4), width)):
            windows = [s[k : k + match] for s in strings for k in range(len(s) - match + 1)]
            want = [[windows.count(s[k : k + match]) > 1 for k in range(len(s) - match + 1)] for s in strings]
            assert [list(map(bool, f)) for f in got] == want
        limits = [rng.randint(0, 40) for _ in strings]
        for match, got in zip((8, 4), repeated_starts(strings, (8, 4), width, limits)):
            starts = [range(min(n, len(s) - match + 1)) for s, n in zip(strings, limits)]
            windows = [s[k : k + match] for s, at in zip(strings, starts) for k in at]
            want = [[windows.count(s[k : k + match]) > 1 for k in at] for s, at in zip(strings, starts)]
            assert [list(map(bool, f)) for f in got] == want


def plain_digest(rows, match, passage):
    """What removal_digest should give, by counting."""
    shorter = plain_removal(rows, passage)
    return sorted((str(i), n, gone, spans, hashlib.sha256(kept).hexdigest(), less[2]) for (i, n, gone, spans, kept), less in zip(plain_removal(rows, match), shorter))


def digests(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_repeated) for r in df.collect())


def test_repeats_against_counting(spark):
    docs = table(spark, "documents")
    want = plain_digest([(r.doc_id, r.text) for r in docs.collect()], 400, 300)
    assert digests(removal_digest(remove_repeats(docs))) == want
    assert sum(r[2] for r in want) > 0 and all(r[5] >= r[2] for r in want)


@pytest.mark.parametrize("most", [4096, 1])
def test_repeats_with_small_windows(spark, most):
    """``most`` = 1 sends every anchor with several stretches the other way, where windows are counted."""
    rng = random.Random(9)
    words = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(5, 60))).decode() for _ in range(30)]
    rows = [(k, "".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for k in range(80)] + [(90, "ab" * 500), (91, None), (92, "é" * 300)]
    rows += [(None, rows[3][1]), (None, rows[4][1] + "x"), (5, rows[6][1]), (7, rows[7][1]), (7, rows[7][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert digests(removal_digest(remove_repeats(docs, match=40, passage=30, core=10, width=10, lot=500, most=most))) == plain_digest(rows, 40, 30)


def test_repeats_on_edge_cases(spark):
    rows = [(i, t) for i, t, *_ in edge_rows() if not t or len(t) < 100_000]
    docs = edge_docs(spark).where("text is null or length(text) < 100000")
    assert digests(removal_digest(remove_repeats(docs))) == plain_digest(rows, 400, 300)
    assert remove_repeats(no_docs(spark)).count() == 0
    whole = {r.doc_id: r for r in removal_digest(remove_repeats(edge_docs(spark))).collect()}
    assert whole[12].n_removed == whole[12].n_bytes  # the very long text is the other's beginning
