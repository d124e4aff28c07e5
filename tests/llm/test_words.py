"""Periodic runs, phrases and byte-level BPE, against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from fixtures import SF, WORDS, edge_docs, edge_rows, no_docs, table
from meterlark.llm import phrase_tries as tries
from meterlark.llm import queries
from meterlark.llm.byte_bpe import ByteBpe, default_pattern, default_ranks, encode_and_decode, library_classes, read_ranks, token_digest
from meterlark.llm.periodic_runs import find_runs, lag_matches, run_digest, runs_of, word_numbers
from meterlark.llm.phrases import mine_phrases
from oracle import compare
from pyspark.sql import functions as F

# Periodic runs


def plain_runs(words: list, least: int = 12) -> list[tuple[int, int, int]]:
    found = []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            part = words[i : j + q]
            if j > i and len(part) >= max(least, 2 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                found.append((i, len(part), q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted_words(doc_id, words: list) -> list:
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


@pytest.mark.parametrize("seed", range(4))
def test_runs_against_trying_all(seed):
    rng = random.Random(seed)
    for _ in range(150):
        n, kinds = rng.choice([0, 1, 11, 12, 13, 40, 90]), rng.choice([1, 2, 3, 30])
        words = [rng.randrange(kinds) for _ in range(n)]
        if n and rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randint(3, 10)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        assert runs_of(np.array(words, np.int64)) == plain_runs(words)


def test_lags_of_heavy_and_light_words():
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.zipf(1.5, 900) % 40, rng.integers(0, 500, 300)]).astype(np.int64)
    want = [0] + [int((ids[:-q] == ids[q:]).sum()) for q in range(1, 601)]
    assert lag_matches(ids, 600).tolist() == want
    assert runs_of(np.zeros(100_000, np.int64)) == [(0, 100_000, 1)]


def run_row(doc_id, words: list) -> tuple:
    runs = plain_runs(words)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(kept)


def test_run_query_against_plain(spark):
    docs = table(spark, "documents").select("doc_id", "text").collect()
    short = [r for r in docs if len(r.text or "") < 6000]  # the plain version takes the square of a text
    want = {r.doc_id: run_row(r.doc_id, planted_words(r.doc_id, WORDS.findall(r.text or ""))) for r in short}
    got = {r.doc_id: tuple(r) for r in queries.op11_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs) and sum(w[1] for w in want.values()) > 10
    assert {k: got[k] for k in want} == want


def test_runs_of_odd_rows(spark):
    got = sorted(map(repr, map(tuple, run_digest(find_runs(edge_docs(spark))).collect())))
    rows = [(r[0], WORDS.findall(r[1] or "")) for r in edge_rows()]
    small = [run_row(i, w) for i, w in rows if len(w) < 1000]
    assert len(got) == len(rows) and all(got.count(repr(r)) == [repr(x) for x in small].count(repr(r)) for r in small)
    assert find_runs(no_docs(spark)).count() == 0


# Phrases


def test_phrases_against_sql(spark):
    assert compare(spark, queries.QUERIES["op12_phrases"], queries.ORACLES["op12_phrases"], SF) > 0


def plain_phrases(rows: list[tuple], least: int, top: int) -> list[tuple]:
    counts, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            counts.update((lang, *words[i : i + m]) for m in range(1, 5) for i in range(len(words) - m + 1))
    many = {p: a for p, a in counts.items() if a >= least and len(p) > 2}
    out = []
    for path, a in many.items():
        lang, words = path[0], path[1:]
        inside = [b for p, b in many.items() if p[0] == lang and len(p) > len(path) and any(p[k : k + len(words)] == words for k in range(1, len(p)))]
        if any(100 * b >= 80 * a for b in inside):
            continue
        cuts = [(2_000_000 * a // (counts[(lang, *words[:k])] + counts[(lang, *words[k:])]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, " ".join(words), a, counts[(lang, *words[:k])], counts[(lang, *words[k:])], n[lang], score))
    best = []
    for lang in {r[0] for r in out}:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        best += [(lang, rank + 1, *r[1:]) for rank, r in enumerate(mine[:top])]
    return sorted(best)


def phrase_rows(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    words = ["a", "B", "c,", "dé", "e\x0b", "f;g", "\x00", "h\xa0i", "漢", "Ä", "x\ty", "."]
    rows = [(rng.choice(["en", None, "de", "", "a\nb", "und", "a"]), " ".join(rng.choices(words, range(12, 0, -1), k=rng.randrange(30)))) for _ in range(120)]
    return rows + [("en", None), (None, ""), ("de", " \t\n"), ("en", "a b a " * 200)] * 2


@pytest.mark.parametrize("shard_words, range_nodes", [(3_000_000, 1_500_000), (50, 400)])
def test_phrases_over_many_shards_and_ranges(spark, shard_words, range_nodes):
    rows = phrase_rows(7)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5).withColumns({c: F.lit("?") for c in ("phrase", "a", "words", "range", "part", "rank", "slot")})
    got = mine_phrases(docs, least=5, top=60, shard_words=shard_words, range_nodes=range_nodes)
    assert sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == plain_phrases(rows, 5, 60)


def test_phrases_of_empty_tables(spark):
    assert mine_phrases(no_docs(spark)).count() == 0
    assert mine_phrases(spark.createDataFrame([("en", None), (None, " ")], "lang string, text string")).count() == 0


def test_phrase_scores_beyond_64_bits(spark):
    from meterlark.llm.phrases import lowest_cut, not_contained

    big = 9 * 10**17
    rows = spark.createDataFrame([("en", ["a", "b"], big, [big], [big + 1], "a b"), ("en", ["a", "b", "c"], big // 5 * 4, [big, big], [big, big], "a b c")], "lang string, words array<string>, a bigint, lefts array<bigint>, rights array<bigint>, phrase string")
    scored = lowest_cut(rows)
    assert scored.where("phrase = 'a b'").first().score == 2_000_000 * big // (2 * big + 1)
    assert [r.phrase for r in not_contained(scored, 4, 80).collect()] == ["a b c"]
    assert not_contained(scored, 4, 81).count() == 2


def test_tries_cut_and_merged(spark):
    rng = random.Random(3)
    texts = [("en" if rng.random() < 0.7 else "de", " ".join(rng.choice("abcde") for _ in range(rng.randrange(40)))) for _ in range(60)]
    whole, parts = tries.Shard(3), []
    starts = sorted({tuple([rng.choice([b"en", b"de", b"fr"]), *[rng.choice([b"a", b"c", b"cc", b"e"]) for _ in range(rng.randrange(4))]]) for _ in range(12)})
    for k in range(0, 60, 7):
        shard = tries.Shard(3)
        for lang, text in texts[k : k + 7]:
            shard.add(lang.encode(), text)
            whole.add(lang.encode(), text)
        parts += list(shard.trie().cut(starts))
    found = []
    for r in range(len(starts) + 1):
        mine = [tries.read_part(p) for at, p in parts if at == r]
        if mine:
            found += list(tries.frequent_nodes(tries.merged(mine), 1, starts[r - 1] if r else None))
    assert sorted(found) == sorted(tries.frequent_nodes(whole.trie(), 1, None))


def test_a_trie_is_cut_at_one_cost_for_all_ranges():
    """Keys of all nodes made anew for each range: time that grows with the square of the texts."""
    made = Counter()

    class Counted(np.ndarray):
        def __mul__(self, other):
            made["keys"] += 1
            return np.asarray(self) * other

    shard = tries.Shard(3)
    shard.add(b"en", " ".join(random.Random(5).choices("abcdefgh", k=2000)))
    trie = shard.trie()
    starts = sorted((b"en", a.encode(), b.encode()) for a in "abcdefgh" for b in "abcdefgh")
    want = list(trie.cut(starts))
    for level in trie.levels:
        level.parent = level.parent.view(Counted)
    assert list(trie.cut(starts)) == want and len(want) == len(starts) + 1
    assert made["keys"] <= len(trie.levels)


def test_texts_are_cut_into_words_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def read(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = phrase_rows(9)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3).mapInArrow(read, "lang string, text string")
    assert mine_phrases(docs, least=5, top=60, shard_words=100, range_nodes=400).count() > 0
    assert seen.value == len(rows)


@pytest.mark.parametrize("least, sampled", [(5, 3), (300, 400)])
def test_phrases_over_many_ranges_of_keys(spark, monkeypatch, least, sampled):
    from meterlark.llm import phrases

    monkeypatch.setattr(phrases, "SAMPLED_SHARDS", sampled)
    rows = phrase_rows(11)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    got = mine_phrases(docs, least=least, top=60, shard_words=50, range_nodes=400, range_words=40)
    want = plain_phrases(rows, least, 60)
    assert want and sorted(map(tuple, got.collect())) == want


def test_words_cut_numbered_and_packed():
    rng = random.Random(2)
    texts = ["", " \t", ".", "A\u00c4.b", "x" * 300, *("".join(rng.choices("aB\u00e9 \t.,;:!?\n\x0b\x0c\r\x1c\u2003", k=rng.randrange(40))) for _ in range(300))]
    want, all_texts = [], pa.array(["skipped. ", *texts])
    for text in texts:
        pieces = re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]+", lambda m: m[0].lower(), text))
        want.append([(w.encode(), k == 0) for piece in pieces for k, w in enumerate(re.findall(r"[^\x20\x09]+", piece))])
    for kind in (pa.string(), pa.large_string()):
        words, begins, each = tries.cut_words(all_texts.cast(kind).slice(1))
        assert list(zip(words.to_pylist(), begins.tolist())) == sum(want, []) and each.tolist() == [len(w) for w in want]
    shard, langs = tries.Shard(), ["en", "", "d\u00e9"]
    for k, text in enumerate(texts):
        shard.add(langs[k % 3].encode(), text)
    found = tries.Numbered.unpacked(shard.numbered().packed())
    told = [(found.langs[a].decode(), found.words[b].as_py(), c) for a, b, c in zip(found.lang, found.ids.tolist(), found.begins.tolist())]
    assert told == [(langs[k % 3], *w) for k, ws in enumerate(want) for w in ws] and found.listed() == found.words.to_pylist()
    with pytest.raises(pa.ArrowInvalid):
        tries.cut_words(pa.array([b"a \xff b"]).view(pa.string()))


# Byte-level BPE

ODD = ["ꟲ x\U00010570y", "a b　 c", "ࡰࡱ 5٣²", "don't'LL 'tis", "  \n\n  x  ", "\U0001f600é́", "0" * 700 + "a" * 300 + "-" * 400, "ab" * 150, "\x00\x1c\x85"]


@pytest.mark.parametrize("words, sampled", [(400_000, 20_000), (3, 5)])
def test_bpe_against_the_library(spark, words, sampled):
    encoding = tiktoken.Encoding("own", pat_str=default_pattern(), mergeable_ranks=read_ranks(default_ranks()), special_tokens={})
    rows = [(r[0], r[1]) for r in edge_rows() if len(r[1] or "") < 20_000] + [(100 + k, t) for k, t in enumerate(ODD)]
    rows += [(r.doc_id + 1000, r.text) for r in table(spark, "documents").limit(40).collect()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).withColumns({c: F.lit(1) for c in ("tables", "packed", "word", "slot", "id")})
    got = encode_and_decode(docs, dictionary_words=words, sampled_docs=sampled).collect()
    want = []
    for i, text in rows:
        ids = encoding.encode_ordinary(text or "")
        want.append((i, struct.pack(f"<{len(ids)}I", *ids), (text or "").encode()))
    assert sorted(repr((r.doc_id, bytes(r.packed), bytes(r.decoded))) for r in got) == sorted(map(repr, want))


def test_bpe_of_empty_tables_and_digests(spark):
    assert token_digest(encode_and_decode(no_docs(spark))).count() == 0
    row = token_digest(spark.createDataFrame([(1, bytearray(struct.pack("<2I", 5, 50_000)), bytearray(b"x"))], "doc_id bigint, packed binary, decoded binary")).first()
    assert tuple(row) == (1, 2, hashlib.sha256(struct.pack("<2I", 5, 50_000)).hexdigest(), hashlib.sha256(b"x").hexdigest())


def test_bpe_tables_are_in_no_row(spark):
    """A column of the tables would be copied for each row."""
    encoded = ByteBpe(spark).encode(table(spark, "documents"))
    plan = encoded._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(array(struct(known, scalar-subquery" in plan and "AS tables" not in plan, plan[:300]


def test_bpe_refuses_ranks_without_all_bytes(spark):
    with pytest.raises(ValueError):
        ByteBpe(spark, {b"a": 0})


def test_jvm_takes_the_library_classes(spark):
    bpe = ByteBpe(spark)
    letters = sorted(library_classes()[r"\p{L}"])
    text = "".join(map(chr, letters))
    got = spark.createDataFrame([(text,)], "text string").select(bpe.words(F.col("text")).alias("w")).first().w
    assert got == [text]


def test_numbers_of_words():
    assert word_numbers([b"a", b"b", b"a"]).tolist() == [0, 1, 0]
