"""Archives, dated lists, fingerprints, mixing and packing."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
import zstandard
from fixtures import CLASH, SF, WORDS, edge_docs, edge_rows, no_docs, table
from meterlark.llm import fingerprints as fp
from meterlark.llm import queries, warc
from meterlark.llm.common import new_folder
from meterlark.llm.packing import Encoder, OpenBins, byte_ranks, cut, default_vocabulary, pack_documents, pack_pieces
from meterlark.llm.source_mixing import mix_sources, mixed_documents
from meterlark.llm.url_lists import filter_urls, host_of, url_patterns
from oracle import compare
from pyspark.sql import functions as F


@pytest.mark.parametrize("name", ["op2_warc", "op3_url_lists", "op8_source_mixing"])
def test_against_sql(spark, name):
    assert compare(spark, queries.QUERIES[name], queries.ORACLES[name], SF) > 0


# Archives


def pages(spark):
    body = "<html>" + "é" * 200
    rows = [(1, "http://a.test/", None), (2, None, ""), (3, "http://a.test/x", body), (4, "http://b.test/\r\nX: y", body), (4, "http://b.test/", body), (5, "u", "short"), (6, "u", "short"), (None, "http://n.test/", body), (7, "u", "a\r\n\r\nb" * 50_000)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({c: F.lit(1) for c in CLASH})


def test_archives_round_trip(spark):
    got = warc.archive_round_trip(pages(spark)).collect()
    assert all(r.error is None for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.record_id.removeprefix("urn:page:")].append(r)
    assert {k: len(v) for k, v in by.items()} == {"1": 1, "2": 1, "3": 1, "4": 2, "5": 1, "6": 1, "7": 1, "None": 1}
    assert {r.record_type for r in by["4"]} == {"revisit"} and {r.refers_to for r in by["4"]} == {"urn:page:3"} and by["4"][0].payload is None
    assert all(r.record_type == "response" for k in ("1", "2", "3", "5", "6", "7", "None") for r in by[k])
    assert by["7"][0].payload == ("a\r\n\r\nb" * 50_000).encode() and by["1"][0].payload == b"" and by["2"][0].target_uri is None
    assert by["4"][0].payload_bytes == 406 and by["4"][0].payload_digest == hashlib.sha256(("<html>" + "é" * 200).encode()).hexdigest()
    assert warc.archive_round_trip(pages(spark).limit(0)).count() == 0


def test_archives_are_plain_zstandard(spark):
    """One frame a record, the dictionary in the leading skippable frame."""
    path = new_folder(spark, "warc-test")
    warc.write_archives(table(spark, "pages"), path)
    seen = 0
    for row in spark.read.format("binaryFile").load(path).where("length > 0").collect():
        data = bytes(row.content)
        magic, size = struct.unpack_from("<II", data)
        assert magic == warc.DICTIONARY_MAGIC
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])))
        at = 8 + size
        while at < len(data):
            n = warc.frame_length(memoryview(data), at)
            if struct.unpack_from("<I", data, at)[0] == warc.FRAME_MAGIC:
                one = reader.decompress(data[at : at + n])
                assert one.startswith(b"WARC/1.1\r\n") and one.count(b"WARC-Record-ID") == 1
                seen += 1
            at += n
    assert seen == table(spark, "pages").count()


def test_damaged_archives():
    record = warc.record_bytes("response", "urn:page:1", "http://a.test/", "2024-01-01T00:00:00Z", hashlib.sha256(b"hello").hexdigest(), b"hello", None)
    pack = zstandard.ZstdCompressor(write_checksum=True).compress
    assert [r["payload"] for r in warc.records(pack(record) + pack(record))] == [b"hello"] * 2
    bad = {
        "no end of headers": b"WARC/1.1\r\n", "no WARC version line": record.replace(b"WARC/1.1", b"WORC/1.1"), "no warc-date": record.replace(b"WARC-Date", b"X-Date"),
        "content-length does not match": record[:-4] + b"more\r\n\r\n", "payload digest does not match": record.replace(b"hello", b"jello"), "malformed header line": record.replace(b"WARC-Type: ", b"WARC-Type "),
    }
    for why, data in bad.items():
        found = list(warc.records(pack(data) + pack(record)))
        assert found[0]["error"] == why and found[1]["payload"] == b"hello", why
    assert [r.get("error", "")[:15] for r in warc.records(pack(record) + pack(record)[:-3])][1:] == ["frame cut short"]
    broken = bytearray(pack(record * 5))
    broken[len(broken) // 2] ^= 255
    assert "error" in list(warc.records(bytes(broken)))[0]


# Dated lists


@pytest.mark.parametrize("broadcast_intervals", [1000, 0])
def test_lists_against_trying_all(spark, broadcast_intervals):
    """Broadcast, and joined by slice as a list too large for that would be."""
    rng = random.Random(2)
    hosts = ["a.test", "b.a.test", "c.b.a.test", "d.test", "aa.test"]
    entries = [(rng.choice(hosts + ["a.test/x", "A.test/x/y/", "d.test/p", "test"]), rng.choice(["add", "remove", "odd"]), rng.randint(0, 400) * 86400) for _ in range(60)]
    entries += [(None, "add", 5), ("a.test", "add", None), ("d.test", "add", 86400), ("d.test", "remove", 86400)]
    captures = [(k, f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/x', '/x/y?q', '/xy', '/p#f', ':80/x'])}", rng.randint(0, 400) * 86400 + rng.choice([0, 1])) for k in range(300)]
    captures += [(900, None, 5), (901, "no url", 5), (902, "http://a.test/", None), (903, "http://a.test/", -(10**9)), (904, "http://a.test/", 10**10), (5, captures[5][1], captures[5][2])]
    stamp = lambda rows, schema, c: spark.createDataFrame(rows, schema).withColumn(c, F.timestamp_seconds(c)).withColumns({x: F.lit(0) for x in ("period", "valid_from", "host")})
    got = filter_urls(stamp(captures, "capture_id bigint, url string, fetched_at bigint", "fetched_at"), stamp(entries, "pattern string, action string, listed_at bigint", "listed_at"), slices=3, broadcast_intervals=broadcast_intervals).collect()

    def active(pattern, at):
        host, slash, path = pattern.partition("/")
        pattern = (host.lower() + slash + path).rstrip("/")
        known = [(t, a) for p, a, t in entries if p and t is not None and a != "odd" and (p.partition("/")[0].lower() + "".join(p.partition("/")[1:])).rstrip("/") == pattern and t <= at]
        last = max((t for t, _ in known), default=None)
        return last is not None and all(a == "add" for t, a in known if t == last)

    def want(url, at):
        if not url or "://" not in url or at is None:
            return 0, None
        host, _, path = url.split("://")[1].partition("/")
        host, path = host.split(":")[0], path.split("?")[0].split("#")[0]
        labels, steps = host.split("."), [s for s in path.split("/") if s]
        patterns = {".".join(labels[k:]) for k in range(len(labels))} | {host + "/" + "/".join(steps[: k + 1]) for k in range(len(steps))}
        hit = [p for p in patterns if active(p, at)]
        return len(hit), max(hit, key=lambda p: (len(p), p), default=None)

    assert len(got) == len(captures)
    expected = {k: want(u, t) for k, u, t in captures}
    assert all((r.n_active, r.pattern) == expected[r.capture_id] and r.blocked == (r.n_active > 0) for r in got)
    assert 20 < sum(r.blocked for r in got) < 280
    none = spark.createDataFrame([], "pattern string, action string, listed_at timestamp")
    assert filter_urls(stamp(captures, "capture_id bigint, url string, fetched_at bigint", "fetched_at"), none).where("blocked").count() == 0


def test_hosts(spark):
    urls = {
        "http://[2001:db8::1]/x": "[2001:db8::1]", "https://u:p@[::1]:8080/": "[::1]", "http://A.B.test.:80/": "a.b.test", "http://1.2.3.4/x": "1.2.3.4", "no url": None, "http:///x": None,
    }
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select("url", host_of(F.col("url")).alias("host"), url_patterns(F.col("url")).alias("p")).collect()
    assert {r.url: r.host for r in rows} == urls
    by = {r.url: set(r.p or []) for r in rows}
    assert by["http://1.2.3.4/x"] == {"1.2.3.4", "1.2.3.4/x"} and by["http://[2001:db8::1]/x"] == {"[2001:db8::1]", "[2001:db8::1]/x"}


# Fingerprints


def plain_sketch(text: str, k: int = fp.K, size: int = fp.SHINGLE) -> list[int]:
    words = WORDS.findall(text)
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def chain(parts):
        seed = 42
        for p in parts:
            seed = xxhash.xxh64_intdigest(p.encode(), seed)
        return signed(seed)

    runs = [words[i : i + size] for i in range(len(words) - size + 1)] if len(words) >= size else [[" ".join(words)]] if words else []
    return sorted({chain(r) for r in runs})[:k]


def alike(a: list[int], b: list[int], k: int = fp.K) -> float:
    both = sorted({*a, *b})[:k]
    return 1.0 if not both else len({*a} & {*b} & {*both}) / len(both)


def plain_fingerprints(rows):
    """Rows of (id, text), ids descending with nulls last."""
    rows = sorted(((i if i is not None else -(2**63), t or "", i) for i, t in rows), key=lambda r: (r[0], r[1].encode()), reverse=True)
    out = []
    for k, (_, text, i) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        m = len(text) // 3
        edited = text[: len(text) - m] + after[:m]
        a, b, c = plain_sketch(text), plain_sketch(edited), plain_sketch(after)
        out.append((str(i), len(text), hashlib.sha256(edited.encode()).hexdigest(), ",".join(map(str, a)), ",".join(map(str, b)), round(alike(a, b), 9), round(alike(a, c), 9)))
    return sorted(out)


def found_fingerprints(df):
    return sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect())


def test_fingerprints_against_plain(spark):
    docs = table(spark, "documents")
    assert found_fingerprints(fp.fingerprint_edits(docs)) == plain_fingerprints([(r.doc_id, r.text) for r in docs.collect()])
    assert found_fingerprints(fp.fingerprint_edits(edge_docs(spark))) == plain_fingerprints([(i, t) for i, t, *_ in edge_rows()])
    lone = spark.createDataFrame([(5, "a b c d e f g h i")], "doc_id bigint, text string")
    assert found_fingerprints(fp.fingerprint_edits(lone)) == plain_fingerprints([(5, "a b c d e f g h i")])
    assert fp.fingerprint_edits(no_docs(spark)).count() == 0


def test_fingerprints_over_many_stretches(spark):
    docs = table(spark, "documents").select("doc_id", "text")
    dealt = fp.with_next(docs, stretch_rows=9)
    assert dealt.select("stretch").distinct().count() > 10 and dealt.where("not ghost").count() == docs.count()


def test_sketches_merge_and_estimate(spark):
    words = [f"w{k}" for k in range(4000)]
    rows = [("a", " ".join(words[:3000])), ("b", " ".join(words[1000:]))]
    df = spark.createDataFrame(rows, "g string, text string").withColumn("sketch", fp.sketch(F.col("text")))
    a, b = (r.sketch for r in df.orderBy("g").collect())
    row = spark.createDataFrame([(a, b)], "a array<bigint>, b array<bigint>").select(fp.resemblance(F.col("a"), F.col("b")).alias("r"), fp.containment(F.col("a"), F.col("b")).alias("c"), fp.distinct_shingles(F.col("a")).alias("n"), fp.merged(F.col("a"), F.col("b")).alias("m")).first()
    assert abs(row.r - 0.5) < 0.15 and abs(row.c - 2 / 3) < 0.2 and abs(row.n / 2996 - 1) < 0.3
    assert fp.merge_sketches(df.withColumn("all", F.lit(1)), ["all"]).first().sketch == row.m


# Mixing


def test_mixing_on_edge_cases(spark):
    rows = mix_sources(edge_docs(spark)).collect()
    assert len(rows) == len(edge_rows())
    sizes = Counter()
    for _, t, _, s, _ in edge_rows():
        sizes[s] += len(WORDS.findall(t or ""))
    assert {(r.source, r.source_size) for r in rows} == set(sizes.items())
    taken = Counter()
    for r in rows:
        assert r.taken == r.copies * r.size and r.copies <= 2 and r.target <= 2 * r.source_size + 1e-6
        taken[r.source] += r.taken
    assert abs(sum({r.source: r.target for r in rows}.values()) - 1.5 * sum(sizes.values())) < 1e-3
    assert sorted(map(str, rows)) == sorted(map(str, mix_sources(edge_docs(spark).repartition(2)).collect()))
    assert mix_sources(no_docs(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id bigint, text string, source string")
    assert [(r.taken, r.target) for r in mix_sources(blank).collect()] == [(0, 0.0)] * 2
    mixed = mixed_documents(edge_docs(spark))
    assert mixed.columns == edge_docs(spark).columns and mixed.count() == sum(r.copies for r in rows)


def test_mixing_does_not_depend_on_the_order_of_rows(spark):
    """Repeated ids and rows without one, with other texts of the same and of other sizes."""
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 2, 3, k]), " ".join(rng.choice("abc") for _ in range(rng.choice([0, 3, 9, 10, 11, 90]))), rng.choice(["s", "t", None])) for k in range(630)]
    seen = set()
    for seed in range(5):
        random.Random(seed).shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(1 + seed)
        digest = sorted(map(repr, map(tuple, mix_sources(docs).collect()))), sorted(map(repr, map(tuple, mixed_documents(docs).collect())))
        seen.add(repr(digest))
        assert len(digest[1]) == mix_sources(docs).agg(F.sum("copies")).first()[0]
    assert len(seen) == 1


def test_mix_comes_near_its_targets(spark):
    rows = mix_sources(table(spark, "documents", "/root/testdata/sf0.1")).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken / r.target - 1) < 0.02 for r in rows)


# Packing


def test_encoder_gives_the_tokenizers_ids():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(default_vocabulary())
    ours = Encoder(default_vocabulary())
    rng = random.Random(4)
    alphabet = [chr(c) for c in range(0x250)] + list("  \n\t'''’“—漢字🎉 ́") + ["'s", "'ll", "<|endoftext|>", "the", "  "]
    for text in [t or "" for _, t, *_ in edge_rows()] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200))) for _ in range(800)] + ["a" * 3000, " " * 5000, "é" * 2001, "hi <|endoftext|> you", "<|endoftext|><|endoftext|>"]:
        assert np.frombuffer(ours(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text[:50]
    assert byte_ranks(default_vocabulary())


def check_packing(rows, docs, most=2048):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_vocabulary())
    want = Counter()
    for i, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for k, (start, n) in enumerate(cut(len(ids), most)):
            want[(i, k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= most
    return len(bins), sum(r.length for r in rows) / most


def test_packing(spark):
    docs = table(spark, "documents")
    bins, least = check_packing(pack_documents(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert bins <= 1.02 * least + 1
    check_packing(pack_documents(edge_docs(spark)).collect(), [(i, t) for i, t, *_ in edge_rows()])
    assert pack_documents(no_docs(spark)).count() == 0
    with_ids = pack_documents(docs.limit(20), with_ids=True).collect()
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in with_ids)


def test_packing_in_small_buckets_and_few_open_bins(spark):
    docs = table(spark, "documents")
    rows = pack_documents(docs, max_tokens=512, bucket_pieces=50, open_bins=4).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()], 512)
    pieces = spark.createDataFrame([(None, 0, 3)] * 400, "doc_id bigint, piece int, length bigint")
    packed = pack_pieces(pieces, 10, bucket_pieces=50).collect()
    assert len({r.sequence_id >> 32 for r in packed}) == 8  # rows without an id are spread, too
    assert all(n <= 3 for n in Counter(r.sequence_id for r in packed).values())


def test_best_fit_and_closing():
    bins = OpenBins(10, 2)
    assert bins.place(6) == (0, 0)  # free: 4
    assert bins.place(7) == (1, 0)  # free: 3
    assert bins.place(3) == (1, 7)  # the fuller one that fits
    assert bins.place(9) == (2, 0)
    assert bins.place(8) == (3, 0)  # two are open: the fullest (2) closes
    assert bins.place(1) == (3, 8) and bins.open == 2
    with pytest.raises(KeyError):
        OpenBins(10, 1).take(5)
