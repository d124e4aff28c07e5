"""The queries of this subpackage: one per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality, toxicity
from .byte_bpe import encode_and_decode, token_digest
from .exact_dedup import exact_dedup
from .fingerprints import fingerprint_edits
from .near_dedup import near_duplicates
from .packing import pack_documents
from .periodic_runs import find_runs, planted, run_digest
from .phrases import mine_phrases
from .source_mixing import mix_sources
from .suffix_dedup import removal_digest, remove_repeats
from .url_lists import filter_urls, host_of
from .warc import archive_round_trip, page_id_of


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, threshold=85)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = archive_round_trip(_table(spark, sf_dir, "pages"))
    return records.select(page_id_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_id_of("refers_to").alias("refers_to"), "error")


OP2_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages
), g AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY body) ELSE page_id END AS first FROM p
)
SELECT page_id, payload_bytes, sha256(body) AS payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to, NULL::VARCHAR AS error FROM g
"""


def _hex(text: str, start: int, n: int) -> str:
    return f"cast(conv(substr(md5({text}), {start}, {n}), 16, 10) as bigint)"


def _dated_list(pages: DataFrame) -> DataFrame:
    """A list for the pages' hosts, dated within 2024: the tables hold none. Hosts, paths and domains come and go."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    hosts = hosts.selectExpr("host", f"{_hex('host', 1, 4)} as d")
    domains = hosts.selectExpr("concat_ws('.', slice(split(host, '[.]'), -2, 2)) as host").where("size(split(host, '[.]')) = 2").distinct().selectExpr("host", f"{_hex('host', 1, 4)} as d")
    entry = lambda rows, pattern, action, day, when: rows.where(when).selectExpr(f"{pattern} as pattern", f"'{action}' as action", f"timestamp_seconds(1704067200 + 86400 * ({day})) as listed_at")
    parts = [
        entry(hosts, "host", "add", "d % 200", "d % 3 <> 0"),
        entry(hosts, "host", "remove", "d % 200 + 30 + d % 50", "d % 3 <> 0 and d % 2 = 0"),
        entry(hosts, "host", "add", "d % 200 + 50 + d % 50", "d % 3 <> 0 and d % 4 = 0"),
        entry(hosts, "host || '/en'", "add", "d % 300", "d % 5 = 0"),
        entry(domains, "host", "add", "100 + d % 100", "true"),
        entry(domains, "host", "remove", "103 + d % 100", "true"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def op3_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.selectExpr("page_id as capture_id", "url", "timestamp_seconds(1704067200 + (page_id * 7919) % 31536000) as fetched_at")
    found = filter_urls(captures, _dated_list(pages))
    return found.select(F.col("capture_id").alias("page_id"), "host", F.unix_seconds("fetched_at").alias("fetched_s"), "blocked", "n_active", "pattern")


OP3_SQL = r"""
WITH a AS (
  SELECT page_id, 1704067200 + (page_id * 7919) % 31536000 AS t, url, string_split(string_split(string_split(substr(url, strpos(url, '://') + 3), '#')[1], '?')[1], '/') AS pieces FROM pages
), b AS (
  SELECT *, string_split(pieces[1], '@')[-1] AS hostport, array_to_string(pieces[2:], '/') AS path FROM a
), c AS (
  SELECT page_id, t, path, CASE WHEN strpos(url, '://') > 1 THEN nullif(rtrim(lower(CASE WHEN starts_with(hostport, '[') THEN string_split(hostport, ']')[1] || ']' ELSE string_split(hostport, ':')[1] END), '.'), '') END AS host FROM b
), n AS (
  SELECT *, host || '/' || array_to_string(list_filter(string_split(path, '/'), lambda x: x <> ''), '/') AS whole FROM c
), h AS (SELECT host, ('0x' || substr(md5(host), 1, 4))::BIGINT AS d FROM (SELECT DISTINCT host FROM c WHERE host IS NOT NULL)
), o AS (SELECT host, ('0x' || substr(md5(host), 1, 4))::BIGINT AS d FROM (
    SELECT DISTINCT array_to_string(string_split(host, '.')[-2:], '.') AS host FROM h WHERE len(string_split(host, '.')) >= 2)
), e AS (
  SELECT host AS pattern, true AS adds, d % 200 AS day FROM h WHERE d % 3 <> 0
  UNION ALL SELECT host, false, d % 200 + 30 + d % 50 FROM h WHERE d % 3 <> 0 AND d % 2 = 0
  UNION ALL SELECT host, true, d % 200 + 50 + d % 50 FROM h WHERE d % 3 <> 0 AND d % 4 = 0
  UNION ALL SELECT host || '/en', true, d % 300 FROM h WHERE d % 5 = 0
  UNION ALL SELECT host, true, 100 + d % 100 FROM o UNION ALL SELECT host, false, 103 + d % 100 FROM o
), s AS (SELECT pattern, 1704067200 + 86400 * day AS t, min(adds) AS adds FROM e GROUP BY pattern, day
), u AS (SELECT *, coalesce(lag(adds) OVER (PARTITION BY pattern ORDER BY t), false) AS was FROM s
), v AS (SELECT pattern, adds, t AS a, lead(t) OVER (PARTITION BY pattern ORDER BY t) AS b FROM u WHERE adds <> was
), m AS (
  SELECT n.page_id, n.t, v.pattern FROM n JOIN v ON v.adds AND n.t >= v.a AND (v.b IS NULL OR n.t < v.b)
    AND (n.host = v.pattern OR (ends_with(n.host, '.' || v.pattern) AND NOT regexp_full_match(n.host, '[0-9]{1,3}([.][0-9]{1,3}){3}')) OR (contains(v.pattern, '/') AND (n.whole = v.pattern OR starts_with(n.whole, v.pattern || '/'))))
), g AS (SELECT page_id, t, count(*) AS n_active, max({'n': length(pattern), 'pattern': pattern}).pattern AS pattern FROM m GROUP BY page_id, t)
SELECT n.page_id, n.host, n.t AS fetched_s, g.n_active IS NOT NULL AS blocked, coalesce(g.n_active, 0) AS n_active, g.pattern
FROM n LEFT JOIN g ON n.page_id = g.page_id AND n.t = g.t
"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents
), g AS (
  SELECT doc_id, body, row_number() OVER (PARTITION BY body ORDER BY length(t) DESC, doc_id) AS rn,
    count(*) OVER (PARTITION BY body) AS group_size, first_value(doc_id) OVER (PARTITION BY body ORDER BY length(t) DESC, doc_id) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(body) AS text_sha256 FROM g
"""


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(_table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digest(remove_repeats(_table(spark, sf_dir, "documents")))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(text, '')) AS mark FROM documents
), r AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY
    lpad(length(bin(size))::VARCHAR, 2, '0') || substr(bin(size), 1, 4) || substr(md5(coalesce('v' || doc_id::VARCHAR, 'n' || mark)), 1, 2), doc_id NULLS FIRST, size, mark) AS place
  FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::DOUBLE AS cap FROM d GROUP BY source
), w AS (
  SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, (sum(source_size) OVER ())::BIGINT AS words FROM s
), l AS (
  SELECT *, (words * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), f AS (
  SELECT *, max(CASE WHEN cap > weight * level THEN level END) OVER () AS final FROM l
), t AS (
  SELECT source, source_size, CASE WHEN cap <= weight * level THEN cap ELSE weight * final END AS target,
    ('0x' || substr(md5('mix-1|' || coalesce('v' || source, 'n')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS start
  FROM f
), c AS (
  SELECT r.doc_id, r.source, r.size, t.source_size, t.target,
    (floor(place * rate + start) - floor((place - 1) * rate + start))::BIGINT AS copies
  FROM r JOIN (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t) t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken FROM c
"""


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digest(find_runs(planted(_table(spark, sf_dir, "documents"))))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(_table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(pieces) AS piece FROM d)
), t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang
), g AS (
  SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase, count(*)::BIGINT AS a
  FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w), (VALUES (1), (2), (3), (4)) AS x(m) WHERE i + m - 1 <= len(ws) GROUP BY ALL HAVING count(*) >= 30
), c AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS ws FROM g WHERE m >= 2
), cut AS (
  SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, ((2000000::HUGEINT * c.a) // (l.a::HUGEINT + r.a))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c
  JOIN g l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:k], ' ') JOIN g r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[k + 1:], ' ')
), low AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, array_to_string(ws[i:i + s - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, m)) AS i FROM c), (VALUES (2), (3)) AS y(s) WHERE s < m AND i + s - 1 <= m GROUP BY ALL
), kept AS (
  SELECT low.* FROM low LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a
)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN t ON t.lang = kept.lang QUALIFY rank <= 2000
"""


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(encode_and_decode(_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_warc": op2_warc,
    "op3_url_lists": op3_url_lists,
    "op4_toxicity": op4_toxicity,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_fingerprints": op6_fingerprints,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_source_mixing": op8_source_mixing,
    "op9_quality": op9_quality,
    "op10_packing": op10_packing,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_phrases": op12_phrases,
    "op13_byte_bpe": op13_byte_bpe,
}
ORACLES: dict[str, str] = {"op2_warc": OP2_SQL, "op3_url_lists": OP3_SQL, "op5_exact_dedup": OP5_SQL, "op8_source_mixing": OP8_SQL, "op12_phrases": OP12_SQL}
