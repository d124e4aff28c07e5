"""Queries that read: each is a panel, scan or function over the events read as usage, with the same in SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical_slug, display_model, joined_hash, price_slug, session_hash
from ..functions.times import UTC, half_hour
from ..operators import panels, views
from ..operators.pricing import price_index, priced_rows, resolved_prices
from ..operators.scans import NUMBERS, Filter, daily_rollups, scan_buckets, scan_days
from ..operators.usage import content_hash, usage_buckets, usage_sessions
from ..session import new_folder
from ..sources.events import SQL_USAGE, read_usage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_STORES: dict[tuple[str, str], str] = {}

#: Prices per token of the families that are priced by speed (fixed values), and of one made-up model.
PRICES = (
    ("composer-2.5", 5e-7, 2.5e-6, 2e-7, 5e-7), ("composer-2.5-fast", 3e-6, 1.5e-5, 5e-7, 3e-6),
    ("cursor-grok-4.5", 2e-6, 6e-6, 5e-7, 2e-6), ("cursor-grok-4.5-fast", 4e-6, 1.8e-5, 1e-6, 4e-6),
    ("cursor-grok-4.6", 2e-6, 6e-6, 5e-7, 2e-6), ("cursor-grok-4.6-fast", 4e-6, 1.2e-5, 1e-6, 4e-6),
    ("grok-4.5-fast", 4e-6, 1.8e-5, 1e-6, 4e-6), ("grok-4.6-fast", 4e-6, 1.2e-5, 1e-6, 4e-6),
    ("made-up-1", 1e-6, 2e-6, None, None),
)
EDGES = (dt.datetime(2024, 1, 3, 12, 17, tzinfo=UTC), dt.datetime(2024, 1, 20, 9, 47, tzinfo=UTC))
MONTH = (dt.datetime(2024, 1, 1, tzinfo=UTC), dt.datetime(2024, 1, 31, tzinfo=UTC))
QUARTER = (dt.datetime(2023, 11, 2, tzinfo=UTC), dt.datetime(2024, 1, 31, tzinfo=UTC))

WHERE_EDGES = "bucket_start >= TIMESTAMP '2024-01-03 12:17:00' AND bucket_start < TIMESTAMP '2024-01-20 09:47:00'"
_EFFORT = "'xhigh', 'high', 'medium', 'low', 'max', 'thinking', 'build'"
DISPLAY = f"array_to_string(list_filter(string_split(regexp_replace({{0}}, '(?i)^cursor-', ''), '-'), lambda x: x <> '' AND lower(x) NOT IN ({_EFFORT})), '-')"
_CANON = "CASE WHEN regexp_matches(slug, '^(composer-|cursor-grok-)') THEN array_to_string(list_filter(string_split(slug, '-'), lambda x: x NOT IN ('xhigh', 'high', 'medium', 'low')), '-') END"
_NULL = "NULL::DOUBLE"
_VALUES = ", ".join(f"('{k}', {a!r}::DOUBLE, {b!r}::DOUBLE, {_NULL if c is None else f'{c!r}::DOUBLE'}, {_NULL if d is None else f'{d!r}::DOUBLE'})" for k, a, b, c, d in PRICES)
SQL_PRICES = f"""
idx AS (SELECT * FROM (VALUES {_VALUES}) t(pslug, p_input, p_output, p_cache_read, p_cache_write)
), names AS (SELECT *, {_CANON} AS canon FROM (SELECT DISTINCT model, lower(model) AS slug FROM buckets)
), resolved AS (
  SELECT model, coalesce((SELECT pslug FROM idx WHERE pslug = slug), (SELECT pslug FROM idx WHERE pslug = regexp_replace(slug, '-build$', '')),
    (SELECT pslug FROM idx WHERE pslug = canon), CASE WHEN canon IS NULL THEN (SELECT max_by(pslug, {{'n': length(pslug), 's': pslug}}) FROM idx WHERE starts_with(slug, pslug) OR starts_with(pslug, slug)) END) AS pslug
  FROM names
), costed AS (
  SELECT b.*, b.model AS billed_model, {DISPLAY.format('b.model')} AS shown, i.*,
    input * p_input + output * p_output + cache_read * coalesce(p_cache_read, p_input * 0.1) + cache_creation * coalesce(p_cache_write, p_input * 1.25) + reasoning * p_output AS cost
  FROM buckets b LEFT JOIN resolved r ON r.model = b.model LEFT JOIN idx i ON i.pslug = r.pslug
)"""
WITH = f"WITH {SQL_USAGE}, {SQL_PRICES}"
_SUMS = ", ".join(f"sum({c})::BIGINT AS {c}" for c in NUMBERS)


def query(oracle: str | None = None, name: str | None = None):
    def register(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn

    return register


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_usage(spark, sf_dir)


def buckets_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_buckets(usage(spark, sf_dir), "host_id")


def stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The tables that panels read: buckets and their daily rollups, written to the shared folder once for a session and folder of events.

    A dashboard's facts are kept, not added up anew from events for each question.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        path = new_folder(spark, "panel-store")
        buckets_of(spark, sf_dir).write.parquet(f"{path}/buckets")
        daily_rollups(spark.read.parquet(f"{path}/buckets")).write.parquet(f"{path}/rollups")
        _STORES[key] = path
    return tuple(spark.read.parquet(f"{_STORES[key]}/{name}") for name in ("buckets", "rollups"))


def prices(spark: SparkSession) -> DataFrame:
    rows = [(*p, None) for p in PRICES]
    return price_index(spark.createDataFrame(rows, "key string, input double, output double, cache_read double, cache_write double, reasoning double"))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Costs have at most eight decimals, so nine are never a tie that the order of a sum decides."""
    return df.withColumns({c: F.round(c, 9 if c == "cost_usd" else 6) for c in columns})


@query(f"WITH {SQL_USAGE} SELECT host_id, source, model, project, epoch(bucket_start)::BIGINT AS bucket_s, input, output, cache_read, cache_creation, reasoning, total FROM buckets")
def usage_buckets_30m(spark, sf_dir):
    return buckets_of(spark, sf_dir).withColumn("bucket_s", F.unix_seconds("bucket_start")).drop("bucket_start")


def _summary_sql(where: str) -> str:
    return f"""{WITH}, f AS (SELECT * FROM costed WHERE {where}), s AS (
  SELECT {", ".join(f"coalesce(sum({c}), 0)::BIGINT AS {c}" for c in NUMBERS)}, coalesce(sum(cost), 0) AS c, coalesce(sum(total) FILTER (WHERE pslug IS NOT NULL), 0)::BIGINT AS priced_tokens,
    count(DISTINCT host_id) AS hosts, count(DISTINCT source) AS sources FROM f)
SELECT * EXCLUDE (c), round(c, 9) AS cost_usd, round(CASE WHEN total > 0 THEN priced_tokens / total ELSE 1.0 END, 6) AS cost_coverage,
  round(CASE WHEN input + cache_read + cache_creation > 0 THEN cache_read / (input + cache_read + cache_creation) ELSE 0.0 END, 6) AS cache_hit_share FROM s"""


def _summary(spark, sf_dir, f, rollup=True):
    b, days = stored(spark, sf_dir)
    return _rounded(panels.summary(b, days if rollup else None, prices(spark), f), "cost_usd", "cost_coverage", "cache_hit_share")


@query(_summary_sql(WHERE_EDGES))
def summary_totals(spark, sf_dir):
    return _summary(spark, sf_dir, Filter(*EDGES))


@query(_summary_sql(WHERE_EDGES + " AND host_id = 'host3' AND source IN ('codex', 'pi', 'grok') AND project IN ('proj1', 'proj2', 'proj5') AND lower(shown) IN ('grok-4.6', 'composer-2.5')"))
def summary_filtered(spark, sf_dir):
    f = Filter.of(*EDGES, host="host3", source="codex,pi, grok", project="proj1,proj2,proj5", model="Cursor-Grok-4.6-high,COMPOSER-2.5")
    return _summary(spark, sf_dir, f)


@query(_summary_sql(WHERE_EDGES + " AND source = 'cursor'"))
def summary_hidden_projects(spark, sf_dir):
    """A project filter does not count where projects are hidden."""
    return _summary(spark, sf_dir, Filter.of(*EDGES, source="cursor", project="proj1", hide_projects=True))


def _series_sql(step: int, start: dt.datetime, end: dt.datetime, by_day: bool = False) -> str:
    a, b = int(start.timestamp()), int(end.timestamp()) - 1
    where = f"bucket_start >= to_timestamp({a})::TIMESTAMP AND epoch_us(bucket_start) < {int(end.timestamp())}::BIGINT * 1000000"
    at = "epoch(date_trunc('day', bucket_start))" if by_day else "epoch(bucket_start)"
    return f"""{WITH}, grid AS (SELECT unnest(range({a // step * step}, {b // step * step + 1}, {step}))::BIGINT AS bin_s), f AS (
  SELECT (floor({at} / {step}) * {step})::BIGINT AS bin_s, sum(total) AS total, sum(input) AS input, sum(output) AS output, sum(cache_read) AS cache_read, sum(cache_creation) AS cache_creation, sum(cost) AS cost
  FROM costed WHERE {where.replace(f"to_timestamp({a})::TIMESTAMP", f"make_timestamp({a}000000)")} GROUP BY 1)
SELECT g.bin_s, coalesce(total, 0)::BIGINT AS total, coalesce(input, 0)::BIGINT AS input, coalesce(output, 0)::BIGINT AS output, coalesce(cache_read, 0)::BIGINT AS cache_read,
  coalesce(cache_creation, 0)::BIGINT AS cache_creation, round(coalesce(cost, 0), 9) AS cost_usd FROM grid g LEFT JOIN f USING (bin_s)"""


def _series(spark, sf_dir, window):
    b, days = stored(spark, sf_dir)
    return _rounded(panels.series(spark, b, days, prices(spark), Filter(*window)), "cost_usd")


@query(_series_sql(1800, *EDGES))
def series_halfhour_dense(spark, sf_dir):
    return _series(spark, sf_dir, EDGES)


@query(_series_sql(10800, *QUARTER))
def series_capped_grid(spark, sf_dir):
    return _series(spark, sf_dir, QUARTER)


YEARS = (dt.datetime(2022, 1, 1, tzinfo=UTC), dt.datetime(2024, 6, 30, 7, 30, tzinfo=UTC))


@query(_series_sql(86400, *YEARS, by_day=True))
def series_by_day(spark, sf_dir):
    return _series(spark, sf_dir, YEARS)


def _price_columns(group: str) -> str:
    one = "count(DISTINCT pslug_price) = 1"
    return ", ".join(f"CASE WHEN {one} THEN any_value(p_{p}) FILTER (WHERE pslug IS NOT NULL) END AS price_{p}" for p in ("input", "output", "cache_read", "cache_write")) + ", NULL::DOUBLE AS price_reasoning"


_PRICED = "pr AS (SELECT *, CASE WHEN pslug IS NOT NULL THEN {'a': p_input, 'b': p_output, 'c': p_cache_read, 'd': p_cache_write} END AS pslug_price FROM costed WHERE " + WHERE_EDGES + ")"


def _breakdown_sql(key: str) -> str:
    return f"""{WITH}, {_PRICED}, g AS (SELECT {key} AS key, {_SUMS}, coalesce(sum(cost), 0) AS c, {_price_columns(key)} FROM pr GROUP BY 1)
SELECT * EXCLUDE (c), round(c, 9) AS cost_usd, round(CASE WHEN sum(total) OVER () > 0 THEN total / sum(total) OVER () ELSE 0.0 END, 6) AS share,
  round(CASE WHEN sum(c) OVER () > 0 THEN c / sum(c) OVER () ELSE 0.0 END, 6) AS cost_share FROM g"""


def _breakdown(by: str):
    def run(spark, sf_dir):
        b, days = stored(spark, sf_dir)
        return _rounded(panels.breakdown(b, days, prices(spark), Filter(*EDGES), by), "cost_usd", "share", "cost_share")

    return run


for _by, _key in (("source", "source"), ("model", "shown"), ("project", "project"), ("host", "host_id")):
    query(_breakdown_sql(_key), f"breakdown_{_by}")(_breakdown(_by))


@query(f"""{WITH}, {_PRICED}, u AS (
  {" UNION ALL ".join(f"SELECT '{n}' AS dimension, {k} AS key, {_SUMS}, coalesce(sum(cost), 0) AS c, {_price_columns(k)} FROM pr GROUP BY {k}" for n, k in (("host", "host_id"), ("source", "source"), ("model", "shown"), ("project", "project")))})
SELECT * EXCLUDE (c), round(c, 9) AS cost_usd, round(CASE WHEN sum(total) OVER w > 0 THEN total / sum(total) OVER w ELSE 0.0 END, 6) AS share,
  round(CASE WHEN sum(c) OVER w > 0 THEN c / sum(c) OVER w ELSE 0.0 END, 6) AS cost_share FROM u WINDOW w AS (PARTITION BY dimension)""")
def distributions_grouping_sets(spark, sf_dir):
    b, days = stored(spark, sf_dir)
    return _rounded(panels.distributions(b, days, prices(spark), Filter(*EDGES)), "cost_usd", "share", "cost_share")


@query(f"""{WITH}, {_PRICED} SELECT shown AS model, {_price_columns('shown')}, count(DISTINCT billed_model) AS billed_names FROM pr GROUP BY shown""")
def model_consensus_price(spark, sf_dir):
    rows = scan_buckets(stored(spark, sf_dir)[0], Filter(*EDGES))
    names = rows.groupBy("model").agg(F.count_distinct("billed_model").alias("billed_names"))
    groups = panels.grouped(panels.costed(rows, prices(spark), "model"), "model")
    return groups.select("model", *[c for c in groups.columns if c.startswith("price_")]).join(names, "model")


@query(f"""WITH {SQL_USAGE}, cells AS (SELECT dayofweek(bucket_start)::INT AS weekday, hour(bucket_start)::INT AS hour, sum(total)::BIGINT AS total FROM buckets WHERE {WHERE_EDGES} GROUP BY ALL)
SELECT weekday, hour, coalesce(total, 0) AS total FROM (SELECT (i // 24)::INT AS weekday, (i % 24)::INT AS hour FROM range(168) t(i)) LEFT JOIN cells USING (weekday, hour)""")
def activity_heatmap(spark, sf_dir):
    return panels.activity(spark, stored(spark, sf_dir)[0], Filter(*EDGES))


@query(f"""WITH {SQL_USAGE}, cells AS (SELECT dayofweek(bucket_start) * 24 + hour(bucket_start) AS cell, sum(total)::BIGINT AS total FROM buckets WHERE {WHERE_EDGES} GROUP BY ALL)
SELECT ((i + 8) % 168 // 24)::INT AS weekday, ((i + 8) % 24)::INT AS hour, coalesce(total, 0) AS total FROM range(168) t(i) LEFT JOIN cells ON cell = i""")
def activity_tz_shift(spark, sf_dir):
    return views.shifted_activity(panels.activity(spark, stored(spark, sf_dir)[0], Filter(*EDGES)), 8)


SQL_SESSIONS = f"""{SQL_USAGE}, turns AS (
  SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY source, session_id ORDER BY moment, seq ROWS UNBOUNDED PRECEDING) AS turn FROM entries
), spans AS (
  SELECT source, session_id, turn, floor((epoch_us(max(moment)) - epoch_us(min(moment))) / 1000000)::BIGINT AS s FROM turns WHERE role <> 'user' AND turn > 0 GROUP BY ALL
), act AS (SELECT source, session_id, sum(s)::BIGINT AS active_seconds FROM spans GROUP BY ALL
), sess AS (
  SELECT e.source, e.session_id, arg_min(project, {{'a': moment, 's': seq}}) AS project, min(moment) AS first_at, max(moment) AS last_at, count(*) AS message_count, count(*) FILTER (WHERE role = 'user') AS user_message_count,
    sum(input)::BIGINT AS input, sum(output)::BIGINT AS output, sum(cache_read)::BIGINT AS cache_read, sum(input + output + cache_read + cache_creation + reasoning)::BIGINT AS total,
    floor((epoch_us(max(moment)) - epoch_us(min(moment))) / 1000000)::BIGINT AS duration_seconds
  FROM entries e GROUP BY ALL
), sessions AS (SELECT s.*, coalesce(a.active_seconds, 0) AS active_seconds, substr(sha256(s.source || chr(0) || s.session_id), 1, 32) AS session_hash FROM sess s LEFT JOIN act a USING (source, session_id))"""


def sessions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usage(spark, sf_dir)
    return usage_sessions(rows, rows).withColumn("session_hash", session_hash(F.col("session_id"), F.col("source"))).withColumn("host_id", F.lit("host"))


@query(f"""WITH {SQL_SESSIONS} SELECT source, session_hash, project, epoch_us(first_at) AS first_us, epoch_us(last_at) AS last_us, duration_seconds, active_seconds, message_count, user_message_count, input, output, cache_read, total
FROM sessions WHERE last_at >= TIMESTAMP '2024-01-03 12:17:00' AND last_at < TIMESTAMP '2024-01-20 09:47:00' ORDER BY last_at DESC, source, session_hash LIMIT 200""")
def sessions_topk(spark, sf_dir):
    rows = panels.latest_sessions(sessions_of(spark, sf_dir), Filter(*EDGES), 200)
    columns = ("source", "session_hash", "project", "duration_seconds", "active_seconds", "message_count", "user_message_count", "input", "output", "cache_read", "total")
    return rows.select(*columns, F.unix_micros("first_at").alias("first_us"), F.unix_micros("last_at").alias("last_us"))


@query(f"""WITH {SQL_SESSIONS} SELECT count(*) AS sessions, coalesce(sum(duration_seconds), 0)::BIGINT AS duration_seconds, coalesce(sum(active_seconds), 0)::BIGINT AS active_seconds,
  coalesce(sum(message_count), 0)::BIGINT AS message_count, coalesce(sum(user_message_count), 0)::BIGINT AS user_message_count FROM sessions
WHERE last_at >= TIMESTAMP '2024-01-03 12:17:00' AND last_at < TIMESTAMP '2024-01-20 09:47:00' AND source IN ('codex', 'grok')""")
def session_totals(spark, sf_dir):
    return panels.session_totals(sessions_of(spark, sf_dir), Filter.of(*EDGES, source="codex,grok", model="any"))


@query(f"""WITH {SQL_USAGE} SELECT array_to_string(list_sort(list(DISTINCT source)), '|') AS sources, array_to_string(list_sort(list(DISTINCT {DISPLAY.format('model')})), '|') AS models,
  array_to_string(list_sort(list(DISTINCT project)), '|') AS projects FROM buckets""")
def filter_options(spark, sf_dir):
    return panels.filter_options(stored(spark, sf_dir)[0]).select(*[F.array_join(c, "|").alias(c) for c in ("sources", "models", "projects")])


@query(f"WITH {SQL_USAGE} SELECT strftime(bucket_start, '%Y-%m-%d') AS day, host_id, source, model, project, {_SUMS} FROM buckets GROUP BY ALL")
def daily_rollup(spark, sf_dir):
    return daily_rollups(buckets_of(spark, sf_dir)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(f"WITH {SQL_USAGE} SELECT strftime(bucket_start, '%Y-%m-%d') AS day, host_id, source, model, project, {_SUMS} FROM buckets GROUP BY ALL")
def kept_rollups(spark, sf_dir):
    """The rollups of the store that panels read; the first to ask writes the store."""
    return stored(spark, sf_dir)[1].withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(f"WITH {SQL_USAGE} SELECT strftime(bucket_start, '%Y-%m-%d') AS day, source, {_SUMS} FROM buckets WHERE {WHERE_EDGES} GROUP BY ALL")
def hybrid_scan(spark, sf_dir):
    """Whole days from the rollups and both edges from the facts give what the facts alone give."""
    b, days = stored(spark, sf_dir)
    rows = scan_days(b, days, Filter(*EDGES))
    return rows.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day"), "source").agg(*[F.sum(c).alias(c) for c in NUMBERS])


@query(f"{WITH} SELECT host_id, source, billed_model, project, epoch(bucket_start)::BIGINT AS bucket_s, round(cost, 9) AS cost FROM costed WHERE pslug = billed_model OR pslug = regexp_replace(billed_model, '-build$', '')")
def price_exact_join(spark, sf_dir):
    rows = buckets_of(spark, sf_dir).withColumnRenamed("model", "billed_model").withColumn("bucket_s", F.unix_seconds("bucket_start"))
    index = prices(spark)
    known = index.select("slug").where("slug is not null")
    exact = priced_rows(rows, index).join(known, F.regexp_replace(price_slug(F.col("billed_model")), "-build$", "") == F.col("slug"), "left_semi")
    return exact.select("host_id", "source", "billed_model", "project", "bucket_s", F.round("cost", 9).alias("cost"))


#: Names made from the parts table: a tool's or a vendor's part before, an effort or a speed after the names that a book may know.
SQL_NAMES = """names AS (
  SELECT p_partkey AS part, ['', 'azure/', 'openrouter/x/', 'cursor-'][p_partkey % 4 + 1] || ['made-up-1', 'Made-Up', 'composer-2.5', 'grok-4.5-fast', 'cursor-grok-4.6', 'unheard-of', 'made'][p_partkey % 7 + 1]
    || ['', '-high', '-thinking', '-build', '-xhigh-fast'][p_partkey % 5 + 1] AS model FROM part)"""


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))
    name = F.concat(pick(("", "azure/", "openrouter/x/", "cursor-")), pick(("made-up-1", "Made-Up", "composer-2.5", "grok-4.5-fast", "cursor-grok-4.6", "unheard-of", "made")), pick(("", "-high", "-thinking", "-build", "-xhigh-fast")))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("part"), name.alias("model"))


_SLUG = "CASE WHEN starts_with(lower(model), 'azure/') OR starts_with(lower(model), 'openrouter/') THEN string_split(lower(model), '/')[-1] ELSE lower(model) END"


@query(f"""WITH {SQL_NAMES}, idx AS (SELECT * FROM (VALUES {_VALUES}) t(pslug, p_input, p_output, p_cache_read, p_cache_write)),
s AS (SELECT *, {_CANON} AS canon FROM (SELECT DISTINCT model, {_SLUG} AS slug FROM names))
SELECT model, coalesce((SELECT p_input FROM idx WHERE pslug = slug), (SELECT p_input FROM idx WHERE pslug = regexp_replace(slug, '-build$', '')), (SELECT p_input FROM idx WHERE pslug = canon), (SELECT p_input FROM idx WHERE pslug = regexp_replace(canon, '-build$', '')),
  CASE WHEN canon IS NULL THEN (SELECT max_by(p_input, {{'n': length(pslug), 's': pslug}}) FROM idx WHERE starts_with(slug, pslug) OR starts_with(pslug, slug)) END) AS price_input FROM s""")
def price_longest_prefix(spark, sf_dir):
    return resolved_prices(part_names(spark, sf_dir), prices(spark)).select("model", F.col("price.input").alias("price_input"))


@query(f"{WITH} SELECT shown AS model, sum(total)::BIGINT AS total, coalesce(sum(total) FILTER (WHERE pslug IS NOT NULL), 0)::BIGINT AS priced_tokens, round(coalesce(sum(cost), 0), 9) AS cost_usd FROM costed GROUP BY shown")
def cost_coverage(spark, sf_dir):
    groups = buckets_of(spark, sf_dir).groupBy(F.col("model").alias("billed_model")).agg(*[F.sum(c).alias(c) for c in NUMBERS])
    rows = priced_rows(groups, prices(spark)).withColumn("model", display_model(F.col("billed_model")))
    known = F.coalesce(F.sum(F.when(F.col("price").isNotNull(), F.col("total"))), F.lit(0))
    return rows.groupBy("model").agg(F.sum("total").alias("total"), known.alias("priced_tokens"), F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 9).alias("cost_usd"))


@query(f"WITH {SQL_NAMES} SELECT part, {DISPLAY.format('model')} AS shown FROM names")
def display_model_fold(spark, sf_dir):
    return part_names(spark, sf_dir).select("part", display_model(F.col("model")).alias("shown"))


@query(f"WITH {SQL_NAMES} SELECT part, slug, {_CANON} AS canon FROM (SELECT part, {_SLUG} AS slug FROM names)")
def normalize_model_slug(spark, sf_dir):
    rows = part_names(spark, sf_dir).select("part", price_slug(F.col("model")).alias("slug"))
    return rows.withColumn("canon", canonical_slug(F.col("slug")))


@query(f"""WITH {SQL_USAGE} SELECT host_id, source, model, project, epoch(bucket_start)::BIGINT AS bucket_s, substr(sha256(concat_ws(chr(0), input::VARCHAR, output::VARCHAR, cache_read::VARCHAR, cache_creation::VARCHAR, reasoning::VARCHAR, total::VARCHAR)), 1, 16) AS hash,
  substr(sha256(source || chr(0) || project), 1, 16) AS pair_hash FROM buckets""")
def content_hashes(spark, sf_dir):
    rows = buckets_of(spark, sf_dir)
    return rows.select("host_id", "source", "model", "project", F.unix_seconds("bucket_start").alias("bucket_s"), content_hash().alias("hash"), joined_hash(F.col("source"), F.col("project")).alias("pair_hash"))


@query(f"WITH {SQL_USAGE}, g AS (SELECT project AS key, sum(total)::BIGINT AS value, row_number() OVER (ORDER BY sum(total) DESC, project) AS n, count(*) OVER () AS c FROM buckets GROUP BY project) SELECT CASE WHEN c > 8 AND n > 7 THEN 'other' ELSE key END AS key, sum(value)::BIGINT AS value FROM g GROUP BY 1")
def donut_top7_other(spark, sf_dir):
    groups = buckets_of(spark, sf_dir).groupBy(F.col("project").alias("key")).agg(F.sum("total").alias("total"))
    return views.top_and_other(groups)


@query("SELECT event_id, epoch(time_bucket(INTERVAL 30 MINUTE, ts))::BIGINT AS half_hour_s, strftime(ts, '%Y-%m-%d') AS day FROM events")
def half_hours(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return rows.select("event_id", F.unix_seconds(half_hour(F.col("ts"))).alias("half_hour_s"), F.date_format("ts", "yyyy-MM-dd").alias("day"))
