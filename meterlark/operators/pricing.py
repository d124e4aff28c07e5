"""Price books and cost. Prices are USD per token; cost is always computed at query time, so history follows a new book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_slug, key_rank, price_slug

PARTS = ("input", "output", "cache_read", "cache_write", "reasoning")
#: Field names of a raw price table (fixed values); the first that is there counts.
RAW_FIELDS = {
    "input": ("input_cost_per_token",),
    "output": ("output_cost_per_token",),
    "cache_read": ("cache_read_input_token_cost", "input_cost_per_token_cache_hit"),
    "cache_write": ("cache_creation_input_token_cost",),
    "reasoning": ("output_cost_per_reasoning_token",),
}
#: Shares of the input price that cache reads and writes cost where a book has no price for them (fixed values).
READ_SHARE, WRITE_SHARE = 0.1, 1.25
#: Keys of one text of a kept book.
KEYS_A_TEXT = 5000
#: Keys of a book that may be one map.
MOST_IN_MAP = 20_000
#: Layers of a book from weak to strong; "gap" rows only fill what none of the others has.
LAYERS = ("gap", "snapshot", "cache", "override")


def prices_from_json(docs: DataFrame, layer: str) -> DataFrame:
    """(key, the five prices, layer, updated_at) from JSON texts in ``value``.

    A text is a condensed table {updated_at, models: {key: {input, output, ...}}} or a raw one {key: {input_cost_per_token, ...}}.
    Values that are no objects, and raw ones with neither an input nor an output price, are skipped; a text that is no JSON gives no rows.
    """
    whole = docs.select(F.from_json("value", "map<string,variant>", {"mode": "PERMISSIVE"}).alias("m"))
    models = F.try_variant_get(F.col("m").getItem("models"), "$", "map<string,variant>")
    stamp = F.try_variant_get(F.col("m").getItem("updated_at"), "$", "string")
    # What holds for a text is found once, before its keys become rows.
    whole = whole.select(stamp.alias("updated_at"), models.alias("models"), "m")
    whole = whole.select(F.col("models").isNotNull().alias("condensed"), "updated_at", F.coalesce("models", "m").alias("entries"))
    rows = whole.select("condensed", "updated_at", F.explode("entries").alias("key", "entry"))
    rows = rows.where(F.schema_of_variant("entry").startswith("OBJECT"))
    price = lambda name: F.try_variant_get("entry", f"$.{name}", "double")
    columns = {p: F.when(F.col("condensed"), price(p)).otherwise(F.coalesce(*[price(n) for n in RAW_FIELDS[p]])) for p in PARTS}
    rows = rows.select("key", "updated_at", *[c.alias(p) for p, c in columns.items()]).where("input is not null or output is not null")
    return rows.fillna(0.0, ["input", "output"]).withColumn("layer", F.lit(layer))


def read_prices(spark: SparkSession, path: str, layer: str) -> DataFrame:
    return prices_from_json(spark.read.text(path, wholetext=True), layer)


def imported_prices(spark: SparkSession, path: str, layer: str = "override") -> DataFrame:
    """read_prices() of a table that a user hands in; one without any price is an error."""
    rows = read_prices(spark, path, layer)
    if rows.isEmpty():
        raise ValueError(f"no prices in {path}")
    return rows


def keep_prices(rows: DataFrame, path: str, updated_at: str) -> None:
    """Writes a price cache: a folder of condensed JSON texts, one a file, each of about KEYS_A_TEXT keys, as read_prices() takes it."""
    texts = max(1, -(-rows.count() // KEYS_A_TEXT))
    models = F.map_from_entries(F.collect_list(F.struct("key", F.struct(*PARTS))))
    each = rows.groupBy(F.pmod(F.xxhash64("key"), F.lit(texts)).cast("int").alias("text")).agg(models.alias("models"))
    each.select(F.to_json(F.struct(F.lit(updated_at).alias("updated_at"), "models")).alias("value"), "text").repartitionById(texts, "text").drop("text").write.mode("overwrite").text(path)


def model_count(book: DataFrame) -> DataFrame:
    """One row: how many keys a book has."""
    return book.agg(F.count_distinct("key").alias("models"))


def layered_prices(rows: DataFrame) -> DataFrame:
    """One row per key. Strong layers win, except a cache that is strictly older than the newest snapshot."""
    stamped = F.try_to_timestamp("updated_at")
    everything = Window.partitionBy(F.lit(1))  # a price book: some thousands of rows, whatever the usage
    newest = F.max(F.when(F.col("layer") == "snapshot", stamped)).over(everything)
    stale = (F.col("layer") == "cache") & F.coalesce(stamped < newest, F.lit(False))
    rank = F.array_position(F.array(*[F.lit(x) for x in LAYERS]), F.col("layer"))
    usable = rows.withColumn("stale", stale).where("not stale")
    best = usable.groupBy("key").agg(F.max_by(F.struct(*PARTS), F.struct(rank.alias("rank"), *PARTS)).alias("p"))
    return best.select("key", "p.*")


def price_index(book: DataFrame) -> DataFrame:
    """(slug, price): keys normalised; of equal ones the plainest key wins, then the first in order."""
    keyed = book.withColumn("slug", price_slug(F.col("key")))
    best = keyed.groupBy("slug").agg(F.min_by(F.struct(*PARTS), F.struct(key_rank(F.col("key")).alias("rank"), "key")).alias("price"))
    return best


def price_book(index: DataFrame) -> Column:
    """The index as one map from slug to price: a scalar subquery, read once a query, for groups by model, of which there are few. A book of more than MOST_IN_MAP keys is refused; resolved_prices() takes any."""
    size = F.count("*")
    whole = F.map_from_entries(F.collect_list(F.struct("slug", "price")))
    refused = F.raise_error(F.concat(F.lit("a price book as a map has to be small, this one has "), size.cast("string"), F.lit(" keys"))).cast(index.select(F.map_from_arrays(F.array("slug"), F.array("price")).alias("m")).schema["m"].dataType)
    return index.limit(MOST_IN_MAP + 1).agg(F.when(size > MOST_IN_MAP, refused).otherwise(whole)).scalar()


def price_of(model: Column, book: Column) -> Column:
    """The price of a model's name in a book, null where none is found.

    Tried in order: the slug; the slug without ``-build``; for families priced by speed the canonical slug alone; for all
    others the longest key that begins with the slug or that the slug begins with (of equally long ones the greatest).
    """
    slug = price_slug(model)
    canon = canonical_slug(slug)
    plain = lambda c: F.regexp_replace(c, "-build$", "")
    exact = [F.try_element_at(book, c) for c in (slug, plain(slug), canon, plain(canon))]
    near = F.filter(F.map_keys(book), lambda k: (k != "") & (F.startswith(slug, k) | F.startswith(k, slug)))
    longest = F.array_max(F.transform(near, lambda k: F.struct(F.length(k).alias("n"), k.alias("key"))))["key"]
    return F.coalesce(*exact, F.when(canon.isNull() & (slug != ""), F.try_element_at(book, longest)))


def with_price(rows: DataFrame, index: DataFrame, model: str) -> DataFrame:
    return rows.withColumn("price_book", price_book(index)).withColumn("price", price_of(F.col(model), F.col("price_book"))).drop("price_book")


def prefixes(text: Column) -> Column:
    """All beginnings of a text, itself included."""
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda n: F.substring(text, F.lit(1), n))


def resolved_prices(models: DataFrame, index: DataFrame) -> DataFrame:
    """(model, price) for the distinct ``model`` values, by the rule of price_of().

    A prefix index, joined by equality both ways: the beginnings of names meet keys, and the beginnings of keys meet names. Each distinct name is resolved once, and the
    book is read three times whatever the number of names, and of rows; it is never compared key by key.
    """
    names = models.select("model").where("model is not null").distinct().withColumn("slug", price_slug(F.col("model"))).withColumn("canon", canonical_slug(F.col("slug")))
    every = index.where("slug is not null").withColumnRenamed("slug", "key")
    book = every.where("key <> ''")
    plain = lambda c: F.regexp_replace(c, "-build$", "")
    tried = F.array(F.col("slug"), plain(F.col("slug")), F.col("canon"), plain(F.col("canon")))
    whole = names.select("model", F.posexplode(tried).alias("nth", "key")).join(every, "key").select("model", F.struct(F.lit(1).alias("whole"), (-F.col("nth")).alias("rank"), "key").alias("by"), "price")
    near = names.where("canon is null and slug <> ''")
    rank = F.struct(F.lit(0).alias("whole"), F.length("key").alias("rank"), "key").alias("by")
    shorter = near.select("model", F.explode(prefixes(F.col("slug"))).alias("key")).join(book, "key").select("model", rank, "price")
    # Of the keys that begin with a name one is enough; partial maxima are made before the shuffle.
    begun = book.select("key", "price", F.explode(prefixes(F.col("key"))).alias("slug")).join(near.select("slug").distinct(), "slug", "left_semi")
    longest = begun.groupBy("slug").agg(F.max_by(F.struct("key", "price"), F.struct(F.length("key").alias("n"), "key")).alias("best")).select("slug", "best.*")
    longer = near.join(longest, "slug").select("model", rank, "price")
    best = whole.unionByName(shorter).unionByName(longer).groupBy("model").agg(F.max_by("price", "by").alias("price"))
    return names.select("model").join(best, "model", "left")


def cost_of(price: str = "price") -> Column:
    """Cost of a row with the five token columns; null without a price."""
    p = lambda name: F.col(f"{price}.{name}")
    return (
        F.col("input") * p("input")
        + F.col("output") * p("output")
        + F.col("cache_read") * F.coalesce(p("cache_read"), p("input") * READ_SHARE)
        + F.col("cache_creation") * F.coalesce(p("cache_write"), p("input") * WRITE_SHARE)
        + F.col("reasoning") * F.coalesce(p("reasoning"), p("output"))
    )


def priced(groups: DataFrame, index: DataFrame, model: str = "billed_model") -> DataFrame:
    """``groups`` with ``price`` and ``cost``, both null for models that no book prices. They are read once, without a join with their own names; for rows in place of groups see priced_rows()."""
    return with_price(groups, index, model).withColumn("cost", cost_of())


def priced_rows(rows: DataFrame, index: DataFrame, model: str = "billed_model") -> DataFrame:
    """The same for any number of rows and keys: each distinct name is resolved once and joined."""
    found = resolved_prices(rows.select(F.col(model).alias("model")), index).withColumnRenamed("model", model)
    return rows.join(found, model, "left").withColumn("cost", cost_of())
