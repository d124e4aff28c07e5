"""Account snapshots from the JSON of usage pages that were saved before; nothing here reaches for a network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_filled, percent_in
from .base import present_at, text_at, time_at


def account_snapshots(pages: DataFrame) -> DataFrame:
    """Rows of schema.ACCOUNT (without archived_at) from rows of account_hash, label, fetched_at, ``value`` and ``bot_value`` (JSON).

    Usage is that of the plan, else of the whole account. A share that is not stated is read from its message.
    ``used_cents`` goes on past the plan's limit, as bonus usage is added. What is no JSON, or not there, is null.
    """
    rows = pages.withColumns({"doc": F.try_parse_json("value"), "bot": F.try_parse_json("bot_value")})
    pool = "$.individualUsage.plan"
    pools = F.when(present_at("doc", pool), F.try_variant_get("doc", pool, "variant")).otherwise(F.try_variant_get("doc", "$.individualUsage.overall", "variant"))
    rows = rows.withColumn("pool", pools)
    number = lambda path: F.try_variant_get("pool", path, "double")
    either = lambda a, b: first_filled(text_at("doc", f"$.{a}"), text_at("doc", f"$.{b}"))
    message = lambda name: percent_in(text_at("doc", f"$.{name}"))
    used = F.try_variant_get("pool", "$.used", "bigint") + F.coalesce(F.try_variant_get("pool", "$.breakdown.bonus", "bigint"), F.lit(0))
    time = lambda c: F.try_to_timestamp(c)
    return rows.select(
        "account_hash", "label", either("membershipType", "membership_type").alias("membership"),
        F.coalesce(number("$.apiPercentUsed"), message("namedModelSelectedDisplayMessage")).alias("api_percent"),
        F.coalesce(number("$.autoPercentUsed"), number("$.totalPercentUsed"), message("autoModelSelectedDisplayMessage")).alias("auto_percent"),
        F.try_variant_get("bot", "$.usagePercent", "double").alias("bot_percent"), used.alias("used_cents"),
        time(either("billingCycleStart", "billing_cycle_start")).alias("cycle_start"), time(either("billingCycleEnd", "billing_cycle_end")).alias("cycle_end"),
        "fetched_at",
    )


def claims_of(token: Column) -> Column:
    """The claims (VARIANT) of a signed token's middle part; null if it has none. The signature is not looked at."""
    body = F.translate(F.try_element_at(F.split(token, "[.]"), F.lit(2)), "-_", "+/")
    padded = F.concat(body, F.repeat(F.lit("="), F.pmod(-F.length(body), F.lit(4))))
    return F.try_parse_json(F.decode(F.unbase64(padded), "UTF-8"))


def account_of(token: Column) -> Column:
    """(subject, mail) of a token's claims."""
    claims = claims_of(token)
    return F.struct(text_at(claims, "$.sub").alias("subject"), text_at(claims, "$.email").alias("mail"), time_at(claims, "$.exp").alias("expires_at"))
