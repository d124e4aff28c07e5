"""Text and hash expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Model name parts that only say how hard a model thinks or how it was built (fixed values).
EFFORT_PARTS = ("xhigh", "high", "medium", "low", "max", "thinking", "build")
#: Effort parts that a price slug drops (fixed values).
PRICE_EFFORT_PARTS = ("xhigh", "high", "medium", "low")
#: Provider prefixes of price keys, the first that matches is dropped (fixed values).
PROVIDERS = ("anthropic/", "openai/", "xai/", "google/", "azure/", "azure_ai/", "vertex_ai/", "bedrock/", "openrouter/", "grok/")

#: Kinds of login session and the codes that end them (fixed values).
SESSION_TYPES = {"SESSION_TYPE_WEB": 1, "SESSION_TYPE_CLIENT": 2, "SESSION_TYPE_MOBILE": 10, "SESSION_TYPE_CHROME_EXTENSION": 11}


def session_type_code(kind: Column) -> Column:
    """The code of a login session's kind; null for an unknown one."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in SESSION_TYPES.items() for x in pair]), kind)


def trimmed(s: Column) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def clamped(s: Column, most: int) -> Column:
    return F.substring(trimmed(F.coalesce(s, F.lit(""))), 1, most)


def clamped_or_unknown(s: Column, most: int) -> Column:
    cut = clamped(s, most)
    return F.when(cut == "", F.lit("unknown")).otherwise(cut)


def joined_hash(*parts: Column, digits: int = 16) -> Column:
    """Leading hex digits of the SHA-256 of NUL-separated parts."""
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, digits)


def session_hash(session_id: Column, source: Column) -> Column:
    return joined_hash(source, session_id, digits=32)


def token_hash(token: Column) -> Column:
    return F.sha2(token, 256)


def host_id_of_token(token: Column) -> Column:
    return F.substring(F.sha2(token, 256), 1, 32)


def account_host(account_hash: Column) -> Column:
    return F.concat(F.lit("acct:"), account_hash)


def is_account_hash(s: Column) -> Column:
    return F.coalesce(s.rlike("^[0-9a-f]{32}$"), F.lit(False))


def is_claim_hash(s: Column) -> Column:
    return F.coalesce(s.rlike("^[0-9a-f]{64}$"), F.lit(False))


def display_model(name: Column) -> Column:
    """The model a reader thinks of: no channel prefix, no effort or build parts; the plain name if nothing is left."""
    plain = F.trim(name)
    parts = F.filter(F.split(F.regexp_replace(plain, "(?i)^cursor-", ""), "-"), lambda p: (p != "") & ~F.lower(p).isin(*EFFORT_PARTS))
    return F.when(F.size(parts) > 0, F.array_join(parts, "-")).otherwise(plain)


def price_slug(name: Column) -> Column:
    """A model name as a price key: lower case, without a known provider, then without all up to the first slash."""
    known = "|".join(PROVIDERS)
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), f"^({known})", ""), "^[^/]*/", "")


def canonical_slug(slug: Column) -> Column:
    """For the families priced by speed alone, the slug without effort parts; null for others."""
    parts = F.filter(F.split(slug, "-"), lambda p: ~p.isin(*PRICE_EFFORT_PARTS))
    return F.when(slug.rlike("^(composer-|cursor-grok-)"), F.array_join(parts, "-"))


def key_rank(key: Column) -> Column:
    """Keys that name a provider or a region rank behind plain ones."""
    return F.when(key.rlike("[/.]"), F.lit(2)).otherwise(F.lit(0))


def last_path_part(path: Column) -> Column:
    """The last non-empty part of a path with either slash; null if there is none."""
    return F.nullif(F.regexp_extract(path, r"([^/\\]+)[/\\]*$", 1), F.lit(""))


def decoded_path_part(encoded: Column) -> Column:
    """The last part of a percent-encoded directory name. A plus sign stays one."""
    return last_path_part(F.coalesce(F.try_url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B"))), encoded))


def dashed_path_part(encoded: Column) -> Column:
    """The last part of a directory name in which dashes stand for slashes."""
    parts = F.filter(F.split(encoded, "-"), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.element_at(parts, -1))


def repository_name(url: Column) -> Column:
    """The repository's name in a git URL."""
    return F.nullif(F.regexp_extract(F.regexp_replace(url, r"(\.git)?/*$", ""), r"([^/:]+)$", 1), F.lit(""))


def utc_offset(s: Column) -> Column:
    """``+HH:MM`` up to 14 hours and 59 minutes, else null."""
    t = trimmed(s)
    fits = t.rlike(r"^[+-]\d{2}:\d{2}$") & (F.try_to_number(F.substring(t, 2, 2), F.lit("99")) <= 14) & (F.try_to_number(F.substring(t, 5, 2), F.lit("99")) <= 59)
    return F.when(fits, t)


def percent_in(message: Column) -> Column:
    return F.expr("double(null)") if message is None else F.regexp_extract(message, r"([0-9.]+)%", 1).try_cast("double")


def first_filled(*choices: Column) -> Column:
    """The first choice that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in choices])
