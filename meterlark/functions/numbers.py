"""Tolerant numbers: logs hold counts as numbers, strings, or not at all."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import TOKENS


def variant_count(doc: Column, path: str) -> Column:
    """A count at a path of a VARIANT: integers as they are, floats rounded half away from zero, numeric strings read, all else 0."""
    whole = F.try_variant_get(doc, path, "bigint")
    real = F.round(F.try_variant_get(doc, path, "double")).try_cast("bigint")
    kind = F.schema_of_variant(F.try_variant_get(doc, path, "variant"))
    number = F.when(kind == "BIGINT", whole).otherwise(real)
    return F.greatest(F.when(kind.isNull() | (kind == "BOOLEAN"), F.lit(0)).otherwise(F.coalesce(number, F.lit(0))), F.lit(0)).cast("bigint")


def text_count(s: Column) -> Column:
    """A count in a CSV cell, with or without thousands separators."""
    return F.greatest(F.coalesce(F.round(F.replace(F.trim(s), F.lit(","), F.lit("")).try_cast("double")).try_cast("bigint"), F.lit(0)), F.lit(0)).cast("bigint")


def token_sum(*columns: str) -> Column:
    total = F.lit(0).cast("bigint")
    for c in columns or TOKENS:
        total = total + F.col(c)
    return total


def share_of(part: Column, whole: Column, empty: float) -> Column:
    """part / whole, or ``empty`` where there is no whole."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty))
