"""Percentages, windows and identities of provider quota documents."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .loose_json import number_from_text
from .text import trim
from .timestamps import MILLISECONDS_ABOVE, rfc3339_seconds

# Quota units per CNY of the external quota, whatever the billing settings say.
EXTERNAL_QUOTA_DIVISOR = 500000.0
SNIPPET_LENGTH = 300


def clamp_percent(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(100.0))


def used_percent(value: Column) -> Column:
    """Percent used from a fraction or a percentage: up to 1 counts as a fraction."""
    return clamp_percent(F.when((value > 0) & (value <= 1), value * 100).otherwise(value))


def remaining_percent(used: Column) -> Column:
    return clamp_percent(100 - used)


def loose_number(value: Column) -> Column:
    """A JSON number or numeric text variant as a double, else 0."""
    return number_from_text(F.try_variant_get(value, "$", "string"))


def loose_epoch(value: Column) -> Column:
    """Unix seconds of a number, numeric text or RFC 3339 time variant; milliseconds are cut, else 0."""
    text = F.try_variant_get(value, "$", "string")
    number = F.floor(number_from_text(text)).cast("long")
    seconds = F.when(number > MILLISECONDS_ABOVE, F.floor(number / 1000).cast("long")).otherwise(number)
    return F.coalesce(rfc3339_seconds(text), seconds, F.lit(0).cast("long"))


def field_text(value: Column) -> Column:
    """Any scalar variant as trimmed text, '' when missing."""
    return F.coalesce(trim(F.try_variant_get(value, "$", "string")), F.lit(""))


def member_text(document: Column, name: str) -> Column:
    return field_text(F.try_variant_get(document, f"$.{name}", "variant"))


def first_with_at(*values: Column) -> Column:
    """The first text that looks like a mail address, '' if none does."""
    return F.coalesce(*[F.when(v.contains("@"), v) for v in values], F.lit(""))


def quota_cny(quota: Column) -> Column:
    """External quota in CNY, two decimals."""
    return F.round(quota / EXTERNAL_QUOTA_DIVISOR * 100, 0) / 100


def snippet(body: Column) -> Column:
    """A response body on one line, cut to a length fit for an error text."""
    line = trim(F.regexp_replace(body, r"\s+", " "))
    return F.when(F.length(line) > SNIPPET_LENGTH, F.concat(F.left(line, F.lit(SNIPPET_LENGTH)), F.lit("…"))).otherwise(line)
