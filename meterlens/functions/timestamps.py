"""Unix seconds from loosely typed JSON values, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import trim

# Number syntax of JSON, the accepted date layouts, and the bound above which a number is milliseconds.
JSON_NUMBER = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"
WHOLE_NUMBER = r"^[+-]?[0-9]+$"
RFC3339 = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"
LOCAL_TIME = r"^(\d{4}-\d\d-\d\d[T ]|\d{4}/\d\d/\d\d )\d\d:\d\d:\d\d(\.\d+)?$"
MILLISECONDS_ABOVE = 1_000_000_000_000


def _div_if_milliseconds(value: Column) -> Column:
    return F.when(value > MILLISECONDS_ABOVE, F.floor(value / 1000).cast("long")).otherwise(value)


def epoch_of_ntz(value: Column) -> Column:
    """Seconds between the epoch and a timestamp without zone, read as UTC."""
    return F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), value)


def rfc3339_seconds(text: Column) -> Column:
    """Unix seconds of an RFC 3339 time, NULL for any other text."""
    return F.when(text.rlike(RFC3339), F.unix_seconds(text.try_cast("timestamp")))


def local_seconds(text: Column, zone: str) -> Column:
    """Unix seconds of a date and time without zone, read in `zone`."""
    plain = F.translate(text, "/", "-").try_cast("timestamp_ntz")
    return F.when(text.rlike(LOCAL_TIME), epoch_of_ntz(F.convert_timezone(F.lit(zone), F.lit("UTC"), plain)))


def parse_timestamp(value: Column, zone: str = "UTC") -> Column:
    """Unix seconds of a JSON number or string variant; 0 when it is neither a number nor a known date form.

    Numbers may come quoted and with a fraction; beyond 10^12 they are milliseconds.
    """
    raw = F.try_variant_get(value, "$", "string")
    text = trim(raw)
    whole = text.try_cast("long")
    number = raw.try_cast("double")
    seconds = F.when(
        raw.rlike(JSON_NUMBER),
        F.coalesce(
            F.when(raw.rlike(WHOLE_NUMBER), _div_if_milliseconds(raw.try_cast("long"))),
            F.when(number > MILLISECONDS_ABOVE, (number / 1000).try_cast("long")).otherwise(number.try_cast("long")),
        ),
    ).otherwise(
        F.coalesce(
            F.when(text.rlike(WHOLE_NUMBER), _div_if_milliseconds(whole)),
            rfc3339_seconds(text),
            local_seconds(text, zone),
        )
    )
    return F.coalesce(seconds, F.lit(0).cast("long"))


def rfc3339_text(seconds: Column) -> Column:
    """Unix seconds as RFC 3339 text in UTC; '' for zero or less."""
    stamp = F.timestamp_add("SECOND", seconds, F.expr("timestamp_ntz'1970-01-01 00:00:00'"))
    return F.when(seconds > 0, F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.lit(""))
