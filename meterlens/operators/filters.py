"""Row filters shared by the usage operators. Every bound of zero or less is off."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.sql import DataFrame, functions as F

# Log types that count as usage.
SUCCESS, ERROR = 2, 5


# Ids in one folder of a written log table.
ID_BLOCK = 1_000_000
DAY = 86400


def limit_or(value: int, high: int, default: int) -> int:
    """The limit itself, or the default for zero or less; a limit above `high` is refused, never cut."""
    if value > high:
        raise ValueError(f"a limit of {value} is above {high}")
    return value if value > 0 else default


def in_time_range(df: DataFrame, start: int = 0, end: int = 0, column: str = "created_at") -> DataFrame:
    """Inclusive time range in Unix seconds, pushed down to the scan; a table in day folders reads only the days."""
    by_day = "event_date" in df.columns and column == "created_at"
    if start > 0:
        df = df.filter(F.col(column) >= start)
        df = df.filter(F.col("event_date") >= F.lit(_day(start))) if by_day else df
    if end > 0:
        df = df.filter(F.col(column) <= end)
        df = df.filter(F.col("event_date") <= F.lit(_day(end))) if by_day else df
    return df


def _day(seconds: int) -> date:
    return date(1970, 1, 1) + timedelta(days=min(seconds // DAY, 2_900_000))


def usage_rows(logs: DataFrame, start: int = 0, end: int = 0, log_type: str = "") -> DataFrame:
    """Successes and errors in a time range; `log_type` narrows to one of them, other words are ignored."""
    wanted = {"success": [SUCCESS], "error": [ERROR]}.get(log_type.strip().lower(), [SUCCESS, ERROR])
    return in_time_range(logs.filter(F.col("type").isin(wanted)), start, end)


def clean_ids(ids: Iterable[int], most: int = 500) -> list[int]:
    """Positive ids, distinct and sorted."""
    cleaned = sorted({int(i) for i in ids if int(i) > 0})
    if len(cleaned) > most:
        raise ValueError("too many keys")
    return cleaned


def clean_models(models: Iterable[str], most: int = 500) -> list[str]:
    """Trimmed model names, distinct and sorted."""
    cleaned = sorted({m.strip() for m in models if m.strip()})
    if len(cleaned) > most:
        raise ValueError("too many request models")
    return cleaned


def check_range(start: int, end: int) -> None:
    if start <= 0 or end <= 0 or end < start:
        raise ValueError("invalid time range")
