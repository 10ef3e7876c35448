"""Matching usage logs as audit entries arrive."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from meterlens import schemas
from meterlens.operators import matching

from .store import days_in, on_days, read_table, widened, write_days


def _days_of(window: int) -> int:
    """Days that a match window can reach over."""
    return -(-max(window, 0) // matching.ONE_DAY)


def _match_open(
    spark: SparkSession, logs: DataFrame, log_days: list[date], batch_id: int, tokens: DataFrame, entries_path: str, matches_path: str, window: int
) -> None:
    """Match the logs of some days that have no match yet, against the entries of the days around."""
    stored = read_table(spark, matches_path, schemas.MATCHES, except_batch=batch_id, days=log_days)
    open_logs = logs.join(stored.select(F.col("log_id").alias("id")), "id", "left_anti")
    # A request starts at most a day before its log is written.
    entry_days = widened(log_days, 1 + _days_of(window))
    entries = read_table(spark, entries_path, schemas.AUDIT_ENTRIES, days=entry_days)
    found = matching.new_matches(matching.match_token_time(open_logs, tokens, entries, window), stored, F.unix_timestamp())
    times = open_logs.select(F.col("id").alias("log_id"), "created_at")
    write_days(found.join(times, "log_id").dropDuplicates(["log_id"]), matches_path, batch_id)


def match_batch(
    new: DataFrame,
    batch_id: int,
    logs: DataFrame,
    tokens: DataFrame,
    entries_path: str,
    matches_path: str,
    window: int = matching.DEFAULT_WINDOW,
) -> None:
    """Match the logs of the days of the new entries that have no match yet, against all entries of that time.

    There is no watermark: an entry that comes late still finds its log as long as none was remembered for it. Only
    the days that the entries name are read, so a line with a wrong clock costs one day more, not all between.
    """
    timed = new.filter("has_timestamp")
    days = widened(days_in(timed, F.col("created_at")), 1 + _days_of(window))
    if days:
        _match_open(new.sparkSession, on_days(logs, days), days, batch_id, tokens, entries_path, matches_path, window)


def match_logs_batch(
    new: DataFrame,
    batch_id: int,
    tokens: DataFrame,
    entries_path: str,
    matches_path: str,
    window: int = matching.DEFAULT_WINDOW,
) -> None:
    """Match logs that have just arrived, however late, against the entries of their days."""
    days = days_in(new, F.col("created_at"))
    if days:
        # Batches of logs have numbers of their own, below those of the batches of entries.
        number = -1 - batch_id
        _match_open(new.sparkSession, new, days, number, tokens, entries_path, matches_path, window)


def current_matches(spark: SparkSession, matches_path: str, days: list[date] | None = None) -> DataFrame:
    """Every remembered match once; of two batches that matched a log at the same time the earlier match counts."""
    rows = read_table(spark, matches_path, schemas.MATCHES, days=days)
    fields = ["matched_at", "audit_entry_id", "matched_by", "matched_note"]
    first = rows.groupBy("log_id").agg(F.min(F.struct(*fields)).alias("m"))
    return first.select("log_id", "m.audit_entry_id", "m.matched_by", "m.matched_note", "m.matched_at")


def start_matching(
    spark: SparkSession,
    entries_path: str,
    logs: Callable[[], DataFrame],
    tokens: Callable[[], DataFrame],
    matches_path: str,
    checkpoint: str,
    *,
    window: int = matching.DEFAULT_WINDOW,
    once: bool = False,
) -> StreamingQuery:
    """Follow the entry table; logs and keys are asked anew for every batch."""
    entries = spark.readStream.schema(schemas.AUDIT_ENTRIES + ", event_date date, batch_id long").parquet(entries_path)

    def write(batch: DataFrame, batch_id: int) -> None:
        match_batch(batch, batch_id, logs(), tokens(), entries_path, matches_path, window)

    writer = entries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**({"availableNow": True} if once else {"processingTime": "10 seconds"})).start()


def start_log_matching(
    spark: SparkSession,
    logs_path: str,
    tokens: Callable[[], DataFrame],
    entries_path: str,
    matches_path: str,
    checkpoint: str,
    *,
    window: int = matching.DEFAULT_WINDOW,
    once: bool = False,
) -> StreamingQuery:
    """Follow the log table, for logs that arrive after the entries of their time were matched."""
    logs = spark.readStream.schema(schemas.USAGE_LOGS + ", event_date date, id_block long").parquet(logs_path)

    def write(batch: DataFrame, batch_id: int) -> None:
        match_logs_batch(batch, batch_id, tokens(), entries_path, matches_path, window)

    writer = logs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**({"availableNow": True} if once else {"processingTime": "10 seconds"})).start()
