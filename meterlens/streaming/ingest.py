"""Following audit files into the entry table."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from meterlens import schemas
from meterlens.operators import ingest
from meterlens.session import cut_lineage
from meterlens.sources.audit_lines import MAX_LINES_PER_TRIGGER, SPLIT_BYTES
from meterlens.sources.line_plan import FIGURE_NAMES, lines_of, plan_lines, planned_steps, steps_per_batch

from .store import days_in, read_table, write_batch, write_days

SCAN_SECONDS = 10

# Ids that a batch may give out: far more than lines come in one.
IDS_PER_BATCH = 1 << 40
# One row a scan: what it met, what the lines were, what came of them.
SCANS = (
    "scan long, step long, matched_files long, scanned_files long, unchanged_files long, processed_lines long, "
    "inserted_entries long, blank_lines long, invalid_lines long, unfinished_lines long, bytes_read long, "
    "line_limit_hit boolean, duration_ms long"
)


def ingest_batch(
    lines: DataFrame,
    batch_id: int,
    tokens: DataFrame,
    entries_path: str,
    scans_path: str = "",
    zone: str = "UTC",
    planned: DataFrame | None = None,
    now: Callable[[], Column] = F.unix_timestamp,
) -> None:
    """Append the entries of one batch of lines, each line once. Ids go up with the batches, with gaps between them.

    The lines are read and parsed once and written to the checkpoint folder; keys that are unknown now stay
    unresolved. A line that comes again has the same time, so only the days of this batch are looked through for it, and
    it is left out before its key and its messages are worked out.
    The batch has its own folders, so an attempt that failed half-way is replaced. A batch may take several steps of a
    plan, whose `step` the lines name; each is a scan with figures of its own, beside what `planned` (the steps' rows
    without a path) says of the files.
    """
    spark, started = lines.sparkSession, time.time()
    if "step" not in lines.columns:
        lines = lines.withColumn("step", F.lit(batch_id).cast("long"))
    parsed = cut_lineage(ingest.parse_lines(lines.drop("split", "split_line"), zone))
    found = parsed.filter(F.col("line_state") == "entry")
    days = days_in(found, F.col("created_at"))
    stored = read_table(spark, entries_path, schemas.AUDIT_ENTRIES, except_batch=batch_id, days=days)
    fresh = cut_lineage(ingest.new_lines(found, stored))
    few_keys = ingest.has_few(fresh.select("api_key").distinct())
    entries = ingest.entries_of(fresh, tokens, now(), few_keys)
    sources = fresh.select(F.col("path").alias("source_path"), "source_id", F.col("line_no").alias("source_line"))
    write_days(ingest.assign_ids(entries, batch_id * IDS_PER_BATCH, sources), entries_path, batch_id)
    if scans_path:
        if planned is None:
            planned = spark.createDataFrame([(batch_id,)], "step long")
        write_batch(_scan_rows(planned, parsed, fresh, started).coalesce(1), scans_path, batch_id)


def _scan_rows(planned: DataFrame, parsed: DataFrame, fresh: DataFrame, started: float) -> DataFrame:
    """One row a step: what the plan says, what its lines were, and how many entries were new; a step's time is its share."""
    met = ingest.line_statistics(parsed, "step")
    inserted = fresh.groupBy("step").agg(F.count("*").alias("inserted_entries"))
    found = cut_lineage(planned.join(met, "step", "left").join(inserted, "step", "left"))
    share = int(1000 * (time.time() - started)) // max(1, found.count())
    found = found.withColumn("duration_ms", F.lit(share))
    counts = ("processed_lines", "inserted_entries", "blank_lines", "invalid_lines", "bytes_read")
    columns = []
    for name, kind in (c.split() for c in SCANS.split(", ")):
        value = F.col(name) if name in found.columns else F.lit(None)
        columns.append((F.coalesce(value, F.lit(0)) if name in counts else value).cast(kind).alias(name))
    return found.select(*columns)


def start_ingest(
    spark: SparkSession,
    paths: str,
    tokens: Callable[[], DataFrame],
    entries_path: str,
    checkpoint: str,
    plan_dir: str,
    *,
    scans_path: str = "",
    zone: str = "UTC",
    max_lines: int = MAX_LINES_PER_TRIGGER,
    split_bytes: int = SPLIT_BYTES,
    now: Callable[[], Column] = F.unix_timestamp,
    once: bool = False,
) -> StreamingQuery:
    """Ingest what is planned in `plan_dir`, at most `max_lines` in a step; `tokens` is asked anew for every batch.

    A batch takes as many steps as are planned at once, up to `LINES_PER_BATCH` lines.

    With `once` all that is there is planned first and read in as many batches as it takes; otherwise `start_planning` looks
    for new lines beside this query.
    """
    plan_lines(spark, paths, plan_dir, max_lines, split_bytes, steps_per_file=steps_per_batch(max_lines))

    def write(steps: DataFrame, batch_id: int) -> None:
        heads = steps.filter("path is null").select("scan", "step", *FIGURE_NAMES)
        ingest_batch(lines_of(steps, with_step=True), batch_id, tokens(), entries_path, scans_path, zone, heads, now)

    writer = planned_steps(spark, plan_dir).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if once else {"processingTime": "1 second"}
    return writer.trigger(**trigger).start()


def start_planning(
    spark: SparkSession,
    paths: str,
    plan_dir: str,
    *,
    max_lines: int = MAX_LINES_PER_TRIGGER,
    split_bytes: int = SPLIT_BYTES,
    scan_seconds: int = SCAN_SECONDS,
) -> StreamingQuery:
    """Plan new lines at once and then every `scan_seconds`; scans that find nothing leave no step."""

    def plan(_: DataFrame, __: int) -> None:
        plan_lines(spark, paths, plan_dir, max_lines, split_bytes, idle=False, steps_per_file=steps_per_batch(max_lines))

    clock = spark.readStream.format("rate").load()
    return clock.writeStream.foreachBatch(plan).trigger(processingTime=f"{scan_seconds} seconds").start()
