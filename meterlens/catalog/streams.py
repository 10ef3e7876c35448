"""Registered queries that run the sources and streams over files written from the generated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from meterlens import bindings as b, schemas
from meterlens.operators import ingest, review_plan as rp
from meterlens.session import cut_lineage
from meterlens.sources.audit_lines import expand_paths, read_audit_lines
from meterlens.sources.line_plan import file_states, lines_of, plan_lines, planned_steps, steps_per_batch
from meterlens.sources.usage import conform
from meterlens.streaming.ingest import SCANS, ingest_batch, start_ingest
from meterlens.streaming.match import current_matches, start_matching
from meterlens.streaming.review import reviewed, start_review, write_results
from meterlens.streaming.store import read_table, write_days

from .audit import WINDOW
from .common import new_folder
from .review import CONFIG, SCOPE, scorer, stored_results

# Lines in a step of a scan, so that the files take several steps.
LINES_PER_STEP, LINES_PER_SCAN = 400, 3000
# Bytes in a range, so that files take many ranges.
RANGE_BYTES = 20_000


def _written_lines(spark: SparkSession, lines: DataFrame) -> str:
    """Write audit lines as text files and return the pattern that finds them."""
    folder = new_folder(spark, "lines")
    lines.select("path", "value").write.partitionBy("path").text(folder)
    return f"{folder}/path=*/part-*"


def _summary(lines: DataFrame) -> DataFrame:
    """What was read: lines by state, model and client."""
    parsed = ingest.parse_lines(lines, b.LINE_ZONE)
    return parsed.groupBy("line_state", "model", "client_name", "has_timestamp").agg(
        F.count("*").alias("line_count"), F.countDistinct("path", "line_no").alias("distinct_lines")
    )


def _scan(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(read_audit_lines(spark, _written_lines(spark, b.raw_lines(spark, sf)), split_bytes=4096))


def _tail(spark: SparkSession, sf: str) -> DataFrame:
    pattern, out = _written_lines(spark, b.raw_lines(spark, sf)), new_folder(spark, "tailed")
    plans = new_folder(spark, "plans")
    plan_lines(spark, pattern, plans, LINES_PER_STEP, RANGE_BYTES, steps_per_file=steps_per_batch(LINES_PER_STEP))
    writer = lines_of(planned_steps(spark, plans)).writeStream.format("parquet")
    writer.option("checkpointLocation", new_folder(spark, "checkpoint")).trigger(availableNow=True).start(out).awaitTermination()
    return _summary(spark.read.schema(schemas.RAW_LINES).parquet(out))


def _ingested(spark: SparkSession, sf: str, pattern: str, **options) -> tuple[str, str]:
    """Stream the lines of files into an entry table; its folder and that of the plans."""
    entries, plans = new_folder(spark, "entries"), new_folder(spark, "plans")
    options = {"zone": b.LINE_ZONE, "max_lines": LINES_PER_STEP, "split_bytes": RANGE_BYTES, "once": True, **options}
    keys = lambda: b.tokens(spark, sf)
    start_ingest(spark, pattern, keys, entries, new_folder(spark, "checkpoint"), plans, **options).awaitTermination()
    return entries, plans


def _stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    folder, _ = _ingested(spark, sf, _written_lines(spark, b.raw_lines(spark, sf)))
    entries = read_table(spark, folder, schemas.AUDIT_ENTRIES)
    return entries.groupBy("token_id", "model", "client_variant").agg(
        F.count("*").alias("entry_count"),
        F.countDistinct("id").alias("ids"),
        F.sum(F.size("messages")).alias("message_count"),
    )


def _status(spark: SparkSession, sf: str) -> DataFrame:
    """The status after a scan of the audit files and of one that has invalid lines only."""
    lines = b.raw_lines(spark, sf)
    broken = lines.filter(F.col("value").endswith('} {"time":1}')).withColumn("path", F.lit("broken.jsonl"))
    pattern = _written_lines(spark, lines.union(broken).repartition("path"))
    entries, plans = _ingested(spark, sf, pattern, now=lambda: F.lit(1_700_100_000))
    return ingest.audit_status(read_table(spark, entries, schemas.AUDIT_ENTRIES), file_states(spark, plans))


def _scans(spark: SparkSession, sf: str) -> DataFrame:
    """What each capped scan of three files met, one of them with an unfinished line; then a scan that finds nothing new, and
    the lines once more, all of which are there already."""
    e = F.col("event_id")
    valid = F.concat(F.lit('{"time":'), e.cast("string"), F.lit(',"body":{"model":"m"}}'))
    value = F.when(e % 11 == 0, "").when(e % 13 == 0, "{broken").otherwise(valid)
    path = F.concat(F.lit("f"), (e % 3).cast("string"))
    lines = b.table(spark, sf, "events").select("event_id", path.alias("path"), value.alias("value"))
    pattern = _written_lines(spark, lines.repartition(3, "path").sortWithinPartitions("path", "event_id"))
    with open(expand_paths(pattern.replace("path=*", "path=f1"))[0], "a") as file:
        file.write('{"time":')
    entries, plans, scans, checkpoint = (new_folder(spark, n) for n in ("entries", "plans", "scans", "checkpoint"))
    keys = lambda: b.tokens(spark, sf)
    for _ in range(2):
        options = {"scans_path": scans, "max_lines": LINES_PER_SCAN, "split_bytes": RANGE_BYTES, "once": True}
        start_ingest(spark, pattern, keys, entries, checkpoint, plans, **options).awaitTermination()
    again = 1 + spark.read.parquet(scans).agg(F.max("step")).first()[0]
    ingest_batch(read_audit_lines(spark, pattern), again, keys(), entries, scans)
    figures = [F.coalesce(n, F.lit(0)).alias(n) for n in ("matched_files", "scanned_files", "unchanged_files", "unfinished_lines")]
    counts = ("processed_lines", "inserted_entries", "blank_lines", "invalid_lines", "bytes_read")
    limit = F.coalesce("line_limit_hit", F.lit(False)).alias("line_limit_hit")
    found = spark.read.schema(SCANS).parquet(scans)
    return found.select("step", *figures, *counts, limit, (F.col("duration_ms") >= 0).alias("timed"))


def _stream_match(spark: SparkSession, sf: str) -> DataFrame:
    entries, matches = new_folder(spark, "entries"), new_folder(spark, "matches")
    filled = b.audit_entries(spark, sf).withColumns(
        {"body": F.lit(""), "messages": F.expr(f"cast(array() as {schemas.MESSAGES})")}
    )
    write_days(filled, entries, 0)
    start_matching(
        spark,
        entries,
        lambda: b.usage_logs(spark, sf),
        lambda: b.tokens(spark, sf),
        matches,
        new_folder(spark, "checkpoint"),
        window=WINDOW,
        once=True,
    ).awaitTermination()
    return current_matches(spark, matches).drop("matched_at")


def _stream_review(spark: SparkSession, sf: str) -> DataFrame:
    """The review requests arrive in four batches that cut all conversations; the rows are those of one run."""
    entries, results, final, index = (new_folder(spark, name) for name in ("entries", "results", "final", "index"))
    fields = T.StructType.fromDDL(schemas.AUDIT_ENTRIES).fields
    requests = conform(b.review_requests(spark, sf), schemas.AUDIT_ENTRIES).select(*[f.name for f in fields])
    requests = cut_lineage(requests.withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(4))))
    checkpoint = new_folder(spark, "checkpoint")
    # The results of an earlier run under the same settings are there already.
    write_results(stored_results(rp.review_plan(b.review_requests(spark, sf), SCOPE)), results, -1)
    for batch in range(4):
        write_days(requests.filter(F.col("batch") == batch).drop("batch"), entries, batch)
        start_review(spark, entries, SCOPE, scorer, CONFIG, results, final, index, checkpoint, once=True).awaitTermination()
    return reviewed(spark, final).select(
        "audit_entry_id", "parent_entry_id", "delta_decision", "effective_decision", "effective_risk_score", "inherited", "status"
    )


QUERIES = {
    "scan_audit_jsonl": _scan,
    "stream_tail_jsonl": _tail,
    "stream_ingest": _stream_ingest,
    "ingest_scans": _scans,
    "audit_status": _status,
    "stream_match": _stream_match,
    "stream_review": _stream_review,
}
