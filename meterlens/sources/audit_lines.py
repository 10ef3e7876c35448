"""JSONL audit files as a Spark data source, read in splits with line numbers.

`line_plan` follows files that grow, are truncated and are rotated, which the built-in file source never sees. Files must lie on
a path that the driver and all executors can open.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from meterlens import schemas

FORMAT = "audit_lines"
SPLIT_BYTES = 128 << 20
# Small splits share a task: as many as make up a two-hundredth of all bytes, at most `SPLIT_BYTES`.
TASKS = 200
MAX_LINES_PER_TRIGGER = 50_000
BATCH_ROWS = 4096
# Lines of a split that stay together when they are numbered.
PART_LINES = 50_000
ARROW_SCHEMA = pa.schema(
    [
        ("path", pa.string()),
        ("source_id", pa.string()),
        ("split", pa.int64()),
        ("split_line", pa.int64()),
        ("line_no", pa.int64()),
        ("byte_offset", pa.int64()),
        ("byte_length", pa.int64()),
        ("value", pa.string()),
    ]
)


def expand_paths(patterns: str) -> list[str]:
    """Files of a list of patterns separated by comma, semicolon or line end; a folder means its *.jsonl files."""
    for separator in ";\n":
        patterns = patterns.replace(separator, ",")
    found: set[str] = set()
    for pattern in filter(None, (p.strip() for p in patterns.split(","))):
        if os.path.isdir(pattern):
            pattern = os.path.join(pattern, "*.jsonl")
        found.update(path for path in glob.glob(pattern) if not os.path.isdir(path))
    return sorted(found)


def file_id(path: str) -> tuple[str, int]:
    """Identity of the file behind a path, and its size."""
    info = os.stat(path)
    return f"{info.st_dev}:{info.st_ino}", info.st_size


def source_id(path: str, identity: str, generation: int) -> str:
    """Identity of one generation of a file; the path is part of it, since inodes come back."""
    return f"{path}#{identity}:{generation}"


@dataclass
class LineRange:
    """Bytes of one file, which may start inside a line."""

    path: str
    source: str
    start: int
    end: int
    split: int
    count_only: bool = False


@dataclass
class LineRanges(InputPartition):
    """Ranges that one task reads one after another."""

    ranges: list[LineRange]


def tasks_of(ranges: list[LineRange]) -> list[LineRanges]:
    """The ranges in order, put together until they are worth a task."""
    worth = min(SPLIT_BYTES, sum(r.end - r.start for r in ranges) // TASKS)
    tasks, held = [], 0
    for part in ranges:
        if not tasks or held + part.end - part.start > worth:
            tasks.append(LineRanges([]))
            held = 0
        tasks[-1].ranges.append(part)
        held += part.end - part.start
    return tasks


def read_range(part: LineRange) -> Iterator[pa.RecordBatch]:
    """The complete lines that begin inside the range; an unfinished last line is left for later."""
    rows: list[tuple] = []
    line = 0
    with open(part.path, "rb", buffering=1 << 20) as file:
        file.seek(max(0, part.start - 1))
        if part.start:
            file.readline()
        position = file.tell()
        while position < part.end:
            raw = file.readline()
            if not raw.endswith(b"\n"):
                break
            if not part.count_only:
                text = raw.rstrip(b"\r\n").decode("utf-8", "replace")
                rows.append((part.path, part.source, part.split, line, None, position, len(raw), text))
                if len(rows) == BATCH_ROWS:
                    yield lines_batch(rows)
                    rows = []
            position += len(raw)
            line += 1
    if part.count_only:
        rows.append((part.path, part.source, part.split, line, None, part.start, position - part.start, None))
    if rows:
        yield lines_batch(rows)


def lines_batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of raw lines as a batch."""
    columns = [pa.array(values, type=field.type) for values, field in zip(zip(*rows), ARROW_SCHEMA)]
    return pa.RecordBatch.from_arrays(columns, schema=ARROW_SCHEMA)


class AuditLines(DataSource):
    """`path`: patterns. `splitBytes`, `countOnly`."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return schemas.RAW_LINES

    def reader(self, schema) -> DataSourceReader:
        return AuditLinesReader(self.options)


class AuditLinesReader(DataSourceReader):
    """Files cut into byte ranges, so that one huge file is read by many tasks."""

    def __init__(self, options) -> None:
        self.paths = options["path"]
        self.split_bytes = int(options.get("splitBytes", SPLIT_BYTES))
        self.count_only = options.get("countOnly", "false").lower() == "true"

    def partitions(self) -> list[LineRanges]:
        parts = []
        for path in expand_paths(self.paths):
            identity, size = file_id(path)
            source = source_id(path, identity, 1)
            for number, start in enumerate(range(0, size, self.split_bytes)):
                end = min(start + self.split_bytes, size)
                parts.append(LineRange(path, source, start, end, number, self.count_only))
        return tasks_of(parts)

    def read(self, partition: LineRanges) -> Iterator[pa.RecordBatch]:
        for part in partition.ranges:
            yield from read_range(part)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(AuditLines)


def read_audit_lines(spark: SparkSession, paths: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All complete lines with their line numbers.

    A split does not know how many lines come before it, so the lines of every split are counted first; the counts,
    one row per split, turn the position inside the split into the line number. A split of many lines meets its count in
    parts, so that what follows does not run in one task a split.
    """
    register(spark)
    reader = spark.read.format(FORMAT).option("path", paths).option("splitBytes", split_bytes)
    earlier = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    counts = reader.option("countOnly", "true").load()
    before = F.coalesce(F.sum("split_line").over(earlier), F.lit(0).cast("long")).alias("_before")
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("split_line") / PART_LINES))).alias("_part")
    # In two steps: in one, the sum would run over the parts, and so add up a split of several parts to its own start.
    firsts = counts.select("path", "split", "split_line", before).select("path", "split", "_before", part)
    lines = spark.read.format(FORMAT).option("path", paths).option("splitBytes", split_bytes).load()
    return (
        lines.withColumn("_part", F.floor(F.col("split_line") / PART_LINES))
        .join(firsts, ["path", "split", "_part"])
        .withColumn("line_no", F.col("_before") + F.col("split_line") + 1)
        .select(*[field.name for field in ARROW_SCHEMA])
    )
