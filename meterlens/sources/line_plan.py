"""Plans for reading growing files: which lines are new, counted by tasks, in steps of a bounded number of lines.

A scan looks at the files' sizes, has tasks count the line ends of the new bytes range by range, and sums the counts up. The
driver sees one row a file and one a range; it opens no file. A step of the plan takes at most a given number of lines over the
files in sorted order, and cuts a range where it has to: a row of the plan is (file, first byte of a range, lines to skip, lines
to take). The states of all files and the steps of a scan are written as one file first, and then each step, or each so many steps
in a row, as a file of its own, which Spark's file source picks up one by one. So a scan that was broken off is published in full by
the next one, and a restart needs nothing but this folder.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from meterlens import schemas
from meterlens.sources.audit_lines import (
    BATCH_ROWS,
    MAX_LINES_PER_TRIGGER,
    SPLIT_BYTES,
    expand_paths,
    file_id,
    lines_batch,
    source_id,
)

#: Bytes that a task counts, at least where files are large.
COUNT_BYTES = 32 << 20
CHUNK = 8 << 20
#: Lines that a micro-batch may take. A backlog of many small steps then needs few batches.
LINES_PER_BATCH = 1_000_000

ROWS = "path string, identity string, source_id string, split long, start long, skip long, take long, first_line long"
FIGURES = "matched_files long, scanned_files long, unchanged_files long, unfinished_lines long, line_limit_hit boolean"
FIGURE_NAMES = [c.split()[0] for c in FIGURES.split(", ")]
#: Rows of a step: those of its ranges, and one with the figures and no path.
STEP = f"scan long, step long, planned_at double, {FIGURES}, {ROWS}"
STATES = "path string, identity string, generation int, size long, byte_offset long, line_no long, seen_at long"
STEPS = f"steps array<struct<figures struct<{FIGURES}>, rows array<struct<{ROWS}>>>>"
SNAPSHOT = f"scan long, first_step long, {STATES}, {STEPS}, steps_per_file long"


@dataclass(frozen=True)
class FileState:
    """A file as a scan sees it, and the byte and the number of lines that were planned before."""

    path: str
    identity: str
    generation: int
    size: int
    byte_offset: int
    line_no: int

    @property
    def source_id(self) -> str:
        return source_id(self.path, self.identity, self.generation)


@dataclass
class Step:
    """What one capped scan takes, and what it meets on its way through the files."""

    scanned_files: int
    unchanged_files: int
    unfinished_lines: int
    line_limit_hit: bool = False
    rows: list[dict] = field(default_factory=list)

    def figures(self) -> dict:
        return {name: value for name, value in vars(self).items() if name != "rows"}


def seen(paths: str, known: dict[str, FileState]) -> list[FileState]:
    """The matched files. Another file under a known path starts over; the same one made shorter is a new generation."""
    found = []
    for path in expand_paths(paths):
        try:
            identity, size = file_id(path)
        except FileNotFoundError:
            continue
        state = known.get(path)
        if state is None or state.identity != identity:
            state = FileState(path, identity, 1, size, 0, 0)
        elif size < state.byte_offset:
            state = FileState(path, identity, state.generation + 1, size, 0, 0)
        found.append(replace(state, size=size))
    return found


def count_lines(path: str, start: int, end: int) -> tuple[int, int | None]:
    """Line ends in the bytes of a range, and the byte after the last one; a file that is gone has none."""
    lines, last = 0, None
    try:
        with open(path, "rb") as file:
            file.seek(start)
            while start < end and (chunk := file.read(min(CHUNK, end - start))):
                lines += chunk.count(b"\n")
                at = chunk.rfind(b"\n")
                last = start + at + 1 if at >= 0 else last
                start += len(chunk)
    except FileNotFoundError:
        pass
    return lines, last


def counted(spark: SparkSession, files: list[FileState], split_bytes: int) -> dict[str, list[tuple[int, int]]]:
    """For each file with new bytes its ranges in order: complete lines that end in them, and where the last one does."""
    ranges = [
        (f.path, start, min(start + split_bytes, f.size)) for f in files for start in range(f.byte_offset, f.size, split_bytes)
    ]
    if not ranges:
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, starts, ends = (c.to_pylist() for c in batch.columns)
            found = [count_lines(*part) for part in zip(paths, starts, ends, strict=True)]
            columns = [pa.array(x, pa.int64()) for x in (starts, [n for n, _ in found], [last for _, last in found])]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), *columns], ["path", "start", "lines", "last"])

    # Ranges may be far smaller than what is worth a task.
    size = sum(end - start for _, start, end in ranges)
    tasks = min(len(ranges), max(4 * spark.sparkContext.defaultParallelism, -(-size // COUNT_BYTES)))
    table = spark.createDataFrame(ranges, "path string, start long, end long").repartition(tasks)
    found: dict[str, list[tuple[int, int]]] = {}
    rows = table.mapInArrow(run, "path string, start long, lines long, last long").filter("lines > 0").collect()
    for r in sorted(rows, key=lambda r: (r["path"], r["start"])):
        found.setdefault(r["path"], []).append((r["lines"], r["last"]))
    return found


def steps_of(files: list[FileState], ranges: dict[str, list[tuple[int, int]]], max_lines: int) -> tuple[list[Step], list[FileState]]:
    """The steps that take all complete lines, `max_lines` at most in each, and the files as the last one leaves them.

    Every step goes through the files from the first one on and stops where its lines are used up, so the ones before it count
    as scanned, and as unchanged or with an unfinished line. A step without lines is given only if there is nothing new.
    """
    after, unchanged, unfinished = [], [0], [0]
    for f in files:
        lines, last = 0, f.byte_offset
        for n, end in ranges.get(f.path, ()):
            lines, last = lines + n, end
        after.append(replace(f, byte_offset=last, line_no=f.line_no + lines))
        unchanged.append(unchanged[-1] + (f.size <= last))
        unfinished.append(unfinished[-1] + (f.size > last))

    more = [False] * (len(files) + 1)
    for i in range(len(files) - 1, -1, -1):
        more[i] = more[i + 1] or files[i].path in ranges
    steps, left = [Step(0, 0, 0)], max_lines

    def next_step(before: int, limit: bool) -> int:
        steps[-1].line_limit_hit = limit
        steps.append(Step(before, unchanged[before], unfinished[before]))
        return max_lines

    for i, f in enumerate(files):
        if not left:
            steps[-1].line_limit_hit = True
            if not more[i]:
                break
            left = next_step(i, True)
        steps[-1].scanned_files += 1
        if f.size <= f.byte_offset:
            steps[-1].unchanged_files += 1
            continue
        start, line = f.byte_offset, f.line_no
        for split, (lines, end) in enumerate(ranges.get(f.path, ())):
            skip = 0
            while skip < lines:
                if not left:
                    left = next_step(i, i + 1 < len(files))
                    steps[-1].scanned_files += 1
                take = min(left, lines - skip)
                steps[-1].rows.append(
                    {
                        "path": f.path,
                        "identity": f.identity,
                        "source_id": f.source_id,
                        "split": split,
                        "start": start,
                        "skip": skip,
                        "take": take,
                        "first_line": line + skip,
                    }
                )
                left, skip = left - take, skip + take
            start, line = end, line + lines
        if left and f.size > start:
            steps[-1].unfinished_lines += 1
    return steps, after


def _slot(folder: str, number: int) -> str:
    return f"{folder}/states/slot={number % 2}"


def _read(spark: SparkSession, path: str, schema: str) -> list[Row]:
    try:
        return spark.read.schema(schema).parquet(path).collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def last_snapshot(spark: SparkSession, folder: str) -> list[Row]:
    """The rows of the newest complete scan. Scans are written to two places in turn, so one of them is always whole."""
    found = [_read(spark, _slot(folder, k), SNAPSHOT) for k in (0, 1)]
    return max(found, key=lambda rows: rows[0]["scan"] if rows else -1)


def file_states(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each file that a scan has met, also those without an entry: the byte and the line that were reached."""
    rows = [tuple(r[c.split()[0]] for c in STATES.split(", ")) for r in last_snapshot(spark, folder) if r["path"] is not None]
    return spark.createDataFrame(rows, STATES)


def _known(rows: list[Row]) -> dict[str, FileState]:
    names = ("path", "identity", "generation", "size", "byte_offset", "line_no")
    return {r["path"]: FileState(*(r[n] for n in names)) for r in rows if r["path"] is not None}


def _publish(spark: SparkSession, folder: str, rows: list[Row]) -> None:
    """Write the steps of a snapshot that are not there yet, in order; a file has as many as the snapshot says."""
    names = [c.split()[0] for c in STEP.split(", ")]
    for r in rows:
        steps, size = r["steps"] or (), r["steps_per_file"] or 1
        for first in range(0, len(steps), size):
            path = f"{folder}/steps/{r['first_step'] + first:012d}"
            try:
                if not spark.read.schema(STEP).json(path).isEmpty():
                    continue
            except AnalysisException as error:
                if error.getCondition() != "PATH_NOT_FOUND":
                    raise
            out = []
            for number, step in enumerate(steps[first : first + size], r["first_step"] + first):
                head = {"scan": r["scan"], "step": number, "planned_at": float(r["seen_at"])}
                out += [{**head, **step["figures"].asDict()}, *({**head, **x.asDict()} for x in step["rows"])]
            table = spark.createDataFrame([tuple(x.get(n) for n in names) for x in out], STEP)
            table.coalesce(1).write.mode("overwrite").json(path)


def plan_lines(
    spark: SparkSession,
    paths: str,
    folder: str,
    max_lines: int = MAX_LINES_PER_TRIGGER,
    split_bytes: int = SPLIT_BYTES,
    idle: bool = True,
    steps_per_file: int = 1,
) -> int:
    """Plan all complete lines that no scan has planned yet, and give the number of steps.

    A file that is gone keeps its state. With `idle` a scan that finds nothing new is a step without lines, else none.
    `steps_per_file` steps go into one file and so into one micro-batch.
    """
    rows = last_snapshot(spark, folder)
    _publish(spark, folder, rows)
    head = next((r for r in rows if r["path"] is None), None)
    scan = head["scan"] + 1 if head else 0
    first = head["first_step"] + len(head["steps"]) if head else 0
    known = _known(rows)
    files = seen(paths, known)
    steps, after = steps_of(files, counted(spark, files, split_bytes), max_lines)
    if not steps[-1].rows and not idle:
        steps.pop()
    now = int(time.time())
    states = {**known, **{f.path: f for f in after}}
    met = {f.path for f in after}
    before = {r["path"]: r["seen_at"] for r in rows}
    table = [
        (scan, first, f.path, f.identity, f.generation, f.size, f.byte_offset, f.line_no, now if f.path in met else before[f.path], None, None)
        for f in states.values()
    ]
    planned = [{"figures": {"matched_files": len(files), **s.figures()}, "rows": s.rows} for s in steps]
    table.append((scan, first, None, None, None, None, None, None, now, planned, steps_per_file))
    snapshot = spark.createDataFrame(table, SNAPSHOT)
    snapshot.coalesce(1).write.mode("overwrite").parquet(_slot(folder, scan))
    _publish(spark, folder, [r for r in last_snapshot(spark, folder) if r["path"] is None])
    return len(steps)


def read_planned(path: str, identity: str, source: str, split: int, start: int, skip: int, take: int, first_line: int) -> Iterator[pa.RecordBatch]:
    """The lines of one row of a plan. A file that is gone or has been replaced since gives none."""
    try:
        if file_id(path)[0] != identity:
            return
        file = open(path, "rb", buffering=1 << 20)
    except FileNotFoundError:
        return
    rows: list[tuple] = []
    with file:
        file.seek(start)
        position = start
        for number in range(skip + take):
            raw = file.readline()
            if not raw.endswith(b"\n"):
                break
            if number >= skip:
                text = raw.rstrip(b"\r\n").decode("utf-8", "replace")
                rows.append((path, source, split, number, first_line + number - skip + 1, position, len(raw), text))
                if len(rows) == BATCH_ROWS:
                    yield lines_batch(rows)
                    rows = []
            position += len(raw)
    if rows:
        yield lines_batch(rows)


def lines_of(plan: DataFrame, with_step: bool = False) -> DataFrame:
    """The lines of a plan's rows, each range by one task; `with_step` adds the number of the step that takes the line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for lines in read_planned(*row):
                    yield lines.append_column("step", pa.array([step] * len(lines), pa.int64())) if with_step else lines

    names = [c.split()[0] for c in ROWS.split(", ")]
    # The plan is tiny and what it names is not: the number of tasks must not follow from its size.
    tasks = 2 * plan.sparkSession.sparkContext.defaultParallelism
    rows = plan.filter(F.col("path").isNotNull()).select("step", *names).repartition(tasks, "path", "start", "skip")
    return rows.mapInArrow(run, f"{schemas.RAW_LINES}, step long" if with_step else schemas.RAW_LINES)


def steps_per_batch(max_lines: int) -> int:
    """How many steps of at most `max_lines` lines a micro-batch takes."""
    return max(1, LINES_PER_BATCH // max(1, max_lines))


def planned_steps(spark: SparkSession, folder: str) -> DataFrame:
    """The files of steps as a stream, one in each micro-batch."""
    stream = spark.readStream.schema(STEP).option("recursiveFileLookup", "true")
    return stream.option("maxFilesPerTrigger", 1).json(f"{folder}/steps")
