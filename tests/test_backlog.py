"""Work that grows with the input must not grow the number of batches, nor what one task holds."""

import json

from pyspark.sql import functions as F

from meterlens import schemas
from meterlens.functions import audit_fields as af
from meterlens.llm import bytelevel, queries, tokens
from meterlens.operators import matching
from meterlens.sources.audit_lines import LineRange, read_audit_lines, tasks_of
from meterlens.sources.line_plan import lines_of, plan_lines, planned_steps
from meterlens.sources.usage import conform
from meterlens.streaming.ingest import start_ingest
from meterlens.streaming.store import read_table

KEYS = [(7, 1, "prod", "prod")]


def put_lines(folder, count):
    folder.mkdir()
    body = {"headers": {"authorization": "Bearer sk-prod"}, "body": {"model": "m", "prompt": "x"}}
    lines = ["\n" if i % 5 == 4 else json.dumps({"time": 1000 + i, **body}) + "\n" for i in range(count)]
    (folder / "a.jsonl").write_text("".join(lines))
    return lines


def test_a_backlog_of_steps_is_one_batch_and_one_scan_a_step(spark, tmp_path):
    lines = put_lines(tmp_path / "logs", 23)
    out, scans = str(tmp_path / "entries"), str(tmp_path / "scans")
    keys = spark.createDataFrame(KEYS, schemas.TOKENS)
    query = start_ingest(
        spark, str(tmp_path / "logs"), lambda: keys, out, str(tmp_path / "c"), str(tmp_path / "plans"), scans_path=scans,
        max_lines=2, split_bytes=100, once=True,
    )
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 1
    rows = spark.read.parquet(scans).orderBy("step").collect()
    assert [(r.step, r.processed_lines) for r in rows] == [(k, 2) for k in range(11)] + [(11, 1)]
    blank = [sum(x == "\n" for x in lines[i : i + 2]) for i in range(0, 23, 2)]
    assert [(r.blank_lines, r.inserted_entries) for r in rows] == [(b, r.processed_lines - b) for b, r in zip(blank, rows)]
    assert [r.bytes_read for r in rows] == [sum(len(x) for x in lines[i : i + 2]) for i in range(0, 23, 2)]
    entries = read_table(spark, out, schemas.AUDIT_ENTRIES).collect()
    assert sorted(r.source_line for r in entries) == [i + 1 for i in range(23) if lines[i] != "\n"]


def test_a_file_of_steps_is_read_whole(spark, tmp_path):
    lines = put_lines(tmp_path / "logs", 23)
    plans = str(tmp_path / "plans")
    assert plan_lines(spark, str(tmp_path / "logs"), plans, 2, 100, steps_per_file=5) == 12
    writer = lines_of(planned_steps(spark, plans)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c"))
    query = writer.trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 3
    found = spark.read.schema(schemas.RAW_LINES).parquet(str(tmp_path / "out")).collect()
    assert sorted((r.line_no, r.value) for r in found) == [(i + 1, x.strip()) for i, x in enumerate(lines)]


def test_small_ranges_share_tasks(spark, tmp_path):
    ranges = [LineRange("a", "s", 10 * i, 10 * i + 10, i) for i in range(50_000)]
    tasks = tasks_of(ranges)
    assert len(tasks) <= 400 and [r for t in tasks for r in t.ranges] == ranges
    lines = put_lines(tmp_path / "logs", 23)
    frame = read_audit_lines(spark, str(tmp_path / "logs"), split_bytes=3)
    assert sorted((r.line_no, r.value) for r in frame.collect()) == [(i + 1, x.strip()) for i, x in enumerate(lines)]


def test_headers_are_merged_once_a_line(spark):
    lines = spark.createDataFrame([('{"headers":{"A":"1"},"request_headers":{"a":"2","b":" "}}',)], "value string")
    staged = af.with_headers(af.with_members(af.lj.with_object(lines, "value", "doc"), "doc", "members"), "members")
    found = staged.select(F.explode("headers").alias("name", "text"))
    assert dict(found.collect())["a"] == "2"
    filters = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter" in x]
    assert not [x for x in filters if "map_from_entries" in x]


def test_a_search_takes_tasks_by_its_rows(spark, monkeypatch):
    log = "id long, created_at long, use_time long, token_id long, model_name string, request_id string"
    entry = "id long, created_at long, has_timestamp boolean, token_id long, model string"
    logs = conform(spark.createDataFrame([(i, 10_000 + 40 * i, 0, 7, "m", "") for i in range(30)], log), schemas.USAGE_LOGS)
    rows = [(i, 10_003 + 40 * i, True, 7, "m" if i % 3 else "n") for i in range(30)]
    entries = conform(spark.createDataFrame(rows, entry), schemas.AUDIT_ENTRIES)
    keys = spark.createDataFrame(KEYS, schemas.TOKENS)

    def found():
        frame = matching.match_token_time(logs, keys, entries, 60, 3)
        got = sorted((r.log_id, r["rank"], r.entry_id) for r in frame.collect())
        return got, frame._jdf.queryExecution().executedPlan().toString()

    plain, _ = found()
    assert plain and plain[0] == (0, 1, 1)
    monkeypatch.setattr(matching, "ROWS_PER_TASK", 3)
    monkeypatch.setattr(matching, "CHUNK_WINDOWS", 1)
    cut, plan = found()
    assert cut == plain and ", 20)" in plan and "REPARTITION_BY_NUM" in plan


def test_both_encoders_of_one_tokenizer_live_in_one_worker():
    path = queries.tokenizer_path("byte_bpe_50k.json")
    texts = ["Plain words, 12 of them.", "more\n\nand more"]
    one, two = bytelevel.ByteEncoder(path).encode(texts), tokens.Encoder(path).encode(texts)
    assert [x.tolist() for x in one] == [x.tolist() for x in two]
