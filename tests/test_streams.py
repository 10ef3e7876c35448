import builtins
import json
import os
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from meterlens import schemas
from meterlens.operators import ingest
from meterlens.operators.review_plan import ReviewScope, prefix_digests
from meterlens.functions.decisions import PASS
from meterlens.operators.review_score import config_hash
from meterlens.plans.review_run import run_review
from meterlens.sources import audit_lines, line_plan
from meterlens.sources.audit_lines import expand_paths, read_audit_lines
from meterlens.sources.line_plan import STEP, file_states, last_snapshot, lines_of, plan_lines, planned_steps
from meterlens.streaming.ingest import ingest_batch, start_ingest
from meterlens.sources.usage import conform, write_usage_logs
from meterlens.streaming.match import current_matches, match_batch, start_log_matching
from meterlens.streaming.review import bucket_of, review_batch, reviewed, start_review
from meterlens.streaming import store
from meterlens.streaming.store import days_in, read_table, widened, write_days, write_folders

from test_review import keyword_scorer

KEYS = [(7, 1, "prod", "prod")]


def line(at, **more):
    return json.dumps({"time": at, "headers": {"authorization": "Bearer sk-prod"}, "body": {"model": "m", "prompt": "x"}, **more}) + "\n"


def put(path, text, mode="a"):
    with open(path, mode) as file:
        file.write(text)


def planned(spark, paths, folder, max_lines=50_000, split_bytes=1 << 20):
    """The steps of the next scan: the values of each, by its rows of the plan."""
    before = {r["first_step"] + len(r["steps"]) for r in last_snapshot(spark, folder) if r["path"] is None}
    plan_lines(spark, paths, folder, max_lines, split_bytes)
    head = next(r for r in last_snapshot(spark, folder) if r["path"] is None)
    assert head["first_step"] == max(before, default=0)
    steps = []
    for number in range(head["first_step"], head["first_step"] + len(head["steps"])):
        rows = lines_of(spark.read.schema(STEP).json(f"{folder}/steps/{number:012d}")).collect()
        steps.append([r.value for r in sorted(rows, key=lambda r: (r.path, r.source_id, r.line_no))])
    return steps


def states(spark, folder):
    return {os.path.basename(r.path): r for r in file_states(spark, folder).collect()}


def test_patterns(tmp_path):
    (tmp_path / "logs").mkdir()
    for name in ("logs/b.jsonl", "logs/a.jsonl", "logs/c.txt", "d.log"):
        put(tmp_path / name, "x\n")
    found = expand_paths(f" {tmp_path}/logs ;{tmp_path}/d.log,{tmp_path}/*.log\n{tmp_path}/none")
    assert [os.path.relpath(p, tmp_path) for p in found] == ["d.log", "logs/a.jsonl", "logs/b.jsonl"]


def test_tail_offsets(spark, tmp_path):
    path, plans = str(tmp_path / "a.jsonl"), str(tmp_path / "plans")
    put(path, "one\n\ntwo\nthr")
    assert planned(spark, path, plans) == [["one", "", "two"]]
    assert planned(spark, path, plans) == [[]]
    put(path, "ee\nfour\n")
    assert planned(spark, path, plans) == [["three", "four"]]
    assert states(spark, plans)["a.jsonl"].line_no == 5
    put(path, "new\n", "w")
    assert planned(spark, path, plans) == [["new"]] and states(spark, plans)["a.jsonl"].generation == 2
    other = str(tmp_path / "other")
    put(other, "replaced and longer\n")
    os.replace(other, path)
    assert planned(spark, path, plans) == [["replaced and longer"]] and states(spark, plans)["a.jsonl"].generation == 1
    os.remove(path)
    assert planned(spark, path, plans) == [[]] and states(spark, plans)["a.jsonl"].line_no == 1


def test_line_cap_and_restart(spark, tmp_path):
    for name in ("a.jsonl", "b.jsonl"):
        put(tmp_path / name, "1\n2\n3\n")
    plans = str(tmp_path / "plans")
    # Nothing but the folder is kept between the scans. Ranges are shorter than lines, and steps cut ranges.
    assert planned(spark, str(tmp_path), plans, 4, 3) == [["1", "2", "3", "1"], ["2", "3"]]
    put(tmp_path / "a.jsonl", "4\n")
    assert planned(spark, str(tmp_path), plans, 4, 3) == [["4"]]


def test_many_ranges_keep_line_numbers(spark, tmp_path):
    texts = {f"{n}.jsonl": [f"{n}-{i}-" + "é" * (i % 41) for i in range(60 * n)] for n in range(4)}
    for name, lines in texts.items():
        put(tmp_path / name, "".join(x + "\n" for x in lines) + "unfinished")
    plans = str(tmp_path / "plans")
    assert plan_lines(spark, str(tmp_path), plans, max_lines=37, split_bytes=50) == -(-sum(map(len, texts.values())) // 37)
    out = lines_of(planned_steps(spark, plans)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c"))
    query = out.trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    sizes = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    assert len(sizes) == 10  # one step in each batch
    rows = spark.read.schema(schemas.RAW_LINES).parquet(str(tmp_path / "out")).collect()
    found = sorted((os.path.basename(r.path), r.line_no, r.value) for r in rows)
    assert found == sorted((name, i + 1, x) for name, lines in texts.items() for i, x in enumerate(lines))
    whole = read_audit_lines(spark, str(tmp_path)).collect()
    names = ("path", "source_id", "line_no", "byte_offset", "byte_length", "value")
    assert {tuple(r[n] for n in names) for r in rows} == {tuple(r[n] for n in names) for r in whole}


def test_broken_off_scan_is_published(spark, tmp_path, monkeypatch):
    put(tmp_path / "a.jsonl", "1\n2\n3\n")
    plans = str(tmp_path / "plans")
    monkeypatch.setattr(line_plan, "_publish", lambda *a: None)
    plan_lines(spark, str(tmp_path), plans, 2)
    monkeypatch.undo()
    put(tmp_path / "a.jsonl", "4\n")
    assert plan_lines(spark, str(tmp_path), plans, 2) == 1
    rows = lines_of(spark.read.schema(STEP).option("recursiveFileLookup", "true").json(f"{plans}/steps")).collect()
    assert sorted((r.line_no, r.value) for r in rows) == [(1, "1"), (2, "2"), (3, "3"), (4, "4")]


def test_the_driver_opens_no_file(spark, tmp_path, monkeypatch):
    put(tmp_path / "a.jsonl", "1\n2\n")
    opened = []
    real = builtins.open
    monkeypatch.setattr(builtins, "open", lambda *a, **k: (opened.append(str(a[0])), real(*a, **k))[1])
    plan_lines(spark, str(tmp_path), str(tmp_path / "plans"))
    assert not [p for p in opened if p.endswith(".jsonl")]


def test_steps_count_files_as_they_are_met():
    names = ["a", "b", "c", "d"]
    files = [line_plan.FileState(n, "i", 1, size, 0, 0) for n, size in zip(names, (30, 0, 25, 10), strict=True)]
    ranges = {"a": [(2, 20), (1, 30)], "c": [(2, 20)], "d": [(1, 10)]}  # c has an unfinished line, b is empty
    steps, after = line_plan.steps_of(files, ranges, 2)
    met = [(s.scanned_files, s.unchanged_files, s.unfinished_lines, s.line_limit_hit) for s in steps]
    assert met == [(1, 0, 0, True), (3, 1, 0, True), (4, 2, 1, False)]
    assert [sum(r["take"] for r in s.rows) for s in steps] == [2, 2, 2]
    assert [(f.byte_offset, f.line_no) for f in after] == [(30, 3), (0, 0), (20, 2), (10, 1)]
    steps, _ = line_plan.steps_of(after, {}, 2)
    assert [(s.scanned_files, s.unchanged_files, s.unfinished_lines, s.line_limit_hit) for s in steps] == [(4, 3, 1, False)]


def test_split_reading_equals_whole(spark, tmp_path):
    lines = [f"{i}-" + "é" * (i % 37) for i in range(500)]
    put(tmp_path / "a.jsonl", "\n".join(lines) + "\nunfinished")
    put(tmp_path / "b.jsonl", "only\n")
    rows = read_audit_lines(spark, str(tmp_path), split_bytes=101).collect()
    mine = sorted((r.line_no, r.value) for r in rows if r.path.endswith("a.jsonl"))
    assert mine == [(i + 1, text) for i, text in enumerate(lines)]
    whole = read_audit_lines(spark, str(tmp_path)).collect()
    assert {(r.path, r.byte_offset, r.value) for r in whole} == {(r.path, r.byte_offset, r.value) for r in rows}


def test_ingest_appends_and_never_repeats(spark, tmp_path):
    logs, out = tmp_path / "logs", str(tmp_path / "entries")
    logs.mkdir()
    put(logs / "a.jsonl", line(1000) + "\n" + "{bad\n" + line(1001)[:-1])

    def scan():
        start_ingest(
            spark, str(logs), lambda: spark.createDataFrame(KEYS, schemas.TOKENS), out, str(tmp_path / "checkpoint"),
            str(tmp_path / "plans"), scans_path=str(tmp_path / "stats"), once=True,
        ).awaitTermination()
        rows = read_table(spark, out, schemas.AUDIT_ENTRIES).orderBy("id").collect()
        assert len({r.id for r in rows}) == len(rows)
        return [(i + 1, r.created_at, r.source_line) for i, r in enumerate(rows)]

    assert scan() == [(1, 1000, 1)]
    put(logs / "a.jsonl", "\n")
    put(logs / "b.jsonl", line(1002))
    assert scan() == [(1, 1000, 1), (2, 1001, 4), (3, 1002, 1)]
    assert scan() == [(1, 1000, 1), (2, 1001, 4), (3, 1002, 1)]
    stats = spark.read.parquet(str(tmp_path / "stats")).agg(
        {"processed_lines": "sum", "blank_lines": "sum", "invalid_lines": "sum"}
    ).first().asDict()
    assert stats == {"sum(processed_lines)": 5, "sum(blank_lines)": 1, "sum(invalid_lines)": 1}


def test_one_scan_reads_all_in_capped_batches(spark, tmp_path):
    logs, out, scans = tmp_path / "logs", str(tmp_path / "entries"), str(tmp_path / "scans")
    logs.mkdir()
    put(logs / "a.jsonl", "".join(line(1000 + i) for i in range(5)) + "{unfinished")
    put(logs / "bad.jsonl", "{\n[\n")
    keys = spark.createDataFrame(KEYS, schemas.TOKENS)
    for _ in range(2):
        start_ingest(
            spark, str(logs), lambda: keys, out, str(tmp_path / "checkpoint"), str(tmp_path / "plans"), scans_path=scans,
            max_lines=2, once=True,
        ).awaitTermination()
    rows = read_table(spark, out, schemas.AUDIT_ENTRIES).orderBy("id").collect()
    assert [r.created_at for r in rows] == [1000 + i for i in range(5)] and len({r.id for r in rows}) == 5
    figures = spark.read.parquet(scans).orderBy("step").collect()
    names = ("matched_files", "scanned_files", "unchanged_files", "processed_lines", "inserted_entries", "invalid_lines", "unfinished_lines")
    assert [tuple(r[n] for n in names) + (r.line_limit_hit,) for r in figures] == [
        (2, 1, 0, 2, 2, 0, 0, True),
        (2, 1, 0, 2, 2, 0, 0, True),
        (2, 2, 0, 2, 1, 1, 1, False),
        (2, 2, 0, 1, 0, 1, 1, False),
        (2, 2, 1, 0, 0, 0, 1, False),
    ]
    assert sum(r.bytes_read for r in figures) == sum(len(line(1000 + i)) for i in range(5)) + 4
    # A file without an entry is tracked.
    status = ingest.audit_status(read_table(spark, out, schemas.AUDIT_ENTRIES), file_states(spark, str(tmp_path / "plans"))).first()
    assert (status.tracked_files, status.indexed_rows, status.last_created_at) == (2, 5, 1004)


def test_repeated_batch_replaces_itself(spark, tmp_path):
    out = str(tmp_path / "entries")
    keys = spark.createDataFrame(KEYS, schemas.TOKENS)
    rows = [("a", "s", 0, i, i + 1, 10 * i, 10, line(1000 + i).strip()) for i in range(3)]
    first = spark.createDataFrame(rows[:2], schemas.RAW_LINES)
    both = spark.createDataFrame(rows, schemas.RAW_LINES)
    ingest_batch(first, 0, keys, out)
    ingest_batch(first, 0, keys, out)
    ingest_batch(both, 1, keys, out)
    ingest_batch(both, 1, keys, out)
    entries = read_table(spark, out, schemas.AUDIT_ENTRIES)
    rows = entries.orderBy("id").collect()
    assert [(r.source_line, r.token_id) for r in rows] == [(1, 7), (2, 7), (3, 7)] and len({r.id for r in rows}) == 3


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_stored_tables_are_read_by_day(spark, tmp_path):
    rows = [("a", "s", 0, i, i + 1, 10 * i, 10, line(1000 + i * 86400).strip()) for i in range(5)]
    out = str(tmp_path / "entries")
    ingest_batch(spark.createDataFrame(rows, schemas.RAW_LINES), 0, spark.createDataFrame(KEYS, schemas.TOKENS), out)
    some = read_table(spark, out, schemas.AUDIT_ENTRIES, days=[date(1970, 1, 2), date(1970, 1, 5)])
    assert sorted(r.created_at for r in some.collect()) == [87400, 346600]
    assert "PartitionFilters: [event_date" in _plan(some)


LOG = "id long, created_at long, use_time long, token_id long, model_name string, request_id string"


def _entry_lines(times):
    return [("a", "s", 0, i, i + 1, 10 * i, 10, line(t).strip()) for i, t in enumerate(times)]


def test_wrong_clocks_and_late_logs(spark, tmp_path):
    day, keys = 1_700_000_000, spark.createDataFrame(KEYS, schemas.TOKENS)
    entries, matches, logs_path = (str(tmp_path / n) for n in ("entries", "matches", "logs"))
    ingest_batch(spark.createDataFrame(_entry_lines([day, day + 500, 40_000_000]), schemas.RAW_LINES), 0, keys, entries)
    new = read_table(spark, entries, schemas.AUDIT_ENTRIES)
    logs = conform(spark.createDataFrame([(1, day + 3, 0, 7, "m", "")], LOG), schemas.USAGE_LOGS)
    asked = widened(days_in(new, F.col("created_at")), 2)
    assert len(asked) == 10 and date(1971, 4, 8) in asked
    match_batch(new, 0, logs, keys, entries, matches)
    match_batch(new, 0, logs, keys, entries, matches)
    assert [r.log_id for r in current_matches(spark, matches).collect()] == [1]
    # A log of the same time arrives a week later, when nobody looks at these entries any more.
    late = conform(spark.createDataFrame([(1, day + 3, 0, 7, "m", ""), (2, day + 501, 0, 7, "m", "")], LOG), schemas.USAGE_LOGS)
    write_usage_logs(late, logs_path)
    for _ in range(2):
        start_log_matching(spark, logs_path, lambda: keys, entries, matches, str(tmp_path / "c"), once=True).awaitTermination()
    found = sorted((r.log_id, r.audit_entry_id) for r in current_matches(spark, matches).collect())
    assert found == [(1, 1), (2, 2)]
    assert read_table(spark, matches, schemas.MATCHES).count() == 2


@pytest.mark.parametrize("seed", [1, 2])
def test_streamed_review_equals_one_run(spark, tmp_path, seed):
    rng = random.Random(seed)
    requests, at = [], 1000
    for talk in range(7):
        turns = [rng.choice(["hi", "危险请求", "more", "x" * 9]) + str(talk % 2) for _ in range(rng.randint(1, 5))]
        for n in range(1, len(turns) + 1):
            at += rng.randint(0, 2)
            messages = [{"role": "user", "content": t} for t in turns[:n]]
            requests.append((len(requests) + 1, talk % 2 + 1, at, "m", messages))
    rng.shuffle(requests)
    rows = [(i, k, t, m, x) for i, k, t, m, x in requests]
    all_entries = conform(spark.createDataFrame(rows, f"id long, token_id long, created_at long, model string, messages {schemas.MESSAGES}"), schemas.AUDIT_ENTRIES)
    scope = ReviewScope([1, 2], ["m"], 1, 10**9, branch_history=4)
    config = config_hash("u", "m", "p")
    single = run_review(all_entries, scope, spark.createDataFrame([], schemas.REVIEW_RESULTS), keyword_scorer(), config)
    fields = ("audit_entry_id", "parent_entry_id", "delta_decision", "effective_decision", "effective_risk_score", "inherited")
    expected = sorted(tuple(r[f] for f in fields) for r in single.final.collect())
    entries, results, final, index = (str(tmp_path / n) for n in ("entries", "results", "final", "index"))
    cuts = sorted(rng.sample(range(1, len(rows)), 2))
    for batch, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        part = all_entries.filter(F.col("id").isin([r[0] for r in rows[a:b]]))
        write_days(part, entries, batch)
        start_review(spark, entries, scope, keyword_scorer(), config, results, final, index, str(tmp_path / "c"), once=True).awaitTermination()
    got = sorted(tuple(r[f] for f in fields) for r in reviewed(spark, final).collect())
    assert got == expected and len({r[0] for r in got}) == len(rows)
    assert any(r[5] for r in got)


def test_batch_reads_what_it_names(spark, tmp_path):
    """Folders that hold nothing of a batch's prefixes and contents, the final rows, and days before it are never opened."""
    def request(i, at, *turns):
        return (i, 1, at, "m", [{"role": "user", "content": t} for t in turns])

    def frame(rows):
        return conform(spark.createDataFrame(rows, f"id long, token_id long, created_at long, model string, messages {schemas.MESSAGES}"), schemas.AUDIT_ENTRIES)

    entries, results, final, index = (str(tmp_path / n) for n in ("entries", "results", "final", "index"))
    scope, config, day = ReviewScope([1], ["m"], 1, 10**9), config_hash("u", "m", "p"), 86400
    old = [request(i, day + i, f"危险请求 {i}") for i in range(1, 30)]
    new = [request(40, 3 * day, "危险请求 7", "and now"), request(41, 3 * day + 1, "something else")]
    late = [request(50, 3 * day - 5, "危险请求 9", "late")]
    for batch, rows in enumerate((old, new)):
        write_days(frame(rows), entries, batch)
        if batch == 1:
            names = {bucket_name(spark, d) for r in rows for d in prefixes_of(spark, r)}
            spoil(f"{index}/prefixes", lambda folder: folder not in names)
            hashes = {content_bucket(spark, t) for t in ("and now", "something else")}
            spoil(results, lambda folder: folder not in hashes)
            spoil(final, lambda folder: True)
            spoil(entries, lambda folder: True)
        review_batch(frame(rows), batch, scope, keyword_scorer(), config, entries, results, final, index)
    rows = spark.read.parquet(f"{final}/batch_id=1").collect()
    assert {r.audit_entry_id: (r.parent_entry_id, r.effective_decision != PASS, r.inherited) for r in rows} == {
        40: (7, True, True), 41: (0, False, False)}
    # A late entry reads the days from its own on, and no earlier ones.
    mend(entries, lambda folder: "1970-01-03" <= folder.removeprefix("event_date="))
    write_days(frame(late), entries, 2)
    mend(f"{index}/prefixes", lambda folder: True)
    review_batch(frame(late), 2, scope, keyword_scorer(), config, entries, results, final, index)
    rows = spark.read.parquet(f"{final}/batch_id=2").collect()
    assert {r.audit_entry_id: r.parent_entry_id for r in rows} == {40: 7, 41: 0, 50: 9}


@pytest.mark.parametrize(("limit", "files"), [(1000, 1), (100, 4)])
def test_a_batch_adds_one_file_to_a_folder(spark, tmp_path, monkeypatch, limit, files):
    monkeypatch.setattr(store, "FILE_ROWS", limit)
    path, rows = str(tmp_path / "t"), spark.range(0, 400, 1, 8).withColumn("bucket", (F.col("id") % 3).cast("int"))
    for _ in range(2):
        write_folders(rows, path, 5, "bucket")
    for n in range(3):
        assert 1 <= len(list(parquet_files(f"{path}/bucket={n}", lambda _: True))) <= files
    got = read_table(spark, path, "id long, bucket int").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(i, i % 3) for i in range(400)]
    if files > 1:
        assert len(list(parquet_files(path, lambda _: True))) > 3


def prefixes_of(spark, request):
    frame = spark.createDataFrame([(request[4],)], f"messages {schemas.MESSAGES}")
    return frame.select(prefix_digests(F.col("messages"))).first()[0]


def bucket_name(spark, digest):
    value = spark.createDataFrame([(bytes(digest),)], "d binary").select(bucket_of(F.col("d"))).first()[0]
    return f"bucket={value}"


def content_bucket(spark, text):
    content = f"[角色:user]\n{text}"
    value = spark.createDataFrame([(content,)], "c string").select(bucket_of(F.sha2("c", 256))).first()[0]
    return f"bucket={value}"


def parquet_files(path, wanted):
    for top, _, files in os.walk(path):
        folder = os.path.relpath(top, path).split(os.sep)[0]
        yield from (os.path.join(top, f) for f in files if f.endswith(".parquet") and wanted(folder))


def spoil(path, wanted):
    """Cut the last byte off the files of some folders, so that opening one fails."""
    for file in parquet_files(path, wanted):
        data = open(file, "rb").read()
        open(file, "wb").write(data[:-1])


def mend(path, wanted):
    """Put back what `spoil` took: Parquet files end with the same four bytes."""
    for file in parquet_files(path, wanted):
        data = open(file, "rb").read()
        if not data.endswith(b"PAR1"):
            open(file, "wb").write(data + b"1")


def test_a_split_of_several_parts_keeps_its_line_numbers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(audit_lines, "PART_LINES", 3)
    for name, count in (("a", 20), ("b", 7)):
        put(tmp_path / f"{name}.jsonl", "".join(line(1000 + i) for i in range(count)))
    for split_bytes in (1 << 20, 500):
        rows = read_audit_lines(spark, str(tmp_path), split_bytes).collect()
        found = sorted((os.path.basename(r.path), r.line_no, json.loads(r.value)["time"]) for r in rows)
        assert found == [(f"{n}.jsonl", i + 1, 1000 + i) for n, count in (("a", 20), ("b", 7)) for i in range(count)]


def test_a_file_of_long_splits_that_is_read_again_adds_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(audit_lines, "PART_LINES", 3)
    put(tmp_path / "a.jsonl", "".join(line(1000 + i) for i in range(20)))
    out, scans, keys = str(tmp_path / "out"), str(tmp_path / "scans"), spark.createDataFrame(KEYS, schemas.TOKENS)
    start_ingest(
        spark, str(tmp_path), lambda: keys, out, str(tmp_path / "c"), str(tmp_path / "plans"), scans_path=scans, once=True
    ).awaitTermination()
    ingest_batch(read_audit_lines(spark, str(tmp_path)), 1, keys, out, scans)
    rows = read_table(spark, out, schemas.AUDIT_ENTRIES).orderBy("id").collect()
    assert [(r.source_line, r.token_id, r.messages[0].content) for r in rows] == [(i + 1, 7, "x") for i in range(20)]
    figures = [(r.step, r.processed_lines, r.inserted_entries) for r in spark.read.parquet(scans).orderBy("step").collect()]
    assert figures == [(0, 20, 20), (1, 20, 0)]


def test_new_lines_are_those_without_an_entry_once_and_of_their_first_step(spark, monkeypatch):
    monkeypatch.setattr(ingest, "BLOCK_LINES", 4)
    rows = [(s, n, step) for step in (3, 2, 5) for s in ("a", "b") for n in range(1, 12)]
    rows += [("a", None, 9), ("a", None, 8), (None, 4, 7)]
    lines = spark.createDataFrame(rows, "source_id string, line_no long, step long")
    stored = [("a", n) for n in (1, 4, 8, 11, 50)] + [("c", 2), ("b", 3), ("b", 3), ("a", None), (None, 4)]
    found = ingest.new_lines(lines, spark.createDataFrame(stored, "source_id string, source_line long")).collect()
    known = {x for x in stored if None not in x}
    expected = {(s, n, 2) for s, n, _ in rows if s and n and (s, n) not in known} | {("a", None, 8), (None, 4, 7)}
    assert len(found) == len(expected) and {tuple(r) for r in found} == expected


def test_ids_do_not_depend_on_how_many_sources_there_are(spark, monkeypatch):
    lines = [(f"p{k % 5}", f"s{k % 7}", k // 3 + 1) for k in range(90)]
    frame = spark.createDataFrame(lines, "source_path string, source_id string, source_line long")
    expected = sorted(ingest.assign_ids(frame, 10).collect())
    assert sorted(ingest.assign_ids(frame, 10, frame).collect()) == expected
    monkeypatch.setattr(ingest, "FEW", 3)
    assert sorted(ingest.assign_ids(frame, 10, frame).collect()) == expected
