"""Hot keys against brute force, and plans without the operators that do not scale."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from meterlens import schemas
from meterlens.operators import matching as m, usage as u
from meterlens.operators.ranking import running_last, running_total

SF = "/root/testdata/sf0.001"


def random_matching(seed, size):
    """One key holds half of the rows, many of them in the same few seconds."""
    rng = random.Random(seed)
    keys = [(1, 1, "hot", "hot-key-AAAAAAAA"), (2, 2, "b", "b-BBBBBBBB")]
    tails = {1: "AAAAAAAA", 2: "BBBBBBBB"}
    logs, entries = [], []
    for i in range(size):
        key = 1 if rng.random() < 0.6 else rng.choice([0, 2, 3])
        at = rng.choice([5000, 5001]) if rng.random() < 0.3 else rng.randint(4000, 9000)
        logs.append((i, at, rng.choice([0, 0, 7, 90000]), key, rng.choice(["a", "b", ""])))
    for i in range(size):
        key = rng.choice([1, 1, 1, 2, 0])
        tail = tails.get(key) or rng.choice(["AAAAAAAA", "BBBBBBBB", ""])
        at = rng.choice([5000, 4990]) if rng.random() < 0.3 else rng.randint(4000, 9000)
        entries.append((1000 + i, at, key, tail, rng.choice(["a", "b"]), rng.random() < 0.95))
    return keys, tails, logs, entries


def brute(tails, logs, entries, window, n):
    found = {}
    for log_id, at, used, key, model in logs:
        if key <= 0:
            continue
        centre = at - used if 0 < used < 86400 else at
        near = [
            (0 if model in ("", e[4]) else 1, abs(e[1] - centre), abs(e[1] - at), -e[0])
            for e in entries
            if e[5] and abs(e[1] - centre) <= window and (e[2] == key or (e[2] == 0 and key in tails and e[3] == tails[key]))
        ]
        for rank, hit in enumerate(sorted(near)[:n], 1):
            found[log_id, rank] = -hit[3]
    return found


@pytest.mark.parametrize(("seed", "window", "n", "chunk"), [(1, 120, 1, 30), (2, 5, 3, 2), (3, 60, 7, 1)])
def test_nearest_match_equals_brute_force(spark, monkeypatch, seed, window, n, chunk):
    monkeypatch.setattr(m, "CHUNK_WINDOWS", chunk)
    keys, tails, logs, entries = random_matching(seed, 400)
    log_rows = [(i, at, 2, "", 1, "u", key, "t", model, 1, 1, 1, used, False, 0, "", "", "", "") for i, at, used, key, model in logs]
    entry_rows = [
        (i, "s", "p", i, 0, at, timed, 0, "", "", model, key, tail, "", "", "", "", "", "", "", [])
        for i, at, key, tail, model, timed in entries
    ]
    rows = m.match_token_time(
        spark.createDataFrame(log_rows, schemas.USAGE_LOGS),
        spark.createDataFrame(keys, schemas.TOKENS),
        spark.createDataFrame(entry_rows, schemas.AUDIT_ENTRIES),
        window,
        n,
    ).collect()
    assert {(r.log_id, r.rank): r.entry_id for r in rows} == brute(tails, logs, entries, window, n)


def test_running_values_across_slices(spark):
    rng = random.Random(7)
    rows = [(1 if i % 3 else 2, i, rng.randint(0, 3), rng.choice([None, f"v{i}"])) for i in range(300)]
    frame = spark.createDataFrame(rows, "k long, t long, n long, v string").repartition(7)
    sums, last, expected = {}, {}, {}
    for k, t, n, v in rows:
        last[k] = v or last.get(k)
        expected[k, t] = (sums.get(k, 0), last[k])
        sums[k] = sums.get(k, 0) + n
    total = running_total(frame, ["k"], [F.col("t")], F.col("n"), "s")
    held = running_last(total, ["k"], [F.col("t")], F.col("v"), "h")
    assert {(r.k, r.t): (r.s, r.h) for r in held.collect()} == expected


def plan_of(df):
    df.sparkSession.conf.set("spark.sql.debug.maxToStringFields", "1000")
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "2000")
    return df._jdf.queryExecution().executedPlan().toString()


# Queries whose plan is built from streams or files; their DataFrames only read results.
@pytest.mark.parametrize(
    "name",
    ["usage_summary", "key_usage", "model_usage_by_key", "logs_page", "match_token_time", "match_token_time_topn",
     "match_tiered", "match_latest", "resolve_key", "review_plan", "risk_inherit", "quota_attach", "quota_cpa"],
)
def test_no_plan_pairs_everything(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    from meterlens.sources.usage import read_usage_logs, write_usage_logs

    rows = [(i, 1704067200 + i * 3600, 2, "", 1, "u", i % 3, "t", "m", 1, 2, 3, 0, False, 0, "", "", "", "") for i in range(100)]
    path = str(tmp_path / "logs")
    write_usage_logs(spark.createDataFrame(rows, schemas.USAGE_LOGS), path)
    logs = read_usage_logs(spark, path)
    assert logs.count() == 100
    plan = plan_of(u.token_summary(logs, 1, start=1704067200, end=1704150000))
    assert "EqualTo(token_id,1)" in plan and "GreaterThanOrEqual(created_at,1704067200)" in plan
    scan = [part for part in plan.split("ReadSchema: ")[1:]][0]
    assert "other" not in scan and "content" not in scan


def test_key_table_joins_one_row_per_key(spark):
    plan = plan_of(entry.queries()["key_usage"](spark, SF))
    join = min(plan.find(word) for word in ("HashJoin [token_id", "SortMergeJoin [token_id") if word in plan)
    assert plan.find("Aggregate(key=[token_id") > join or plan.find("Aggregate(keys=[token_id") > join
    assert "HashAggregate(keys=[token_id" in plan.split("Aggregate(")[0] + plan[plan.rfind("HashAggregate(") :]
