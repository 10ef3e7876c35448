import os
import random
from datetime import date

import pytest

from meterlens import schemas
from meterlens.operators import rollup as r, usage as u
from meterlens.sources.usage import conform, read_usage_logs, write_usage_logs

DAY = 86400
FIELDS = (
    "id long, created_at long, type int, user_id long, username string, token_id long, token_name string, model_name string, "
    "prompt_tokens long, completion_tokens long, quota long, other string"
)
OTHERS = [
    None, "", "{bad", '{"cache_tokens":7}', '{"cache_tokens":3,"input_tokens_total":900}',
    '{"cache_tokens":5,"cache_write_tokens":2,"usage_semantic":"anthropic","model_ratio":1,"group_ratio":1,"completion_ratio":2,"cache_ratio":0.5,"cache_creation_ratio":1.25}',
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(9)
    rows = []
    for i in range(600):
        at = None if i % 97 == 0 else 20 * DAY + rng.randrange(9 * DAY)
        key = 1 if i % 3 else rng.choice([None, 2, 3, 4])
        rows.append(
            (i, at, rng.choice([2, 2, 5, 1]), rng.choice([None, 1, 2, 3]), rng.choice(["a", "b"]), key, rng.choice(["", "n1", "n2"]),
             rng.choice(["", None, "m1", "m2"]), rng.choice([None, 10, 400]), rng.choice([None, 3]), rng.choice([None, 0, 5000]), rng.choice(OTHERS))
        )
    folder = tmp_path_factory.mktemp("rollup")
    write_usage_logs(conform(spark.createDataFrame(rows, FIELDS), schemas.USAGE_LOGS), str(folder / "logs"))
    logs = read_usage_logs(spark, str(folder / "logs"))
    keys = spark.createDataFrame([(1, 1, "one", "sk-111111111"), (2, 1, "two", "sk-222222222")], schemas.TOKENS)
    through = date(1970, 1, 27)
    r.write_rollup(logs, str(folder / "rollup"), date(1970, 1, 21), through)
    return logs, keys, r.Rollup.read(spark, logs, str(folder / "rollup"), through), folder


def rows_of(df):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in row) for row in df.collect()), key=str)


RANGES = [(0, 0), (20 * DAY, 0), (21 * DAY + 5, 26 * DAY - 9), (22 * DAY, 23 * DAY - 1), (22 * DAY + 1, 22 * DAY + 50), (0, 24 * DAY + 3), (25 * DAY + 1, 29 * DAY), (40 * DAY, 41 * DAY)]


@pytest.mark.parametrize("start, end", RANGES)
def test_ranges_equal_the_logs(tables, start, end):
    logs, keys, rollup, _ = tables
    assert rows_of(r.rollup_summary(rollup, start=start, end=end)) == rows_of(u.usage_summary(logs, start=start, end=end))
    mine, theirs = (r.rollup_key_usage(rollup, keys, start=start, end=end), u.key_usage(logs, keys, start=start, end=end))
    assert rows_of(mine) == rows_of(theirs)
    mine, theirs = r.rollup_model_usage_by_key(rollup, start=start, end=end), u.model_usage_by_key(logs, start=start, end=end)
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows_of(mine.select(*theirs.columns)) == rows_of(theirs)


def test_sketch_search_and_one_key(tables):
    logs, keys, rollup, _ = tables
    few, exact = (r.rollup_summary(rollup, start=21 * DAY + 5, exact=e).first().asDict() for e in (False, True))
    assert few == exact  # sketches of a handful of values are exact
    assert rows_of(r.rollup_key_usage(rollup, keys, query="ONE")) == rows_of(u.key_usage(logs, keys, query="ONE"))
    mine, theirs = r.rollup_model_usage(rollup, 1), u.model_usage(logs, 1)
    assert rows_of(mine.select(*theirs.columns)) == rows_of(theirs)


def test_a_day_made_again_replaces_itself(spark, tables):
    logs, _, rollup, folder = tables
    before = rollup.keys.count()
    r.write_rollup(logs, str(folder / "rollup"), date(1970, 1, 23), date(1970, 1, 24))
    again = r.Rollup.read(spark, logs, str(folder / "rollup"), rollup.through)
    assert again.keys.count() == before and again.days.count() == 7
    assert rows_of(r.rollup_summary(again)) == rows_of(u.usage_summary(logs))


def test_whole_days_read_no_logs(spark, tables):
    logs, _, rollup, folder = tables
    rollup = r.Rollup.read(spark, logs, str(folder / "rollup"), rollup.through)  # days may have been replaced
    expected = rows_of(u.usage_summary(logs, start=22 * DAY + 5, end=26 * DAY - 1))
    spoiled = []
    for top, _, files in os.walk(folder / "logs"):
        if any(f"event_date=1970-01-{d}" in top for d in (24, 25, 26)):
            spoiled += [os.path.join(top, f) for f in files if f.endswith(".parquet")]
    assert spoiled
    whole = {path: open(path, "rb").read() for path in spoiled}
    for path in spoiled:
        open(path, "wb").write(b"")
    try:
        assert rows_of(r.rollup_summary(rollup, start=22 * DAY + 5, end=26 * DAY - 1)) == expected
        assert r.rollup_summary(rollup, start=22 * DAY + 5, end=26 * DAY - 1, exact=False).count() == 1
    finally:
        for path, data in whole.items():
            open(path, "wb").write(data)
