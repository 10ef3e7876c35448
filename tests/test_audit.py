import json

import pytest
from pyspark.sql import functions as F

from meterlens import schemas
from meterlens.functions.audit_fields import canonical_json, client_columns
from meterlens.functions.messages import with_messages
from meterlens.operators import ingest, matching as m

KEYS = [(7, 1, "prod", "prod-34567890")]


def parse(spark, lines, zone="UTC"):
    rows = [(i + 1, line if isinstance(line, str) else json.dumps(line)) for i, line in enumerate(lines)]
    return ingest.parse_lines(spark.createDataFrame(rows, "line_no long, value string"), zone).orderBy("line_no").collect()


def test_codex_line(spark):
    row = parse(
        spark,
        [
            {
                "time": 1000,
                "method": "post",
                "path": "/v1/chat/completions",
                "user_agent": "codex-tui/0.98.4 (Linux 6.8.1; x86_64)",
                "headers": {"Authorization": "Bearer sk-prod"},
                "body": {"model": "gpt-4o", "messages": [{"role": "user", "content": "hi"}]},
            }
        ],
    )[0]
    assert (row.line_state, row.created_at, row.has_timestamp, row.method) == ("entry", 1000, True, "POST")
    assert (row.client_name, row.client_version, row.client_variant) == ("codex", "0.98.4", "tui")
    assert (row.api_key, row.model) == ("sk-prod", "gpt-4o")


@pytest.mark.parametrize(
    ("value", "zone", "expected"),
    [
        ("2026-06-10 12:34:56", "UTC", 1781094896),
        ("2026-06-10 20:34:56", "Asia/Shanghai", 1781094896),
        ("2026/06/10 12:34:56", "UTC", 1781094896),
        ("2026-06-10T12:34:56Z", "Asia/Shanghai", 1781094896),
        ("2026-06-10T14:34:56.5+02:00", "UTC", 1781094896),
        (1781094896123, "UTC", 1781094896),
        ("1781094896123", "UTC", 1781094896),
        ("1781094896.9", "UTC", 1781094896),
        (1781094896.9, "UTC", 1781094896),
        ("+1781094896", "UTC", 1781094896),
        ("2026-06-10", "UTC", 0),
        ("soon", "UTC", 0),
        (-5, "UTC", 0),
        (True, "UTC", 0),
        (None, "UTC", 0),
    ],
)
def test_times(spark, value, zone, expected):
    row = parse(spark, [{"time": value}], zone)[0]
    assert (row.created_at, row.has_timestamp) == (expected, expected > 0)


def test_line_states_and_aliases(spark):
    rows = parse(
        spark,
        [
            "  ",
            "[1]",
            '{"time":1} {"time":2}',
            '{"Time":"0","TS":5,"RequestId":"a","headers":null,"request_headers":{"X-Api-Key":"***","API-Key":["k1","",2,"k2"]}}',
            '{"path":"/x?a=1&key=q%20r","data":" {\\"b\\": 1, \\"a\\": \\"<\\"} ","headers":{"x-request-id":12}}',
        ],
    )
    assert [r.line_state for r in rows] == ["blank", "invalid", "invalid", "entry", "entry"]
    assert (rows[3].created_at, rows[3].request_id, rows[3].api_key) == (5, "a", "k1,k2")
    assert (rows[4].api_key, rows[4].request_id) == ("q r", "12")
    assert rows[4].body == '{"a":"\\u003c","b":1}'


def test_canonical_json(spark):
    texts = ['{"b":1, "a":[1, {"z":true,"y":null}]}', "plain <text>", ' "s" ', '{"a":1} x']
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(canonical_json(F.col("t")).alias("c")).collect()
    assert [r.c for r in rows] == ['{"a":[1,{"y":null,"z":true}],"b":1}', "plain <text>", '"s"', '{"a":1} x']


@pytest.mark.parametrize(
    ("agent", "expected"),
    [
        ("claude-cli/1.7.33 (external, cli, agent-sdk/0.4.8)", ("claude", "1.7.33", "cli-agent")),
        ("claude-cli/1.0 (sdk-cli)", ("claude", "1.0", "sdk-cli")),
        ("Codex Desktop/3.2-b_1 x", ("codex", "3.2-b_1", "desktop")),
        ("Mozilla CherryStudio/1.5.0 Chrome", ("cherrystudio", "1.5.0", "desktop")),
        ("curl/8", ("unknown", "", "")),
    ],
)
def test_clients(spark, agent, expected):
    rows = spark.createDataFrame([(agent,)], "ua string").withColumns(client_columns(F.col("ua")))
    assert tuple(rows.select("client_name", "client_version", "client_variant").first()) == expected


@pytest.mark.parametrize(
    ("body", "expected"),
    [
        ({"messages": [{"role": "user", "content": " a "}, {"content": [{"text": "b"}, {"input_text": "c"}]}]}, [("user", "a"), ("message", "b\nc")]),
        ({"system": "s", "input": "ignored"}, [("system", "s")]),
        ({"system": "s", "messages": "no list"}, [("system", "s")]),
        ({"messages": [{"role": "assistant", "content": "", "tool_calls": [{"id": "x"}]}]}, [("assistant", '{"id":"x"}')]),
        ({"input": [{"type": "message", "content": "q"}, {"content": "r"}, 5]}, [("message", "q"), ("input", "r")]),
        ({"contents": [{"parts": [{"text": "g"}, {"inline_data": {"d": 1}}]}]}, [("user", "g\n[inline_data]")]),
        ({"prompt": "", "query": "z"}, [("user", "z")]),
        ({"messages": [{"role": "user", "content": [{"image_url": {"url": "u"}}, {"image_url": ""}]}]}, [("user", '[image] {"url":"u"}\n[image]')]),
        ({"messages": [{"role": "user", "content": [[[["deep", {"text": "er"}]]], 1.5, True]}]}, [("user", "deep\ner\n1.5\ntrue")]),
        ({"messages": [{"role": "user", "content": {"image_url": {"image_url": "in"}}}]}, [("user", "[image] [image] in")]),
        ("not json", []),
    ],
)
def test_messages(spark, body, expected):
    text = body if isinstance(body, str) else json.dumps(body)
    row = with_messages(spark.createDataFrame([(text,)], "body string")).first()
    assert [(x.role, x.content) for x in row.messages] == expected


def entry(i, at, token=7, tail="34567890", model="gpt-4o", request="", timed=True):
    return (
        i, "s", "a.jsonl", i, 0, at, timed, at, "POST", "/v1", model, token, tail, "h", "ua", "codex", "1", "tui",
        request, "", [],
    )


def log(i, at, used, token=7, model="gpt-4o", request=""):
    return (i, at, 2, request, 1, "u", token, "t", model, 1, 1, 1, used, False, 0, "", "", "", "")


def tables(spark, logs, entries, matches=()):
    return (
        spark.createDataFrame(logs, schemas.USAGE_LOGS),
        spark.createDataFrame(KEYS, schemas.TOKENS),
        spark.createDataFrame(entries, schemas.AUDIT_ENTRIES),
        spark.createDataFrame(list(matches), schemas.MATCHES),
    )


def test_start_is_estimated_from_use_time(spark):
    logs, keys, entries, none = tables(spark, [log(1, 1010, 10), log(2, 1010, 0)], [entry(5, 1000)])
    found = {r.log_id: r for r in m.match_tiered(logs, keys, entries, none, window=2).collect()}
    assert found[1].matched_by == "token_time" and "+/- 2s" in found[1].matched_note
    assert found[2].matched_by == "token_latest"


def test_unresolved_entry_is_found_by_tail(spark):
    logs, keys, entries, none = tables(spark, [log(1, 1000, 0)], [entry(5, 1000, token=0), entry(6, 1000, token=0, tail="x")])
    assert [r.entry_id for r in m.match_token_time(logs, keys, entries).collect()] == [5]


def test_tiers_and_stickiness(spark):
    logs, keys, entries, _ = tables(
        spark,
        [log(1, 1000, 0), log(2, 9000, 0, request="r"), log(3, 9000, 0), log(4, 9000, 0, token=0)],
        [entry(5, 1000), entry(6, 0, request="r", timed=False), entry(7, 1001, model="other")],
    )
    none = spark.createDataFrame([], schemas.MATCHES)
    found = m.match_tiered(logs, keys, entries, none, limit=2)
    tiers = {r.log_id: r.matched_by for r in found.collect()}
    assert tiers == {1: "token_time", 2: "request_id", 3: "token_latest"}
    kept = m.new_matches(found, none, F.lit(1)).collect()
    assert {(r.log_id, r.audit_entry_id) for r in kept} == {(1, 5), (2, 6)}
    stored = spark.createDataFrame([(1, 7, "token_time", "n", 1)], schemas.MATCHES)
    again = m.match_tiered(logs.filter("id = 1"), keys, entries, stored).collect()
    assert [(r.entry_id, r.matched_note) for r in again] == [(7, "cached match; n")]
    assert m.new_matches(m.match_tiered(logs, keys, entries, stored), stored, F.lit(1)).filter("log_id = 1").isEmpty()
    page = m.match_tiered(logs, keys, entries, none, limit=2, page=True)
    order = ["log_id", "rank", "entry_id"]
    assert page.select(order).orderBy(order).collect() == found.select(order).orderBy(order).collect()


def test_ranking_steps(spark):
    # Same model first, then nearer to the start, then nearer to the end, then the newer id.
    entries = [entry(1, 1000, model="x"), entry(2, 990), entry(3, 1010), entry(4, 1010), entry(5, 1200)]
    logs, keys, table, _ = tables(spark, [log(1, 1030, 30), log(2, 1000, 0)], entries)
    found = m.match_token_time(logs, keys, table, 120, 4)
    lists = {
        i: [r.entry_id for r in found.filter(F.col("log_id") == i).orderBy("rank").collect()] for i in (1, 2)
    }
    assert lists == {1: [4, 3, 2, 1], 2: [4, 3, 2, 1]}
    best = {r.log_id: r.entry_id for r in m.match_token_time(logs, keys, table, 120, 1).collect()}
    assert best == {1: 4, 2: 4}


def test_ids_follow_path_and_line(spark):
    rows = [("s", "b", 1), ("s", "a", 2), ("s", "a", 1)]
    frame = spark.createDataFrame(rows, "source_id string, source_path string, source_line long")
    ids = {(r.source_path, r.source_line): r.id for r in ingest.assign_ids(frame, after=10).collect()}
    assert ids == {("a", 1): 11, ("a", 2): 12, ("b", 1): 13}


def test_a_page_is_checked(spark):
    logs, keys, entries, none = tables(spark, [log(i, 1000, 0) for i in range(501)], [entry(5, 1000)])
    with pytest.raises(ValueError):
        m.match_tiered(logs, keys, entries, none, page=True)


def test_deep_contents_are_trimmed_like_plain_ones(spark):
    from meterlens.functions.messages import with_messages

    text = "\u001c x \u00a0"
    bodies = [json.dumps({"messages": [{"content": c}]}) for c in (text, [[text]], [[[text]]])]
    rows = with_messages(spark.createDataFrame([(i, x) for i, x in enumerate(bodies)], "i int, body string")).orderBy("i").collect()
    assert [r.messages[0].content for r in rows] == ["\u001c x"] * 3
