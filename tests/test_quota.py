import json

import pytest
from pyspark.sql import functions as F

from meterlens.functions import quota as qf
from meterlens.operators import quota as q


def docs(spark, *bodies, **extra):
    rows = [(i, 1000 + i, b if isinstance(b, str) else json.dumps(b), *(v[i] for v in extra.values())) for i, b in enumerate(bodies)]
    columns = ["snapshot", "fetched_at", "body", *extra]
    return spark.createDataFrame(rows, columns)


def test_percent(spark):
    values = [0.03, 0.0, -1.0, 1.0, 42.0, 180.0]
    frame = spark.createDataFrame([(v,) for v in values], "v double").select(qf.used_percent(F.col("v")).alias("u"))
    assert [r.u for r in frame.collect()] == [3.0, 0.0, 0.0, 100.0, 42.0, 100.0]


def test_external_quota_in_cny(spark):
    frame = spark.createDataFrame([(318200450,), (96321750,)], "v long").select(qf.quota_cny(F.col("v")).alias("c"))
    assert [r.c for r in frame.collect()] == [636.4, 192.64]


def test_sub2api_accounts(spark):
    account = {
        "id": 9, "name": "my IKUN one", "type": "oauth", "extra": {
            "session_window_utilization": 0.03, "passive_usage_7d_utilization": 0, "email_address": "a@b.c",
        }, "groups": [{"name": "g"}, {"name": ""}], "session_window_end": "later",
    }
    frame = docs(spark, {"code": 0, "data": {"items": [account]}}, {"code": 7, "message": "no"}, "oops")
    accounts = q.sub2api_accounts(frame)
    row = accounts.first()
    assert (row.email, row.groups, row.can_refresh_usage) == ("a@b.c", ["g"], True)
    windows = {w.window_name: w for w in q.sub2api_estimated_windows(accounts).collect()}
    assert windows["5h 预估"].used_percent == 3 and windows["5h 预估"].remaining_percent == 97
    assert len(windows) == 2 and windows["7d 预估"].resets_at == ""
    states = {s.snapshot: s.error for s in q.sub2api_snapshots(frame).collect()}
    assert states == {0: "", 1: "accounts code 7: no", 2: "decode accounts"}
    quotas = q.external_quota(docs(spark, {"success": True, "data": {"id": 5, "quota": 318200450}}))
    assert q.attach_quota(accounts, quotas).first().balance_cny == 636.4
    assert q.attach_quota(accounts, quotas, account_id=8).first().balance_cny is None


def test_sub2api_live(spark):
    body = {
        "code": 0,
        "data": {
            "five_hour": {"utilization": 3, "window_stats": {"requests": 119, "tokens": 17278452}},
            "seven_day": {"utilization": 0, "remaining_seconds": 593046},
        },
    }
    windows = q.sub2api_live_windows(docs(spark, body, account_id=["9"])).collect()
    assert [(w.remaining_percent, w.requests, w.window_seconds) for w in windows] == [(97, 119, 0), (100, 0, 593046)]


def test_opencode_windows(spark):
    accounts = q.opencode_accounts(docs(spark, [{"id": "x", "enabled": True, "account_type": "managed", "setup_step": "ready"}]))
    assert accounts.first().can_refresh_usage
    prices = docs(spark, {"limits": {"window_5h": 12, "window_week": 30, "window_month": 60}})
    usage = docs(spark, {"window_5h": 3, "window_week": 12, "window_month": 75}, account_id=["x"])
    windows = {w.window_name: w for w in q.opencode_windows(accounts, prices, usage).collect()}
    assert windows["5h"].remaining_value == 9 and windows["周"].remaining_percent == 60
    assert (windows["月"].remaining_value, windows["月"].used_percent) == (0, 100)


def test_pool(spark):
    files = [
        {"type": "codex", "name": "one@mail.json", "auth_index": "1"},
        {"typo": "CODEX", "id": "two", "auth_index": 2},
        {"type": "codex", "name": "three", "auth_index": "3"},
        {"type": "codex", "name": "four"},
        {"type": "gemini", "name": "five", "auth_index": "5"},
    ]
    listed = q.pool_files(docs(spark, {"files": files}), "codex")
    assert listed.count() == 4 and q.pool_files(docs(spark, {"files": files}), "codex", 2).count() == 2

    def usage(first, second):
        part = {"primary_window": {"used_percent": first, "limit_window_seconds": 18000, "reset_after_seconds": 60}}
        if second is not None:
            part["secondary_window"] = {"used_percent": second, "reset_at": "2024-01-01T00:00:00Z"}
        return {"status_code": 200, "body": json.dumps({"rate_limit": part})}

    bodies = [usage(20, 40), usage(98, None), {"status_code": 401, "body": ""}]
    probes = spark.createDataFrame(
        [(0, 1000, json.dumps(b), str(i + 1), 200) for i, b in enumerate(bodies)],
        "snapshot long, fetched_at long, body string, auth_index string, http_status int",
    )
    accounts = q.pool_accounts(listed, probes)
    errors = {a.account_name: a.error for a in accounts.collect()}
    assert errors == {"one@mail.json": "", "two": "", "three": "401", "four": "missing auth_index"}
    windows = {(w.account_name, w.window_name): w for w in q.pool_windows(accounts).collect()}
    assert windows["one@mail.json", "primary_window"].remaining_percent == 80
    assert windows["one@mail.json", "primary_window"].resets_at == "1970-01-01T00:17:40Z"
    assert windows["one@mail.json", "secondary_window"].remaining_percent == 60
    assert windows["two", "primary_window"].remaining_percent == 2


def test_xfyun_limit(spark):
    row = {"name": "p", "codingPlanUsageDTO": {"packageLimit": 40000, "packageUsage": 2350, "packageLeft": 37650}}
    frame = docs(
        spark,
        {"code": 0, "succeed": True, "data": {"rows": [row]}},
        {"code": 4001, "succeed": False, "message": "x"},
        account_id=[1, 2], account_name=["a", "b"], has_session=[True, True], http_status=[200, 200],
    )
    accounts = q.xfyun_accounts(frame)
    assert {a.account_id: a.status for a in accounts.collect()} == {1: "ok", 2: "expired"}
    window = q.xfyun_windows(accounts).first()
    assert window.remaining_percent == pytest.approx(94.125, abs=0.05) and window.remaining_value == 37650


def test_balances_stay_text(spark):
    body = {"is_available": True, "balance_infos": [
        {"currency": "CNY", "total_balance": "110.00", "granted_balance": "10.00", "topped_up_balance": "100.00"}
    ]}
    row = q.currency_balances(docs(spark, body)).first()
    assert (row.total_balance, row.granted_balance, row.topped_up_balance) == ("110.00", "10.00", "100.00")


def test_last_good(spark):
    history = spark.createDataFrame(
        [("a", 1, False, "e1", None), ("a", 2, True, "", "p2"), ("a", 3, False, "e3", None), ("b", 2, False, "x", None)],
        "channel string, fetched_at long, ok boolean, error string, payload string",
    )
    shown = {(r.channel, r.fetched_at): (r.ok, r.error, r.updated_at, r.payload) for r in q.last_good(history).collect()}
    assert shown == {
        ("a", 1): (False, "e1", 1, None),
        ("a", 2): (True, "", 2, "p2"),
        ("a", 3): (True, "stale: e3", 2, "p2"),
        ("b", 2): (False, "x", 2, None),
    }
