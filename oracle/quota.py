"""Oracles of the quota queries, written from what the documents are made of."""

P = "WITH p AS (SELECT s_suppkey AS s, s_name AS name, s_acctbal AS u FROM supplier)"


def used(value: str) -> str:
    return f"CASE WHEN {value} < 0 THEN 0 WHEN {value} <= 1 THEN {value} * 100 ELSE least({value}, 100) END"


def window(channel: str, given: dict[str, str], source: str) -> str:
    """A select of the common window columns; what is not given is NULL."""
    types = {
        "account_id": "VARCHAR", "account_name": "VARCHAR", "window_name": "VARCHAR", "source": "VARCHAR",
        "limit_value": "DOUBLE", "used_value": "DOUBLE", "remaining_value": "DOUBLE", "used_percent": "DOUBLE",
        "remaining_percent": "DOUBLE", "resets_at": "VARCHAR", "window_seconds": "BIGINT", "requests": "BIGINT",
        "tokens": "BIGINT", "cost": "DOUBLE",
    }
    columns = []
    for name, kind in types.items():
        text = given.get(name, "NULL")
        if kind == "DOUBLE":
            columns.append(f"round({text}, 6) AS {name}" if text != "NULL" else f"cast(NULL AS DOUBLE) AS {name}")
        else:
            columns.append(f"cast({text} AS {kind}) AS {name}")
    return f"SELECT s AS snapshot, '{channel}' AS channel, {', '.join(columns)}, '' AS error FROM {source}"


def percent(value: str, **given: str) -> dict[str, str]:
    return {"used_percent": f"({used(value)})", "remaining_percent": f"100 - ({used(value)})", **given}


def usd(name: str, spent: str, limit: str, reset: str, source: str) -> dict[str, str]:
    share = f"(CASE WHEN {limit} > 0 THEN least(greatest({spent}, 0) / ({limit}) * 100, 100) ELSE 0 END)"
    return {
        "account_id": "s", "account_name": "name" if source == "estimated" else "''", "window_name": f"'{name}'",
        "source": f"'{source}'", "limit_value": f"cast({limit} AS DOUBLE)", "used_value": f"cast(greatest({spent}, 0) AS DOUBLE)",
        "remaining_value": f"cast(greatest({limit} - greatest({spent}, 0), 0) AS DOUBLE)", "used_percent": share,
        "remaining_percent": f"100 - {share}", "resets_at": reset,
    }


def opencode(source: str, rows: str) -> str:
    windows = [
        usd("5h", "s % 20", "12", "''", source),
        usd("周", "u", "10000 + s", "'W' || s", source),
        usd("月", "3", "0", "''", source),
    ]
    return f"{P} " + " UNION ALL ".join(window("opencode", w, rows) for w in windows)


SUB_NAME = "CASE WHEN s % 4 = 0 THEN ' Ikun ' || s ELSE name END"
ISO = "strftime(make_timestamp(({}) * 1000000), '%Y-%m-%dT%H:%M:%SZ')"
POOL_ERROR = """CASE WHEN which = 'b' THEN 'decode api-call' WHEN s % 7 = 0 THEN 'missing auth_index'
  WHEN s % 11 = 0 THEN 'api-call http 502: bad gateway' WHEN s % 6 = 1 THEN '401' WHEN s % 6 = 2 THEN 'usage status 500'
  ELSE '' END"""
POOL = f"""{P}, files AS (SELECT *, 'a' AS which FROM p WHERE s % 5 <> 0 UNION ALL SELECT *, 'b' FROM p),
  pool AS (SELECT *, {POOL_ERROR} AS error FROM files)"""
XF_ERROR = """CASE WHEN s % 9 = 0 THEN 'missing ssoSessionId' WHEN s % 13 = 0 THEN 'http 500: ' || body
  WHEN s % 8 = 3 THEN 'decode response' WHEN s % 8 = 4 THEN '请先登录' WHEN s % 8 = 5 THEN '未登录状态'
  WHEN s % 8 = 6 THEN 'code 9' ELSE '' END"""
XF_LEFT = "least(greatest(CASE WHEN s % 2 = 0 THEN 90000 - u ELSE 90000 - u END, 0), 90000)"
STATUS = f"""{POOL}, accounts AS (
  SELECT 'sub2api' AS channel, cast(s AS VARCHAR) AS account_id, {SUB_NAME} AS account_name,
    CASE WHEN s % 2 = 0 THEN 'x@extra' ELSE 'a' || s || '@mail' END AS email, 'active' AS status,
    'g' || s % 3 || '|' || CASE WHEN s % 2 = 0 THEN 'px' ELSE '' END || '|' || s % 7 AS detail, s % 2 = 0 AS can_refresh_usage,
    '' AS error FROM p WHERE s % 10 <> 9
  UNION ALL SELECT 'opencode', cast(s AS VARCHAR), name, '', CASE WHEN s % 4 = 0 THEN 'disabled' ELSE 'enabled' END,
    CASE WHEN s % 3 = 0 THEN 'READY' ELSE 'new' END, s % 4 <> 0 AND s % 3 = 0,
    CASE WHEN s % 10 = 0 THEN 'denied' WHEN s % 5 = 0 THEN 'late' ELSE '' END FROM p
  UNION ALL SELECT 'cpa', CASE which WHEN 'a' THEN '' ELSE 'acc' END,
    CASE which WHEN 'a' THEN name || '.json' ELSE 'User' || s || '@Mail.com.JSON' END,
    CASE which WHEN 'a' THEN '' ELSE 'user' || s || '@mail.com' END, CASE WHEN error = '' THEN 'ok' ELSE 'error' END,
    CASE WHEN which = 'b' THEN cast(s AS VARCHAR) WHEN s % 7 = 0 THEN '' ELSE 'i' || s END, false, error FROM pool
  UNION ALL SELECT 'xfyun', cast(s AS VARCHAR), name, '',
    CASE WHEN error = '' THEN 'ok' WHEN s % 9 = 0 OR (s % 13 <> 0 AND s % 8 IN (4, 5)) THEN 'expired' ELSE 'error' END, '', false, error
    FROM (SELECT *, {XF_ERROR} AS error FROM (SELECT *, CASE WHEN s % 8 = 3 THEN 'oops'
      WHEN s % 8 = 4 THEN '{{"code":4001,"succeed":false,"message":" 请先登录 "}}'
      WHEN s % 8 = 5 THEN '{{"code":7,"succeed":false,"message":"未登录状态"}}'
      WHEN s % 8 = 6 THEN '{{"code":9,"succeed":true}}'
      ELSE '{{"code":0,"succeed":true,"data":{{"rows":[{{"appId":"a","name":"plan' || s || '","codingPlanUsageDTO":{{"channel":"c","packageLimit":90000,"packageUsage":' || u ||
        CASE WHEN s % 2 = 0 THEN ',"packageLeft":' || (90000 - u) ELSE '' END || ',"rp5hLimit":0,"rp5hUsage":1,"rpwLimit":10000,"rpwUsage":' || u || '}}}}]}}}}' END
      AS body FROM p)))"""

ORACLE = {
    "quota_sub2api": f"{P} "
    + window(
        "sub2api",
        percent(
            "CASE WHEN s % 3 = 0 THEN u / 10000 ELSE u / 100 END", account_id="s", account_name=SUB_NAME,
            window_name="'5h 预估'", source="'estimated'", resets_at="'E' || s",
        ),
        "p WHERE s % 10 <> 9 AND s % 3 <> 2",
    )
    + " UNION ALL "
    + window(
        "sub2api",
        percent(
            "u / 100", account_id="s", account_name=SUB_NAME, window_name="'7d 预估'", source="'estimated'",
            resets_at=ISO.format("1700000000 + s"),
        ),
        "p WHERE s % 10 <> 9",
    ),
    "quota_sub2api_state": f"""{P} SELECT s AS snapshot, 1704000000 + s AS fetched_at, 'sub2api' AS channel, s % 10 <> 9 AS ok,
        CASE WHEN s % 10 = 9 THEN 'accounts code 500: down' ELSE '' END AS error,
        CASE WHEN s % 10 = 9 THEN 0 WHEN s % 5 = 0 THEN 1 ELSE s % 5 END AS total FROM p""",
    "quota_sub2api_live": f"{P} "
    + window(
        "sub2api",
        percent(
            "u / 100", account_id="s", account_name="''", window_name="'5h 实时'", source="'live'", resets_at="'R' || s",
            window_seconds="s * 10", requests="s", tokens="s * 1000", cost="u / 8",
        ),
        "p",
    )
    + " UNION ALL "
    + window(
        "sub2api",
        percent(
            "u / 10000", account_id="s", account_name="''", window_name="'7d 实时'", source="'live'", resets_at="''",
            window_seconds="s", requests="0", tokens="0", cost="0.0",
        ),
        "p WHERE s % 2 = 1",
    ),
    "quota_opencode": opencode("estimated", "p WHERE s % 6 <> 5"),
    "quota_opencode_live": opencode("live", "p"),
    "quota_cpa": f"{POOL} "
    + window(
        "cpa",
        {
            "account_id": "''", "account_name": "name || '.json'", "window_name": "'primary_window'", "source": "'live'",
            "used_percent": "u / 100", "remaining_percent": "100 - u / 100", "window_seconds": "18000",
            "resets_at": "CASE WHEN s % 4 = 0 THEN '2024-01-01T00:00:00Z' ELSE "
            + ISO.format("1704000000 + s + 60")
            + " END",
        },
        "pool WHERE error = ''",
    )
    + " UNION ALL "
    + window(
        "cpa",
        {
            "account_id": "''", "account_name": "name || '.json'", "window_name": "'secondary_window'", "source": "'live'",
            "used_percent": "50.0", "remaining_percent": "50.0", "window_seconds": "0",
            "resets_at": "'2024-01-01T00:00:00Z'",
        },
        "pool WHERE error = '' AND s % 2 = 1",
    ),
    "quota_xfyun": " UNION ALL ".join(
        (f"{P} " if name == "package" else "")
        + window(
            "xfyun",
            {
                "account_id": "s", "account_name": "'plan' || s", "window_name": f"'{name}'", "source": "'live'",
                "limit_value": f"{limit}.0", "used_value": "u",
                "remaining_value": f"least(greatest({limit} - u, 0), {limit})",
                "remaining_percent": f"least(greatest({limit} - u, 0), {limit}) / {limit} * 100",
                "used_percent": f"100 - least(greatest({limit} - u, 0), {limit}) / {limit} * 100",
            },
            "p WHERE s % 9 <> 0 AND s % 13 <> 0 AND (s % 8 < 3 OR s % 8 = 7)",
        )
        for name, limit in (("package", 90000), ("rpw", 10000))
    ),
    "balance_currency": f"""{P} SELECT s AS snapshot, 1704000000 + s AS fetched_at, true AS is_available, 'CNY' AS currency,
        '110.00' AS total_balance, '10.00' AS granted_balance, '100.00' AS topped_up_balance FROM p
        UNION ALL SELECT s, 1704000000 + s, true, 'USD', s || '.50', '', '' FROM p""",
    "quota_accounts": f"{STATUS} SELECT * FROM accounts",
    "quota_totals": f"""{STATUS} SELECT channel, count(*) AS accounts, count(*) FILTER (error <> '') AS errors FROM accounts
        GROUP BY 1""",
    "quota_attach": f"""{P}, m AS (SELECT *, s % 4 IN (0, 1) AS hit, s % 5 = 4 AS bad FROM p WHERE s % 10 <> 9)
        SELECT s AS account_id, CASE WHEN hit THEN CASE WHEN bad THEN '' ELSE 'u' || s END END AS quota_username,
          CASE WHEN hit THEN CASE WHEN bad THEN 0 ELSE 318200450 + s * 1000003 END END AS quota,
          round(CASE WHEN hit THEN CASE WHEN bad THEN 0 ELSE round((318200450 + s * 1000003) / 500000 * 100) / 100 END END, 6)
            AS balance_cny,
          round(CASE WHEN hit THEN CASE WHEN bad THEN 0 ELSE 2409.8 END END, 6) AS used_cny,
          CASE WHEN hit THEN CASE WHEN bad THEN 0 ELSE s END END AS request_count,
          CASE WHEN hit THEN CASE WHEN bad THEN 'ikun: busy' ELSE '' END END AS quota_error FROM m""",
    "quota_percent": f"""{P} SELECT s AS s_suppkey, round({used('u / 4000')}, 6) AS used,
        round(100 - ({used('u / 4000')}), 6) AS remaining FROM p""",
    "quota_last_good": f"""{P}, h AS (SELECT CASE WHEN s % 2 = 0 THEN 'deepseek' ELSE 'other-' || s % 3 END AS channel, s, name,
          s % 3 = 1 AS good FROM p),
        w AS (SELECT *, max(CASE WHEN good THEN s END) OVER (PARTITION BY channel ORDER BY s) AS last_s FROM h)
        SELECT w.channel, w.s AS fetched_at, w.good OR last_s IS NOT NULL AS ok,
          CASE WHEN w.good THEN '' WHEN last_s IS NOT NULL THEN 'stale: error ' || w.s ELSE 'error ' || w.s END AS error,
          coalesce(last_s, w.s) AS updated_at, g.name AS payload FROM w LEFT JOIN p g ON g.s = last_s""",
}
