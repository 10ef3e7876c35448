"""Oracles of the usage queries."""

from .base import BILLING, USAGE, VIEW

SUMS = """count(*) AS request_count,
  count(*) FILTER (type = 2) AS success_count, count(*) FILTER (type = 5) AS error_count"""
RAW_SUMS = """cast(coalesce(sum(prompt_tokens), 0) AS BIGINT) AS input_tokens,
  cast(coalesce(sum(completion_tokens), 0) AS BIGINT) AS output_tokens,
  cast(coalesce(sum(prompt_tokens + completion_tokens), 0) AS BIGINT) AS total_tokens,
  cast(coalesce(sum(quota), 0) AS BIGINT) AS quota,
  coalesce(min(created_at), 0) AS first_used_at, coalesce(max(created_at), 0) AS last_used_at"""
COSTS = ["input_cost_cny", "output_cost_cny", "cache_read_cost_cny", "cache_write_cost_cny", "other_cost_cny"]
MODEL = f"""{SUMS}, cast(sum(p) AS BIGINT) AS input_tokens, cast(sum(o) AS BIGINT) AS output_tokens,
  cast(sum(p + o) AS BIGINT) AS total_tokens, cast(sum(q) AS BIGINT) AS quota, round(sum(quota_cny), 6) AS quota_cny,
  cast(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens,
  cast(sum(cache_write_tokens) AS BIGINT) AS cache_write_tokens,
  {', '.join(f'round(sum({c}), 6) AS {c}' for c in COSTS)},
  coalesce(min(CASE WHEN created_at > 0 THEN created_at END), 0) AS first_used_at,
  greatest(max(created_at), 0) AS last_used_at"""
VIEW_COLUMNS = "* EXCLUDE (raw_key_name)"
SELF_COLUMNS = """id, created_at, type, model_name, input_tokens, output_tokens, total_tokens, cache_read_tokens,
  cache_write_tokens, quota_cny, use_time, is_stream, channel_name"""
KEYS = f"""
  SELECT coalesce(l.token_id, 0) AS token_id,
    coalesce(nullif(max(t.name), ''), nullif(max(l.token_name), ''), '') AS key_name,
    coalesce(max(right(t.key, 8)), '') AS key_tail, {{key_value}} AS key_value,
    coalesce(max(l.user_id), 0) AS user_id, coalesce(max(l.username), '') AS username,
    count(DISTINCT nullif(model_name, '')) AS model_count, {SUMS}, {RAW_SUMS},
    round(coalesce(sum(quota), 0) / any_value(unit) * any_value(rate), 6) AS quota_cny
  FROM logs l CROSS JOIN settings LEFT JOIN tokens t ON t.id = l.token_id
  WHERE type IN (2, 5) {{where}}
  GROUP BY l.token_id ORDER BY {{order}} LIMIT {{limit}}"""
SUMMARY = f"""
  SELECT {SUMS}, count(DISTINCT token_id) AS token_count, count(DISTINCT user_id) AS user_count,
    count(DISTINCT nullif(model_name, '')) AS model_count, {RAW_SUMS}
  FROM logs WHERE type IN (2, 5) {{where}}"""

ORACLE = {
    "scan_usage_logs": f"WITH {USAGE} SELECT * FROM logs",
    "scan_tokens": f"WITH {USAGE} SELECT * FROM tokens",
    "billing_settings": f"WITH {USAGE} SELECT unit AS quota_per_unit, rate AS usd_to_cny FROM settings",
    "filter_time_range": f"WITH {USAGE} SELECT id, created_at, type FROM logs WHERE type IN (2, 5) "
    "AND created_at BETWEEN 1704500000 AND 1706000000",
    "usage_summary": f"""WITH {BILLING},
        s AS ({SUMMARY.format(where='')}),
        adj AS (SELECT coalesce(sum(cache_read_tokens), 0) AS r,
          coalesce(sum(CASE WHEN input_tokens_total > p THEN input_tokens_total - p
            WHEN anthropic_semantic THEN cache_read_tokens + cache_write_tokens ELSE 0 END), 0) AS a
          FROM meta WHERE type IN (2, 5) AND other LIKE '%"cache_tokens"%')
        SELECT s.* EXCLUDE (input_tokens, total_tokens), cast(input_tokens + a AS BIGINT) AS input_tokens,
          cast(input_tokens + a + output_tokens AS BIGINT) AS total_tokens, cast(r AS BIGINT) AS cache_read_tokens,
          round(CASE WHEN input_tokens + a > 0 THEN least(greatest(r / (input_tokens + a) * 100, 0), 100) ELSE 0 END, 6)
            AS cache_rate, round(quota / unit * rate, 6) AS quota_cny
        FROM s, adj, settings""",
    "token_summary": f"""WITH {USAGE}, s AS ({SUMMARY.format(where='AND token_id = 1')})
        SELECT s.*, cast(0 AS BIGINT) AS cache_read_tokens, cast(0 AS DOUBLE) AS cache_rate,
          round(quota / unit * rate, 6) AS quota_cny FROM s, settings""",
    "key_usage": f"WITH {USAGE} "
    + KEYS.format(
        key_value="coalesce(max(t.key), '')", where="", order="total_tokens DESC, request_count DESC, 1", limit=500
    ),
    "key_usage_search": f"WITH {USAGE} "
    + KEYS.format(
        key_value="''",
        where="""AND (lower(coalesce(t.name, '')) LIKE '%r#0000_00%' OR lower(coalesce(l.token_name, '')) LIKE '%r#0000_00%'
          OR lower(coalesce(username, '')) LIKE '%r#0000_00%' OR lower(coalesce(model_name, '')) LIKE '%r#0000_00%')""",
        order="request_count DESC, total_tokens DESC, 1",
        limit=100,
    ),
    "model_usage": f"""WITH {BILLING}
        SELECT coalesce(nullif(model_name, ''), 'unknown') AS model_name, {MODEL} FROM billed
        WHERE type IN (2, 5) AND token_id = 1 GROUP BY 1 ORDER BY total_tokens DESC, request_count DESC, 1 LIMIT 100""",
    "model_usage_by_key": f"""WITH {BILLING}
        SELECT token_id, coalesce(nullif(model_name, ''), 'unknown') AS model_name, {MODEL} FROM billed
        WHERE type IN (2, 5) GROUP BY 1, 2""",
    "model_share": f"""WITH {BILLING},
        m AS (SELECT token_id, coalesce(nullif(model_name, ''), 'unknown') AS model_name,
          cast(sum(p + o) AS BIGINT) AS total_tokens FROM billed WHERE type IN (2, 5) GROUP BY 1, 2)
        SELECT *, round(greatest(2, total_tokens / greatest(max(total_tokens) OVER (PARTITION BY token_id), 1) * 100), 6)
          AS share FROM m""",
    "logs_page": f"""WITH {VIEW} SELECT {VIEW_COLUMNS} FROM log_view
        WHERE type IN (2, 5) AND created_at >= 1704500000 ORDER BY id DESC LIMIT 500 OFFSET 500""",
    "logs_key_search": f"""WITH {VIEW} SELECT {VIEW_COLUMNS} FROM log_view WHERE type = 2
        AND (lower(coalesce(raw_key_name, '')) LIKE '%customer#%1%' OR lower(token_name) LIKE '%customer#%1%')
        ORDER BY id DESC LIMIT 500""",
    "logs_text_search": f"""WITH {VIEW} SELECT {VIEW_COLUMNS} FROM log_view WHERE type IN (2, 5)
        AND (lower(username) LIKE '%claude_3%' OR lower(token_name) LIKE '%claude_3%'
          OR lower(model_name) LIKE '%claude_3%' OR lower(request_id) LIKE '%claude_3%')
        ORDER BY id DESC LIMIT 500""",
    "logs_total": f"""WITH {USAGE} SELECT count(*) AS total,
          cast(greatest(1, ceil(count(*) / 100)) AS BIGINT) AS pages
        FROM logs WHERE type = 5""",
    "self_logs": f"""WITH {VIEW} SELECT {SELF_COLUMNS} FROM log_view WHERE type IN (2, 5) AND token_id = 1
        ORDER BY id DESC LIMIT 100""",
    "logs_after": f"""WITH {USAGE} SELECT * FROM logs WHERE type IN (2, 5)
        AND (created_at > 1705000000 OR (created_at = 1705000000 AND id > 5)) ORDER BY created_at, id LIMIT 200""",
    "log_by_id": f"WITH {VIEW} SELECT {VIEW_COLUMNS} FROM log_view WHERE id = 77",
    "token_options": f"""WITH {USAGE} SELECT id AS token_id, name AS key_name, right(key, 8) AS key_tail FROM tokens
        ORDER BY CASE WHEN name = '' THEN 1 ELSE 0 END, name, id LIMIT 2000""",
    "token_options_search": f"""WITH {USAGE} SELECT id AS token_id, name AS key_name, right(key, 8) AS key_tail FROM tokens
        WHERE contains(lower(concat_ws(' ', name, right(key, 8))), '7b') ORDER BY CASE WHEN name = '' THEN 1 ELSE 0 END,
        name, id LIMIT 500""",
    "quota_cny": f"""WITH {USAGE}, v AS (SELECT id, coalesce(quota, 0) / unit * rate AS cny FROM logs, settings
        WHERE type IN (2, 5))
        SELECT id, round(cny, 6) AS quota_cny, '¥' || CASE WHEN abs(cny) >= 0.01 THEN printf('%.2f', cny)
          ELSE printf('%.6f', cny) END AS shown FROM v""",
    "billing_meta": f"""WITH {BILLING} SELECT id, model_ratio, group_ratio, completion_ratio, cache_ratio,
        cache_creation_ratio, cache_creation_ratio_5m, cache_creation_ratio_1h, cache_read_tokens, cache_write_tokens,
        cache_creation_tokens_5m, cache_creation_tokens_1h, input_tokens_total, model_price, anthropic_semantic, tiered,
        has_ratios FROM meta""",
    "log_billing": f"""WITH {BILLING} SELECT id, round(quota_cny, 6) AS quota_cny, cache_read_tokens, cache_write_tokens,
        {', '.join(f'round({c}, 6) AS {c}' for c in COSTS)} FROM billed WHERE type IN (2, 5)""",
    "json_coerce": f"""WITH {USAGE}, raw AS (SELECT id, CASE id % 7 WHEN 0 THEN '{{"x":' || quota || '.5}}'
          WHEN 1 THEN '{{"x":" -' || quota || '.25 "}}' WHEN 2 THEN '{{"x":true}}' WHEN 3 THEN '{{"x":"1.5d"}}'
          WHEN 4 THEN '{{"x":null}}' WHEN 5 THEN '{{"x":{{"y":1}}}}' ELSE '{{"x":"1e2"}} tail' END AS doc FROM logs)
        SELECT id, CASE id % 7 WHEN 0 THEN cast(doc->>'$.x' AS DOUBLE) WHEN 1 THEN cast(trim(doc->>'$.x') AS DOUBLE)
          ELSE 0 END AS number,
          CASE id % 7 WHEN 0 THEN cast(round(cast(doc->>'$.x' AS DOUBLE)) AS BIGINT)
            WHEN 1 THEN cast(round(cast(trim(doc->>'$.x') AS DOUBLE)) AS BIGINT) ELSE 0 END AS whole,
          CASE WHEN id % 7 IN (1, 3) THEN doc->>'$.x' ELSE '' END AS text, id % 7 = 2 AS flag, id % 7 <> 6 AS valid
        FROM raw""",
}
