"""The bindings of the generated tables, as common table expressions."""

USAGE = r"""
base AS (
  SELECT event_id AS e, user_id, event_type,
    cast(json_extract_string(props, '$.k') AS BIGINT) AS k,
    cast(round(value * 100) AS BIGINT) AS c,
    cast(floor(epoch(ts)) AS BIGINT) AS created_at
  FROM events),
keyed AS (
  SELECT *, CASE WHEN k < 33 THEN 1 WHEN k = 97 THEN NULL WHEN k = 98 THEN 0
    WHEN k = 99 THEN 900000 + user_id % 10 ELSE user_id + 2 END AS tid FROM base),
logs AS (
  SELECT e + 1 AS id, created_at,
    CASE event_type WHEN 'error' THEN 5 WHEN 'signup' THEN 1 ELSE 2 END AS type,
    CASE WHEN e % 3 = 0 THEN '' ELSE 'req-' || e END AS request_id,
    user_id, 'user-' || user_id AS username, cast(tid AS BIGINT) AS token_id,
    CASE WHEN e % 11 = 0 THEN '' ELSE 'tok-' || coalesce(tid, 0) END AS token_name,
    CASE k % 6 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'claude-3' WHEN 2 THEN 'gemini-pro'
      WHEN 3 THEN 'deepseek-chat' WHEN 4 THEN 'qwen-max' ELSE '' END AS model_name,
    CASE WHEN e % 53 = 0 THEN NULL ELSE c END AS prompt_tokens,
    (c * 3) % 997 AS completion_tokens,
    CASE WHEN event_type = 'error' THEN 0 ELSE c * 2 END AS quota,
    k % 30 AS use_time, e % 2 = 0 AS is_stream, k % 5 AS channel_id, 'ch-' || (k % 5) AS channel_name,
    '10.0.0.' || (user_id % 256) AS ip, 'ok' AS content,
    CASE e % 8
      WHEN 0 THEN '' WHEN 1 THEN '{bad'
      WHEN 2 THEN '{"cache_tokens":' || k || '}'
      WHEN 3 THEN '{"model_ratio":2,"group_ratio":1,"completion_ratio":4,"cache_ratio":0.1,"cache_creation_ratio":1.25,"cache_tokens":'
        || k || ',"cache_write_tokens":' || (k % 7) || '}'
      WHEN 4 THEN '{"model_ratio":" 1.5 ","group_ratio":"1","completion_ratio":"3","cache_ratio":"0.5","cache_creation_ratio":"1.25","cache_tokens":"'
        || k || '","input_tokens_total":' || (c + k) || '}'
      WHEN 5 THEN '{"model_ratio":1,"group_ratio":0.5,"completion_ratio":5,"cache_ratio":0.1,"cache_creation_ratio":1.25,"cache_creation_ratio_5m":1.25,"cache_creation_ratio_1h":2,"usage_semantic":"anthropic","cache_tokens":'
        || k || ',"cache_creation_tokens":3,"cache_creation_tokens_5m":' || (k % 5) || ',"cache_creation_tokens_1h":4}'
      WHEN 6 THEN '{"model_price":1}'
      ELSE '{"billing_mode":"tiered_expr","model_ratio":null,"group_ratio":1,"completion_ratio":1,"claude":true}' END AS other
  FROM keyed),
tokens AS (
  SELECT c_custkey + 1 AS id, c_custkey AS user_id,
    CASE WHEN c_custkey % 9 = 1 THEN '' ELSE c_name END AS name, 'k' || md5(c_name) AS key
  FROM customer),
options AS (
  SELECT CASE n_nationkey WHEN 0 THEN 'QuotaPerUnit' WHEN 1 THEN 'USDExchangeRate' ELSE 'Nation.' || n_name END AS key,
    CASE n_nationkey WHEN 0 THEN '500000' WHEN 1 THEN ' 7.3 ' ELSE cast(n_regionkey AS VARCHAR) END AS value
  FROM nation),
settings AS (
  SELECT coalesce(max(CASE WHEN key = 'QuotaPerUnit' AND try_cast(trim(value) AS DOUBLE) > 0
      THEN cast(trim(value) AS DOUBLE) END), 500000.0) AS unit,
    coalesce(max(CASE WHEN key = 'USDExchangeRate' AND try_cast(trim(value) AS DOUBLE) > 0
      THEN cast(trim(value) AS DOUBLE) END), 7.3) AS rate
  FROM options)
"""

BILLING = USAGE + r""",
docs AS (
  SELECT *, CASE WHEN json_valid(other) AND other LIKE '{%' THEN other END AS doc FROM logs),
fields AS (
  SELECT *,
    coalesce(try_cast(trim(json_extract_string(doc, '$.model_ratio')) AS DOUBLE), 0) AS model_ratio,
    coalesce(try_cast(trim(json_extract_string(doc, '$.group_ratio')) AS DOUBLE), 0) AS group_ratio,
    coalesce(try_cast(trim(json_extract_string(doc, '$.completion_ratio')) AS DOUBLE), 0) AS completion_ratio,
    coalesce(try_cast(trim(json_extract_string(doc, '$.cache_ratio')) AS DOUBLE), 0) AS cache_ratio,
    coalesce(try_cast(trim(json_extract_string(doc, '$.cache_creation_ratio')) AS DOUBLE), 0) AS cache_creation_ratio,
    coalesce(try_cast(trim(json_extract_string(doc, '$.cache_creation_ratio_5m')) AS DOUBLE), 0) AS cache_creation_ratio_5m,
    coalesce(try_cast(trim(json_extract_string(doc, '$.cache_creation_ratio_1h')) AS DOUBLE), 0) AS cache_creation_ratio_1h,
    cast(coalesce(try_cast(json_extract_string(doc, '$.cache_tokens') AS DOUBLE), 0) AS BIGINT) AS cache_read_tokens,
    cast(coalesce(try_cast(json_extract_string(doc, '$.cache_write_tokens') AS DOUBLE), 0) AS BIGINT) AS explicit_write,
    cast(coalesce(try_cast(json_extract_string(doc, '$.cache_creation_tokens') AS DOUBLE), 0) AS BIGINT) AS creation_total,
    cast(coalesce(try_cast(json_extract_string(doc, '$.cache_creation_tokens_5m') AS DOUBLE), 0) AS BIGINT) AS cache_creation_tokens_5m,
    cast(coalesce(try_cast(json_extract_string(doc, '$.cache_creation_tokens_1h') AS DOUBLE), 0) AS BIGINT) AS cache_creation_tokens_1h,
    cast(coalesce(try_cast(json_extract_string(doc, '$.input_tokens_total') AS DOUBLE), 0) AS BIGINT) AS input_tokens_total,
    coalesce(try_cast(json_extract_string(doc, '$.model_price') AS DOUBLE), 0) AS model_price,
    coalesce(json_extract_string(doc, '$.usage_semantic') = 'anthropic', false)
      OR coalesce(json_extract(doc, '$.claude') = 'true', false) AS anthropic_semantic,
    coalesce(json_extract_string(doc, '$.billing_mode') = 'tiered_expr', false) AS tiered,
    coalesce(list_has_all(json_keys(doc), ['model_ratio', 'group_ratio', 'completion_ratio']), false) AS has_ratios
  FROM docs),
meta AS (
  SELECT *, CASE WHEN explicit_write <> 0 THEN explicit_write
    WHEN cache_creation_tokens_5m + cache_creation_tokens_1h > 0
      AND creation_total < cache_creation_tokens_5m + cache_creation_tokens_1h
      THEN cache_creation_tokens_5m + cache_creation_tokens_1h
    ELSE creation_total END AS cache_write_tokens,
    coalesce(prompt_tokens, 0) AS p, coalesce(completion_tokens, 0) AS o, coalesce(quota, 0) AS q
  FROM fields),
parts AS (
  SELECT *, q / unit * rate AS quota_cny,
    q <> 0 AND has_ratios AND NOT tiered AND model_price = 0 AS by_ratio,
    (CASE WHEN anthropic_semantic THEN p ELSE greatest(p - (cache_read_tokens + cache_write_tokens), 0) END)
      * (model_ratio * group_ratio) AS input_quota,
    o * completion_ratio * (model_ratio * group_ratio) AS output_quota,
    cache_read_tokens * cache_ratio * (model_ratio * group_ratio) AS read_quota,
    (CASE WHEN cache_write_tokens = 0 THEN 0
      WHEN cache_creation_tokens_5m = 0 AND cache_creation_tokens_1h = 0 THEN cache_write_tokens * cache_creation_ratio
      ELSE greatest(cache_write_tokens - cache_creation_tokens_5m - cache_creation_tokens_1h, 0) * cache_creation_ratio
        + cache_creation_tokens_5m * cache_creation_ratio_5m + cache_creation_tokens_1h * cache_creation_ratio_1h END)
      * (model_ratio * group_ratio) AS write_quota
  FROM meta, settings),
billed AS (
  SELECT *,
    CASE WHEN by_ratio THEN input_quota / unit * rate ELSE 0 END AS input_cost_cny,
    CASE WHEN by_ratio THEN output_quota / unit * rate ELSE 0 END AS output_cost_cny,
    CASE WHEN by_ratio THEN read_quota / unit * rate ELSE 0 END AS cache_read_cost_cny,
    CASE WHEN by_ratio THEN write_quota / unit * rate ELSE 0 END AS cache_write_cost_cny,
    CASE WHEN q = 0 THEN 0 WHEN NOT by_ratio THEN quota_cny
      WHEN abs(q - (input_quota + output_quota + read_quota + write_quota)) < 1 THEN 0
      ELSE (q - (input_quota + output_quota + read_quota + write_quota)) / unit * rate END AS other_cost_cny
  FROM parts)
"""

VIEW = BILLING + r""",
log_view AS (
  SELECT l.id, l.created_at, cast(l.type AS BIGINT) AS type, l.request_id, l.user_id, l.username,
    coalesce(l.token_id, 0) AS token_id, l.token_name,
    coalesce(nullif(t.name, ''), nullif(l.token_name, ''), '') AS key_name,
    coalesce(right(t.key, 8), '') AS key_tail, l.model_name,
    l.p AS input_tokens, l.o AS output_tokens, coalesce(l.prompt_tokens + l.completion_tokens, 0) AS total_tokens,
    l.q AS quota, round(l.quota_cny, 6) AS quota_cny, l.cache_read_tokens, l.cache_write_tokens, l.use_time,
    l.is_stream, l.channel_id, l.channel_name, l.ip, l.content, l.other, t.name AS raw_key_name
  FROM billed l LEFT JOIN tokens t ON t.id = l.token_id)
"""
