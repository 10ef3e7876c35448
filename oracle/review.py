"""Oracles of the review queries."""

import hashlib

from .base import USAGE

CONFIG = hashlib.sha256(
    "\x00".join(["https://review.example/v1", "review-model", "policy", "auto", "schema-v2"]).encode()
).hexdigest()
WS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160) || chr(8232) || chr(12288)"
CLEAN = f"trim(replace(text, chr(13) || chr(10), chr(10)), {WS})"

REQUESTS = f"""
said AS MATERIALIZED (
  SELECT conv_id, turn, lower(role) AS role, {CLEAN} AS content,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos,
    string_agg(lower(role) || chr(0) || {CLEAN}, chr(1)) OVER (PARTITION BY conv_id ORDER BY turn) AS prefix
  FROM conversations),
first_sent AS (
  SELECT conv_id * 100 + turn + 1 AS id, conv_id, turn, conv_id % 5 + 1 AS token_id, 1700000000 + conv_id * 7 + turn * 60 AS sent,
    CASE WHEN conv_id % 7 = 0 THEN 'other-model' ELSE 'gpt-test' END AS model, pos AS len, prefix
  FROM said WHERE role = 'user'),
requests AS MATERIALIZED (
  SELECT * FROM first_sent
  UNION ALL SELECT id + 1000000000, conv_id, turn, token_id, sent + 1, model, len, prefix FROM first_sent WHERE id % 3 = 0)
"""


def plan(start: int, roles: str) -> str:
    """CTEs up to `plan`: requests, anchors before `start`, parents, and the content each request adds."""
    return REQUESTS + f""",
anchors AS (
  SELECT id, token_id, sent AS created_at, row_number() OVER (PARTITION BY token_id ORDER BY sent DESC, id DESC) AS anchor_rank
  FROM requests WHERE sent < {start} QUALIFY anchor_rank <= 50),
ordered AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY token_id ORDER BY sent, id) AS seq FROM requests
  WHERE sent >= {start} OR id IN (SELECT id FROM anchors)),
found AS (
  SELECT r.id, b.id AS parent, b.len AS parent_len
  FROM ordered r JOIN said p ON p.conv_id = r.conv_id AND p.pos <= r.len
  JOIN ordered b ON b.token_id = r.token_id AND b.len = p.pos AND b.prefix = p.prefix
    AND b.seq BETWEEN r.seq - 100 AND r.seq - 1
  WHERE r.sent >= {start}
  QUALIFY row_number() OVER (PARTITION BY r.id ORDER BY b.len DESC, b.seq) = 1),
started AS (
  SELECT r.*, f.parent, coalesce(f.parent_len,
    (SELECT max(s.pos) - 1 FROM said s WHERE s.conv_id = r.conv_id AND s.pos <= r.len AND {roles} AND s.content <> ''),
    r.len) AS delta_start
  FROM ordered r LEFT JOIN found f ON f.id = r.id WHERE r.sent >= {start}),
added AS (
  SELECT r.id, count(*) AS n,
    string_agg('[角色:' || s.role || ']' || chr(10) || s.content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY s.pos)
      AS content
  FROM started r JOIN said s ON s.conv_id = r.conv_id AND s.pos > r.delta_start AND s.pos <= r.len
  WHERE {roles} AND s.content <> '' GROUP BY r.id),
plan AS MATERIALIZED (
  SELECT cast(1 AS BIGINT) AS job_id, r.id AS audit_entry_id, token_id, sent AS created_at, model AS request_model,
    coalesce(parent, 0) AS parent_entry_id, delta_start, coalesce(n, 0) AS delta_message_count,
    coalesce(content, '') AS content, CASE WHEN content IS NULL THEN '' ELSE sha256(content) END AS content_hash,
    length(coalesce(content, '')) AS content_chars
  FROM started r LEFT JOIN added a ON a.id = r.id)
"""


PLAN = plan(1, "s.role IN ('user', 'human', 'input')")
LATER = plan(1700000400, "true")

SCORED = f""",
units AS (
  SELECT content_hash, cast('0x' || substr(content_hash, 1, 2) AS INTEGER) AS v,
    arg_min(audit_entry_id, (token_id, created_at, audit_entry_id)) AS first_id
  FROM plan WHERE content_hash <> '' GROUP BY 1, 2),
results AS (
  SELECT *, v % 3 = 0 AND v < 254 AS known, v >= 254 AS failed,
    CASE WHEN v < 16 THEN '阻断' WHEN v < 48 THEN '复核' ELSE '通过' END AS decision,
    CASE WHEN v < 16 THEN 90 WHEN v < 48 THEN 60 ELSE 3 END AS score FROM units),
outcome AS MATERIALIZED (
  SELECT p.*,
    CASE WHEN content_hash = '' THEN '通过' WHEN failed THEN '复核' ELSE decision END AS delta_decision,
    CASE WHEN content_hash = '' THEN 0 WHEN failed THEN 50 ELSE score END AS delta_risk_score,
    content_hash <> '' AND NOT failed AND (known OR first_id <> audit_entry_id) AS cache_hit,
    content_hash <> '' AND NOT failed AND NOT known AND first_id = audit_entry_id AS called,
    CASE WHEN content_hash <> '' AND failed THEN 'error' ELSE 'done' END AS status,
    CASE WHEN content_hash = '' THEN '' WHEN v = 254 THEN 'timeout'
      WHEN v = 255 THEN 'review model did not return a valid decision' ELSE '' END AS error,
    CASE WHEN content_hash <> '' AND NOT failed THEN content_hash ELSE '' END AS result_hash, coalesce(v, -1) AS v
  FROM plan p LEFT JOIN results r USING (content_hash)),
chain AS (
  SELECT audit_entry_id AS node, audit_entry_id AS at_id, parent_entry_id AS up, 0 AS depth FROM outcome
  UNION ALL SELECT c.node, o.audit_entry_id, o.parent_entry_id, c.depth + 1 FROM chain c JOIN outcome o ON o.audit_entry_id = c.up),
worst AS (
  SELECT c.node, o.delta_decision AS effective_decision, o.delta_risk_score AS effective_risk_score, c.depth, o.result_hash
  FROM chain c JOIN outcome o ON o.audit_entry_id = c.at_id
  QUALIFY row_number() OVER (PARTITION BY c.node ORDER BY CASE o.delta_decision WHEN '阻断' THEN 2 WHEN '复核' THEN 1 ELSE 0 END
    DESC, o.delta_risk_score DESC, c.depth) = 1),
final AS (
  SELECT o.*, w.effective_decision, w.effective_risk_score, w.depth > 0 AND w.effective_decision <> '通过' AS inherited,
    CASE WHEN w.depth > 0 AND w.effective_decision <> '通过' THEN w.result_hash ELSE o.result_hash END
      AS effective_result_hash
  FROM outcome o JOIN worst w ON w.node = o.audit_entry_id)
"""
SPENT = "CASE WHEN called THEN 10 + v ELSE 0 END"
RUN = f"WITH RECURSIVE {PLAN}{SCORED}"
RESULT = """CASE WHEN v < 48 THEN '网络攻击、其他风险' ELSE '' END"""

ORACLE = {
    "message_hashes": f"SELECT conv_id, turn, sha256(lower(role) || chr(0) || {CLEAN}) AS hash FROM conversations",
    "model_options": f"WITH {PLAN} SELECT model, count(*) AS request_count FROM requests GROUP BY 1",
    "review_scope": f"WITH {PLAN} SELECT max(id) AS max_entry_id, count(*) AS total_entries FROM requests",
    "review_anchors": f"WITH {LATER} SELECT * FROM anchors",
    "review_plan": f"WITH {PLAN} SELECT * FROM plan",
    "review_plan_anchored": f"WITH {LATER} SELECT * EXCLUDE (content) FROM plan",
    "review_plan_sink": f"""WITH {PLAN} SELECT cast(2 AS BIGINT) AS job_id, audit_entry_id, parent_entry_id, delta_start, content_hash FROM plan
        UNION ALL SELECT 1, audit_entry_id, parent_entry_id, delta_start, content_hash FROM plan WHERE content_hash <> ''""",
    "review_plan_totals": f"""WITH {PLAN} SELECT count(*) AS total_entries, count(*) FILTER (content_hash <> '') AS review_units,
        cast(coalesce(sum(content_chars) FILTER (content_hash <> ''), 0) AS BIGINT) AS estimated_chars FROM plan""",
    "review_cache_hits": f"""{RUN} SELECT audit_entry_id, content_hash, known AS cached_before,
        known OR audit_entry_id <> first_id AS cache_hit FROM plan JOIN results USING (content_hash)""",
    "review_cache_write": f"""{RUN} SELECT content_hash, '{CONFIG}' AS config_hash, decision, score AS risk_score,
        {RESULT} AS categories, 'r' || v AS reason, cast(0.9 AS DOUBLE) AS confidence, cast(10 + v AS BIGINT) AS prompt_tokens,
        cast(5 AS BIGINT) AS completion_tokens, cast(1700000500 AS BIGINT) AS created_at
        FROM results WHERE NOT known AND NOT failed""",
    "review_outcomes": f"""{RUN} SELECT audit_entry_id, delta_decision, delta_risk_score, cache_hit, called, status, error,
        cast({SPENT} AS BIGINT) AS prompt_tokens FROM outcome""",
    "risk_inherit": f"""{RUN} SELECT audit_entry_id, effective_decision, effective_risk_score, inherited,
        effective_result_hash FROM final""",
    "review_counters": f"""{RUN} SELECT count(*) AS total_entries, count(*) AS processed_entries,
        count(*) FILTER (called) AS reviewed_units, count(*) FILTER (cache_hit) AS cache_hits,
        count(*) FILTER (effective_decision <> '通过') AS flagged_entries, count(*) FILTER (status = 'error') AS error_entries,
        cast(sum({SPENT}) AS BIGINT) AS prompt_tokens, cast(sum(CASE WHEN called THEN 5 ELSE 0 END) AS BIGINT)
          AS completion_tokens, cast(100 AS DOUBLE) AS progress FROM final""",
    "review_results_page": f"""WITH RECURSIVE {USAGE}, {PLAN}{SCORED},
        page AS (SELECT * FROM final ORDER BY effective_risk_score DESC, created_at DESC, audit_entry_id DESC LIMIT 200),
        own AS (SELECT p.*, (SELECT any_value(v) FROM results r WHERE r.content_hash = p.effective_result_hash) AS top_v
          FROM page p),
        shown AS (SELECT o.*, status = 'error' AND top_v IS NULL AS fallback, coalesce(name, '') AS name
          FROM own o LEFT JOIN tokens t ON t.id = o.token_id)
        SELECT audit_entry_id, audit_entry_id + 7 AS log_id, token_id,
          CASE WHEN name <> '' THEN name ELSE 'Token #' || token_id END AS key_name, created_at, request_model,
          delta_message_count, delta_decision, delta_risk_score,
          CASE WHEN status = 'error' THEN '其他风险' WHEN content_hash = '' THEN '' ELSE {RESULT} END AS delta_categories,
          CASE WHEN status = 'error' THEN '审查失败，需要人工确认' WHEN content_hash = '' THEN '' ELSE 'r' || v END AS delta_reason,
          cast(CASE WHEN status = 'error' OR content_hash = '' THEN 0 ELSE 0.9 END AS DOUBLE) AS delta_confidence,
          CASE WHEN fallback THEN '复核' WHEN top_v IS NULL THEN effective_decision WHEN top_v < 16 THEN '阻断'
            WHEN top_v < 48 THEN '复核' ELSE '通过' END AS result_decision,
          CASE WHEN fallback THEN 50 WHEN top_v IS NULL THEN effective_risk_score WHEN top_v < 16 THEN 90
            WHEN top_v < 48 THEN 60 ELSE 3 END AS result_risk_score,
          CASE WHEN fallback THEN '其他风险' WHEN top_v < 48 THEN '网络攻击、其他风险' ELSE '' END AS result_categories,
          CASE WHEN fallback THEN '审查失败，需要人工确认' WHEN top_v IS NULL THEN '' ELSE 'r' || top_v END AS result_reason,
          cast(CASE WHEN fallback OR top_v IS NULL THEN 0 ELSE 0.9 END AS DOUBLE) AS result_confidence,
          effective_decision, effective_risk_score, inherited, cache_hit, status, error,
          CASE WHEN inherited THEN '继承' ELSE '新增' END || ' · ' || CASE WHEN cache_hit THEN '缓存' ELSE '模型' END ||
            CASE WHEN status = 'error' THEN ' · 错误' ELSE '' END AS origin,
          coalesce(nullif(error, ''), CASE WHEN fallback THEN '审查失败，需要人工确认' WHEN top_v IS NOT NULL THEN 'r' || top_v END,
            CASE WHEN status = 'error' THEN '审查失败，需要人工确认' WHEN content_hash <> '' THEN 'r' || v END, '-')
            AS shown_reason
        FROM shown""",
    "review_ready": f"""WITH {PLAN} SELECT audit_entry_id, token_id, created_at, parent_entry_id FROM plan p
        WHERE created_at % 2 = 1 AND NOT EXISTS (SELECT 1 FROM plan q
          WHERE q.audit_entry_id = p.parent_entry_id AND q.created_at % 2 = 1)""",
    "review_pending": f"WITH {PLAN} SELECT count(*) FILTER (created_at % 2 = 1) AS pending FROM plan",
    "review_runs": """SELECT c_custkey + 1 AS id, 'completed' AS status, c_name AS models FROM customer
        ORDER BY c_custkey DESC LIMIT 100""",
    "parse_decision": """WITH d AS (SELECT doc_id, n_chars, doc_id % 8 AS shape FROM documents)
        SELECT doc_id, CASE shape WHEN 0 THEN '复核' WHEN 1 THEN '阻断' WHEN 2 THEN '通过' WHEN 5 THEN '复核' END AS decision,
          CASE shape WHEN 0 THEN 70 WHEN 1 THEN least(n_chars, 100) WHEN 2 THEN 0 WHEN 5 THEN 0 END AS risk_score,
          CASE shape WHEN 0 THEN '提示词注入,其他风险' WHEN 1 THEN '' WHEN 2 THEN '' WHEN 5 THEN '' END AS categories,
          CASE shape WHEN 0 THEN '可疑' WHEN 1 THEN '' WHEN 2 THEN '' WHEN 5 THEN repeat('长', 500) END AS reason,
          cast(CASE shape WHEN 0 THEN 0.8 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 5 THEN 0 END AS DOUBLE) AS confidence FROM d""",
    "reply_text": """SELECT doc_id, sha256(CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN text || '!' ELSE '' END) AS digest
        FROM documents""",
}
