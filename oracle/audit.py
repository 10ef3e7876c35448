"""Oracles of the audit and matching queries."""

from .base import USAGE, VIEW

ENTRIES = r""",
entries AS (
  SELECT e * 10 + 1 AS id, 'src-' || e % 3 AS source_id, 'audit-' || e % 3 || '.jsonl' AS source_path, e AS source_line,
    CASE WHEN e % 10 = 0 THEN 0 ELSE created_at - use_time + CASE WHEN e % 4 = 0 THEN 500000 ELSE e % 7 - 3 END END
      AS created_at,
    e % 10 <> 0 AS has_timestamp, created_at + 5 AS ingested_at,
    CASE WHEN e % 5 = 0 THEN 'wrong' ELSE model_name END AS model,
    CASE WHEN e % 6 = 0 THEN 0 ELSE coalesce(token_id, 0) END AS token_id, coalesce(tail, '') AS key_tail,
    'agent/' || e % 5 AS user_agent, CASE e % 3 WHEN 0 THEN 'codex' WHEN 1 THEN 'claude' ELSE 'unknown' END AS client_name,
    '1.' || e % 4 AS client_version, CASE WHEN e % 3 = 2 THEN '' ELSE 'cli' END AS client_variant,
    CASE WHEN e % 9 = 1 THEN request_id ELSE '' END AS request_id
  FROM (SELECT l.*, l.id - 1 AS e, right(t.key, 8) AS tail FROM logs l LEFT JOIN tokens t ON t.id = l.token_id)),
stored AS (
  SELECT id AS log_id, (id - 1) * 10 + 1 AS entry_id, 'token_time' AS matched_by,
    CASE WHEN id % 2 = 0 THEN 'earlier' ELSE '' END AS matched_note FROM logs WHERE channel_id = 3),
asked AS (
  SELECT l.id AS log_id, coalesce(l.token_id, 0) AS token_id, coalesce(right(t.key, 8), '') AS tail, model_name AS model,
    l.created_at, request_id,
    CASE WHEN use_time > 0 AND use_time < 86400 THEN l.created_at - use_time ELSE l.created_at END AS centre
  FROM logs l LEFT JOIN tokens t ON t.id = l.token_id),
near AS (
  SELECT a.log_id, a.centre, e.*, CASE WHEN a.model = '' OR a.model = e.model THEN 0 ELSE 1 END AS mismatch,
    a.created_at AS log_at
  FROM asked a JOIN entries e ON e.has_timestamp AND abs(e.created_at - a.centre) <= 3600
    AND (e.token_id = a.token_id OR (e.token_id = 0 AND a.tail <> '' AND e.key_tail = a.tail))
  WHERE a.token_id > 0),
timed AS (
  SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY mismatch, abs(created_at - centre), abs(created_at - log_at),
    id DESC) AS rank FROM near),
requested AS (
  SELECT a.log_id, e.*, row_number() OVER (PARTITION BY a.log_id ORDER BY e.id DESC) AS rank
  FROM asked a JOIN entries e ON e.request_id = a.request_id WHERE a.request_id <> ''),
scopes AS (SELECT DISTINCT token_id, tail, model FROM asked WHERE token_id > 0),
scope_hits AS (
  SELECT s.token_id AS scope_token, s.tail AS scope_tail, s.model AS scope_model, e.*,
    row_number() OVER (PARTITION BY s.token_id, s.tail, s.model
      ORDER BY CASE WHEN s.model = '' OR s.model = e.model THEN 0 ELSE 1 END, e.id DESC) AS rank
  FROM scopes s JOIN entries e
    ON e.token_id = s.token_id OR (e.token_id = 0 AND s.tail <> '' AND e.key_tail = s.tail)),
latest AS (
  SELECT a.log_id, h.* FROM asked a JOIN scope_hits h
    ON h.scope_token = a.token_id AND h.scope_tail = a.tail AND h.scope_model = a.model WHERE h.rank <= 3),
cached AS (
  SELECT s.log_id, e.*, s.matched_by, CASE WHEN matched_note = '' THEN 'cached match' ELSE 'cached match; ' || matched_note END
    AS matched_note FROM stored s JOIN entries e ON e.id = s.entry_id)
"""
NOTE = (
    "'same token within +/- 3600s around estimated request start ' || centre || '; model match is ranked first'"
)
HIT = "id AS entry_id, created_at AS entry_created_at, client_name"
TIERED = f""",
tiers AS (
  SELECT log_id, 1 AS tier, 1 AS rank, matched_by, matched_note, {HIT} FROM cached
  UNION ALL SELECT log_id, 2, rank, 'token_time', {NOTE}, id, created_at, client_name FROM timed WHERE rank <= 3
  UNION ALL SELECT log_id, 3, rank, 'request_id', 'exact request_id match', id, created_at, client_name
    FROM requested WHERE rank <= 3
  UNION ALL SELECT log_id, 4, rank, 'token_latest', 'audit log has no usable timestamp match; newest same-token candidates are shown with model match ranked first',
    id, created_at, client_name FROM latest),
chosen AS (SELECT * FROM tiers QUALIFY tier = min(tier) OVER (PARTITION BY log_id))
"""

# What every shape of raw line should parse to, written from the shapes and not from the lines.
LINES = r""",
asked_turns AS (
  SELECT conv_id * 100 + turn + 1 AS line_no, conv_id, turn, text, 1700000000 + conv_id * 7 + turn * 60 AS sent,
    cast((conv_id + turn // 2) % 8 AS INTEGER) AS shape, conv_id % 5 + 1 AS token_id FROM conversations
  WHERE role = 'user'),
lines AS (
  SELECT a.*, t.key, t.name, (shape < 5 OR shape = 7) AS is_entry FROM asked_turns a LEFT JOIN tokens t ON t.id = a.token_id)
"""
WS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160) || chr(8232) || chr(12288)"
KEY = """CASE shape WHEN 0 THEN 'sk-' || key WHEN 1 THEN key WHEN 2 THEN 'sk-' || key
  WHEN 4 THEN 'unknown-' || line_no ELSE '' END"""
MESSAGE_ROWS = f""",
spoken AS (
  SELECT l.line_no, cast(row_number() OVER (PARTITION BY l.line_no ORDER BY c.turn) - 1 AS INTEGER) AS position,
    c.role, trim(c.text, {WS}) AS content
  FROM lines l JOIN conversations c ON c.conv_id = l.conv_id AND c.turn <= l.turn WHERE shape IN (0, 1, 2))
"""


def safe(text: str) -> str:
    """JSON text of a value with the escapes of canonical JSON."""
    escaped = f"cast(to_json({text}) AS VARCHAR)"
    for character, code in (("<", "003c"), (">", "003e"), ("&", "0026")):
        escaped = f"replace({escaped}, '{character}', '\\u{code}')"
    return escaped


BODIES = f""",
bodies AS (
  SELECT l.line_no,
    string_agg('{{"content":' || {safe('c.text')} || ',"role":' || {safe('c.role')} || '}}', ',' ORDER BY c.turn) AS chat,
    string_agg('{{"content":[{{"text":' || {safe('c.text')} || ',"type":"input_text"}}],"role":' || {safe('c.role')} || '}}', ','
      ORDER BY c.turn) AS spoken,
    string_agg('{{"parts":[{{"text":' || {safe('c.text')} || '}}],"role":' || {safe('c.role')} || '}}', ',' ORDER BY c.turn) AS parts
  FROM lines l JOIN conversations c ON c.conv_id = l.conv_id AND c.turn <= l.turn GROUP BY 1)
"""

ORACLE = {
    "canonical_json": f"""WITH {USAGE}{LINES}{BODIES} SELECT line_no, CASE shape
        WHEN 0 THEN '{{"messages":[' || chat || '],"model":"gpt-4o"}}'
        WHEN 1 THEN '{{"input":[' || spoken || '],"model":" claude-3 "}}'
        WHEN 2 THEN '{{"contents":[' || parts || ']}}' WHEN 3 THEN '{{"prompt":' || {safe('text')} || '}}'
        WHEN 4 THEN '{{"messages":[],"system":" S\\n"}}' ELSE 'not json <b>' END AS body
        FROM lines JOIN bodies USING (line_no) WHERE is_entry""",
    "parse_audit": f"""WITH {USAGE}{LINES} SELECT line_no,
        CASE WHEN shape = 7 THEN 0 ELSE sent END AS created_at, shape <> 7 AS has_timestamp,
        CASE shape WHEN 0 THEN 'POST' WHEN 1 THEN 'POST' WHEN 3 THEN 'GET' ELSE '' END AS method,
        CASE shape WHEN 0 THEN '/v1/chat/completions' WHEN 1 THEN '/v1/responses'
          WHEN 2 THEN '/v1beta/x?alt=1&key=sk%2D' || key || '#top' ELSE '' END AS request_path,
        CASE shape WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'claude-3' ELSE '' END AS model,
        CASE shape WHEN 0 THEN 'a,' || line_no WHEN 2 THEN 'req-' || line_no WHEN 3 THEN 't' || line_no ELSE '' END
          AS request_id,
        CASE shape WHEN 0 THEN 'codex-tui/0.98.4 (Linux 6.8.1; x86_64)'
          WHEN 1 THEN 'claude-cli/1.7.33 (external, cli, agent-sdk/0.4.8)'
          WHEN 4 THEN 'Mozilla Claude-VSCode CLAUDE-CLI/1.0;x' ELSE '' END AS user_agent
        FROM lines WHERE is_entry""",
    "parse_timestamp": f"""WITH {USAGE}{LINES} SELECT line_no, CASE WHEN shape = 7 THEN 0 ELSE sent END AS created_at,
        shape <> 7 AS has_timestamp FROM lines WHERE is_entry""",
    "parse_api_key": f"WITH {USAGE}{LINES} SELECT line_no, {KEY} AS api_key FROM lines WHERE is_entry",
    "parse_client": f"""WITH {USAGE}{LINES} SELECT line_no,
        CASE shape WHEN 0 THEN 'codex' WHEN 1 THEN 'claude' WHEN 4 THEN 'claude' ELSE 'unknown' END AS client_name,
        CASE shape WHEN 0 THEN '0.98.4' WHEN 1 THEN '1.7.33' WHEN 4 THEN '1.0' ELSE '' END AS client_version,
        CASE shape WHEN 0 THEN 'tui' WHEN 1 THEN 'cli-agent' WHEN 4 THEN 'vscode' ELSE '' END AS client_variant
        FROM lines WHERE is_entry""",
    "parse_headers": f"""WITH {USAGE}{LINES}
        SELECT line_no, 'authorization' AS name, 'Bearer sk-' || key AS text FROM lines WHERE shape = 0
        UNION ALL SELECT line_no, 'x-request-id', 'a,' || line_no FROM lines WHERE shape = 0
        UNION ALL SELECT line_no, 'user-agent', 'claude-cli/1.7.33 (external, cli, agent-sdk/0.4.8)' FROM lines
          WHERE shape = 1
        UNION ALL SELECT line_no, 'x-api-key', key FROM lines WHERE shape = 1
        UNION ALL SELECT line_no, 'x-api-key', '[REDACTED]' FROM lines WHERE shape = 2
        UNION ALL SELECT line_no, 'authorization', '***' FROM lines WHERE shape = 4
        UNION ALL SELECT line_no, 'api-key', 'unknown-' || line_no FROM lines WHERE shape = 4
        UNION ALL SELECT line_no, 'user-agent', 'Mozilla Claude-VSCode CLAUDE-CLI/1.0;x' FROM lines WHERE shape = 4""",
    "normalize_messages": f"""WITH {USAGE}{LINES}{MESSAGE_ROWS} SELECT * FROM spoken
        UNION ALL SELECT line_no, 0, 'user', trim(text, {WS}) FROM lines WHERE shape = 3
        UNION ALL SELECT line_no, 0, 'system', 'S' FROM lines WHERE shape = 4""",
    "content_text": f"""SELECT doc_id, 'message' AS role, sha256(CASE WHEN doc_id % 2 = 0 THEN trim(text, {WS}) ELSE
        'first' || chr(10) || trim(text, {WS}) || chr(10) || '[image] {{"url":"u"}}' || chr(10) || '3' END) AS digest
        FROM documents""",
    "decode_body": "SELECT doc_id, sha256(text) AS digest FROM documents",
    "resolve_key": f"""WITH {USAGE}{LINES} SELECT line_no, CASE WHEN shape IN (0, 1, 2) THEN token_id ELSE 0 END
          AS token_id, CASE WHEN shape IN (0, 1, 2) THEN name ELSE '' END AS token_name, right({KEY}, 8) AS key_tail
        FROM lines WHERE is_entry""",
    "ingest_stats": f"""WITH {USAGE}{LINES}
        SELECT 'requests-' || line_no % 3 || '.jsonl' AS path, count(*) AS processed_lines,
          count(*) FILTER (is_entry) AS entry_lines, count(*) FILTER (shape = 5) AS blank_lines,
          count(*) FILTER (shape = 6) AS invalid_lines FROM lines GROUP BY 1""",
    "ingest_dedup": f"WITH {USAGE}{ENTRIES} SELECT source_id, source_line, created_at FROM entries WHERE source_id <> 'src-0'",
    "entry_by_id": f"""WITH {USAGE}{ENTRIES} SELECT id, source_id, source_line, model, token_id, key_tail, request_id
        FROM entries WHERE id = 71""",
    "match_token_time": f"""WITH {USAGE}{ENTRIES} SELECT log_id, 'token_time' AS matched_by, {NOTE} AS matched_note, rank, {HIT}
        FROM timed WHERE rank = 1""",
    "match_token_time_topn": f"""WITH {USAGE}{ENTRIES} SELECT log_id, 'token_time' AS matched_by, {NOTE} AS matched_note,
        rank, {HIT} FROM timed WHERE rank <= 5""",
    "match_request_id": f"WITH {USAGE}{ENTRIES} SELECT log_id, rank, {HIT} FROM requested WHERE rank <= 3",
    "match_latest": f"WITH {USAGE}{ENTRIES} SELECT log_id, rank, {HIT} FROM latest",
    "match_stored": f"WITH {USAGE}{ENTRIES} SELECT log_id, matched_by, matched_note, 1 AS rank, {HIT} FROM cached",
    "match_tiered": f"WITH {USAGE}{ENTRIES}{TIERED} SELECT * EXCLUDE (tier) FROM chosen",
    "match_sticky": f"""WITH {USAGE}{ENTRIES}{TIERED} SELECT log_id, entry_id AS audit_entry_id, matched_by, matched_note,
        cast(1800000000 AS BIGINT) AS matched_at FROM chosen WHERE rank = 1 AND tier IN (2, 3)""",
    "logs_with_client": f"""WITH {VIEW}{ENTRIES},
        page AS (SELECT id, key_name FROM log_view WHERE type IN (2, 5) ORDER BY id DESC LIMIT 500),
        hit AS (SELECT log_id, 1 AS tier, client_name, client_version, client_variant, user_agent FROM cached
          UNION ALL SELECT log_id, 2, client_name, client_version, client_variant, user_agent FROM timed WHERE rank = 1)
        SELECT p.id, key_name, coalesce(client_name, '') AS client_name, coalesce(client_version, '') AS client_version,
          coalesce(client_variant, '') AS client_variant, coalesce(user_agent, '') AS user_agent
        FROM page p LEFT JOIN (SELECT * FROM hit QUALIFY tier = min(tier) OVER (PARTITION BY log_id)) h ON h.log_id = p.id""",
    "log_audit_messages": f"""WITH {USAGE}{ENTRIES}{TIERED.replace('<= 3', '<= 10')} SELECT log_id, rank, entry_id AS id, position, role,
        CASE position WHEN 0 THEN 'be brief' ELSE 'ask ' || source_line END AS content
        FROM chosen JOIN entries ON entries.id = entry_id, (VALUES (0, 'system'), (1, 'message')) m(position, role) WHERE log_id = 2""",
    "log_audit": f"""WITH {USAGE}{ENTRIES}{TIERED.replace('<= 3', '<= 10')} SELECT log_id, rank, matched_by, matched_note,
        entry_id AS id, model, source_path, source_line FROM chosen JOIN entries ON entries.id = entry_id
        WHERE log_id = 2""",
}
