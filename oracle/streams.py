"""Oracles of the queries that read files or run streams."""

from .audit import ENTRIES, LINES, MESSAGE_ROWS, NOTE
from .base import USAGE
from .review import RUN

SUMMARY = f"""WITH {USAGE}{LINES}, r AS (SELECT
    CASE shape WHEN 5 THEN 'blank' WHEN 6 THEN 'invalid' ELSE 'entry' END AS line_state,
    CASE shape WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'claude-3' ELSE '' END AS model,
    CASE shape WHEN 0 THEN 'codex' WHEN 1 THEN 'claude' WHEN 4 THEN 'claude' ELSE 'unknown' END AS client_name,
    shape < 5 AS has_timestamp FROM lines)
  SELECT line_state, model, client_name, has_timestamp, count(*) AS line_count, count(*) AS distinct_lines
  FROM r GROUP BY ALL"""

ORACLE = {
    "scan_audit_jsonl": SUMMARY,
    "stream_tail_jsonl": SUMMARY,
    "stream_ingest": f"""WITH {USAGE}{LINES}{MESSAGE_ROWS}, r AS (SELECT
          CASE WHEN shape IN (0, 1, 2) THEN token_id ELSE 0 END AS token_id,
          CASE shape WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'claude-3' ELSE '' END AS model,
          CASE shape WHEN 0 THEN 'tui' WHEN 1 THEN 'cli-agent' WHEN 4 THEN 'vscode' ELSE '' END AS client_variant,
          CASE WHEN shape IN (3, 4) THEN 1 ELSE (SELECT count(*) FROM spoken s WHERE s.line_no = l.line_no) END AS n
          FROM lines l WHERE is_entry)
        SELECT token_id, model, client_variant, count(*) AS entry_count, count(*) AS ids, cast(sum(n) AS BIGINT) AS message_count
        FROM r GROUP BY ALL""",
    "audit_status": f"""WITH {USAGE}{LINES} SELECT count(DISTINCT line_no % 3) + max(CASE WHEN shape = 6 THEN 1 ELSE 0 END) AS tracked_files,
        count(*) FILTER (is_entry) AS indexed_rows, max(CASE WHEN NOT is_entry OR shape = 7 THEN 0 ELSE sent END) AS last_created_at,
        cast(1700100000 AS BIGINT) AS last_ingested_at FROM lines""",
    # Steps of 3,000 lines over three files in order, an idle scan, and the same lines once more.
    "ingest_scans": """WITH l AS (
          SELECT event_id % 3 AS f, row_number() OVER (ORDER BY event_id % 3, event_id) - 1 AS n, event_id % 11 = 0 AS blank,
            event_id % 11 <> 0 AND event_id % 13 = 0 AS invalid,
            CASE WHEN event_id % 11 = 0 THEN 0 WHEN event_id % 13 = 0 THEN 7 ELSE 30 + length(CAST(event_id AS VARCHAR)) END + 1 AS bytes
          FROM events
        ), files AS (
          SELECT f, f = 1 AS unfinished, min(n) AS low, max(n) + 1 AS high FROM l GROUP BY f
        ), steps AS (
          SELECT CAST(n // 3000 AS BIGINT) AS step, count(*) AS processed_lines, count(*) FILTER (NOT blank AND NOT invalid) AS inserted_entries,
            count(*) FILTER (blank) AS blank_lines, count(*) FILTER (invalid) AS invalid_lines, CAST(sum(bytes) AS BIGINT) AS bytes_read
          FROM l GROUP BY 1
        ), met AS (
          SELECT step, (SELECT count(*) FROM files) AS matched_files, (SELECT count(*) FROM files WHERE low < 3000 * (step + 1)) AS scanned_files,
            (SELECT count(*) FROM files WHERE NOT unfinished AND high <= 3000 * step) AS unchanged_files,
            (SELECT count(*) FROM files WHERE unfinished AND high < 3000 * (step + 1)) AS unfinished_lines,
            processed_lines, inserted_entries, blank_lines, invalid_lines, bytes_read FROM steps
        )
        SELECT *, scanned_files < matched_files AS line_limit_hit, true AS timed FROM met
        UNION ALL SELECT max(step) + 1, max(matched_files), max(matched_files), max(matched_files) - 1, 1, 0, 0, 0, 0, 0, false, true FROM met
        UNION ALL SELECT max(step) + 2, 0, 0, 0, 0, CAST(sum(processed_lines) AS BIGINT), 0, CAST(sum(blank_lines) AS BIGINT),
          CAST(sum(invalid_lines) AS BIGINT), CAST(sum(bytes_read) AS BIGINT), false, true FROM met""",
    "stream_match": f"""WITH {USAGE}{ENTRIES} SELECT log_id, id AS audit_entry_id, 'token_time' AS matched_by,
        {NOTE} AS matched_note FROM timed WHERE rank = 1""",
    "stream_review": f"""{RUN} SELECT audit_entry_id, parent_entry_id, delta_decision, effective_decision,
        effective_risk_score, inherited, status FROM final""",
}
